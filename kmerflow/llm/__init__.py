"""Operations of a training-data pipeline: one module per operator, ``queries`` with the registered queries.

Nothing outside this subpackage imports it.
"""
