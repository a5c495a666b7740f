"""Fingerprints and quality scores of tables whose further columns bear the names that the operators use."""

from kmerflow.llm import quality, syncmers

EXTRA = ", fingerprint string, near_next int, score string, features int, held_out string, predicted string, n_chars string, label int"


def wide(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, "s", 2, "h", "p", "n", 3) for r in rows], "doc_id long, text string" + EXTRA)


ROWS = [(1, "the quick brown fox jumps over the lazy dog " * 4), (2, None), (3, ""), (4, "the quick brown fox jumps over the lazy dog " * 4), (4, "other words"), (None, "x y z")]


def test_fingerprints(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string")
    got, want = (sorted(map(tuple, syncmers.compare_with_next(df).collect()), key=str) for df in (wide(spark, ROWS), plain))
    assert got == want and len(got) == len(ROWS)
    assert syncmers.compare_with_next(wide(spark, [])).count() == 0


def test_quality(spark):
    docs = [(k, ("good words in a row. " if k % 2 else "@@ 11 ## ") * (k % 5 + 1)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0, "t") for k in range(60)], "doc_id long, quality int, toxic int, text string")
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    got, want = (sorted(map(tuple, quality.predictions(df, labels).collect()), key=str) for df in (wide(spark, docs), plain))
    assert got == want and len(got) == 60
    assert quality.predictions(wide(spark, []), labels).count() == 0
