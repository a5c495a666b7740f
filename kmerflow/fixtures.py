"""Views over the shared test tables that play the roles of sequences, classes, taxonomies and predictions.

Each is SQL that Spark and DuckDB both accept; queries read them through ``view``, oracles inline them as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "seqs": "SELECT doc_id AS id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS sequence, source, lang FROM documents",
    "letters": """SELECT doc_id AS id, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,',
        'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTACGTA') AS sequence, source AS species FROM documents""",
    "classes": """SELECT doc_id AS id, source AS species,
        concat('genus', CAST(CAST(substr(source, 4) AS INT) % 10 AS STRING)) AS genus,
        concat('family', CAST(CAST(substr(source, 4) AS INT) % 5 AS STRING)) AS family,
        CASE WHEN CAST(substr(source, 4) AS INT) % 5 = 0 THEN 'Archaea' ELSE 'Bacteria' END AS domain FROM documents""",
    "dna": """SELECT doc_id AS id, translate(concat(
        md5(concat(source, '-0')), md5(concat(source, '-1')), md5(concat(source, '-2')), md5(concat(source, '-3')),
        md5(concat(CAST(doc_id AS STRING), '-0')), md5(concat(CAST(doc_id AS STRING), '-1')),
        md5(concat(CAST(doc_id AS STRING), '-2')), md5(concat(CAST(doc_id AS STRING), '-3'))),
        '0123456789abcdef', 'ACGTACGTACGTACGT') AS sequence, source AS species FROM documents""",
    "host_dna": """SELECT 1000000 + item_id AS id, translate(concat(md5(concat('host-', CAST(item_id % 3 AS STRING))), md5(concat('h-', CAST(item_id AS STRING)))),
        '0123456789abcdef', 'AACCGGTTAACCGGTT') AS sequence, 'host' AS domain FROM benchmark""",
    "reads": "SELECT concat('G', CAST(d.doc_id AS STRING), '_', CAST(m.n_nationkey AS STRING), '/1') AS read_id, d.doc_id AS genome FROM documents d JOIN nation m ON m.n_nationkey < 3",
    "pair_r1": "SELECT doc_id AS read_no, concat('r', CAST(doc_id AS STRING), '/1') AS id, substr(md5(concat('a', CAST(doc_id AS STRING))), 1, 20) AS sequence FROM documents",
    "pair_r2": "SELECT doc_id AS read_no, concat('r', CAST(doc_id AS STRING), '/2') AS id, substr(md5(concat('b', CAST(doc_id AS STRING))), 1, 20) AS sequence FROM documents",
    "taxonomy": """SELECT 1 AS id, 0 AS depth, 1 AS parent, 'no rank' AS rank, 'root' AS name
        UNION ALL SELECT 10 + r_regionkey, 1, 1, 'region', r_name FROM region
        UNION ALL SELECT 100 + n_nationkey, 2, 10 + n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN 'no rank' ELSE 'nation' END, n_name FROM nation
        UNION ALL SELECT CAST(1000 + s_suppkey AS INT), 3, 100 + s_nationkey, 'supplier', s_name FROM supplier""",
    "hits": "SELECT l_orderkey AS query, CAST(1000 + l_suppkey AS INT) AS taxon, l_linenumber AS pos, CAST(l_quantity AS DOUBLE) AS score, CAST(l_discount AS DOUBLE) AS evalue FROM lineitem",
    "lineages": """SELECT s.s_suppkey AS id, CAST(s.s_acctbal AS DOUBLE) AS magnitude, r.r_name AS level1, n.n_name AS level2,
        CASE WHEN s.s_suppkey % 7 = 0 THEN '' ELSE s.s_name END AS level3
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "ec_numbers": """SELECT p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS magnitude,
        CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat(CAST(p_size % 6 + 1 AS STRING), '.', CAST(p_partkey % 4 + 1 AS STRING), '.', CAST(p_partkey % 3 + 1 AS STRING)) END AS ec FROM part""",
    "member_probs": """SELECT user_id AS id, event_id % 3 AS member, event_type AS label,
        sum(value) / sum(sum(value)) OVER (PARTITION BY user_id, event_id % 3) AS p FROM events GROUP BY user_id, event_id % 3, event_type""",
    "predictions": """SELECT l.doc_id AS id, CASE WHEN l.quality = 1 THEN 'Bacteria' ELSE 'host' END AS y_true,
        CASE WHEN l.doc_id % 10 = 0 THEN 'Unknown' WHEN l.toxic = 1 THEN 'host' ELSE 'Bacteria' END AS y_pred FROM labels l""",
    "ranked": """SELECT l.doc_id AS id, 'domain' AS rank, CASE WHEN l.doc_id % 10 = 0 THEN 'Unknown' WHEN l.toxic = 1 THEN 'host' ELSE 'Bacteria' END AS label FROM labels l
        UNION ALL SELECT d.doc_id, 'genus', CASE WHEN d.doc_id % 7 = 0 THEN 'Unknown' ELSE concat('genus', CAST(CAST(substr(d.source, 4) AS INT) % 10 AS STRING)) END
        FROM documents d JOIN labels m ON d.doc_id = m.doc_id WHERE d.doc_id % 10 <> 0 AND m.toxic = 0""",
}

_TABLE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables of ``sf_dir``."""
    return spark.sql(_TABLE.sub(lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", VIEWS[name]))


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the views inlined in front."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {ctes}, {sql.lstrip()[5:]}"
