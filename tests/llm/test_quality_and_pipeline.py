"""Quality classifier: held-out accuracy; pipeline: every stage's decisions."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kmerflow.llm import quality, queries, secrets, token_tree

from .test_similarity import brute_groups

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    rows = queries.op10_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    held = rows.join(labels, "doc_id").where("held_out").collect()
    assert len(held) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.97
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows.where("score < 0 or score > 1 or score is null").count() == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x " * 90_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.predictions(docs, none).collect()
    assert len(rows) == 4 and all(abs(r["score"] - 0.5) < 0.1 for r in rows)
    assert quality.predictions(docs.limit(0), none).count() == 0


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    model = quality.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    at, x = np.array([1, 5, 7, 30]), np.array([0.5, 1.0, 2.0, 0.25])
    pairs = sum(model.v[a] @ model.v[b] * x[i] * x[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
    assert np.isclose(model.raw(at, x), 0.3 + model.w[at] @ x + pairs)


def test_repeated_ids_are_fitted_once(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k} of some words here") for k in range(4000)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    picked = quality.sample(docs, labels).collect()
    assert len({r["doc_id"] for r in picked}) == len(picked) < 40
    assert all(r["text"] == min(f"text {k} of some words here" for k in range(r["doc_id"], 4000, 40)) for r in picked)


ODD = [(10_001, None, "en", "src1", None), (10_002, "", "en", "src1", 0), (None, "no id here, but some words", "en", "src1", 26), (10_003, "word " * 60_000, "de", "src1", 300_000), (10_004, "same words stand here twice", "en", "src1", 27), (10_004, "same words stand here twice", "en", "src1", 27)]


def pipeline_docs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(t).alias(c) for c, t in docs.dtypes])
    return docs.unionByName(odd).withColumn("score", F.lit("x")).withColumn("node", F.lit(1))


def plain(rows):
    return sorted(map(str, rows))


def test_pipeline_stages_equal_brute_force(spark):
    """Every stage on all that the one before kept, with null, empty, long and repeated rows and clashing columns."""
    stage, docs = dict(corpus_pipeline.STAGES), pipeline_docs(spark)
    columns = docs.columns

    kept = stage["quality"](spark, docs, SMALL)
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = [r for r in docs.collect() if model.score(*quality.features(r["text"] or "")) >= quality.ACCEPT]
    assert kept.columns == columns and plain(kept.collect()) == plain(want)

    every = spark.createDataFrame(docs.collect(), docs.schema)
    single = stage["near_duplicates"](spark, every, SMALL)
    groups = {}
    for i, _, c in brute_groups([(r["doc_id"], r["text"]) for r in every.collect()]):
        groups.setdefault(i, set()).add(c)
    got = [r["doc_id"] for r in single.collect()]
    assert single.columns == columns and got.count(None) == 1
    assert sorted(i for i in got if i is not None) == sorted({c for i, own in groups.items() if i is not None for c in own})

    clean = stage["secrets"](spark, every, SMALL)
    changed = [r.asDict() | ({"text": secrets.redact(r["text"]), "n_chars": len(secrets.redact(r["text"]))} if r["text"] and secrets.redact(r["text"]) != r["text"] else {}) for r in every.collect()]
    assert clean.columns == columns and plain(r.asDict() for r in clean.collect()) == plain(changed)
    assert any(a["text"] != b["text"] for a, b in zip(changed, every.collect(), strict=True))

    rows = stage["packing"](spark, every, SMALL).collect()
    lengths, used = {}, {}
    for r in rows:
        lengths.setdefault(str(r["doc_id"]), []).append(r["length"])
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    count = token_tree.Counter(queries.RANKS, queries.PATTERN)
    want = {}
    for r in every.collect():
        want[str(r["doc_id"])] = want.get(str(r["doc_id"]), 0) + 1 + (token_tree.TokenTree(r["text"], count).n_tokens if r["text"] else 0)
    assert {i: sum(x) for i, x in lengths.items()} == want
    for places in used.values():
        ends = [0]
        for offset, length in sorted(places):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024


def test_pipeline_runs_from_start_to_end(spark):
    out = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}


def test_empty_table_goes_through_every_stage(spark):
    docs = pipeline_docs(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0, name
