"""Goldens, properties and partition invariance of the core operators."""

import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerflow import sources
from kmerflow.functions import accession, canonical_domain, kmers, lineage_path, one_class_truth
from kmerflow.operators import classify, counting, decompose, profile, report, select, stats, taxonomy, transform
from kmerflow.plans import classify_metagenome, extract_profile
from kmerflow.streaming import stream_kmer_counts

SEQS = [("a", "ACGTACGTAC"), ("b", "acgtnacgt"), ("c", "ACG"), ("d", ""), ("e", None)]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(SEQS, "id string, sequence string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_last_window_is_left_out(seqs):
    got = {r["id"]: r["k"] for r in seqs.select("id", kmers(F.col("sequence"), 3).alias("k")).collect()}
    assert got["c"] == [] and got["d"] == [] and got["e"] is None
    assert len(got["a"]) == 7
    assert [r["k"] for r in seqs.where("id = 'c'").select(kmers("sequence", 3, include_last=True).alias("k")).collect()] == [["ACG"]]


def test_counts_within_alphabet(seqs):
    long = counting.count_profile(seqs, 3)
    assert {r["id"] for r in long.collect()} == {"a", "b"}
    assert long.where("kmer like '%N%'").count() == 0
    assert counting.count_profile(seqs, 3, alphabet=None).agg(F.sum("value")).first()[0] == 7 + 6


def test_chunks_do_not_change_counts(seqs, monkeypatch):
    want = rows(counting.count_profile(seqs, 3))
    monkeypatch.setattr(counting, "CHUNK", 4)
    assert rows(counting.count_profile(seqs, 3)) == want


@pytest.mark.parametrize("n", [1, 3, 16])
def test_partitions_do_not_matter(spark, n):
    made = [(i, "".join(np.random.default_rng(i).choice(list("ACGT"), 60))) for i in range(20)]
    df = spark.createDataFrame(made, "id long, sequence string").repartition(n)
    long, vocab = extract_profile(df, 3)
    base = spark.createDataFrame(made, "id long, sequence string").coalesce(1)
    long1, vocab1 = extract_profile(base, 3)
    assert rows(long) == rows(long1) and rows(vocab) == rows(vocab1)
    weigh = lambda d: [(i, k, round(v, 9)) for i, k, v in rows(transform.TfIdf.fit(d, 20).transform(d).select("id", "kmer", "value"))]
    assert weigh(long) == weigh(long1)


def test_tf_idf_rows_have_length_one(seqs):
    long = counting.count_profile(seqs, 3)
    w = transform.TfIdf.fit(long, 5).transform(long)
    for r in w.groupBy("id").agg(F.sum(F.col("value") ** 2).alias("s")).collect():
        assert abs(r["s"] - 1) < 1e-9


def test_scalers(spark):
    long = spark.createDataFrame([(1, "x", 2.0), (2, "x", 4.0), (1, "y", 3.0), (2, "y", 3.0), (1, "z", 5.0)], "id long, kmer string, value double")
    got = {(r["id"], r["kmer"]): r["value"] for r in transform.MinMax.fit(long, 2).transform(long).collect()}
    assert got[1, "x"] == 0 and got[2, "x"] == 1 and got[1, "y"] == 0 and got[1, "z"] == 1
    got = {(r["id"], r["kmer"]): r["value"] for r in transform.MaxAbs.fit(long, 2).transform(long).collect()}
    assert got[1, "x"] == 0.5 and got[1, "z"] == 1


def test_power_is_standard(spark):
    x = np.random.default_rng(1).exponential(size=300)
    dense = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(x)], "id long, feature_idx int, value double")
    model = transform.Power.fit(dense, rounds=2)
    y = np.array([r["value"] for r in model.transform(dense).collect()])
    assert abs(y.mean()) < 1e-6 and abs(y.std() - 1) < 1e-6
    assert -1.2 < model.fitted.first()["lam"] < 0.8


def test_selection_never_leaves_nothing(spark):
    long = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0)], "id long, kmer string, value double")
    assert rows(select.by_occurrence(long, 2, 1.0)) == [("x",)]
    assert rows(select.by_variance(long, 2)) == [("x",)]


def test_occurrence_is_strict(spark):
    long = spark.createDataFrame([(i, "often", 1.0) for i in range(10)] + [(i, "half", 1.0) for i in range(5)] + [(1, "rare", 1.0)], "id long, kmer string, value double")
    assert rows(select.by_occurrence(long, 10, 0.5)) == [("rare",)]
    assert rows(select.by_occurrence(long, 10, 0.4, low=0.2)) == [("half",)]


def test_chi_square_in_batches(spark):
    long = spark.createDataFrame([(i, "x", float(i % 2 + 1)) for i in range(40)], "id long, kmer string, value double")
    classes = spark.createDataFrame([(i, str(i % 2)) for i in range(40)], "id long, label string")
    assert abs(stats.chi_square(long, classes).first()["chi"] - ((20 - 30) ** 2 / 30 + (40 - 30) ** 2 / 30)) < 1e-9
    assert stats.chi_square(long, classes, batches=4).count() == 1


def test_labels(spark):
    df = spark.createDataFrame([("archaea",), ("Archaea",), ("Bacteria",), (None,), ("bact",)], "d string")
    assert [r[0] for r in df.select(canonical_domain("d")).collect()] == ["Bacteria", "Bacteria", "Bacteria", None, "bact"]
    assert [r[0] for r in df.select(one_class_truth("d")).collect()] == ["Unknown", "Unknown", "Bacteria", "Unknown", "bact"]
    one = spark.createDataFrame([(">gi|1|ref|NC_7.2| x",), (">ctg9.1 y",), ("z",)], "s string")
    assert [r[0] for r in one.select(accession("s")).collect()] == ["NC_7", "ctg9", "z"]
    text = spark.createDataFrame([("a\t\tb",), ("# no",)], "s string")
    assert [r[0] for r in text.select(lineage_path("s")).collect()] == [["a", "b"], None]


def test_ranks():
    ranks = ["species", "genus", "domain"]
    assert profile.resolve_ranks(None, ranks) == ["domain", "genus", "species"]
    assert profile.resolve_ranks(["species", "domain"], ranks) == ["domain", "species"]
    with pytest.raises(ValueError):
        profile.resolve_ranks("order", ranks)
    assert profile.before_rank(["domain", "genus", "species"], "species") == ["domain", "genus"]


def test_zip_raises_on_unequal_counts(spark):
    with pytest.raises(ValueError):
        profile.zip_rows(spark.range(3), spark.range(4).withColumnRenamed("id", "y"), ["id"], ["y"])
    with pytest.raises(ValueError):
        profile.assert_same_k(spark.createDataFrame([("ACG",)], "kmer string"), spark.createDataFrame([("ACGT",)], "kmer string"))


def test_last_match_wins(spark):
    reads = spark.createDataFrame([("G12_0/1",), ("zz",)], "read_id string")
    classes = spark.createDataFrame([("G1", 1, "one"), ("G12", 2, "twelve"), (".12", 3, "dot")], "id string, pos int, species string")
    assert rows(profile.reads_to_genomes(reads, classes, by_prefix=False).where("species is not null")) == [("G12_0/1", "twelve")]
    assert profile.reads_to_genomes(reads, classes).where("species is null").count() == 1


NODES = [(1, 0, 1, "no rank", "root"), (2, 1, 1, "domain", "A"), (3, 2, 2, "no rank", "B"), (4, 3, 3, "species", "C"), (5, 3, 3, "species", "D"), (6, 1, 1, "domain", "E")]


def test_lowest_common_ancestor(spark):
    nodes = spark.createDataFrame(NODES, "id int, depth int, parent int, rank string, name string")
    reach = taxonomy.tour(nodes)
    hits = spark.createDataFrame([("q", 4, 1, 9.0), ("q", 5, 2, 8.5), ("r", 4, 1, 9.0), ("r", 6, 2, 9.0), ("s", 4, 1, 9.0), ("t", 99, 1, 3.0)], "query string, taxon int, pos int, score double")
    got = {r["query"]: (r["taxon"], r["score"]) for r in taxonomy.lca(taxonomy.best_hits(hits, 1.0), reach).collect()}
    assert got == {"q": (3, 8.75), "r": (1, 9.0), "s": (4, 9.0), "t": (-1, 3.0)}


def test_roll_up_root_is_the_sum(spark):
    lineages = spark.createDataFrame([(["a", "b"], 2.0), (["a"], 1.0), (["c"], 4.0), ([], 0.5)], "path array<string>, magnitude double")
    got = {tuple(r["path"]): (r["magnitude"], r["count"], r["unassigned"]) for r in taxonomy.roll_up(lineages).collect()}
    assert got[()] == (7.5, 4, 0.5) and got[("a",)] == (3.0, 2, 1.0)
    assert taxonomy.roll_up(lineages, max_depth=1).where("size(path) = 2").count() == 0


def test_no_hits_and_melting(spark):
    nodes = spark.createDataFrame(NODES, "id int, depth int, parent int, rank string, name string")
    hits = spark.createDataFrame([(0, 1.0, 5.0), (4, 1.0, 5.0), (3, 2.0, 1.0), (77, 1.0, 1.0)], "taxon int, magnitude double, score double")
    got = {r["taxon"]: (r["magnitude"], r["unassigned"]) for r in taxonomy.taxon_roll_up(hits, nodes, taxonomy.tour(nodes), no_rank=True).collect()}
    assert got[0] == (1.0, 1.0) and got[1] == (4.0, 1.0) and 3 not in got and got[2] == (3.0, 2.0) and got[4] == (1.0, 1.0)


def test_predictions(spark):
    p = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "a", 0.9)], "id long, label string, p double")
    assert rows(classify.with_threshold(classify.argmax(p), 0.8)) == [(1, "Unknown", 0.5), (2, "a", 0.9)]
    assert [r[0] for r in spark.createDataFrame([(0.9,), (0.09,), (0.5,)], "p double").select(classify.binary_band("p")).collect()] == ["1", "0", "Unknown"]
    assert spark.range(1).select(classify.binary_round(F.lit(0.5))).first()[0] == 0


def test_top_down_stops_when_nothing_is_left(spark):
    data = spark.range(3)
    none = lambda d: d.select("id", F.lit("x").alias("label"), F.lit(0.1).alias("p"))
    out = classify.top_down(data, ["domain", "genus"], {"domain": none, "genus": none})
    assert {r["rank"] for r in out.collect()} == {"domain"}


def test_scores_leave_undefined_classes_out(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "y_true string, y_pred string")
    r = classify.cross_scores(p).first()
    assert abs(r["precision"] - 0.5) < 1e-9 and abs(r["recall"] - 1 / 3) < 1e-9


def test_svd_beats_a_random_projection(spark):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(30, 3)) @ rng.normal(size=(3, 12)))
    long = spark.createDataFrame([(i, f"k{j:02d}", float(x[i, j])) for i in range(30) for j in range(12)], "id long, kmer string, value double")
    vocab = counting.index_vocabulary(long)
    v = np.zeros((3, 12))
    for r in decompose.truncated_svd(long, vocab, 3).collect():
        v[r["component"], int(r["kmer"][1:])] = r["weight"]
    q = np.linalg.qr(rng.normal(size=(12, 3)))[0].T
    error = lambda m: np.linalg.norm(x - x @ m.T @ m)
    assert error(v) <= error(q) and np.allclose(v @ v.T, np.eye(3), atol=1e-6)


@pytest.mark.parametrize("fit", [decompose.nmf, decompose.dictionary])
def test_factors_are_not_negative(spark, fit):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(20, 2)) @ rng.uniform(size=(2, 8))
    long = spark.createDataFrame([(i, f"k{j}", float(x[i, j])) for i in range(20) for j in range(8)], "id long, kmer string, value double")
    h = fit(long, counting.index_vocabulary(long), 2, rounds=2)
    assert h.count() == 16 and h.where("weight < 0").count() == 0
    assert profile.project(long, h).count() == 40


def test_metagenome(spark):
    block = {"A": "ACGGT", "B": "TTTAC"}
    db = spark.createDataFrame([(i, (block["AB"[i % 2]] * 20)) for i in range(6)], "id long, sequence string")
    classes = spark.createDataFrame([(i, f"s{'AB'[i % 2]}", "Bacteria") for i in range(6)], "id long, species string, domain string")
    got = classify_metagenome(db, db, classes, ["domain", "species"], 3)
    assert {(r["id"], r["label"]) for r in got.where("rank = 'species'").collect()} == {(i, f"s{'AB'[i % 2]}") for i in range(6)}


def test_counts_without_domain(spark):
    p = spark.createDataFrame([(1, "genus", "g"), (1, "species", "s"), (2, "genus", "Unknown")], "id long, rank string, label string")
    count = lambda **o: {r["item"]: r["n"] for r in report.read_counts(p, **o).collect()}
    assert count()["classified"] == 1 and count(per_rank_sum=True)["classified"] == 2


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "GCF_1.1_x.fna").write_text(">s1 some text\nacg\nTT\n>s2|x\r\nGG\r\n")
    import bz2
    import gzip

    with gzip.open(tmp_path / "in" / "deep" / "GCF_2.1_y.fna.gz", "wt") as f:
        f.write(">s3\nAC\n")
    with bz2.open(tmp_path / "in" / "z.fna.bz2", "wt") as f:
        f.write(">s4 w\nTT")
    got = sources.read_fasta(spark, str(tmp_path / "in"), recursive=True, with_file=True)
    assert rows(got.select("id", "sequence")) == [("s1", "ACGTT"), ("s2|x", "GG"), ("s3", "AC"), ("s4", "TT")]
    named = sources.build_reference(got, spark.createDataFrame([("GCF_1.1", "Homo sapiens strain", "Homo")], "accession string, species string, genus string"))
    assert {r["species"] for r in named.collect()} == {"Homo_sapiens"}
    assert sources.list_files(spark, str(tmp_path / "in")).count() == 3
    (tmp_path / "r.fq").write_text("@a/1 x\nACGT\n+\nIIII\n@b/1\nTT\n+\n@I\n")
    reads = sources.read_fastq(spark, str(tmp_path / "r.fq"))
    assert rows(reads.select("read_no", "id", "sequence", "quality")) == [(0, "a/1", "ACGT", "IIII"), (1, "b/1", "TT", "@I")]
    (tmp_path / "v.txt").write_text("ACG\nAAA\n")
    with pytest.warns(UserWarning):
        vocab, k = sources.read_vocab(spark, str(tmp_path / "v.txt"), 5)
    assert k == 3 and rows(vocab) == [(0, "ACG"), (1, "AAA")]
    (tmp_path / "l.tsv").write_text("# no\n2\ta\t\tb\n1\tc\n")
    assert sorted((r["magnitude"], r["path"]) for r in sources.read_lineages(spark, str(tmp_path / "l.tsv")).collect()) == [(1.0, ["c"]), (2.0, ["a", "b"])]
    long = counting.count_profile(got, 1)
    vocab = counting.index_vocabulary(long)
    assert sources.save_dataset(spark, str(tmp_path / "d"), long, vocab, {"k": 1}) and not sources.save_dataset(spark, str(tmp_path / "d"), long, vocab, {"k": 2})
    assert sources.load_dataset(spark, str(tmp_path / "d"))[2] == {"k": 1}


def test_stream(spark, tmp_path):
    spark.createDataFrame(SEQS[:2], "id string, sequence string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("id string, sequence string").parquet(str(tmp_path / "s"))
    q = stream_kmer_counts(stream, 3).writeStream.outputMode("complete").format("memory").queryName("kmers_of_stream").start()
    q.processAllAvailable()
    q.stop()
    got = rows(spark.table("kmers_of_stream").select("kmer", "count"))
    assert got == rows(counting.discover_vocabulary(spark.createDataFrame(SEQS[:2], "id string, sequence string"), 3))


def test_entry_without_the_training_operators(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        alone = importlib.reload(__spark_entry__)
        assert alone.llm is None and "kmer_counts" in alone.queries() and not any(k.startswith("op") for k in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_members_keep_every_query(spark):
    from kmerflow.operators import taxonomy

    rows = [(7, q) for q in range(12_345)] + [(8, q) for q in (3, 1, 3)]
    got = taxonomy.members(spark.createDataFrame(rows, "taxon int, query long").repartition(3)).collect()
    by = {t: [r["members"] for r in sorted(got, key=lambda r: r["page"]) if r["taxon"] == t] for t in (7, 8)}
    assert [len(m) for m in by[7]] == [10_000, 2_345] and sum(by[7], []) == list(range(12_345)) and by[8] == [[1, 3]]


def test_power_is_likeliest(spark):
    rng = np.random.default_rng(2)
    own = [rng.exponential(size=200), rng.normal(size=200), 0.02 * rng.exponential(size=200) ** 2, np.ones(200)]

    def score(x, lam):
        with np.errstate(all="ignore"):
            up = np.log1p(np.abs(x)) if abs(lam) < 1e-9 else ((np.abs(x) + 1) ** lam - 1) / lam
            down = -np.log1p(np.abs(x)) if abs(lam - 2) < 1e-9 else -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam)
        return -len(x) / 2 * np.log(np.where(x >= 0, up, down).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    grid = np.arange(-40, 10, 0.002)
    want = [grid[np.argmax([score(x, lam) for lam in grid])] for x in own[:3]]
    assert want[2] < -2.5
    dense = spark.createDataFrame([(k, float(v)) for k, x in enumerate(own) for v in x], "feature_idx int, value double")
    got = {r["feature_idx"]: r["lam"] for r in transform.Power.fit(dense).fitted.collect()}
    assert all(abs(got[k] - want[k]) < 0.005 for k in range(3)), (got, want)
    assert len(got) == 4


def test_quantile_by_position(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=57)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        monkeypatch.setattr(stats, "BUFFERED", 1_000_000)
        assert abs(stats.quantile(df, "v", q) - np.quantile(x, q)) < 1e-12
        monkeypatch.setattr(stats, "BUFFERED", 0)
        assert abs(stats.quantile(df, "v", q) - np.quantile(x, q)) < 1e-12


def test_several_fastq_files_and_splits(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.fq").write_text("".join(f"@{f}{k}/1 x\n{'ACGT' * 5}\n+\n{'I' * 20}\n" for k in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        got = sources.read_fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")])
        assert rows(got.select("id", "read_no")) == sorted((f"{f}{k}/1", k) for f in "ab" for k in range(200))
        vocab = counting.index_vocabulary(spark.createDataFrame([(f"{a}{b}{c}",) for a in "ACGT" for b in "ACGT" for c in "ACGT"], "kmer string"))
        sources.write_vocab(vocab, str(tmp_path / "v"))
        assert rows(sources.read_vocab(spark, str(tmp_path / "v"))[0]) == rows(vocab)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chain_equals_one_by_one(spark):
    long = spark.createDataFrame([(1, "x", 2.0), (2, "x", 4.0), (1, "y", 3.0), (3, "y", 1.0)], "id long, kmer string, value double")
    chain = transform.Chain.fit(long, 3, [transform.TfIdf.fit, transform.MaxAbs.fit])
    one = transform.TfIdf.fit(long, 3).transform(long)
    two = transform.MaxAbs.fit(one, 3).transform(one)
    assert rows(chain.transform(long).select("id", "kmer", "value")) == rows(two.select("id", "kmer", "value"))


def test_merged_classification_is_written(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, domain string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, domain string")
    report.save_classification(old, new, str(tmp_path / "m"))
    got = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "m"))
    assert rows(got.select("id", "domain")) == [("1", "a"), ("2", "c"), ("3", "d")]


def test_cycles_raise(spark):
    nodes = spark.createDataFrame([(k, 0, (k + 1) % 9 + 1, "r", "n") for k in range(1, 10)], "id int, depth int, parent int, rank string, name string")
    with pytest.raises(ValueError):
        taxonomy.tour(nodes, 1)


def test_power_equals_formula(spark):
    x = np.random.default_rng(3).gamma(2, size=80) - 1
    dense = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(x)], "id long, feature_idx int, value double")
    model = transform.Power.fit(dense)
    lam = model.fitted.first()["lam"]
    y = np.where(x >= 0, ((np.abs(x) + 1) ** lam - 1) / lam, -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam))
    got = np.array([r["value"] for r in model.transform(dense).orderBy("id").collect()])
    assert np.allclose(got, (y - y.mean()) / y.std(), atol=1e-6)


def test_alphabet_at_a_line_end(spark):
    from kmerflow.functions import is_valid

    assert [r[0] for r in spark.createDataFrame([("ACG",), ("ACG\n",), ("AC\nG",)], "k string").select(is_valid("k")).collect()] == [True, False, False]


def test_lineage_of_a_label_is_the_first(spark):
    classes = spark.createDataFrame([(1, "s", "g2", "d"), (2, "s", "g1", "e"), (3, "s", "g1", "d")], "id long, species string, genus string, domain string")
    assert rows(report.one_lineage(classes, "species", ["species", "genus", "domain"])) == [("s", "g1", "d")]


def plain_shared(up, taxa):
    """Deepest node above all of ``taxa``; -1 if there is none."""
    paths = []
    for t in taxa:
        path = [t]
        while up[path[-1]] != path[-1] and up[path[-1]] in up:
            path.append(up[path[-1]])
        paths.append(path[::-1])
    shared = -1
    for level in zip(*paths):
        if len(set(level)) > 1:
            break
        shared = level[0]
    return shared


def test_tour_of_random_trees(spark):
    """Intervals, containment, roll-up and shared ancestors against plain loops; several roots, a deep chain, gaps in ids."""
    rng = np.random.default_rng(8)
    up = {1: 1, 5000: 5000, 70: 999_999}  # 70 names a parent that the table lacks
    for k in range(2, 60):
        up[k] = k - 1  # a chain
    for k in range(100, 400):
        up[k] = int(rng.choice([n for n in up]))
    depth = {}
    for k in up:
        d, at = 0, k
        while up[at] != at and up[at] in up:
            d, at = d + 1, up[at]
        depth[k] = d
    nodes = spark.createDataFrame([(k, depth[k], p, "r", "n") for k, p in up.items()], "id int, depth int, parent int, rank string, name string").repartition(3)
    toured = taxonomy.tour(nodes, 90)
    got = {r["id"]: r for r in toured.collect()}
    assert sorted(r["entry"] for r in got.values()) == list(range(len(up)))
    above = {k: set() for k in up}
    for k in up:
        at = k
        while True:
            above[k].add(at)
            if up[at] == at or up[at] not in up:
                break
            at = up[at]
    for a in up:
        for b in up:
            assert (a in above[b]) == (got[a]["entry"] <= got[b]["entry"] <= got[a]["exit"])
    ids = list(up)
    pairs = [(i, int(rng.choice(ids)), int(rng.choice(ids))) for i in range(500)] + [(500, 1, 123_456), (501, 123_456, 1)]
    held = taxonomy.taxon_contains(spark.createDataFrame(pairs, "q int, parent int, child int"), toured).collect()
    assert sorted(r["q"] for r in held) == [q for q, p, c in pairs if c in above and p in above[c]]
    hits = [(q, int(rng.choice([*ids, 123_456])), float(rng.integers(1, 9))) for q in range(200) for _ in range(int(rng.integers(1, 5)))]
    found = {r["query"]: r["taxon"] for r in taxonomy.lca(spark.createDataFrame(hits, "query int, taxon int, score double"), toured).collect()}
    for q in range(200):
        taxa = [t for p, t, _ in hits if p == q and t in up]
        assert found[q] == (plain_shared(up, taxa) if taxa else -1)
    rolled = {r["taxon"]: r for r in taxonomy.taxon_roll_up(spark.createDataFrame([(t, s, s) for _, t, s in hits], "taxon int, magnitude double, score double"), nodes, toured).collect()}
    for t in rolled:
        own = [(x if x in up else 1, s) for _, x, s in hits]
        own = [(x, s) for x, s in own if t in above[x]]
        assert rolled[t]["count"] == len(own) and rolled[t]["magnitude"] == pytest.approx(sum(s for _, s in own))
        assert rolled[t]["unassigned"] == pytest.approx(sum(s for x, s in own if x == t))
        assert t == 1 or rolled[t]["score"] == pytest.approx(sum(s * s for _, s in own) / sum(s for _, s in own))


def test_power_of_implicit_zeros(spark):
    """Lambda, mean and variance from the entries that are there, against the likelihood of dense columns."""
    rng, n = np.random.default_rng(9), 400
    x = np.where(rng.random((n, 6)) < [0.05, 0.2, 0.5, 0.9, 0.3, 1.0], rng.poisson([2, 9, 4, 30, 1, 3], (n, 6)) * [1.0, 1.0, 0.5, 1.0, -1.0, 1.0], 0.0)
    long = spark.createDataFrame([(int(i), f"f{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "id long, kmer string, value double")
    model = transform.Power.fit(long, "kmer", n=n)
    got = {r["kmer"]: r for r in model.fitted.collect()}
    zeros = {r["kmer"]: r["value"] for r in model.zeros().collect()}

    def yj(v, lam):
        up = np.log1p(np.maximum(v, 0)) if abs(lam) < 1e-9 else ((np.maximum(v, 0) + 1) ** lam - 1) / lam
        down = -np.log1p(np.maximum(-v, 0)) if abs(lam - 2) < 1e-9 else -((np.maximum(-v, 0) + 1) ** (2 - lam) - 1) / (2 - lam)
        return np.where(v >= 0, up, down)

    def score(v, lam):
        return -n / 2 * np.log(yj(v, lam).var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()

    for j in range(6):
        low, high = got[f"f{j}"]["lam"] - 1, got[f"f{j}"]["lam"] + 1
        for _ in range(60):  # the likelihood has one peak
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (a, high) if score(x[:, j], a) < score(x[:, j], b) else (low, b)
        assert got[f"f{j}"]["lam"] == pytest.approx(low, abs=1e-3)
        y = yj(x[:, j], got[f"f{j}"]["lam"])
        assert got[f"f{j}"]["mean"] == pytest.approx(y.mean()) and got[f"f{j}"]["var"] == pytest.approx(y.var())
        assert zeros[f"f{j}"] == pytest.approx(-y.mean() / y.std())
    low = transform.MinMax.fit(long, n)
    assert {r["kmer"]: r["value"] for r in low.zeros().collect()}["f4"] == pytest.approx(-x[:, 4].min() / (x[:, 4].max() - x[:, 4].min()))


def test_naive_bayes_in_blocks_of_labels(spark, monkeypatch):
    rng = np.random.default_rng(12)
    long = spark.createDataFrame([(i, f"k{j}", float(rng.integers(1, 5))) for i in range(40) for j in range(6) if rng.random() < 0.6] + [(99, "new", 2.0)], "id long, kmer string, value double")
    classes = spark.createDataFrame([(i, f"c{i % 5}", i % 2) for i in range(40)], "id long, label string, cluster long")
    model = classify.NaiveBayes.fit(long, classes, 6)
    whole = {tuple(r)[:3]: r["p"] for r in model.predict(long).collect()}
    monkeypatch.setattr(classify.NaiveBayes, "BLOCK", 2)
    parts = {tuple(r)[:3]: r["p"] for r in model.predict(long).collect()}
    assert whole.keys() == parts.keys() and all(whole[k] == pytest.approx(parts[k]) for k in whole)
    assert len(whole) == 2 * 5 * (long.select("id").distinct().count())


def test_naive_bayes_sent_to_tasks_equals_the_joined_model(spark, monkeypatch):
    """Clusters that lack a label, entries the model never saw, a row with none it knows, a repeated entry."""
    entries = [(i, f"k{(i * j) % 7}", float(1 + (i + j) % 3)) for i in range(30) for j in (1, 2, 5)] + [(4, "new", 2.0), (99, "new", 1.0)]
    long = spark.createDataFrame(entries, "id long, kmer string, value double")
    rows = spark.createDataFrame([(i, f"l{i % (2 + i % 3)}", i % 3) for i in range(30)], "id long, label string, cluster long")
    model = classify.NaiveBayes.fit(long.where("kmer <> 'new'"), rows, 7)
    found = {}
    monkeypatch.setattr(classify.NaiveBayes, "BLOCK", 2)
    for sent in (0, 1 << 20):
        monkeypatch.setattr(classify.NaiveBayes, "SENT", sent)
        found[sent] = [{tuple(r)[:-1]: r["p"] for r in df.collect()} for df in (model.predict(long), model.ensemble(long, 3))]
    for got, want in zip(*found.values(), strict=True):
        assert got.keys() == want.keys()
        assert all(abs(got[x] - want[x]) < 1e-9 for x in want)
    plan = model.ensemble(long, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_models_of_two_classes_are_sent_after_a_tour(spark):
    """A tour leaves nothing in the session that models with a training summary cannot be sent with."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    taxonomy.tour(spark.createDataFrame([(1, 0, 1, "no rank", "root"), (2, 1, 1, "a", "x"), (3, 2, 2, "b", "y")], "id int, depth int, parent int, rank string, name string")).count()
    vectors = spark.range(60).select("id", array_to_vector(F.array((F.col("id") % 7).cast("double"), F.lit(1.0))).alias("features"), (F.col("id") % 7 > 3).cast("double").alias("label"))
    found = classify.linear_svm(vectors, rounds=5).transform(vectors)
    assert found.where("label = prediction").count() > 40
    assert classify.search(vectors.select("features", "label"), LogisticRegression(maxIter=3), {"regParam": [0.0, 0.1]})[1].count() == 2


def test_reduction_weighs_once(spark):
    """As the three selections one after the other, over entries that are shuffled once; ids without, and with two labels."""
    from kmerflow.operators.transform import TfIdf

    from .test_forest import shuffled

    rng, n = np.random.default_rng(2), 2400
    x = rng.poisson(rng.uniform(0.1, 2.0, 24), (n, 24))
    long = spark.createDataFrame([(int(i), f"k{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "id long, kmer string, value double").coalesce(2).cache()
    labels = [(i, f"s{i % 5}" if i % 11 else None) for i in range(n)] + [(i, "twice") for i in range(0, n, 9)]
    classes, entries = spark.createDataFrame(labels, "id long, label string").coalesce(1).cache(), long.count()
    classes.count()
    kept, moved = shuffled(spark, lambda: [r[0] for r in select.reduce_features(long, classes, n, 0.2, 0.2, 0.5).select("kmer").distinct().collect()], "60000")
    one = TfIdf.fit(long, n).transform(long)
    one = profile.select_features(one, select.by_occurrence(one, n, 0.2))
    one = profile.select_features(one, select.by_variance(one, n, 0.2))
    assert sorted(kept) == sorted(r[0] for r in select.by_chi_square(one, classes, 0.5).collect()) and 0 < len(kept) < 16
    assert moved < 2 * entries
