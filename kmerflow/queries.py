"""Registered queries over the shared tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression, NaiveBayes as MlNaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .fixtures import table, view, with_views
from .functions import accession, canonical_domain, is_valid, kmers, lineage_path, one_class_truth
from .operators import classify, counting, decompose, linear, profile, registry, report, select, stats, taxonomy, transform, tune
from .operators.lineage import cut, shared_folder
from .plans import classify_metagenome, top_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS = ["species", "genus", "family", "domain"]

#: The long profile of ``dna``, k = 3, in SQL; the last window is left out.
PROFILE = """WITH tok AS (SELECT id, substr(sequence, CAST(p AS INT), 3) AS kmer FROM dna, unnest(range(1, length(sequence) - 2)) t(p)),
prof AS (SELECT id, kmer, CAST(count(*) AS DOUBLE) AS value FROM tok GROUP BY 1, 2), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM dna)"""
#: Embeddings as a long table.
HASH = "CAST('0x' || substr(md5('{}:' || {}), 1, 8) AS BIGINT)"
DENSE = "WITH dense AS (SELECT vec_id AS id, CAST(p - 1 AS INT) AS feature_idx, CAST(embedding[CAST(p AS INT)] AS DOUBLE) AS value, label FROM embeddings, unnest(range(1, len(embedding) + 1)) t(p))"


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dna_profile(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_profile(view(spark, d, "dna"), 3)


def dense(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return profile.to_long(e, "vec_id", "embedding", zeros=True).withColumn("value", F.col("value").cast("double"))


def named(rows: DataFrame) -> DataFrame:
    """Entries of dense rows with the place of a feature as its name; zeros need no rows."""
    return rows.where("value <> 0").withColumn("kmer", F.format_string("f%03d", "feature_idx")).drop("feature_idx")


# sources and sinks


@query("SELECT id, sequence FROM dna", "dna")
def fasta_round_trip(spark, d):
    path = scratch(spark, "fasta")
    sources.write_fasta(view(spark, d, "dna"), path, gzip=False)
    return sources.read_fasta(spark, path, pattern="part-*").select(F.col("id").cast("long").alias("id"), "sequence")


@query("SELECT read_no, concat('r', CAST(read_no AS STRING), '/1') AS id, sequence, repeat('I', 20) AS quality FROM pair_r1", "pair_r1")
def fastq_round_trip(spark, d):
    path = scratch(spark, "fastq")
    rows = view(spark, d, "pair_r1")
    rows.select(F.format_string("@%s\n%s\n+\n%s", "id", "sequence", F.lit("I" * 20)).alias("value")).write.text(path)
    made = sources.read_fastq(spark, path)
    return made.select(F.regexp_extract("id", r"(\d+)", 1).cast("long").alias("read_no"), "id", "sequence", "quality")


@query("SELECT read_no, 1 AS mate, replace(id, '/', '_') AS id, sequence FROM pair_r1 UNION ALL SELECT read_no, 2, replace(id, '/', '_'), sequence FROM pair_r2", "pair_r1", "pair_r2")
def interleave_pairs(spark, d):
    return sources.interleave_pairs(view(spark, d, "pair_r1"), view(spark, d, "pair_r2"))


SHARDS = "SELECT read_no, read_no % 3 AS shard, id, CASE WHEN read_no % 7 = 0 THEN '' ELSE sequence END AS sequence FROM {}"


@query(
    f"SELECT read_no // 3 AS read_no, shard, 1 AS mate, replace(id, '/', '_') AS id, sequence FROM ({SHARDS.format('pair_r1')}) UNION ALL SELECT read_no // 3, shard, 2, replace(id, '/', '_'), sequence FROM ({SHARDS.format('pair_r2')})",
    "pair_r1",
    "pair_r2",
)
def paired_shards(spark, d):
    """Both sides written in three shards, reads of length 0 and qualities that begin with ``@`` among them, and read in pairs."""
    sides = []
    for side in ("pair_r1", "pair_r2"):
        path = scratch(spark, side)
        view(spark, d, side).createOrReplaceTempView(f"_{side}")
        rows = spark.sql(SHARDS.format(f"_{side}"))
        quality = F.when(F.col("sequence") == "", "").when(F.col("read_no") % 5 == 0, F.lit("@" + "I" * 19)).otherwise(F.lit("I" * 20))
        line = F.format_string("@%s x\n%s\n+\n%s", "id", "sequence", quality)
        rows.repartition(3, "shard").sortWithinPartitions("shard", "read_no").select("shard", line.alias("value")).write.partitionBy("shard").text(path)
        sides.append(sources.read_fastq(spark, path).select("shard", "read_no", "id", "sequence"))
    return sources.interleave_pairs(*sides).select("read_no", F.col("shard").cast("long").alias("shard"), "mate", "id", "sequence")


@query("SELECT CAST(id AS VARCHAR) AS id, species, genus, family, domain FROM classes", "classes")
def class_table_round_trip(spark, d):
    path = scratch(spark, "classes")
    sources.write_csv(view(spark, d, "classes"), path)
    df, ranks = sources.read_classes(spark, path)
    assert ranks == RANKS
    return df


@query(PROFILE + " SELECT CAST(row_number() OVER (ORDER BY kmer) - 1 AS BIGINT) AS feature_idx, kmer FROM (SELECT DISTINCT kmer FROM tok)", "dna")
def vocabulary_round_trip(spark, d):
    path = scratch(spark, "vocab")
    sources.write_vocab(counting.index_vocabulary(dna_profile(spark, d)), path)
    return sources.read_vocab(spark, path, 3)[0]


@query(PROFILE + " SELECT id, kmer, value FROM prof", "dna")
def dataset_round_trip(spark, d):
    path = scratch(spark, "dataset")
    long = dna_profile(spark, d)
    sources.save_dataset(spark, path, long, counting.index_vocabulary(long), {"k": 3})
    return sources.load_dataset(spark, path)[0]


@query(
    """SELECT id, array_to_string(list_slice(string_split(species, ' '), 1, 2), '_') AS species, genus FROM
    (SELECT doc_id AS id, concat('GCF_', CAST(doc_id % 50 AS STRING)) AS accession FROM documents) r
    JOIN (SELECT concat('GCF_', CAST(n AS STRING)) AS accession, concat('Genus', CAST(n % 7 AS STRING), ' species', CAST(n AS STRING), ' strain') AS species, concat('Genus', CAST(n % 7 AS STRING)) AS genus
    FROM (SELECT DISTINCT doc_id % 40 AS n FROM documents)) c USING (accession)"""
)
def build_reference(spark, d):
    docs = table(spark, d, "documents")
    records = docs.select(F.col("doc_id").alias("id"), F.format_string("/data/GCF_%d_genomic.fna", F.col("doc_id") % 50).alias("file"))
    n = docs.select((F.col("doc_id") % 40).alias("n")).distinct()
    classes = n.select(F.format_string("GCF_%d", "n").alias("accession"), F.format_string("Genus%d species%d strain", F.col("n") % 7, F.col("n")).alias("species"), F.format_string("Genus%d", F.col("n") % 7).alias("genus"))
    return sources.build_reference(records, classes)


@query("SELECT id, 'Homo_sapiens' AS species, 'host' AS domain FROM host_dna", "host_dna")
def host_class_table(spark, d):
    return sources.host_classes(view(spark, d, "host_dna"), "Homo_sapiens")


# projections and scalar functions


@query("SELECT kmer, count(*) AS n FROM (SELECT substr(sequence, CAST(p AS INT), 5) AS kmer FROM dna, unnest(range(1, length(sequence) - 4)) t(p)) GROUP BY 1", "dna")
def kmer_windows(spark, d):
    return view(spark, d, "dna").select(F.explode(kmers("sequence", 5)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query("SELECT id, regexp_full_match(sequence, '[A-Z ]+') AS valid, length(sequence) AS n FROM seqs", "seqs")
def alphabet_filter(spark, d):
    return view(spark, d, "seqs").select("id", is_valid("sequence", "A-Z ").alias("valid"), F.length("sequence").cast("long").alias("n"))


@query("SELECT CASE WHEN lower(domain) = 'archaea' THEN 'Bacteria' ELSE domain END AS domain, count(*) AS n FROM classes GROUP BY 1", "classes")
def canonical_domains(spark, d):
    return view(spark, d, "classes").groupBy(canonical_domain("domain").alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN y_true IN ('Bacteria', 'bacteria', 'bact') THEN y_true ELSE 'Unknown' END AS y_true FROM predictions", "predictions")
def one_class_truths(spark, d):
    return view(spark, d, "predictions").select("id", one_class_truth("y_true").alias("y_true"))


@query("SELECT id, species, domain FROM classes", "classes")
def keep_columns(spark, d):
    return profile.keep_columns(view(spark, d, "classes"), ["domain", "id", "species", "absent"])


@query(PROFILE + " SELECT id, kmer, value FROM prof WHERE kmer LIKE 'A%'", "dna")
def feature_projection(spark, d):
    long = dna_profile(spark, d)
    return profile.select_features(long, long.where("kmer like 'A%'").select("kmer"))


@query(
    PROFILE + """, vocab AS (SELECT kmer FROM (SELECT DISTINCT kmer FROM tok)), grid AS (SELECT dna.id, kmer FROM dna, vocab)
    SELECT g.id, string_agg(CAST(CAST(coalesce(p.value, 0) AS INT) AS VARCHAR), ',' ORDER BY g.kmer) AS features FROM grid g LEFT JOIN prof p ON g.id = p.id AND g.kmer = p.kmer GROUP BY g.id""",
    "dna",
)
def tensor_assembly(spark, d):
    seqs, long = view(spark, d, "dna"), dna_profile(spark, d)
    arrays = profile.to_arrays(long, counting.index_vocabulary(long), seqs)
    return arrays.select("id", F.array_join(F.transform("features", lambda x: x.cast("int").cast("string")), ",").alias("features"))


@query(DENSE + " SELECT id, feature_idx, round(value, 6) AS value FROM dense")
def tensor_explode(spark, d):
    return dense(spark, d).select(F.col("id"), "feature_idx", *r6("value"))


@query(PROFILE + ", comp AS (SELECT DISTINCT kmer, CAST(c AS INT) AS component, CAST((ascii(kmer) + c) % 5 AS DOUBLE) AS weight FROM tok, unnest(range(0, 2)) t(c)) SELECT id, component, round(sum(value * weight), 6) AS value FROM prof JOIN comp USING (kmer) GROUP BY 1, 2", "dna")
def linear_projection(spark, d):
    long = dna_profile(spark, d)
    comp = long.select("kmer").distinct().select("kmer", F.explode(F.array(F.lit(0), F.lit(1))).alias("component"))
    return profile.project(long, comp.withColumn("weight", ((F.ascii("kmer") + F.col("component")) % 5).cast("double"))).select("id", "component", *r6("value"))


@query("SELECT s.id, s.source FROM seqs s WHERE s.id IN (SELECT id FROM predictions WHERE y_pred <> 'Unknown')", "seqs", "predictions")
def remove_unknown(spark, d):
    kept, _ = profile.remove_unknown(view(spark, d, "seqs"), view(spark, d, "predictions").withColumnRenamed("y_pred", "label"))
    return kept.select("id", "source")


@query("SELECT id, CAST(id % 7 AS BIGINT) AS prediction, CASE WHEN id % 7 < 5 THEN chr(CAST(65 + id % 7 AS INT)) END AS label FROM predictions", "predictions")
def decode_labels(spark, d):
    labels = spark.range(5).select(F.col("id").alias("idx"), F.char((F.col("id") + 65)).alias("label"))
    return profile.decode_labels(view(spark, d, "predictions").select("id", (F.col("id") % 7).alias("prediction")), labels).select("id", "prediction", "label")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN concat('NC_', CAST(doc_id AS STRING)) ELSE concat('ctg', CAST(doc_id AS STRING)) END AS accession FROM documents")
def accessions(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.format_string(">gi|7|ref|NC_%d.1| some text", "doc_id")).otherwise(F.format_string(">ctg%d.2 other", "doc_id"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), accession(text).alias("accession"))


@query("SELECT id, array_to_string(list_filter([level1, level2, level3], lambda x: x <> ''), '|') AS path FROM lineages", "lineages")
def lineage_lines(spark, d):
    line = F.concat_ws("\t", "level1", "level2", "level3")
    return view(spark, d, "lineages").select("id", F.array_join(lineage_path(line), "|").alias("path"))


# joins


@query("SELECT d.id, c.species, c.genus, c.family, c.domain FROM host_dna h FULL JOIN seqs d ON h.id = d.id LEFT JOIN (SELECT * FROM classes WHERE id % 3 <> 0) c ON d.id = c.id", "host_dna", "seqs", "classes")
def sequences_with_classes(spark, d):
    both = view(spark, d, "seqs").select("id").unionByName(view(spark, d, "host_dna").select(F.lit(None).cast("long").alias("id")))
    return profile.with_classes(both, view(spark, d, "classes").where("id % 3 <> 0"))


@query("SELECT user_id AS id, min(event_id) AS pos, arg_min(event_type, event_id) AS event_type FROM events WHERE user_id IN (SELECT doc_id FROM documents) GROUP BY 1")
def first_class_rows(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), "event_type")
    return profile.first_classes(rows, table(spark, d, "documents").select(F.col("doc_id").alias("id")), "pos")


@query("SELECT id, sequence FROM dna WHERE id IN (SELECT id FROM predictions)", "dna", "predictions")
def genome_subset(spark, d):
    return profile.subset(view(spark, d, "dna").select("id", "sequence"), view(spark, d, "predictions"))


@query(
    """SELECT r.read_id AS id, c.species, c.domain FROM reads r LEFT JOIN classes c ON concat('G', CAST(c.id AS STRING)) = regexp_extract(r.read_id, '^(.*)_[^_]*$', 1)""",
    "reads",
    "classes",
)
def reads_to_genomes(spark, d):
    named = view(spark, d, "classes").select(F.concat(F.lit("G"), F.col("id").cast("string")).alias("id"), F.col("id").alias("pos"), "species", "domain")
    return profile.reads_to_genomes(view(spark, d, "reads").select("read_id"), named)


@query(
    """SELECT r.read_id AS id, arg_max(concat('N', CAST(n.n_nationkey AS STRING)), n.n_nationkey) AS label FROM reads r LEFT JOIN nation n ON contains(r.read_id, concat('G', CAST(n.n_nationkey AS STRING))) GROUP BY 1""",
    "reads",
)
def reads_to_genomes_by_substring(spark, d):
    n = table(spark, d, "nation")
    named = n.select(F.concat(F.lit("G"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("label"))
    return profile.reads_to_genomes(view(spark, d, "reads").select("read_id"), named, by_prefix=False)


@query("SELECT a.c_custkey, b.y FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) a JOIN (SELECT c_custkey % 5 AS y, row_number() OVER (ORDER BY -c_custkey) AS n FROM customer) b USING (n)")
def positional_zip(spark, d):
    c = table(spark, d, "customer")
    left = c.select("c_custkey")
    right = c.select((F.col("c_custkey") % 5).alias("y"), (-F.col("c_custkey")).alias("o"))
    return profile.zip_rows(left, right, ["c_custkey"], ["o"]).select("c_custkey", "y")


@query(
    """SELECT coalesce(o.id, n.id) AS id, coalesce(n.label, o.label) AS label, o.extra FROM (SELECT id, y_true AS label, id * 2 AS extra FROM predictions WHERE id % 3 <> 0) o
    FULL JOIN (SELECT id, y_pred AS label FROM predictions WHERE id % 2 = 0) n ON o.id = n.id""",
    "predictions",
)
def merged_classifications(spark, d):
    p = view(spark, d, "predictions")
    return profile.merge_classifications(p.where("id % 3 <> 0").select("id", F.col("y_true").alias("label"), (F.col("id") * 2).alias("extra")), p.where("id % 2 = 0").select("id", F.col("y_pred").alias("label")))


@query("SELECT query, CASE WHEN taxon % 9 = 0 THEN 0 ELSE taxon END AS taxon FROM hits", "hits")
def accession_lookup(spark, d):
    hits = view(spark, d, "hits").select("query", F.concat(F.lit("AC"), F.col("taxon").cast("string")).alias("accession"))
    known = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).cast("int").alias("taxon")).where("taxon % 9 <> 0")
    found, _ = taxonomy.to_taxa(hits, known.select(F.concat(F.lit("AC"), F.col("taxon").cast("string")).alias("accession"), "taxon"))
    return found.select("query", "taxon")


CLOSURE = "reach AS (SELECT id, id AS ancestor FROM taxonomy UNION SELECT t.id, t.parent FROM taxonomy t UNION SELECT t.id, p.parent FROM taxonomy t JOIN taxonomy p ON t.parent = p.id UNION SELECT t.id, g.parent FROM taxonomy t JOIN taxonomy p ON t.parent = p.id JOIN taxonomy g ON p.parent = g.id), up AS (SELECT r.id, r.ancestor, t.depth FROM reach r JOIN taxonomy t ON r.ancestor = t.id)"


@query(f"WITH {CLOSURE} SELECT id, ancestor, depth FROM up", "taxonomy")
def ancestors(spark, d):
    return taxonomy.closure(taxonomy.tour(view(spark, d, "taxonomy")))


@query("SELECT query, pos, CASE WHEN taxon % 9 = 0 THEN 1 ELSE taxon END AS taxon FROM hits", "hits")
def unknown_to_root(spark, d):
    hits = view(spark, d, "hits").select("query", "pos", "taxon")
    return taxonomy.known_or_root(hits, view(spark, d, "taxonomy").where("id % 9 <> 0 or id < 1000")).select("query", "pos", "taxon")


@query("SELECT p.id, coalesce(l.magnitude, 1.0) AS magnitude FROM predictions p LEFT JOIN lineages l ON p.id = l.id", "predictions", "lineages")
def query_magnitudes(spark, d):
    return taxonomy.with_magnitudes(view(spark, d, "predictions").select("id"), view(spark, d, "lineages").select("id", "magnitude"))


# aggregations and statistics


@query(
    """SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(l) - 2), lambda p: l[p] || l[p + 1] || l[p + 2])) AS kmer FROM (SELECT string_split(sequence, '') AS l FROM seqs))
    WHERE regexp_full_match(kmer, '[ATCG]+') GROUP BY 1""",
    "seqs",
)
def kmer_counts(spark, d):
    return counting.discover_vocabulary(counting.spread(view(spark, d, "seqs")), 3)


@query(PROFILE + " SELECT id, kmer, value FROM prof", "dna")
def kmer_profile(spark, d):
    return dna_profile(spark, d)


@query(PROFILE + " SELECT id, kmer, value FROM prof WHERE kmer IN (SELECT kmer FROM prof GROUP BY 1 HAVING count(*) < (SELECT n FROM n) * 0.97)", "dna")
def given_vocabulary_profile(spark, d):
    seqs = view(spark, d, "dna")
    found = stats.document_frequency(counting.count_profile(seqs, 3)).where(F.col("df") < seqs.count() * 0.97)
    return counting.count_profile(seqs, 3, vocabulary=found)


@query(PROFILE + " SELECT kmer, count(*) AS df FROM prof GROUP BY 1", "dna")
def document_frequency(spark, d):
    return stats.document_frequency(dna_profile(spark, d))


@query(PROFILE + " SELECT kmer, round(sum(value), 6) AS total, round(sum(value) / n, 6) AS mean, round(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 6) AS variance FROM prof, n GROUP BY kmer, n", "dna")
def feature_moments(spark, d):
    return stats.moments(dna_profile(spark, d), view(spark, d, "dna").count()).select("kmer", *r6("total", "mean", "variance"))


@query(DENSE + " SELECT feature_idx, round(min(value), 6) AS low, round(max(value), 6) AS high, round(max(abs(value)), 6) AS peak FROM dense GROUP BY 1")
def feature_extremes(spark, d):
    return stats.extremes(dense(spark, d), table(spark, d, "embeddings").count(), "feature_idx").select("feature_idx", *r6("low", "high", "peak"))


CHI = """, lab AS (SELECT id, species AS label FROM dna), share AS (SELECT label, count(*) / (SELECT n FROM n) AS share FROM lab GROUP BY 1), tot AS (SELECT kmer, sum(value) AS total FROM prof GROUP BY 1),
obs AS (SELECT kmer, label, sum(value) AS o FROM prof JOIN lab USING (id) GROUP BY 1, 2),
chi AS (SELECT t.kmer, sum((coalesce(o.o, 0) - s.share * t.total) * (coalesce(o.o, 0) - s.share * t.total) / (s.share * t.total)) AS chi FROM tot t CROSS JOIN share s LEFT JOIN obs o ON o.kmer = t.kmer AND o.label = s.label GROUP BY 1)"""


@query(PROFILE + CHI + " SELECT kmer, round(chi, 6) AS chi FROM chi", "dna")
def chi_square(spark, d):
    return stats.chi_square(dna_profile(spark, d), view(spark, d, "dna").select("id", F.col("species").alias("label"))).select("kmer", *r6("chi"))


@query(PROFILE + ", v AS (SELECT kmer, sum(value * value) / n - (sum(value) / n) * (sum(value) / n) AS x FROM prof, n GROUP BY kmer, n) SELECT round(quantile_cont(x, 0.25), 6) AS q FROM v", "dna")
def statistic_quantile(spark, d):
    m = stats.moments(dna_profile(spark, d), view(spark, d, "dna").count())
    return spark.createDataFrame([(round(stats.quantile(m, "variance", 0.25), 6),)], "q double")


@query(
    """SELECT label, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM
    (SELECT CASE WHEN lower(domain) = 'archaea' THEN 'Bacteria' ELSE domain END AS label FROM classes UNION ALL SELECT domain FROM host_dna) GROUP BY 1)""",
    "classes",
    "host_dna",
)
def class_weights(spark, d):
    return stats.class_weights(view(spark, d, "classes"), "domain", view(spark, d, "host_dna")).select("label", *r6("weight"))


@query("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS idx FROM (SELECT DISTINCT species AS label FROM classes)", "classes")
def label_index(spark, d):
    return stats.label_index(view(spark, d, "classes"), "species")


@query("SELECT 'genus' AS parent, count(DISTINCT genus) AS n FROM classes", "classes")
def parent_rank(spark, d):
    c = view(spark, d, "classes")
    return c.agg(F.lit(stats.parents(c, "species", RANKS)[0]).alias("parent"), F.count_distinct("genus").alias("n"))


@query("SELECT genus, count(*) AS n, count(DISTINCT species) AS species FROM classes GROUP BY 1", "classes")
def split_by_parent(spark, d):
    return profile.split_by_parent(view(spark, d, "classes"), "species", "genus").select(F.col("parent").alias("genus"), F.col("rows").alias("n"), F.col("labels").alias("species"))


@query("SELECT DISTINCT id FROM (SELECT id FROM predictions UNION ALL SELECT id FROM seqs)", "predictions", "seqs")
def distinct_ids(spark, d):
    return profile.distinct_ids(view(spark, d, "predictions"), view(spark, d, "seqs"))


# long features of whole texts: letters, spaces and marks as one of four letters, k = 8

TEXT = """WITH chars AS (SELECT id, string_split(sequence, '') AS l FROM letters), tok AS (SELECT id, unnest(list_transform(range(1, len(l) - 7), lambda p: l[p] || l[p + 1] || l[p + 2] || l[p + 3] || l[p + 4] || l[p + 5] || l[p + 6] || l[p + 7])) AS kmer FROM chars),
prof AS (SELECT id, kmer, CAST(count(*) AS DOUBLE) AS value FROM tok WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY 1, 2), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM letters)"""


def text_letters(spark: SparkSession, d: str) -> DataFrame:
    """The texts as letters, dealt and written once, as every profile reads them several times."""
    return cut(counting.spread(view(spark, d, "letters")))


@query(TEXT + " SELECT kmer, count(*) AS df, sum(value) AS total, round(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 6) AS variance FROM prof, n GROUP BY kmer, n", "letters")
def text_kmer_moments(spark, d):
    letters = text_letters(spark, d)
    return stats.moments_of(counting.count_sums(letters, 8), letters.count()).select("kmer", "df", "total", *r6("variance"))


@query(
    TEXT + """, idf AS (SELECT kmer, ln(n / count(*)) + 1 AS idf FROM prof, n GROUP BY kmer, n), w AS (SELECT id, kmer, value * idf AS value FROM prof JOIN idf USING (kmer)),
    u AS (SELECT id, kmer, value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS value FROM w) SELECT id, count(*) AS features, round(max(value), 6) AS most, round(sum(value), 4) AS total FROM u GROUP BY 1""",
    "letters",
)
def text_tf_idf(spark, d):
    letters = text_letters(spark, d)
    weighted = counting.tf_idf(letters, 8, letters.count())
    return weighted.groupBy("id").agg(F.count("*").alias("features"), F.round(F.max("value"), 6).alias("most"), F.round(F.sum("value"), 4).alias("total"))


@query(TEXT + ", v AS (SELECT kmer, sum(value * value) / n - (sum(value) / n) * (sum(value) / n) AS x FROM prof, n GROUP BY kmer, n) SELECT kmer FROM v WHERE x > (SELECT quantile_cont(x, 0.95) FROM v)", "letters")
def text_variance_selection(spark, d):
    letters = text_letters(spark, d)
    return select.above_quantile(stats.moments_of(counting.count_sums(letters, 8), letters.count()), "variance", 0.95)


def long_sql(k: int) -> str:
    window = " || ".join(f"l[p + {j}]" for j in range(k))
    return f"""WITH chars AS (SELECT id, string_split(sequence, '') AS l FROM letters), tok AS (SELECT id, unnest(list_transform(range(1, len(l) - {k} + 1), lambda p: {window})) AS kmer FROM chars),
prof AS (SELECT id, kmer, CAST(count(*) AS DOUBLE) AS value FROM tok WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY 1, 2)"""


@query(long_sql(21) + " SELECT id, count(*) AS features, sum(value) AS windows, max(value) AS most, min(kmer) AS first, max(kmer) AS last FROM prof GROUP BY 1", "letters")
def text_profile_21(spark, d):
    long = counting.count_profile(text_letters(spark, d), 21)
    return long.groupBy("id").agg(F.count("*").alias("features"), F.sum("value").alias("windows"), F.max("value").alias("most"), F.min("kmer").alias("first"), F.max("kmer").alias("last"))


@query(long_sql(35) + " SELECT substr(kmer, 1, 3) AS head, count(*) AS kmers, CAST(sum(n) AS BIGINT) AS windows, max(n) AS most FROM (SELECT kmer, CAST(sum(value) AS BIGINT) AS n FROM prof GROUP BY 1) GROUP BY 1", "letters")
def text_vocabulary_35(spark, d):
    found = counting.discover_vocabulary(counting.spread(view(spark, d, "letters")), 35)
    return found.groupBy(F.substring("kmer", 1, 3).alias("head")).agg(F.count("*").alias("kmers"), F.sum("n").alias("windows"), F.max("n").alias("most"))


# lineage and taxonomy

PATHS = "WITH paths AS (SELECT id, magnitude, list_filter([level1, level2, level3], lambda x: x <> '') AS path FROM lineages), spread AS (SELECT *, path[1:CAST(k AS INT)] AS node, CAST(k AS INT) AS k FROM paths, unnest(range(0, len(path) + 1)) t(k))"


def lineage_rows(spark, d):
    return view(spark, d, "lineages").select("id", "magnitude", F.filter(F.array("level1", "level2", "level3"), lambda x: x != "").alias("path"))


@query(PATHS + " SELECT array_to_string(node, '|') AS path, round(sum(magnitude), 4) AS magnitude, count(*) AS count, round(sum(CASE WHEN k = len(path) THEN magnitude ELSE 0 END), 4) AS unassigned FROM spread GROUP BY 1", "lineages")
def lineage_roll_up(spark, d):
    r = taxonomy.roll_up(lineage_rows(spark, d))
    return r.select(F.array_join("path", "|").alias("path"), F.round("magnitude", 4).alias("magnitude"), "count", F.round("unassigned", 4).alias("unassigned"))


@query(PATHS + " SELECT array_to_string(node, '|') AS path, round(sum(magnitude * (id % 10)) / sum(magnitude), 4) AS score FROM spread GROUP BY 1", "lineages")
def lineage_scores(spark, d):
    r = taxonomy.roll_up(lineage_rows(spark, d).withColumn("score", (F.col("id") % 10).cast("double")))
    return r.select(F.array_join("path", "|").alias("path"), F.round("score", 4).alias("score"))


@query("SELECT query, pos, round(CASE WHEN evalue > 0 THEN log10(evalue) ELSE -300.0 END, 6) AS score FROM hits", "hits")
def log_scores(spark, d):
    return view(spark, d, "hits").select("query", "pos", F.round(taxonomy.log_score("evalue", -300), 6).alias("score"))


@query(
    "WITH nodes AS (SELECT s_nationkey AS n, sum(CAST(s_suppkey AS DOUBLE)) AS m FROM supplier GROUP BY 1), leaf AS (SELECT 'r' || CAST(n_regionkey AS STRING) AS a, 'n' || CAST(n AS STRING) AS b, m FROM nodes JOIN nation ON n = n_nationkey)"
    " SELECT a || '|' || b AS path, m AS magnitude FROM leaf UNION ALL SELECT a, sum(m) FROM leaf GROUP BY 1 UNION ALL SELECT '', sum(m) FROM leaf"
)
def leaf_sums(spark, d):
    n = table(spark, d, "nation")
    leaves = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum(F.col("s_suppkey").cast("double")).alias("magnitude")).join(n, "n_nationkey")
    path = F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    return taxonomy.leaf_values(leaves.select(path.alias("path"), "magnitude")).select(F.array_join("path", "|").alias("path"), "magnitude")


@query(
    "WITH paths AS (SELECT magnitude, CASE WHEN ec = '' THEN ['No hits'] ELSE string_split(ec, '.') END AS path FROM ec_numbers), spread AS (SELECT magnitude, path[1:CAST(k AS INT)] AS node FROM paths, unnest(range(0, len(path) + 1)) t(k))"
    " SELECT array_to_string(node, '.') AS path, round(sum(magnitude), 3) AS magnitude, count(*) AS count FROM spread GROUP BY 1",
    "ec_numbers",
)
def ec_roll_up(spark, d):
    return taxonomy.ec_roll_up(view(spark, d, "ec_numbers")).select(F.array_join("path", ".").alias("path"), F.round("magnitude", 3).alias("magnitude"), "count")


TAXA = f"WITH {CLOSURE}, own AS (SELECT CASE WHEN taxon % 50 = 0 THEN 0 WHEN taxon % 49 = 0 THEN 1 ELSE taxon END AS taxon, score FROM hits)"


@query(
    TAXA + """, kept AS (SELECT u.* FROM up u JOIN taxonomy t ON u.ancestor = t.id WHERE NOT (t.rank = 'no rank' AND t.id <> 1)), deep AS (SELECT id, max(depth) AS last FROM kept GROUP BY 1),
    j AS (SELECT coalesce(k.ancestor, 0) AS taxon, o.score, k.ancestor IS NULL OR k.depth = e.last AS ends FROM own o LEFT JOIN kept k ON o.taxon = k.id LEFT JOIN deep e ON o.taxon = e.id)
    SELECT taxon, CAST(count(*) AS DOUBLE) AS magnitude, count(*) AS count, CAST(sum(CASE WHEN ends THEN 1 ELSE 0 END) AS DOUBLE) AS unassigned, round(avg(CASE WHEN taxon <> 1 THEN score END), 6) AS score FROM j GROUP BY 1""",
    "taxonomy",
    "hits",
)
def taxon_roll_up(spark, d):
    nodes = view(spark, d, "taxonomy")
    t = F.col("taxon")
    hits = view(spark, d, "hits").select(F.when(t % 50 == 0, 0).when(t % 49 == 0, 987654).otherwise(t).alias("taxon"), F.lit(1.0).alias("magnitude"), "score")
    return taxonomy.taxon_roll_up(hits, nodes, taxonomy.tour(nodes), no_rank=True).select("taxon", "magnitude", "count", "unassigned", *r6("score"))


LCA = """, best AS (SELECT query, taxon, score FROM (SELECT *, first(score) OVER (PARTITION BY query ORDER BY pos, score DESC, taxon) AS top FROM hits) WHERE score >= top - {t}), taxa AS (SELECT DISTINCT query, taxon FROM best),
shared AS (SELECT query, ancestor, max(depth) AS depth, count(*) AS held FROM taxa JOIN up ON taxon = id GROUP BY 1, 2), n AS (SELECT query, count(*) AS n FROM taxa GROUP BY 1),
found AS (SELECT s.query, arg_max(ancestor, depth) AS taxon FROM shared s JOIN n USING (query) WHERE held = n GROUP BY 1)
SELECT b.query, f.taxon, round(avg(b.score), 6) AS score FROM best b JOIN found f USING (query) GROUP BY 1, 2"""


@query(f"WITH {CLOSURE}" + LCA.format(t=10), "taxonomy", "hits")
def lowest_common_ancestor(spark, d):
    toured = taxonomy.tour(view(spark, d, "taxonomy"))
    return taxonomy.lca(taxonomy.best_hits(view(spark, d, "hits"), 10.0), toured).select("query", "taxon", *r6("score"))


@query(f"WITH {CLOSURE}" + LCA.format(t=3), "taxonomy", "hits")
def blast_lowest_common_ancestor(spark, d):
    nodes = view(spark, d, "taxonomy")
    best = taxonomy.blast_best(view(spark, d, "hits").withColumnRenamed("score", "bits").withColumn("identity", F.lit(1.0)), nodes)
    return taxonomy.lca(best, taxonomy.tour(nodes)).select("query", "taxon", *r6("score"))


@query("SELECT query, taxon, pos, score FROM (SELECT *, first(score) OVER (PARTITION BY query ORDER BY pos, score DESC, taxon) AS top FROM hits) WHERE score >= top", "hits")
def top_hits(spark, d):
    return taxonomy.best_hits(view(spark, d, "hits")).select("query", "taxon", "pos", "score")


@query(
    f"SELECT query, taxon, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {HASH.format(7, "CAST(query AS VARCHAR) || ':' || CAST(taxon AS VARCHAR) || ':' || CAST(pos AS VARCHAR)")} DESC, taxon DESC, pos DESC, score DESC) AS n FROM"
    " (SELECT *, first(score) OVER (PARTITION BY query ORDER BY pos, score DESC, taxon) AS top FROM hits) WHERE score >= top - 10) WHERE n = 1",
    "hits",
)
def random_best_hit(spark, d):
    return taxonomy.random_hit(taxonomy.best_hits(view(spark, d, "hits"), 10.0), 7)


@query(f"WITH {CLOSURE} SELECT DISTINCT h.query, 10 + h.pos % 5 AS parent, h.taxon AS child FROM hits h JOIN up u ON u.id = h.taxon AND u.ancestor = 10 + h.pos % 5", "taxonomy", "hits")
def taxon_containment(spark, d):
    pairs = view(spark, d, "hits").select("query", (10 + F.col("pos") % 5).cast("int").alias("parent"), F.col("taxon").alias("child")).distinct()
    return taxonomy.taxon_contains(pairs, taxonomy.tour(view(spark, d, "taxonomy"))).select("query", "parent", "child")


@query("SELECT taxon, string_agg(CAST(query AS VARCHAR), ',' ORDER BY query) AS members FROM (SELECT DISTINCT taxon, query FROM hits) GROUP BY 1", "hits")
def node_members(spark, d):
    # one row a taxon, as the SQL has it; the pages themselves have no such row
    pages = taxonomy.members(view(spark, d, "hits")).select("taxon", "page", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("ids"))
    whole = pages.groupBy("taxon").agg(F.array_sort(F.collect_list(F.struct("page", "ids"))).alias("pages"))
    return whole.select("taxon", F.array_join("pages.ids", ",").alias("members"))


# set operations, samples, order


@query("SELECT CAST(id AS BIGINT) AS id, CASE WHEN lower(domain) = 'archaea' THEN 'Bacteria' ELSE domain END AS domain FROM classes UNION ALL SELECT id, domain FROM host_dna", "classes", "host_dna")
def union_with_hosts(spark, d):
    return profile.union_hosts(view(spark, d, "classes"), view(spark, d, "host_dna").select("id", "domain", "sequence"))


@query(PROFILE + ", htok AS (SELECT id, substr(sequence, CAST(p AS INT), 3) AS kmer FROM host_dna, unnest(range(1, length(sequence) - 2)) t(p)) SELECT id, kmer, value FROM prof UNION ALL SELECT id, kmer, CAST(count(*) AS DOUBLE) FROM htok GROUP BY 1, 2", "dna", "host_dna")
def merged_profiles(spark, d):
    return profile.merge_profiles([dna_profile(spark, d), counting.count_profile(view(spark, d, "host_dna"), 3)])


@query("SELECT id, domain FROM classes UNION ALL SELECT id, domain FROM host_dna", "classes", "host_dna")
def union_common_columns(spark, d):
    return profile.union_common(view(spark, d, "classes"), view(spark, d, "host_dna"))


@query("SELECT id, species, genus, family, domain FROM classes UNION ALL SELECT id, NULL, NULL, NULL, domain FROM host_dna", "classes", "host_dna")
def union_ragged_columns(spark, d):
    return profile.union_ragged(view(spark, d, "classes"), view(spark, d, "host_dna").select("id", "domain"))


@query("SELECT id, CAST(CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % greatest(1, least(64, n // 100)) AS BIGINT) AS cluster FROM seqs, (SELECT count(*) AS n FROM seqs)", "seqs")
def sample_clusters(spark, d):
    return profile.clusters(view(spark, d, "seqs").select("id"), 100).select("id", "cluster")


@query(f"SELECT id, source FROM seqs WHERE {HASH.format(3, 'CAST(id AS VARCHAR)')} % 1000 < 100", "seqs")
def sample_tenth(spark, d):
    return profile.sample_share(view(spark, d, "seqs").select("id", "source"), 0.1, 3)


@query(f"SELECT id, source FROM (SELECT id, source, row_number() OVER (ORDER BY {HASH.format(5, 'CAST(id AS VARCHAR)')}, id) AS n, count(*) OVER () AS total FROM seqs) WHERE n <= total // 10", "seqs")
def random_sample_rows(spark, d):
    s = view(spark, d, "seqs").select("id", "source")
    return profile.random_rows(s, s.count() // 10, 5)


@query("SELECT source, CAST(CASE WHEN n * 100 < 50000 THEN 10 WHEN n * 100 < 100000 THEN 5 WHEN n * 100 < 250000 THEN 2 ELSE 1 END AS INT) AS ratio FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def reads_for_genomes(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", profile.read_ratio(F.col("n") * 100).alias("ratio"))


@query(PROFILE + " SELECT kmer FROM (SELECT kmer, count(*) AS df FROM prof GROUP BY 1) ORDER BY df, kmer LIMIT 50", "dna")
def least_occurring_features(spark, d):
    long = dna_profile(spark, d)
    return select.least_occurring(long, long.select("kmer").distinct().count() - 50)


# transforms and selection

IDF = ", idf AS (SELECT kmer, ln(n / count(*)) + 1 AS idf FROM prof, n GROUP BY kmer, n), w AS (SELECT id, kmer, value * idf AS v FROM prof JOIN idf USING (kmer)), tfidf AS (SELECT id, kmer, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM w)"


@query(PROFILE + IDF + " SELECT id, kmer, round(value, 6) AS value FROM tfidf", "dna")
def tf_idf(spark, d):
    long = dna_profile(spark, d)
    return transform.TfIdf.fit(long, view(spark, d, "dna").count()).transform(long).select("id", "kmer", *r6("value"))


@query(PROFILE + IDF + " SELECT id, kmer, round(value, 6) AS weight, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(value, 9) DESC, kmer) AS place FROM tfidf) WHERE place <= 3", "dna")
def top_tf_idf_features(spark, d):
    return top_features(view(spark, d, "dna"), 3).select("id", "kmer", *r6("weight"), "place")


@query(DENSE + " SELECT id, feature_idx, round((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS value FROM dense JOIN (SELECT feature_idx, min(value) AS lo, max(value) AS hi FROM dense GROUP BY 1) USING (feature_idx)")
def min_max_scale(spark, d):
    long = dense(spark, d)
    return transform.MinMax.fit(long, table(spark, d, "embeddings").count(), "feature_idx").transform(long).select("id", "feature_idx", *r6("value"))


@query(DENSE + " SELECT id, feature_idx, round(value / peak, 6) AS value FROM dense JOIN (SELECT feature_idx, max(abs(value)) AS peak FROM dense GROUP BY 1) USING (feature_idx)")
def max_abs_scale(spark, d):
    long = dense(spark, d)
    return transform.MaxAbs.fit(long, table(spark, d, "embeddings").count(), "feature_idx").transform(long).select("id", "feature_idx", *r6("value"))


YJ = "CASE WHEN value >= 0 THEN CASE WHEN abs(lam) < 1e-9 THEN ln(1 + value) ELSE (pow(value + 1, lam) - 1) / lam END ELSE CASE WHEN abs(lam - 2) < 1e-9 THEN -ln(1 - value) ELSE -(pow(1 - value, 2 - lam) - 1) / (2 - lam) END END"


def likeliest_sql(rows: str, feature: str, rounds: int = 5) -> str:
    """CTEs ``best0 .. best``: the likeliest lambda of dense ``rows``, by the grid and the refinements around its best."""
    out, step, grid = "", 0.5, f"SELECT d.{feature}, d.value, CAST(g AS DOUBLE) * 0.5 - 2.0 AS lam FROM {rows} d, unnest(range(0, 13)) t(g)"
    for k in range(rounds):
        score = "CASE WHEN v > 0 THEN -n / 2.0 * ln(v) + (lam - 1) * jac END"
        out += f""", tried{k} AS MATERIALIZED ({grid}), s{k} AS MATERIALIZED (SELECT {feature}, lam, count(*) AS n, avg(y) AS m, var_pop(y) AS v, sum(sign(value) * ln(1 + abs(value))) AS jac FROM (SELECT *, {YJ} AS y FROM tried{k}) GROUP BY 1, 2),
        best{k} AS MATERIALIZED (SELECT {feature}, arg_max(lam, {score}) AS lam, arg_max(m, {score}) AS m, arg_max(v, {score}) AS v FROM s{k} GROUP BY 1)"""
        grid = f"SELECT d.{feature}, d.value, b.lam + {step!r} * (2 * g / 12.0::DOUBLE - 1) AS lam FROM {rows} d JOIN best{k} b USING ({feature}), unnest(range(0, 13)) t(g)"
        step *= 2 / 12
    return out + f", best AS (SELECT * FROM best{rounds - 1})"


@query(DENSE + likeliest_sql("dense", "feature_idx") + " SELECT feature_idx, round(lam, 5) AS lam, round(m, 5) AS mean, round(v, 5) AS var FROM best")
def power_lambdas(spark, d):
    return transform.Power.fit(dense(spark, d)).fitted.select("feature_idx", *[F.round(c, 5).alias(c) for c in ("lam", "mean", "var")])


@query(
    PROFILE + ", every AS (SELECT kmer, id, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT kmer FROM prof) CROSS JOIN (SELECT id FROM dna) LEFT JOIN prof USING (kmer, id))" + likeliest_sql("every", "kmer")
    + f""", y AS (SELECT id, kmer, value, ({YJ} - m) / sqrt(v) AS y FROM every JOIN best USING (kmer))
    SELECT kmer, round(any_value(b.lam), 5) AS lam, round(sum(y), 4) AS total, round(sum(y * y), 3) AS squares, round(max(CASE WHEN value = 0 THEN y END), 4) AS zero FROM y JOIN best b USING (kmer) GROUP BY 1""",
    "dna",
)
def power_profile(spark, d):
    """The power transform of a profile with implicit zeros; the SQL has them as rows."""
    long, n = cut(dna_profile(spark, d)), view(spark, d, "dna").count()
    model = transform.Power.fit(long, "kmer", n=n)
    model = transform.Power(cut(model.fitted), "kmer")
    y = F.col("value")
    present = model.transform(long).groupBy("kmer").agg(F.sum(y).alias("t"), F.sum(y * y).alias("s"), F.count("*").alias("m"))
    zero, absent = F.col("zero"), F.lit(n) - F.col("m")
    both = present.join(model.zeros().withColumnRenamed("value", "zero"), "kmer").join(model.fitted.select("kmer", "lam"), "kmer")
    total, squares = F.col("t") + absent * zero, F.col("s") + absent * zero * zero
    return both.select("kmer", F.round("lam", 5).alias("lam"), F.round(total, 4).alias("total"), F.round(squares, 3).alias("squares"), F.round(F.when(absent > 0, zero), 4).alias("zero"))


@query(PROFILE + " SELECT id, CAST(CAST('0x' || substr(md5(kmer), 1, 8) AS BIGINT) % 16 AS BIGINT) AS bucket, sum(value) AS value FROM prof GROUP BY 1, 2", "dna")
def hashed_features(spark, d):
    return transform.hash_features(dna_profile(spark, d), 16, "md5")


@query(PROFILE.replace(", 3) AS kmer", ", 5) AS kmer").replace("length(sequence) - 2", "length(sequence) - 4") + " SELECT kmer FROM prof, n GROUP BY kmer, n HAVING count(*) < floor(0.3 * n) AND count(*) >= 0.1 * n", "dna")
def occurrence_selection(spark, d):
    return select.by_occurrence(counting.count_profile(view(spark, d, "dna"), 5), view(spark, d, "dna").count(), 0.7, low=0.1)


@query(PROFILE + ", v AS (SELECT kmer, sum(value * value) / n - (sum(value) / n) * (sum(value) / n) AS x FROM prof, n GROUP BY kmer, n) SELECT kmer FROM v WHERE x > (SELECT quantile_cont(x, 0.3) FROM v)", "dna")
def variance_selection(spark, d):
    return select.by_variance(dna_profile(spark, d), view(spark, d, "dna").count(), 0.3)


@query(PROFILE + CHI + " SELECT kmer FROM chi WHERE chi > (SELECT quantile_cont(chi, 0.75) FROM chi)", "dna")
def chi_square_selection(spark, d):
    return select.by_chi_square(dna_profile(spark, d), view(spark, d, "dna").select("id", F.col("species").alias("label")))


REDUCED = """, idf AS (SELECT kmer, ln(n / count(*)) + 1 AS idf FROM prof, n GROUP BY kmer, n), w AS (SELECT id, kmer, value * idf AS value FROM prof JOIN idf USING (kmer)),
w0 AS (SELECT id, kmer, value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS value FROM w), d0 AS (SELECT kmer, count(*) AS df FROM w0 WHERE value <> 0 GROUP BY 1), k0 AS (SELECT kmer FROM d0, n WHERE df < floor(0.5 * n)),
w1 AS (SELECT * FROM w0 WHERE kmer IN (SELECT kmer FROM k0) OR NOT EXISTS (SELECT 1 FROM k0)), v AS (SELECT kmer, greatest(0, sum(value * value) / n - (sum(value) / n) * (sum(value) / n)) AS x FROM w1, n GROUP BY kmer, n),
k1 AS (SELECT kmer FROM v WHERE x > (SELECT quantile_cont(x, 0.05) FROM v)), w2 AS (SELECT * FROM w1 WHERE kmer IN (SELECT kmer FROM k1) OR NOT EXISTS (SELECT 1 FROM k1)),
lab AS (SELECT id, species AS label FROM dna), share AS (SELECT label, count(*) / (SELECT n FROM n) AS share FROM lab GROUP BY 1), tot AS (SELECT kmer, sum(value) AS total FROM w2 GROUP BY 1), obs AS (SELECT kmer, label, sum(value) AS o FROM w2 JOIN lab USING (id) GROUP BY 1, 2),
chi AS (SELECT t.kmer, sum((coalesce(o.o, 0) - s.share * t.total) * (coalesce(o.o, 0) - s.share * t.total) / (s.share * t.total)) AS chi FROM tot t CROSS JOIN share s LEFT JOIN obs o ON o.kmer = t.kmer AND o.label = s.label GROUP BY 1),
k2 AS (SELECT kmer FROM chi WHERE chi > (SELECT quantile_cont(chi, 0.75) FROM chi)) SELECT id, kmer, value FROM prof WHERE kmer IN (SELECT kmer FROM w2 WHERE kmer IN (SELECT kmer FROM k2) OR NOT EXISTS (SELECT 1 FROM k2))"""


@query(PROFILE.replace(", 3) AS kmer", ", 5) AS kmer").replace("length(sequence) - 2", "length(sequence) - 4").replace(" AS (", " AS MATERIALIZED (") + REDUCED.replace(" AS (", " AS MATERIALIZED ("), "dna")
def feature_reduction(spark, d):
    dna = view(spark, d, "dna")
    return select.reduce_features(counting.count_profile(dna, 5), dna.select("id", F.col("species").alias("label")), dna.count())


@query()
def forest_selection(spark, d):
    dna, long = view(spark, d, "dna"), dna_profile(spark, d)
    classes = transform.encode_labels(dna, "species").select("id", F.col("labels").cast("double").alias("idx"))
    return select.by_forest(long, classes, counting.index_vocabulary(long), trees=10, depth=4)


@query("SELECT c.id, c.species, l.idx AS labels FROM classes c LEFT JOIN (SELECT species, CAST(row_number() OVER (ORDER BY species) - 1 AS INT) AS idx FROM (SELECT DISTINCT species FROM classes WHERE id % 2 = 0)) l USING (species)", "classes")
def encoded_labels(spark, d):
    c = view(spark, d, "classes").select("id", "species")
    return transform.encode_labels(c, "species", stats.label_index(c.where("id % 2 = 0"), "species")).select("id", "species", "labels")


@query("SELECT id, CASE WHEN domain = 'Bacteria' THEN 1 ELSE -1 END AS labels FROM classes", "classes")
def one_class_encoding(spark, d):
    return transform.one_class_labels(view(spark, d, "classes").select("id", "domain")).select("id", "labels")


@query("SELECT id, array_to_string(list_transform(range(0, 5), lambda i: CASE WHEN i = CASE WHEN id % 6 < 5 THEN id % 6 END THEN 1 ELSE 0 END), ',') AS one_hot FROM classes", "classes")
def one_hot_labels(spark, d):
    rows = view(spark, d, "classes").select("id", F.when(F.col("id") % 6 < 5, (F.col("id") % 6).cast("int")).alias("labels"))
    return transform.one_hot(rows, 5).select("id", F.array_join(F.transform("one_hot", lambda x: x.cast("string")), ",").alias("one_hot"))


# decompositions


@query()
def truncated_svd(spark, d):
    long = dna_profile(spark, d)
    return profile.project(long, decompose.truncated_svd(long, counting.index_vocabulary(long), 5)).select("id", "component", *r6("value"))


@query()
def nmf_projection(spark, d):
    long = dna_profile(spark, d)
    return profile.project(long, decompose.nmf(long, counting.index_vocabulary(long), 3, rounds=3))


@query()
def dictionary_projection(spark, d):
    long = dna_profile(spark, d)
    return profile.project(long, decompose.dictionary(long, counting.index_vocabulary(long), 3, rounds=3))


# classifiers


def vectors(spark, d):
    """Embeddings as vectors, first five labels against the others."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") < 5).cast("double").alias("label"))


@query()
def linear_svm(spark, d):
    rows = vectors(spark, d)
    return classify.linear_svm(rows, stats.class_weights(rows.withColumn("rank", F.col("label").cast("int").cast("string")), "rank"), rounds=8).transform(rows).select("id", "label", "prediction")


@query()
def one_class_svm(spark, d):
    long = named(dense(spark, d))
    own = table(spark, d, "embeddings").where("label = 0").select(F.col("vec_id").alias("id"))
    return classify.OneClassSvm.fit(long.join(own, "id", "left_semi")).predict(long)


@query(
    PROFILE + """, s AS (SELECT species AS label, kmer, sum(value) AS s FROM prof JOIN dna USING (id) GROUP BY 1, 2), t AS (SELECT label, sum(s) AS total FROM s GROUP BY 1), h AS (SELECT species AS label, count(*) AS h FROM dna GROUP BY 1),
    base AS (SELECT h.label, ln(h / n) AS prior, -ln(total + 64.0) AS low FROM h JOIN t USING (label), n), g AS (SELECT id, label, sum(value * ln(s + 1.0)) AS g FROM prof JOIN s USING (kmer) GROUP BY 1, 2), x AS (SELECT id, sum(value) AS x FROM prof GROUP BY 1),
    z AS (SELECT x.id, b.label, prior + x * low + coalesce(g, 0) AS z FROM x CROSS JOIN base b LEFT JOIN g ON g.id = x.id AND g.label = b.label), e AS (SELECT id, label, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z)
    SELECT id, label, round(e / sum(e) OVER (PARTITION BY id), 6) AS p FROM e""",
    "dna",
)
def naive_bayes(spark, d):
    dna, long = view(spark, d, "dna"), dna_profile(spark, d)
    model = classify.NaiveBayes.fit(long, dna.select("id", F.col("species").alias("label")), 64)
    return model.predict(long).select("id", "label", *r6("p"))


@query(
    PROFILE + """, nn AS (SELECT greatest(1, least(64, CAST(n AS BIGINT) // 250)) AS c FROM n), cl AS (SELECT id, species AS label, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % c AS cluster FROM dna, nn),
    s AS (SELECT cluster, label, kmer, sum(value) AS s FROM prof JOIN cl USING (id) GROUP BY 1, 2, 3), t AS (SELECT cluster, label, sum(s) AS total FROM s GROUP BY 1, 2), h AS (SELECT cluster, label, CAST(count(*) AS DOUBLE) AS h FROM cl GROUP BY 1, 2),
    base AS (SELECT cluster, h.label, ln(h / sum(h) OVER (PARTITION BY cluster)) AS prior, -ln(total + 64.0) AS low FROM h JOIN t USING (cluster, label)), g AS (SELECT id, cluster, label, sum(value * ln(s + 1.0)) AS g FROM prof JOIN s USING (kmer) GROUP BY 1, 2, 3),
    x AS (SELECT id, sum(value) AS x FROM prof GROUP BY 1), z AS (SELECT x.id, b.cluster, b.label, prior + x * low + coalesce(g, 0) AS z FROM x CROSS JOIN base b LEFT JOIN g ON g.id = x.id AND g.label = b.label AND g.cluster = b.cluster),
    e AS (SELECT id, cluster, label, exp(z - max(z) OVER (PARTITION BY id, cluster)) AS e FROM z), p AS (SELECT id, cluster, label, e / sum(e) OVER (PARTITION BY id, cluster) AS p FROM e), m AS (SELECT id, label, sum(p) / c AS p FROM p, nn GROUP BY 1, 2, c)
    SELECT id, label, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, label) AS r FROM m) WHERE r = 1""",
    "dna",
)
def naive_bayes_clusters(spark, d):
    dna, long = view(spark, d, "dna"), dna_profile(spark, d)
    rows = profile.clusters(dna.select("id", F.col("species").alias("label")), 250)
    n = rows.select("cluster").distinct().count()
    return classify.argmax(classify.NaiveBayes.fit(long, rows, 64).ensemble(long, n)).select("id", "label", *r6("p"))


@query()
def sgd_classifier(spark, d):
    long = transform.MaxAbs.fit(named(dense(spark, d)), 1).transform(named(dense(spark, d)))
    rows = profile.clusters(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), 250)
    long = cut(long)
    models = linear.train_clusters(long, rows)
    return classify.argmax(linear.predict_clusters(long, models, rows.select("cluster").distinct().count()))


ENSEMBLE = "WITH ens AS (SELECT id, label, sum(p) / 3 AS p FROM member_probs GROUP BY 1, 2), best AS (SELECT id, max(p) AS p, arg_max(label, p) AS label FROM ens GROUP BY 1)"


@query(ENSEMBLE + " SELECT id, label, round(p, 6) AS p FROM ens", "member_probs")
def ensemble_average(spark, d):
    return classify.ensemble(view(spark, d, "member_probs"), 3).select("id", "label", *r6("p"))


@query(ENSEMBLE + " SELECT id, label, round(p, 6) AS p FROM best", "member_probs")
def argmax_prediction(spark, d):
    return classify.argmax(classify.ensemble(view(spark, d, "member_probs"), 3)).select("id", "label", *r6("p"))


@query(ENSEMBLE + " SELECT id, CASE WHEN p < 0.4 THEN 'Unknown' ELSE label END AS label, round(p, 6) AS p FROM best", "member_probs")
def threshold_prediction(spark, d):
    return classify.with_threshold(classify.argmax(classify.ensemble(view(spark, d, "member_probs"), 3)), 0.4).select("id", "label", *r6("p"))


@query(ENSEMBLE + " SELECT id, CASE WHEN p >= 0.6 THEN '1' WHEN p <= 0.4 THEN '0' ELSE 'Unknown' END AS label, CAST(round_even(p, 0) AS INT) AS rounded FROM best", "member_probs")
def binary_predictions(spark, d):
    best = classify.argmax(classify.ensemble(view(spark, d, "member_probs"), 3))
    return best.select("id", classify.binary_band("p", 0.2).alias("label"), classify.binary_round("p").alias("rounded"))


@query(
    """WITH one AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'Unknown' ELSE domain END AS label, CASE WHEN id % 4 = 0 THEN 0.5 ELSE 0.9 END AS p FROM classes)
    SELECT id, 'domain' AS rank, label, CAST(p AS DOUBLE) AS p FROM one UNION ALL SELECT c.id, 'genus', CASE WHEN c.id % 3 = 0 THEN 'Unknown' ELSE c.genus END, CAST(CASE WHEN c.id % 3 = 0 THEN 0.5 ELSE 0.9 END AS DOUBLE) FROM classes c WHERE c.id % 4 <> 0""",
    "classes",
)
def top_down_prediction(spark, d):
    classes = view(spark, d, "classes")

    def scorer(rank, every):
        return lambda data: classes.join(data.select("id"), "id", "left_semi").select("id", F.col(rank).alias("label"), F.when(F.col("id") % every == 0, 0.5).otherwise(0.9).alias("p"))

    return classify.top_down(classes.select("id"), ["domain", "genus"], {"domain": scorer("domain", 4), "genus": scorer("genus", 3)}, 0.8)


@query(
    """WITH b AS (SELECT y_true, y_pred, count(*) AS n FROM predictions GROUP BY 1, 2), t AS (SELECT y_true AS label, CAST(sum(n) AS DOUBLE) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS hit FROM b GROUP BY 1),
    q AS (SELECT y_pred AS label, sum(n) AS named FROM b GROUP BY 1), e AS (SELECT support, hit / named AS p, hit / support AS r FROM t LEFT JOIN q USING (label)),
    f AS (SELECT *, CASE WHEN p IS NOT NULL AND p + r > 0 THEN 2 * p * r / (p + r) END AS f FROM e)
    SELECT round(sum(p * support) / sum(CASE WHEN p IS NOT NULL THEN support END), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(CASE WHEN f IS NOT NULL THEN support END), 6) AS f FROM f""",
    "predictions",
)
def cross_validation_scores(spark, d):
    return classify.cross_scores(view(spark, d, "predictions")).select(*r6("precision", "recall", "f"))


@query("SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS score FROM predictions", "predictions")
def validation_score(spark, d):
    return classify.mean_score(view(spark, d, "predictions")).select(*r6("score"))


@query()
def hyper_parameter_search(spark, d):
    return classify.search(vectors(spark, d).select("features", "label"), LogisticRegression(maxIter=5), {"regParam": [0.0, 0.1]})[1]


TUNED = HASH.format(3, "CAST(id AS VARCHAR)")


@query(
    PROFILE + f""", lab AS (SELECT id, species AS label, {TUNED} % 3 AS fold FROM dna), f AS (SELECT CAST(f AS BIGINT) AS fold FROM range(0, 3) t(f)), al AS (SELECT unnest([0.01, 1.0, 20.0]) AS alpha),
    s AS (SELECT fold, label, kmer, sum(value) AS s FROM prof JOIN lab USING (id) GROUP BY 1, 2, 3), tr AS (SELECT f.fold, label, kmer, sum(s) AS s FROM s JOIN f ON s.fold <> f.fold GROUP BY 1, 2, 3), st AS (SELECT fold, label, sum(s) AS total FROM tr GROUP BY 1, 2),
    pr AS (SELECT f.fold, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY f.fold) AS al FROM lab JOIN f ON lab.fold <> f.fold GROUP BY 1, 2),
    z AS (SELECT l.id, l.fold, l.label AS y_true, pr.label AS y_pred, alpha, ln(any_value(n / pr.al)) + sum(value * (ln(coalesce(tr.s, 0) + alpha) - ln(coalesce(total, 0) + alpha * 64))) AS z
        FROM lab l JOIN prof p USING (id) JOIN pr ON pr.fold = l.fold LEFT JOIN st ON st.fold = l.fold AND st.label = pr.label CROSS JOIN al LEFT JOIN tr ON tr.fold = l.fold AND tr.label = pr.label AND tr.kmer = p.kmer GROUP BY 1, 2, 3, 4, 5),
    predictions AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, alpha ORDER BY round(z, 9) DESC, y_pred) AS r FROM z) WHERE r = 1),
    b AS (SELECT alpha, fold, y_true, y_pred, count(*) AS n FROM predictions GROUP BY 1, 2, 3, 4), t AS (SELECT alpha, fold, y_true AS label, CAST(sum(n) AS DOUBLE) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS hit FROM b GROUP BY 1, 2, 3),
    q AS (SELECT alpha, fold, y_pred AS label, sum(n) AS named FROM b GROUP BY 1, 2, 3), e AS (SELECT alpha, fold, support, hit / named AS p, hit / support AS r FROM t LEFT JOIN q USING (alpha, fold, label)),
    g AS (SELECT *, CASE WHEN p IS NOT NULL AND p + r > 0 THEN 2 * p * r / (p + r) END AS f FROM e)
    SELECT CAST(alpha AS DOUBLE) AS alpha, fold, round(sum(p * support) / sum(CASE WHEN p IS NOT NULL THEN support END), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(CASE WHEN f IS NOT NULL THEN support END), 6) AS f FROM g GROUP BY 1, 2""",
    "dna",
)
def naive_bayes_search(spark, d):
    """All settings of the smoothing over all folds, from one set of sums."""
    dna = view(spark, d, "dna").select("id", F.col("species").alias("label"))
    return tune.naive_bayes_search(dna_profile(spark, d), dna, 64, [{"alpha": a} for a in (0.01, 1.0, 20.0)], folds=3, seed=3).select("alpha", "fold", *r6("precision", "recall", "f"))


@query()
def linear_search(spark, d):
    """Random settings of linear models over folds, trained side by side."""
    long = transform.MaxAbs.fit(named(dense(spark, d)), 1).transform(named(dense(spark, d)))
    classes = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"))
    space = {"rate": ("log", 0.02, 0.5), "penalty": ("log", 1e-5, 1e-1)}
    return tune.linear_search(long, classes, tune.draws(space, 4, seed=1), folds=3, seed=1, rounds=10)


@query()
def perceptron_classifier(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    return classify.perceptron(e, 64, 10, rounds=15).transform(e).select("id", "label", "prediction")


@query(DENSE + ", dot AS (SELECT id, sum(value * (feature_idx - 31.5)) AS z FROM dense GROUP BY 1) SELECT id, round(1 / (1 + exp(-z)), 5) AS p FROM dot")
def external_scorer(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))

    def score(x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(x @ (np.arange(64) - 31.5))))
        return np.stack([p], axis=1)

    return classify.external(e, score, ["1"]).select("id", F.round("p", 5).alias("p"))


@query()
def model_registry(spark, d):
    path, rows = scratch(spark, "models"), vectors(spark, d)
    counts = rows.withColumn("features", array_to_vector(F.transform(profile_array("features"), lambda x: F.abs(x))))
    models = classify.Registry(spark, path)
    models.fit(["domain"], lambda rank: MlNaiveBayes().fit(counts))
    from pyspark.ml.classification import NaiveBayesModel

    return models.load(["domain"], NaiveBayesModel)["domain"].transform(counts).select("id", "prediction")


def profile_array(col: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(col)


def naive_bayes_sql(tag: str, rank: str) -> str:
    """CTEs that end in ``best_<tag>``: id, label, p of naive Bayes over ``prof`` at one rank, Unknown below 0.6."""
    t = tag
    return f""", s_{t} AS (SELECT {rank} AS label, kmer, sum(value) AS s FROM prof JOIN classes USING (id) GROUP BY 1, 2), t_{t} AS (SELECT label, sum(s) AS total FROM s_{t} GROUP BY 1),
    h_{t} AS (SELECT {rank} AS label, CAST(count(*) AS DOUBLE) AS h FROM classes GROUP BY 1), b_{t} AS (SELECT label, ln(h / n) AS prior, -ln(total + 64.0) AS low FROM h_{t} JOIN t_{t} USING (label), n),
    g_{t} AS (SELECT id, label, sum(value * ln(s + 1.0)) AS g FROM prof JOIN s_{t} USING (kmer) GROUP BY 1, 2), x_{t} AS (SELECT id, sum(value) AS x FROM prof GROUP BY 1),
    z_{t} AS (SELECT x.id, b.label, prior + x * low + coalesce(g, 0) AS z FROM x_{t} x CROSS JOIN b_{t} b LEFT JOIN g_{t} g ON g.id = x.id AND g.label = b.label),
    e_{t} AS (SELECT id, label, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z_{t}), p_{t} AS (SELECT id, label, e / sum(e) OVER (PARTITION BY id) AS p FROM e_{t}),
    r_{t} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, label) AS r FROM p_{t}), best_{t} AS (SELECT id, CASE WHEN p < 0.6 THEN 'Unknown' ELSE label END AS label, p FROM r_{t} WHERE r = 1)"""


@query(
    PROFILE + naive_bayes_sql("d", "domain") + naive_bayes_sql("f", "family") + """ SELECT id, 'domain' AS rank, label, round(p, 6) AS p FROM best_d
    UNION ALL SELECT id, 'family', label, round(p, 6) FROM best_f WHERE id IN (SELECT id FROM best_d WHERE label <> 'Unknown')""",
    "dna",
    "classes",
)
def metagenome_classification(spark, d):
    dna = view(spark, d, "dna")
    return classify_metagenome(dna, dna, view(spark, d, "classes"), ["domain", "family"], 3, 0.6).select("id", "rank", "label", *r6("p"))


@query(
    PROFILE + naive_bayes_sql("f", "family") + " SELECT id, 'family' AS rank, label, round(p, 6) AS p FROM best_f",
    "dna",
    "classes",
)
def rank_models(spark, d):
    """A chain of two ranks: both trained, one dropped, only that one trained again, its answers as before."""
    path, long, classes = scratch(spark, "ranks"), cut(dna_profile(spark, d)), view(spark, d, "classes")
    models = registry.RankModels(spark, path)
    known = classes.select("id", "domain", "family")
    assert models.fit(["domain", "family"], long, known, 64, domain={"negative": "Archaea", "rounds": 2}) == ["domain", "family"]
    models.drop("family")
    assert models.fit(["domain", "family"], long, known, 64) == ["family"]
    best = classify.with_threshold(classify.argmax(models.scorers(["domain", "family"], long)["family"](classes.select("id"))), 0.6)
    return best.select("id", F.lit("family").alias("rank"), "label", *r6("p"))


# reports

COUNTS = "WITH cnt AS (SELECT rank, label, count(*) AS n FROM ranked WHERE label <> 'Unknown' GROUP BY 1, 2), ab AS (SELECT *, CAST(sum(n) OVER (PARTITION BY rank) AS BIGINT) AS total FROM cnt), dom AS (SELECT * FROM ranked WHERE rank = 'domain'), rc AS (SELECT 'total' AS item, count(DISTINCT id) AS n FROM dom UNION ALL SELECT 'classified', count(*) FROM dom WHERE label <> 'Unknown' UNION ALL SELECT 'bacteria', count(*) FROM dom WHERE lower(label) IN ('bacteria', 'bact') UNION ALL SELECT 'host', count(*) FROM dom WHERE lower(label) = 'host' UNION ALL SELECT 'unknown', count(*) FROM dom WHERE label = 'Unknown')"


@query(COUNTS + " SELECT rank, label, n, total FROM ab", "ranked")
def abundance_counts(spark, d):
    return report.abundances(view(spark, d, "ranked"))


@query(COUNTS + " SELECT item, n FROM rc", "ranked")
def read_counts(spark, d):
    return report.read_counts(view(spark, d, "ranked"))


@query(COUNTS + " SELECT item, n, round(CASE WHEN item <> 'total' THEN 100.0 * n / (SELECT n FROM rc WHERE item = 'total') END, 6) AS share FROM (SELECT * FROM rc UNION ALL SELECT rank || ' ' || label, n FROM ab)", "ranked")
def summary_table(spark, d):
    return report.summary(view(spark, d, "ranked")).select("item", "n", F.round(F.nanvl("share", F.lit(None).cast("double")), 6).alias("share"))


@query("SELECT 'd__' || domain || '|f__' || family || '|g__' || genus || '|s__' || species AS string, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM classes), 6) AS share FROM classes GROUP BY 1", "classes")
def taxonomic_strings(spark, d):
    return report.taxonomic_strings(view(spark, d, "classes"), ["domain", "family", "genus", "species"]).select("string", "n", *r6("share"))


@query(COUNTS + ", g AS (SELECT DISTINCT genus, family, CASE WHEN 1 = 1 THEN domain END AS domain FROM classes) SELECT a.label AS genus, a.n, g.family, g.domain FROM ab a LEFT JOIN g ON a.label = g.genus WHERE a.rank = 'genus'", "ranked", "classes")
def abundance_lineage(spark, d):
    counts = report.abundances(view(spark, d, "ranked"))
    return report.with_lineage(counts, view(spark, d, "classes"), "genus", RANKS).select("genus", "n", "family", "domain")


@query(COUNTS + ", g AS (SELECT DISTINCT genus, family, domain FROM classes) SELECT a.n, g.domain, g.family, a.label AS genus FROM ab a LEFT JOIN g ON a.label = g.genus WHERE a.rank = 'genus' UNION ALL SELECT n, label, NULL, NULL FROM ab WHERE rank = 'domain'", "ranked", "classes")
def chart_table(spark, d):
    return report.chart_table(report.abundances(view(spark, d, "ranked")), view(spark, d, "classes"), ["genus", "family", "domain"])


@query(
    """WITH g AS (SELECT DISTINCT genus, family, domain FROM classes), one AS (SELECT id, label FROM ranked WHERE rank = 'genus' AND label <> 'Unknown') SELECT one.id, one.label AS genus, g.family, g.domain FROM one LEFT JOIN g ON one.label = g.genus
    UNION ALL SELECT id, NULL, NULL, label FROM ranked WHERE rank = 'domain' AND label <> 'Unknown' AND id NOT IN (SELECT id FROM one)""",
    "ranked",
    "classes",
)
def full_report(spark, d):
    return report.full_report(view(spark, d, "ranked"), view(spark, d, "classes"), ["genus", "family", "domain"])
