"""Profiles as tables: projections, joins, unions, samples. ``long``: id, kmer, value with implicit zeros."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical_domain, seeded_hash
from .lineage import with_position


def keep_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns of the keep-list that exist, in the table's order."""
    return df.select(*[c for c in df.columns if c in keep])


def select_features(long: DataFrame, keep: DataFrame) -> DataFrame:
    """Features of the keep-list (P7); ``keep``: kmer. An index comes from ``index_vocabulary`` on it."""
    return long.join(keep.select("kmer").distinct(), "kmer", "left_semi").select("id", "kmer", "value")


def to_arrays(long: DataFrame, vocab: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``id, features array<double>``: dense rows in the order of ``feature_idx`` (P8); meant for small vocabularies.

    The entries of a batch of rows are set at once in one block of zeros.
    """
    width = int(vocab.agg(F.max("feature_idx") + 1).first()[0] or 0)
    placed = long.join(vocab.select("kmer", F.col("feature_idx").cast("long").alias("feature_idx")), "kmer").groupBy("id").agg(F.collect_list(F.struct("feature_idx", "value")).alias("e"))
    if ids is not None:
        placed = ids.select("id").join(placed, "id", "left")
    packed = placed.select("id", F.coalesce("e.feature_idx", F.array().cast("array<long>")).alias("at"), F.coalesce("e.value", F.array().cast("array<double>")).alias("value"))
    rows_at_once = max(1, (1 << 20) // max(1, width))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), rows_at_once):
                part = batch.slice(k, rows_at_once)
                out = np.zeros((len(part), width))
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                out[np.repeat(np.arange(len(part)), sizes), part.column(1).flatten().to_numpy()] = part.column(2).flatten().to_numpy()
                offsets = pa.array(np.arange(0, (len(part) + 1) * width, width) if width else np.zeros(len(part) + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["id", "features"])

    return packed.mapInArrow(filled, f"id {placed.schema['id'].dataType.simpleString()}, features array<double>")


def to_vectors(long: DataFrame, vocab: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``id, features`` as Spark ML vectors."""
    return to_arrays(long, vocab, ids).withColumn("features", array_to_vector("features"))


def to_long(arrays: DataFrame, id_col: str = "id", features_col: str = "features", zeros: bool = False) -> DataFrame:
    """``id, feature_idx, value`` of a dense column, array or vector (P9); zeros stay implicit unless asked for."""
    kind = arrays.schema[features_col].dataType.typeName()
    values = F.col(features_col) if kind == "array" else vector_to_array(features_col)
    out = arrays.select(F.col(id_col).alias("id"), F.posexplode(values).alias("feature_idx", "value"))
    return out if zeros else out.where("value <> 0")


def project(long: DataFrame, components: DataFrame) -> DataFrame:
    """``id, component, value``: X times the transposed components, ``component, kmer, weight`` (P10)."""
    return long.join(components, "kmer").groupBy("id", "component").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def with_classes(seqs: DataFrame, classes: DataFrame) -> DataFrame:
    """Left join on id (J1); classes are cut to the ids at hand first (J2), which also bounds the other side."""
    return seqs.join(classes.join(seqs.select("id"), "id", "left_semi"), "id", "left")


def first_classes(classes: DataFrame, seqs: DataFrame, order: str) -> DataFrame:
    """Classes of the ids at hand, the first row by ``order`` of each id."""
    own = classes.join(seqs.select("id"), "id", "left_semi")
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("_n = 1").drop("_n")


def subset(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """Sequences of the id list."""
    return seqs.join(ids.select("id").distinct(), "id", "left_semi")


def reads_to_genomes(reads: DataFrame, classes: DataFrame, by_prefix: bool = True) -> DataFrame:
    """Classes of the genome whose id a read's id holds; of several the last class row wins.

    ``reads``: read_id; ``classes``: id, pos and ranks. With ``by_prefix`` a read id is ``<genome>_<anything>`` and the
    join is an equi-join; otherwise any substring counts, and reads are joined by all their substrings of the lengths that
    genome ids have.
    """
    named = classes.withColumnRenamed("id", "genome_id")
    if by_prefix:
        joined = reads.withColumn("genome_id", F.regexp_extract("read_id", r"^(.*)_[^_]*$", 1)).join(named, "genome_id", "left")
    else:
        sizes = [r[0] for r in classes.select(F.length("id")).distinct().collect() if r[0]]  # a row for each length
        part = [F.expr(f"transform(sequence(1, greatest(1, length(read_id) - {n - 1})), i -> substring(read_id, i, {n}))") for n in sizes]
        every = F.array_distinct(F.concat(*part)) if part else F.array(F.lit(None).cast("string"))
        joined = reads.withColumn("genome_id", F.explode_outer(every)).join(named, "genome_id", "left")
    last = Window.partitionBy("read_id").orderBy(F.desc_nulls_last("pos"))
    won = joined.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return won.drop("_n", "genome_id", "pos").withColumnRenamed("read_id", "id")


def zip_rows(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str]) -> DataFrame:
    """Rows paired by position (J6); positions are global ranks by the given orders; raises on unequal counts."""
    if left.count() != right.count():
        raise ValueError("the tables have different numbers of rows")
    return with_position(left, order_left).join(with_position(right, order_right), "_pos").drop("_pos")


def merge_classifications(old: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier and new classifications on id, all ids once; where both have a column the new value wins."""
    shared = [c for c in old.columns if c in new.columns and c != "id"]
    renamed = reduce(lambda d, c: d.withColumnRenamed(c, f"_old_{c}"), shared, old)
    joined = renamed.join(new, "id", "full_outer")
    cols = [F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if c in shared else F.col(c) for c in [*old.columns, *(c for c in new.columns if c not in old.columns)]]
    return joined.select(*cols)


def remove_unknown(df: DataFrame, predictions: DataFrame, label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """Without rows predicted Unknown: the data and the predictions."""
    known = predictions.where(F.col(label_col) != "Unknown")
    return df.join(known.select("id"), "id", "left_semi"), known


def decode_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of each predicted index; unmapped stays null (P12). ``labels``: idx, label."""
    return predictions.join(labels.select(F.col("idx").alias("prediction"), "label"), "prediction", "left")


def resolve_ranks(requested: list[str] | str | None, available: list[str]) -> list[str]:
    """Requested ranks broad to specific (P13); ``available`` runs specific to broad; raises on unknown names."""
    wanted = available if requested in (None, "all") else [requested] if isinstance(requested, str) else list(requested)
    if missing := [r for r in wanted if r not in available]:
        raise ValueError(f"unknown ranks: {missing}; there are {available}")
    return [r for r in reversed(available) if r in wanted]


def before_rank(ranks: list[str], end: str | None) -> list[str]:
    """Ranks before ``end``, without it."""
    return ranks[: ranks.index(end)] if end in ranks else list(ranks)


def assert_same_k(one: DataFrame, two: DataFrame) -> int:
    """Both vocabularies have k-mers of one length."""
    found = [d.select(F.length("kmer").alias("k")).limit(1).collect() for d in (one, two)]
    sizes = {r[0]["k"] for r in found if r}
    if len(sizes) > 1:
        raise ValueError(f"k differs: {sorted(sizes)}")
    return sizes.pop() if sizes else 0


def union_hosts(db: DataFrame, host: DataFrame) -> DataFrame:
    """Database and host profiles on their common columns, domains made canonical."""
    cols = [c for c in db.columns if c in host.columns]
    return db.select(*cols).unionByName(host.select(*cols)).withColumn("domain", canonical_domain("domain"))


def merge_profiles(profiles: list[DataFrame]) -> DataFrame:
    """Profiles of different vocabularies: in long form a union by k-mer, absent features stay zero."""
    return reduce(lambda a, b: a.unionByName(b), profiles)


def union_common(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of both on the columns both have."""
    cols = [c for c in one.columns if c in two.columns]
    return one.select(*cols).unionByName(two.select(*cols))


def union_ragged(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of both, missing columns null (U4)."""
    return one.unionByName(two, allowMissingColumns=True)


def split_by_parent(classes: DataFrame, rank: str, parent: str) -> DataFrame:
    """``parent, rows, labels``: the classes in the parts that each label of the parent rank trains on."""
    return classes.groupBy(F.col(parent).alias("parent")).agg(F.count("*").alias("rows"), F.count_distinct(rank).alias("labels"))


def distinct_ids(*tables: DataFrame, id_col: str = "id") -> DataFrame:
    """``id``: each id of any of the tables once."""
    return reduce(lambda a, b: a.unionByName(b), [t.select(F.col(id_col).alias("id")) for t in tables]).distinct()


def sample_share(df: DataFrame, share: float = 0.1, seed: int = 0, id_col: str = "id") -> DataFrame:
    """A share of the rows by hash of id: the same rows however dealt (X1); never empty unless the table is.

    If the hash takes none, the row of the smallest hash is taken (T2).
    """
    picked = df.where(F.pmod(seeded_hash(seed, id_col), F.lit(1000)) < int(1000 * share))
    return picked if not picked.isEmpty() else random_rows(df, 1, seed, id_col)


def random_rows(df: DataFrame, n: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``n`` rows in random but reproducible order."""
    return df.orderBy(seeded_hash(seed, id_col), id_col).limit(n)


def clusters(df: DataFrame, batch_size: int, id_col: str = "id", most: int = 64) -> DataFrame:
    """Adds ``cluster``: about ``batch_size`` rows each, dealt by hash of id, at least one cluster.

    At most ``most`` clusters, larger ones then: each is a member of an ensemble that scores every row.
    """
    n = max(1, min(most, df.count() // batch_size))
    bucket = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("cluster", F.pmod(bucket, F.lit(n)))


def read_ratio(genomes):
    """How many reads to draw for each genome, by the number of genomes (X5): ten, five, two or one times."""
    # fixed values: limits of the number of genomes
    return F.when(genomes < 50_000, 10).when(genomes < 100_000, 5).when(genomes < 250_000, 2).otherwise(1)
