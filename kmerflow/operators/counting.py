"""k-mer counting: discovery of the vocabulary, counts per sequence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_valid, kmers_of_chunk, upper_ascii
from . import packed
from .lineage import cut, with_position
from .transform import TfIdf

#: Sequences longer than this are cut into overlapping chunks, so that no row holds millions of windows.
CHUNK = 65_536


#: Inputs of fewer bytes a core than this may be dealt anew.
SMALL = 4 << 20
#: Up to so many ids that come in several rows are sent to all tasks.
SENT = 100_000
#: Up to so many factors of k-mers (a few MB) are sent to all tasks.
FACTORS = 1 << 18


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` dealt over ``partitions``, or, if it is small, as one file of a few megabytes is, over all cores. Larger inputs
    come in splits enough and are left as they are; their size is what the plan reckons, nothing is run for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if partitions is None and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * SMALL:
        return df
    return df.repartition(partitions or cores)


def tokens(seqs: DataFrame, k: int, include_last: bool = False, id_col: str = "id", sequence_col: str = "sequence") -> DataFrame:
    """``id, kmer``: one row per window (P1, P3). Short sequences and null give none."""
    rows = seqs.select(F.col(id_col).alias("id"), upper_ascii(sequence_col).alias("s")).where(F.length("s") >= k + (not include_last))
    parts = F.expr(f"sequence(0, cast((length(s) - {k}) div {CHUNK} as int))")
    cut = rows.select("id", "s", F.explode(parts).alias("c"))
    chunk = F.expr(f"substring(s, c * {CHUNK} + 1, {CHUNK + k - 1})")
    last = F.expr(f"c = cast((length(s) - {k}) div {CHUNK} as int)")
    return cut.select("id", F.explode(kmers_of_chunk(chunk, last, k, include_last)).alias("kmer"))


def fits(k: int, alphabet: str | None) -> bool:
    return bool(alphabet) and set(alphabet.encode()) == set(packed.LETTERS) and k <= packed.MOST


def discover_vocabulary(seqs: DataFrame, k: int, alphabet: str | None = "ATCG", include_last: bool = False) -> DataFrame:
    """``kmer, n``: the k-mers that occur, within the alphabet (A1, P2). Counts are combined before the shuffle.

    The four letters are packed, for k up to 64; other alphabets, and none, go by strings.
    """
    if fits(k, alphabet):
        return packed.total_counts(packed.chunks(seqs, k, include_last, CHUNK), k)
    found = tokens(seqs, k, include_last)
    if alphabet:
        found = found.where(is_valid("kmer", alphabet))
    return found.groupBy("kmer").agg(F.count("*").alias("n"))


def index_vocabulary(vocab: DataFrame) -> DataFrame:
    """``feature_idx, kmer``: positions by k-mer, the same however the data are dealt."""
    return with_position(vocab.select("kmer").distinct(), ["kmer"], "feature_idx").select("feature_idx", "kmer")


def count_profile(seqs: DataFrame, k: int, alphabet: str | None = "ATCG", vocabulary: DataFrame | None = None, include_last: bool = False) -> DataFrame:
    """``id, kmer, value`` of k-mers that occur (A2); with ``vocabulary`` only its k-mers count, unfiltered (A3).

    K-mers of the four letters are counted within the row that holds the sequence, and nothing is shuffled but ids; only
    sequences cut in chunks, and ids that come in several rows, are merged. Other alphabets, or a vocabulary that goes
    beyond the four letters, go by strings, one row a window.
    """
    if vocabulary is not None:
        vocabulary = vocabulary.select("kmer").distinct()
        alphabet = "ATCG" if vocabulary.where((F.length("kmer") != k) | ~is_valid("kmer", "ATCG")).isEmpty() else None
    if fits(k, alphabet):
        counts = packed_profile(seqs, k, include_last)
    else:
        found = tokens(seqs, k, include_last)
        found = found.where(is_valid("kmer", alphabet)) if alphabet else found
        counts = found.groupBy("id", "kmer").agg(F.count("*").cast("double").alias("value"))
    return counts if vocabulary is None else counts.join(vocabulary, "kmer", "left_semi").select("id", "kmer", "value")


def count_sums(seqs: DataFrame, k: int, alphabet: str | None = "ATCG", include_last: bool = False) -> DataFrame:
    """``kmer, df, total, squares`` of the profile that ``count_profile`` makes, without making it (A1, A2, A4, A5).

    ``df`` samples hold the k-mer, ``total`` times in all; ``squares`` is the sum of squared counts. Samples of one row are
    counted and summed in the tasks that read them, so what is shuffled has at most a row a k-mer for each task; samples of
    several chunks or rows are merged first. ``stats.moments_of`` makes mean and variance.
    """
    if fits(k, alphabet):
        one, merged = _packed_parts(seqs, k, include_last)
        return _sums([packed.row_sums(one, k)], merged)
    return _sums([], count_profile(seqs, k, alphabet, include_last=include_last))


def _sums(found: list[DataFrame], merged: DataFrame | None) -> DataFrame:
    if merged is not None:
        v = F.col("value")
        found = [*found, merged.select("kmer", F.lit(1).cast("long").alias("df"), v.alias("total"), (v * v).alias("squares"))]
    return reduce(DataFrame.unionByName, found).groupBy("kmer").agg(*[F.sum(c).alias(c) for c in ("df", "total", "squares")])


def tf_idf(seqs: DataFrame, k: int, n: int, alphabet: str | None = "ATCG", include_last: bool = False) -> DataFrame:
    """``id, kmer, value``: the profile that ``count_profile`` makes, weighed by ``TfIdf`` over ``n`` samples (M1).

    Samples of one row are weighed and scaled where they are counted, so the profile is shuffled nowhere; a factor for each
    of up to ``FACTORS`` k-mers is sent to the tasks. More, or longer, k-mers meet the profile in a join, as do samples of
    several chunks or rows.
    """
    if not fits(k, alphabet):
        long = count_profile(seqs, k, alphabet, include_last=include_last)
        return TfIdf.fit(long, n).transform(long)
    one, merged = _packed_parts(seqs, k, include_last)
    model = TfIdf.of_frequencies(_sums([packed.row_sums(one, k)], merged), n)
    if k > packed.WORD or model.idf.count() > FACTORS:
        long = packed.row_counts(one, k)
        return model.transform(long if merged is None else long.unionByName(merged))
    sent = model.idf.orderBy("kmer").toArrow()  # at most so many rows; codes sort as k-mers do
    out = packed.row_weights(one, k, packed.codes_of(sent.column("kmer").to_pylist()), sent.column("idf").to_numpy())
    return out if merged is None else out.unionByName(model.transform(merged).select("id", "kmer", "value"))


def packed_profile(seqs: DataFrame, k: int, include_last: bool = False) -> DataFrame:
    one, merged = _packed_parts(seqs, k, include_last)
    counts = packed.row_counts(one, k)
    return counts if merged is None else counts.unionByName(merged)


def _packed_parts(seqs: DataFrame, k: int, include_last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows that are whole samples, and the merged profile of samples that come in several chunks or rows, if there are any.

    One aggregate by id tells which there are; most inputs have none, and are then read once more and shuffled nowhere.
    """
    length, limit = F.length("sequence"), CHUNK + k
    facts = cut(seqs.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"), F.max(length).alias("_most")).where((F.col("_n") > 1) | (F.col("_most") >= limit)))
    again = facts.where("_n > 1").select("_id")
    repeated, any_long = again.count(), not facts.where(F.col("_most") >= limit).isEmpty()
    one = packed.whole(seqs.where(length.isNull() | (length < limit)) if any_long else seqs, include_last)
    parts = [packed.chunks(seqs.where(length >= limit), k, include_last, CHUNK)] if any_long else []
    if repeated:
        same = F.col("id").eqNullSafe(F.col("_id"))
        again = F.broadcast(again) if repeated <= SENT else again
        parts.append(one.join(again, same, "left_semi"))
        one = one.join(again, same, "left_anti")
    if not parts:
        return one, None
    return one, packed.row_counts(reduce(DataFrame.unionByName, parts), k).groupBy("id", "kmer").agg(F.sum("value").alias("value"))
