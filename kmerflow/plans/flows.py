"""Extraction, reduction and classification from start to end, each a lazy plan but for what fits need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.classify import NaiveBayes, top_down
from ..operators.counting import count_profile, index_vocabulary
from ..operators.lineage import cut
from ..operators.select import reduce_features
from ..operators.transform import TfIdf


def extract_profile(seqs: DataFrame, k: int, alphabet: str | None = "ATCG") -> tuple[DataFrame, DataFrame]:
    """The long profile of sequences and its indexed vocabulary."""
    long = count_profile(seqs, k, alphabet)
    return long, index_vocabulary(long)


def top_features(seqs: DataFrame, k: int, top: int = 3) -> DataFrame:
    """``id, kmer, weight, place``: the features of the largest TF-IDF weight of each sequence, ties by k-mer."""
    long = count_profile(seqs, k)
    weighted = TfIdf.fit(long, seqs.count()).transform(long)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("value", 9)), "kmer"))
    return weighted.withColumn("place", place).where(F.col("place") <= top).select("id", "kmer", F.col("value").alias("weight"), "place")


def reduce_profile(long: DataFrame, classes: DataFrame, n: int, **options) -> DataFrame:
    return reduce_features(long, classes, n, **options)


def classify_metagenome(reads: DataFrame, db: DataFrame, classes: DataFrame, ranks: list[str], k: int, threshold: float = 0.8) -> DataFrame:
    """Top-down classification of reads by naive Bayes fitted per rank; ``ranks`` broad to specific."""
    train = cut(count_profile(db, k))
    test = train if reads is db else cut(count_profile(reads, k))
    features = 4**k
    scorers = {}
    for rank in ranks:
        model = NaiveBayes.fit(train, classes.select("id", F.col(rank).alias("label")).where("label is not null"), features)
        scorers[rank] = lambda data, model=model: model.predict(test.join(data.select("id"), "id", "left_semi")).select("id", "label", "p")
    return top_down(reads.select("id"), ranks, scorers, threshold)
