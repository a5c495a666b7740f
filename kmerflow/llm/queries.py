"""The registered queries of the operators, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import documents, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_digest, scan_licenses

    return license_digest(scan_licenses(documents(spark, sf_dir)))


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import compare_with_next

    return compare_with_next(documents(spark, sf_dir))


def op4_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_tree import count_edits

    return count_edits(documents(spark, sf_dir), RANKS, PATTERN)


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_pii, span_digest

    return span_digest(find_pii(documents(spark, sf_dir)), KINDS)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import codec_digest, round_trip

    return codec_digest(round_trip(documents(spark, sf_dir), RANKS, PATTERN))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join_groups

    return join_groups(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import span_digest
    from .secrets import KINDS, find_secrets

    return span_digest(find_secrets(documents(spark, sf_dir)), KINDS[:3])


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), RANKS, PATTERN)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import predictions

    return predictions(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import digest, mix

    return digest(mix(documents(spark, sf_dir)))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, digest

    rows = table(spark, sf_dir, "conversations")
    return digest(damaged(rows), rows)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
