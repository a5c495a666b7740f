"""Feature transforms with fit and transform. Fitted values are DataFrames, so large vocabularies stay distributed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .stats import document_frequency, extremes, label_index


@dataclass(frozen=True)
class TfIdf:
    """``value * (ln(n / df) + 1)``, rows scaled to length one; zero rows stay zero; df = 0 has idf 0 (M1)."""

    idf: DataFrame

    @classmethod
    def fit(cls, long: DataFrame, n: int, vocabulary: DataFrame | None = None) -> TfIdf:
        return cls._of(document_frequency(long, vocabulary=vocabulary), n)

    @classmethod
    def of_frequencies(cls, df: DataFrame, n: int) -> TfIdf:
        """From ``kmer, df``, as ``counting.count_sums`` gives them without a profile.

        They are written as a table: its true size decides how the profile meets it, where a profile that is made on the way
        has the size of its sequences by the plan's reckoning and would be taken for the smaller side.
        """
        return cls._of(cut(df.select("kmer", "df")), n)

    @classmethod
    def _of(cls, df: DataFrame, n: int) -> TfIdf:
        return cls(df.select("kmer", F.when(F.col("df") > 0, F.log(F.lit(float(n)) / F.col("df")) + 1).otherwise(0.0).alias("idf")))

    def transform(self, long: DataFrame) -> DataFrame:
        scaled = long.join(self.idf, "kmer").withColumn("value", F.col("value") * F.col("idf")).drop("idf")
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("id")))
        return scaled.withColumn("_n", norm).withColumn("value", F.when(F.col("_n") > 0, F.col("value") / F.col("_n")).otherwise(0.0)).drop("_n")


@dataclass(frozen=True)
class MinMax:
    """``(x - min) / (max - min)``; a constant feature is divided by 1 (M2). Absent entries are zeros: where a min is not 0
    they become what ``zeros`` says, and need no rows."""

    bounds: DataFrame
    feature: str

    @classmethod
    def fit(cls, long: DataFrame, n: int, feature: str = "kmer") -> MinMax:
        return cls(extremes(long, n, feature), feature)

    def transform(self, long: DataFrame) -> DataFrame:
        return long.join(self.bounds, self.feature).withColumn("value", self._scaled(F.col("value"))).drop("low", "high", "peak")

    def zeros(self) -> DataFrame:
        """``feature, value`` of entries that are absent."""
        return self.bounds.select(self.feature, self._scaled(F.lit(0.0)).alias("value"))

    @staticmethod
    def _scaled(x):
        return (x - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)


@dataclass(frozen=True)
class MaxAbs:
    """``x / max|x|``; a zero feature stays zero (M3)."""

    bounds: DataFrame
    feature: str

    @classmethod
    def fit(cls, long: DataFrame, n: int, feature: str = "kmer") -> MaxAbs:
        return cls(extremes(long, n, feature).select(feature, "peak"), feature)

    def transform(self, long: DataFrame) -> DataFrame:
        return long.join(self.bounds, self.feature).withColumn("value", F.when(F.col("peak") > 0, F.col("value") / F.col("peak")).otherwise(0.0)).drop("peak")


def yeo_johnson(x, lam):
    """The Yeo-Johnson transform of one value."""
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


@dataclass(frozen=True)
class Power:
    """Yeo-Johnson per feature with the likeliest lambda, then standardized (M4).

    Takes dense rows, or with ``n``, the number of samples, a long profile whose absent entries are zeros. The transform of
    0 is 0 and adds nothing to the Jacobian, so mean, variance and likelihood follow from the other entries and ``n``; what
    absent entries become is said by ``zeros``. The likelihood of each lambda of a grid is one aggregate. Where the best
    lies at an end, the grid goes on beyond it, up to ``widen`` times; then it is refined around the best, so that there are
    ``rounds`` rounds in all; five leave steps of 0.0004. A feature that is constant has no likeliest lambda and gets the
    one of the grid nearest to 0.
    """

    fitted: DataFrame
    feature: str

    @classmethod
    def fit(cls, dense: DataFrame, feature: str = "feature_idx", low: float = -2.0, high: float = 4.0, steps: int = 13, rounds: int = 5, widen: int = 20, n: int | None = None) -> Power:
        rows = dense.select(feature, "value") if n is None else dense.where("value <> 0").select(feature, "value")
        step = (high - low) / (steps - 1)

        def likeliest(tried: DataFrame) -> DataFrame:
            y = yeo_johnson(F.col("value"), F.col("lam"))
            sign = F.signum("value") * F.log1p(F.abs("value"))
            stats = tried.withColumn("y", y).groupBy(feature, "lam").agg(F.count("*").alias("n"), F.var_pop("y").alias("var"), F.avg("y").alias("mean"), F.sum(sign).alias("jac"))
            if n is not None:  # m of n entries are not 0
                m = F.col("n") / float(n)
                stats = stats.select(feature, "lam", F.lit(n).alias("n"), (m * F.col("var") + m * (1 - m) * F.col("mean") * F.col("mean")).alias("var"), (m * F.col("mean")).alias("mean"), "jac")
            usable = (F.col("var") > 0) & ~F.isnan("var") & (F.col("var") < float("inf"))
            score = F.when(usable, -F.col("n") / 2 * F.log("var") + (F.col("lam") - 1) * F.col("jac")).otherwise(F.lit(float("-inf")))
            return stats.withColumn("score", score).groupBy(feature).agg(F.max_by(F.struct("lam", "mean", "var"), F.struct("score", -F.abs("lam"))).alias("b")).select(feature, "b.*")

        def beside(best: DataFrame, offsets: list) -> DataFrame:
            tried = rows.join(best, feature).withColumn("step", F.explode(F.array(*offsets)))
            return tried.withColumn("lam", F.col("lam") + F.col("step")).drop("step")

        best = likeliest(rows.withColumn("lam", F.explode(F.array(*[F.lit(low + step * k) for k in range(steps)]))))
        ends = F.when(F.col("lam") <= low, F.lit(-1.0)).when(F.col("lam") >= high, F.lit(1.0))
        if widen:
            best = cut(best.withColumn("side", ends))
        for _ in range(widen):
            at_end = best.where("side is not null")
            if at_end.isEmpty():
                break
            start = at_end.select(feature, F.col("lam").alias("from"), "side")
            further = likeliest(beside(at_end.select(feature, "lam", "side"), [F.col("side") * step * k for k in range(steps)])).join(start, feature)
            still = F.abs(F.col("lam") - F.col("from")) > step * (steps - 1.5)
            best = cut(best.where("side is null").unionByName(further.withColumn("side", F.when(still, F.col("side"))).drop("from")))
        best = best.drop("side")
        for _ in range(rounds - 1):
            best = likeliest(beside(best.select(feature, "lam"), [F.lit(step * (2 * k / (steps - 1) - 1)) for k in range(steps)]))
            step *= 2 / (steps - 1)
        return cls(best, feature)

    def transform(self, dense: DataFrame) -> DataFrame:
        return dense.join(self.fitted, self.feature).withColumn("value", self._standard(yeo_johnson(F.col("value"), F.col("lam")))).drop("lam", "mean", "var")

    def zeros(self) -> DataFrame:
        """``feature, value`` of entries that are absent."""
        return self.fitted.select(self.feature, self._standard(F.lit(0.0)).alias("value"))

    @staticmethod
    def _standard(y):
        return (y - F.col("mean")) / F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0)


def hash_features(long: DataFrame, buckets: int = 1000, how: str = "xxhash64") -> DataFrame:
    """Counts summed by hash bucket of the k-mer, ``id, bucket, value`` (M5)."""
    h = F.xxhash64("kmer") if how == "xxhash64" else F.conv(F.substring(F.md5("kmer"), 1, 8), 16, 10).cast("long")
    return long.groupBy("id", F.pmod(h, F.lit(buckets)).alias("bucket")).agg(F.sum("value").alias("value"))


def encode_labels(rows: DataFrame, rank: str, labels: DataFrame | None = None) -> DataFrame:
    """Adds ``labels``: index of the label, null if unseen."""
    index = label_index(rows, rank) if labels is None else labels
    return rows.join(index.select(F.col("label").alias(rank), F.col("idx").alias("labels")), rank, "left")


def one_class_labels(rows: DataFrame, rank: str = "domain") -> DataFrame:
    """Adds ``labels``: Bacteria 1, all else and null -1."""
    return rows.withColumn("labels", F.when(F.col(rank) == "Bacteria", 1).otherwise(-1))


def one_hot(rows: DataFrame, n: int, label_col: str = "labels") -> DataFrame:
    """Adds ``one_hot``: ``n`` zeros with a one at the label; null gives zeros."""
    return rows.withColumn("one_hot", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce((i == F.col(label_col)).cast("int"), F.lit(0))))


@dataclass(frozen=True)
class Chain:
    """Transforms fitted one on the other's output."""

    fitted: tuple

    @classmethod
    def fit(cls, long: DataFrame, n: int, steps: list) -> Chain:
        out = []
        for step in steps:
            model = step(long, n)
            long = model.transform(long)
            out.append(model)
        return cls(tuple(out))

    def transform(self, long: DataFrame) -> DataFrame:
        for model in self.fitted:
            long = model.transform(long)
        return long
