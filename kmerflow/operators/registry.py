"""Models of a chain of ranks in a folder (C11, C12): two-class models for some ranks, many-class ones for the others.

A model is tables of Parquet and a note that is written last: a rank without its note was not trained to the end and is
trained again, the others are not.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear
from .classify import NaiveBayes

#: Ranks of two classes, fixed values.
BINARY = ("domain", "bacteria", "host")


class LinearBinary:
    """``positive`` against all else by a balanced linear model in long form."""

    tables = ("weights",)

    def __init__(self, weights: DataFrame, note: dict) -> None:
        self.weights, self.note = weights, note

    @classmethod
    def fit(cls, long: DataFrame, classes: DataFrame, features: int, positive: str = "Bacteria", negative: str = "host", rounds: int = 20, rate: float = 0.1, penalty: float = 1e-4) -> LinearBinary:
        yes = F.col("label") == positive
        n, own = classes.agg(F.count("*"), F.count_if(yes)).first()
        of = {True: n / (2.0 * max(1, own)), False: n / (2.0 * max(1, n - own))}
        targets = classes.select(F.lit("m").alias("model"), "id", F.when(yes, 1.0).otherwise(-1.0).alias("y"), F.when(yes, of[True]).otherwise(of[False]).alias("weight"))
        size = long.groupBy("id").agg(F.sum("value").alias("_all"))
        settings = long.sparkSession.createDataFrame([("m", rate, penalty)], "model string, rate double, penalty double")
        shares = long.join(size, "id").withColumn("value", F.col("value") / F.col("_all")).drop("_all")
        return cls(linear.train(linear.with_bias(shares), targets, settings, rounds=rounds), {"positive": positive, "negative": negative})

    def predict(self, long: DataFrame) -> DataFrame:
        size = long.groupBy("id").agg(F.sum("value").alias("_all"))
        shares = long.join(size, "id").withColumn("value", F.col("value") / F.col("_all")).drop("_all")
        found = linear.margins(linear.with_bias(shares), self.weights)
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("margin") + 1) / 2))
        both = F.array(F.struct(F.lit(self.note["positive"]).alias("label"), p.alias("p")), F.struct(F.lit(self.note["negative"]).alias("label"), (1 - p).alias("p")))
        return found.select("id", F.explode(both).alias("r")).select("id", "r.label", "r.p")


class BayesMany:
    """Naive Bayes over all classes of a rank, as tables."""

    tables = ("weights", "priors")

    def __init__(self, weights: DataFrame, priors: DataFrame, note: dict) -> None:
        self.weights, self.priors, self.note = weights, priors, note

    @classmethod
    def fit(cls, long: DataFrame, classes: DataFrame, features: int, alpha: float = 1.0) -> BayesMany:
        model = NaiveBayes.fit(long, classes, features, alpha)
        return cls(model.weights, model.priors, {"features": features, "alpha": alpha})

    def predict(self, long: DataFrame) -> DataFrame:
        return NaiveBayes(self.weights, self.priors, self.note["features"], self.note["alpha"]).predict(long).select("id", "label", "p")


FAMILIES = {"linear": LinearBinary, "mnb": BayesMany}


class RankModels:
    """One folder of models by rank. ``binary`` and ``multiclass`` name the family that serves either kind of rank."""

    def __init__(self, spark: SparkSession, path: str, binary: str = "linear", multiclass: str = "mnb", binary_ranks: tuple[str, ...] = BINARY) -> None:
        if unknown := {binary, multiclass} - FAMILIES.keys():
            raise ValueError(f"no such family of models: {sorted(unknown)}")
        self.spark, self.path, self.binary, self.multiclass, self.binary_ranks = spark, path, binary, multiclass, binary_ranks

    def family(self, rank: str) -> str:
        return self.binary if rank in self.binary_ranks else self.multiclass

    def folder(self, rank: str) -> str:
        return f"{self.path}/{self.family(rank)}_{rank}"

    def has(self, rank: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(rank)}/note/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def missing(self, ranks: list[str]) -> list[str]:
        return [r for r in ranks if not self.has(r)]

    def fit(self, ranks: list[str], long: DataFrame, classes: DataFrame, features: int, **options: dict) -> list[str]:
        """Trains the ranks that have no model and returns them. ``classes``: id and a column for each rank; rows without a
        label at a rank do not train it. ``options``: for each rank, what its family takes."""
        fresh = self.missing(ranks)
        for rank in fresh:
            kind, folder = FAMILIES[self.family(rank)], self.folder(rank)
            rows = classes.select("id", F.col(rank).alias("label")).where("label is not null")
            model = kind.fit(long.join(rows.select("id"), "id", "left_semi"), rows, features, **options.get(rank, {}))
            for table in kind.tables:
                getattr(model, table).write.mode("overwrite").parquet(f"{folder}/{table}")
            self.spark.createDataFrame([(json.dumps(model.note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/note")
        return fresh

    def load(self, ranks: list[str]) -> dict[str, LinearBinary | BayesMany]:
        """The models of the ranks; a rank without one is an error."""
        if missing := self.missing(ranks):
            raise FileNotFoundError(f"no model for {missing} in {self.path}")
        out = {}
        for rank in ranks:
            kind, folder = FAMILIES[self.family(rank)], self.folder(rank)
            note = json.loads(self.spark.read.text(f"{folder}/note").first()["value"])
            out[rank] = kind(*[self.spark.read.parquet(f"{folder}/{t}") for t in kind.tables], note)
        return out

    def drop(self, rank: str) -> None:
        """Forgets the model of a rank."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(rank))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def scorers(self, ranks: list[str], long: DataFrame) -> dict:
        """Functions from rows (id) to id, label, p, as ``top_down`` takes them."""
        models = self.load(ranks)
        return {r: lambda data, m=models[r]: m.predict(long.join(data.select("id"), "id", "left_semi")) for r in ranks}
