"""Search of settings over folds (C13, C14): every setting is tried on every fold, side by side where a model allows it.

Folds come from a hash of the id and settings from a seed, so neither depends on how the rows are dealt.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seeded_hash
from . import linear
from .classify import cross_scores
from .lineage import cut, dropped


def draws(space: dict, n: int, seed: int = 0) -> list[dict]:
    """``n`` settings: each parameter from ``("uniform", low, high)``, ``("log", low, high)`` or a list of values."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        one = {}
        for name, how in sorted(space.items()):
            if isinstance(how, list):
                one[name] = how[rng.randrange(len(how))]
            elif how[0] == "uniform":
                one[name] = rng.uniform(how[1], how[2])
            else:
                one[name] = math.exp(rng.uniform(math.log(how[1]), math.log(how[2])))
        out.append(one)
    return out


def grid(space: dict[str, list]) -> list[dict]:
    """Every combination of the values."""
    out: list[dict] = [{}]
    for name, values in sorted(space.items()):
        out = [one | {name: v} for one in out for v in values]
    return out


def with_fold(rows: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold``, from a hash of the id."""
    return rows.withColumn("fold", F.pmod(seeded_hash(seed, "id"), F.lit(folds)))


def _settings(spark, settings: list[dict]) -> DataFrame:
    names = list(settings[0])
    return spark.createDataFrame([(k, *(s[c] for c in names)) for k, s in enumerate(settings)], ["trial", *names])


def best_of(scores: DataFrame, by: str = "f") -> dict:
    """The setting of the best mean over its folds, the first of equals."""
    names = [c for c in scores.columns if c not in ("fold", "precision", "recall", "f")]
    row = scores.groupBy(*names).agg(F.avg(by).alias("_mean")).orderBy(F.desc_nulls_last("_mean"), "trial").first()  # a row for each setting
    return {c: row[c] for c in names if c != "trial"}


def cross_validated(long: DataFrame, classes: DataFrame, run: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], folds: int = 5, seed: int = 0) -> DataFrame:
    """``fold, precision, recall, f`` of any classifier (C13): for each fold it is trained on the others.

    ``run`` takes the training profile, its classes (id, label) and the profile of the fold, and returns id, label.
    """
    dealt, out = cut(with_fold(classes.select("id", "label"), folds, seed)), None
    for fold in range(folds):
        train, held = dealt.where(F.col("fold") != fold).drop("fold"), dealt.where(F.col("fold") == fold)
        named = run(long.join(train.select("id"), "id", "left_semi"), train, long.join(held.select("id"), "id", "left_semi")).select("id", F.col("label").alias("y_pred"))
        rows = cut(held.join(named, "id", "left").select("fold", F.col("label").alias("y_true"), F.coalesce("y_pred", F.lit("Unknown")).alias("y_pred")))
        out = rows if out is None else out.unionByName(rows)
    return cross_scores(out, ["fold"])


def naive_bayes_search(long: DataFrame, classes: DataFrame, features: int, settings: list[dict], folds: int = 5, seed: int = 0) -> DataFrame:
    """``trial, alpha, fold, precision, recall, f`` of naive Bayes for each ``alpha`` of ``settings``.

    The sums of each fold by label and k-mer are made once; those that train a fold are all sums less its own. A row's
    likelihood under every setting is one column of the same aggregate.
    """
    alphas = [float(s["alpha"]) for s in settings]
    rows = cut(with_fold(classes.select("id", "label"), folds, seed))
    own = long.join(rows, "id").select("id", "fold", "label", "kmer", "value")
    by_fold = own.groupBy("label", "kmer", "fold").agg(F.sum("value").alias("s"))
    every = by_fold.groupBy("label", "kmer").agg(F.sum("s").alias("all"), F.map_from_entries(F.collect_list(F.struct("fold", "s"))).alias("of"))  # an entry for each fold
    each = every.select("label", "kmer", "all", "of", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("f"))
    fold = F.col("f").cast("long")
    sums = cut(each.select(fold.alias("fold"), "label", "kmer", (F.col("all") - F.coalesce(F.try_element_at("of", fold), F.lit(0.0))).alias("s")).where("s > 0"))
    totals = sums.groupBy("fold", "label").agg(F.sum("s").alias("total"))
    held = rows.groupBy("label").pivot("fold", list(range(folds))).count().na.fill(0)
    counts = sum(F.col(str(k)) for k in range(folds))
    trained = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("fold"), (counts - F.col(str(k))).alias("n")) for k in range(folds)]))
    priors = held.select("label", trained.alias("t")).select("t.fold", "label", "t.n").where("n > 0")
    priors = priors.join(priors.groupBy("fold").agg(F.sum("n").alias("rows")), "fold").join(totals, ["fold", "label"], "left").na.fill(0.0, ["total"])
    gained = own.drop("label").join(sums, ["fold", "kmer"]).groupBy("id", "label").agg(*[F.sum(F.col("value") * (F.log(F.col("s") + a) - math.log(a))).alias(f"g{k}") for k, a in enumerate(alphas)])
    of_row = own.groupBy("id", "fold").agg(F.sum("value").alias("x")).join(rows.select("id", F.col("label").alias("y_true")), "id")
    scored = of_row.join(F.broadcast(priors), "fold").join(gained, ["id", "label"], "left").na.fill(0.0)  # priors: a row for each fold and label
    z = [F.log(F.col("n") / F.col("rows")) + F.col("x") * (math.log(a) - F.log(F.col("total") + a * features)) + F.col(f"g{k}") for k, a in enumerate(alphas)]
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("trial"), F.round(v, 9).alias("p")) for k, v in enumerate(z)]))
    named = scored.select("id", "fold", "y_true", "label", stacked.alias("t")).select("id", "fold", "y_true", "label", "t.trial", "t.p")
    best = named.groupBy("id", "trial", "fold", "y_true").agg(F.min(F.struct((-F.col("p")).alias("m"), "label")).alias("b"))
    scores = cross_scores(best.select("trial", "fold", "y_true", F.col("b.label").alias("y_pred")), ["trial", "fold"])
    return scores.join(F.broadcast(_settings(long.sparkSession, settings)), "trial").select("trial", *settings[0], "fold", "precision", "recall", "f")  # a row for each setting


def linear_search(long: DataFrame, classes: DataFrame, settings: list[dict], folds: int = 5, seed: int = 0, rounds: int = 20) -> DataFrame:
    """``trial, rate, penalty, fold, precision, recall, f`` of linear models of two classes. ``classes``: id, y (1 or -1).

    Setting and fold name a model; all are trained side by side, each on the rows of the other folds, and every row is then
    scored by the models that have not seen it.
    """
    spark = long.sparkSession
    rows = cut(with_fold(classes.select("id", F.col("y").cast("double").alias("y")), folds, seed))
    models = [(f"{t}:{f}", t, f, float(s["rate"]), float(s["penalty"])) for t, s in enumerate(settings) for f in range(folds)]
    table = spark.createDataFrame(models, "model string, trial long, out long, rate double, penalty double")
    sides = rows.groupBy("fold").pivot("y", [1.0, -1.0]).count().na.fill(0).collect()  # two numbers for each fold
    of = {s: sum(r[s] for r in sides) for s in ("1.0", "-1.0")}
    seen = {f: {s: of[s] - sum(r[s] for r in sides if r["fold"] == f) for s in of} for f in range(folds)}
    weight = [(f, y, (seen[f]["1.0"] + seen[f]["-1.0"]) / (2.0 * max(1, seen[f][str(y)]))) for f in range(folds) for y in (1.0, -1.0)]
    per_side = table.join(spark.createDataFrame(weight, "out long, y double, weight double"), "out").select("model", "out", "y", "weight")
    targets = rows.join(F.broadcast(per_side), (rows["y"] == per_side["y"]) & (rows["fold"] != per_side["out"])).select("model", "id", rows["y"], "weight")  # models of both sides
    full = cut(linear.with_bias(long.select("id", "kmer", "value")))
    weights = linear.train(full, targets, table.select("model", "rate", "penalty"), rounds=rounds)
    found = rows.join(F.broadcast(table), rows["fold"] == table["out"]).join(linear.margins(full, weights), ["model", "id"], "left").na.fill(0.0, ["margin"])
    named = found.select("trial", "fold", F.col("y").alias("y_true"), F.when(F.col("margin") >= 0, 1.0).otherwise(-1.0).alias("y_pred"))
    scores = cut(cross_scores(named, ["trial", "fold"]))
    dropped(full, weights)
    return scores.join(F.broadcast(table.select("trial", "rate", "penalty").distinct()), "trial").select("trial", "rate", "penalty", "fold", "precision", "recall", "f")
