"""Classifiers and prediction algebra. Predictions are long: id, label, p (a probability for each class)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import linear
from .lineage import cut
from .profile import remove_unknown


def ensemble(members: DataFrame, n: int) -> DataFrame:
    """``id, label, p``: sum of the members' probabilities over their number; an absent class counts 0."""
    return members.groupBy("id", "label").agg((F.sum("p") / F.lit(n)).alias("p"))


def argmax(probabilities: DataFrame) -> DataFrame:
    """``id, label, p`` of the best class, ties to the lowest label."""
    best = probabilities.groupBy("id").agg(F.min(F.struct((-F.col("p")).alias("m"), "label")).alias("b"))
    return best.select("id", "b.label", (-F.col("b.m")).alias("p"))


def with_threshold(best: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Unknown where the best probability is below the threshold."""
    return best.withColumn("label", F.when(F.col("p") < threshold, F.lit("Unknown")).otherwise(F.col("label")))


def binary_band(p, threshold: float = 0.8, labels: tuple[str, str] = ("0", "1")):
    """Upper class from .5 + t/2 on, lower up to .5 - t/2, else Unknown."""
    c = F.col(p) if isinstance(p, str) else p
    return F.when(c >= 0.5 + threshold / 2, labels[1]).when(c <= 0.5 - threshold / 2, labels[0]).otherwise("Unknown")


def binary_round(p):
    """Half to even."""
    return F.rint(F.col(p) if isinstance(p, str) else p).cast("int")


def top_down(data: DataFrame, ranks: list[str], scorers: dict[str, Callable[[DataFrame], DataFrame]], threshold: float = 0.8) -> DataFrame:
    """``id, rank, label, p`` from broad to specific (C10). Rows that are Unknown at a rank go no further; an empty rest
    ends early with what there is. ``scorers``: rank -> function from data to id, label, p."""
    out = None
    for rank in ranks:
        best = cut(with_threshold(argmax(scorers[rank](data)), threshold))
        rows = best.select("id", F.lit(rank).alias("rank"), "label", "p")
        out = rows if out is None else out.unionByName(rows)
        data, _ = remove_unknown(data, best)
        if data.isEmpty():
            break
    return out


def cross_scores(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``precision, recall, f``: weighted by support, undefined classes left out (C13). ``predictions``: y_true, y_pred.

    With ``by`` one row for each value of these columns, as trials and folds are.
    """
    by = by or []
    both = predictions.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    true = both.groupBy(*by, F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("hit"))
    pred = both.groupBy(*by, F.col("y_pred").alias("label")).agg(F.sum("n").alias("named"))
    each = true.join(pred, [*by, "label"], "left")
    p, r = F.try_divide("hit", "named"), F.try_divide("hit", "support")
    each = each.select(*by, "support", p.alias("p"), r.alias("r")).withColumn("f", F.when(F.col("p").isNotNull() & (F.col("p") + F.col("r") > 0), 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))))
    mean = lambda c, name: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum(F.when(F.col(c).isNotNull(), F.col("support")))).alias(name)
    return each.groupBy(*by).agg(mean("p", "precision"), mean("r", "recall"), mean("f", "f"))


def mean_score(predictions: DataFrame) -> DataFrame:
    """Share of right predictions (C17)."""
    return predictions.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("score"))


class NaiveBayes:
    """Multinomial naive Bayes per cluster as joins and sums (C3): smoothing alpha, class priors from counts."""

    BLOCK = 64
    #: Models of up to so many cells, features times classes, are sent to the tasks, which score blocks of as many cells.
    SENT = 1 << 20

    def __init__(self, weights: DataFrame, priors: DataFrame, features: int, alpha: float) -> None:
        self.weights, self.priors, self.features, self.alpha = weights, priors, features, alpha

    @classmethod
    def fit(cls, long: DataFrame, classes: DataFrame, features: int, alpha: float = 1.0) -> NaiveBayes:
        """``classes``: id, label and cluster (one cluster, 0, if absent)."""
        rows = classes if "cluster" in classes.columns else classes.withColumn("cluster", F.lit(0).cast("long"))
        sums = long.join(rows.select("id", "label", "cluster"), "id").groupBy("cluster", "label", "kmer").agg(F.sum("value").alias("s"))
        sums = cut(sums)
        total = sums.groupBy("cluster", "label").agg(F.sum("s").alias("total"))
        held = rows.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        all_held = held.groupBy("cluster").agg(F.sum("n").alias("all"))
        low = F.log(F.lit(alpha)) - F.log(F.coalesce("total", F.lit(0.0)) + alpha * features)
        priors = held.join(all_held, "cluster").join(total, ["cluster", "label"], "left").select("cluster", "label", F.log(F.col("n") / F.col("all")).alias("prior"), low.alias("low"))
        weights = sums.join(total, ["cluster", "label"]).select("cluster", "label", "kmer", (F.log(F.col("s") + alpha) - F.log(F.lit(alpha))).alias("gain"))
        return cls(weights, priors, features, alpha)

    def predict(self, long: DataFrame) -> DataFrame:
        """``id, cluster, label, p``. A feature a class never had adds the smoothed floor, so only gains are needed."""
        model = self._sent()
        return self._joined(long) if model is None else self._dense(long, model, None)

    def ensemble(self, long: DataFrame, n: int) -> DataFrame:
        """``id, label, p``: the mean of ``n`` clusters as ``ensemble`` makes it; a row's members are summed where it is scored."""
        model = self._sent()
        return ensemble(self._joined(long), n) if model is None else self._dense(long, model, n)

    def _sent(self) -> tuple[np.ndarray, ...] | None:
        """Classes in order of cluster and label, their priors and floors, k-mers, and gains as a matrix; none if it is large."""
        priors = cut(self.priors.select("cluster", "label", "prior", "low"))
        kmers = self.weights.select("kmer").distinct()
        if not 0 < (classes := priors.count()) <= self.SENT or classes * kmers.count() > self.SENT:
            return None
        own = priors.orderBy("cluster", "label").toArrow()  # a row for each class, as many as ``SENT`` at most
        names = kmers.orderBy("kmer").toArrow().column("kmer").to_pylist()
        cells = self.weights.toArrow()  # a row for each cell
        cluster, label = own.column("cluster").to_pylist(), own.column("label").to_pylist()
        place, at = {c: k for k, c in enumerate(zip(cluster, label, strict=True))}, {w: k for k, w in enumerate(names)}
        gains = np.zeros((len(names), classes))
        of = zip(cells.column("cluster").to_pylist(), cells.column("label").to_pylist(), strict=True)
        gains[[at[w] for w in cells.column("kmer").to_pylist()], [place[c] for c in of]] = cells.column("gain").to_numpy()
        return cluster, label, own.column("prior").to_numpy(), own.column("low").to_numpy(), names, gains

    def _dense(self, long: DataFrame, model: tuple, n: int | None) -> DataFrame:
        """Each row's entries in one row, against all classes at once; with ``n`` the clusters' mean over ``n``."""
        cluster, label, prior, low, names, gains = model
        start = np.array([k for k, c in enumerate(cluster) if not k or c != cluster[k - 1]])
        member = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(cluster))))
        labels = sorted(set(label), key=lambda c: (c is not None, c))
        of = np.array([labels.index(c) for c in label])
        most = max(1, self.SENT // max(1, len(names), len(cluster)))
        kinds = {f.name: f.dataType.simpleString() for f in [*self.priors.schema, long.schema["id"]]}
        spark = long.sparkSession
        vocabulary = spark.createDataFrame(list(enumerate(names)), "at int, kmer string")
        entry = F.when(F.col("at").isNotNull(), F.struct("at", "value"))
        rows = long.join(F.broadcast(vocabulary), "kmer", "left").groupBy("id").agg(F.collect_list(entry).alias("e"), F.sum("value").alias("x"))  # at most ``SENT`` k-mers
        schema = pa.schema([(c, to_arrow_type(t)) for c, t in ((f.name, f.dataType) for f in self.priors.select("cluster", "label").schema)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, len(batch), most):
                    part = batch.slice(k, most)
                    owner = np.repeat(np.arange(len(part)), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
                    at, value = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                    x = np.bincount(owner * gains.shape[0] + at, value, len(part) * gains.shape[0]).reshape(len(part), -1)
                    z = prior + part.column(3).to_numpy()[:, None] * low + x @ gains
                    e = np.exp(z - np.maximum.reduceat(z, start, axis=1)[:, member])
                    p = e / np.add.reduceat(e, start, axis=1)[:, member]
                    if n is not None:
                        sums = np.zeros((len(p), len(labels)))
                        for first, last in zip(start, [*start[1:], len(cluster)], strict=True):
                            sums[:, of[first:last]] += p[:, first:last]
                        p = sums / n
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), p.shape[1])))
                    turn = pa.array(np.resize(np.arange(p.shape[1]), p.size))
                    if n is not None:
                        yield pa.RecordBatch.from_arrays([ids, pa.array(labels, schema.field("label").type).take(turn), pa.array(p.ravel())], names=["id", "label", "p"])
                    else:
                        cols = [pa.array(v, schema.field(c).type).take(turn) for c, v in (("cluster", cluster), ("label", label))]
                        yield pa.RecordBatch.from_arrays([ids, *cols, pa.array(p.ravel())], names=["id", "cluster", "label", "p"])

        columns = ["id", "label"] if n is not None else ["id", "cluster", "label"]
        return rows.select("id", "e.at", "e.value", "x").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", p double")

    def _joined(self, long: DataFrame) -> DataFrame:
        """``id, cluster, label, p`` with a model of any size.

        Weights are one array a feature and block of ``BLOCK`` labels, so an entry meets a row for each block, not one for
        each label, and its products go into one aggregate of as many sums.
        """
        at = F.row_number().over(Window.partitionBy("cluster").orderBy("label")) - 1  # a row for each label of a cluster
        priors = cut(self.priors.select("cluster", "label", "prior", "low", at.alias("at")))
        clusters, most = priors.agg(F.collect_set("cluster"), F.max("at")).first()  # at most as many as ``clusters`` deals
        blocks = 0 if most is None else most // self.BLOCK + 1
        width = min(self.BLOCK, (most or 0) + 1)
        models = priors.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "label", "prior", "low"))), lambda c: F.struct(c["label"].alias("label"), c["prior"].alias("prior"), c["low"].alias("low"))).alias("classes"))
        placed = self.weights.join(priors.select("cluster", "label", "at"), ["cluster", "label"])
        by_label = F.map_from_entries(F.collect_list(F.struct((F.col("at") % self.BLOCK).alias("k"), "gain")))
        gain = placed.groupBy("cluster", "kmer", F.floor(F.col("at") / self.BLOCK).alias("block")).agg(by_label.alias("m"))
        gain = gain.select("cluster", "kmer", "block", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("gains"))
        sums = long.join(gain, "kmer").groupBy("id", "cluster", "block").agg(*[F.sum(F.col("value") * F.get("gains", F.lit(k))).alias(f"g{k}") for k in range(width)])
        sums = sums.select("id", "cluster", "block", F.array(*[f"g{k}" for k in range(width)]).alias("gains"))
        if blocks > 1:  # blocks that no entry met are absent
            every = F.map_from_entries(F.collect_list(F.struct("block", "gains")))
            none = F.array_repeat(F.lit(0.0), width)
            sums = sums.groupBy("id", "cluster").agg(every.alias("m")).select("id", "cluster", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), none))).alias("gains"))
        totals = long.groupBy("id").agg(F.sum("value").alias("x")).withColumn("cluster", F.explode(F.array(*[F.lit(c) for c in clusters]).cast(f"array<{priors.schema['cluster'].dataType.simpleString()}>")))
        each = totals.join(models, "cluster").join(sums.select("id", "cluster", "gains"), ["id", "cluster"], "left")
        z = F.zip_with("classes", F.coalesce("gains", F.array().cast("array<double>")), lambda c, g: F.when(c["label"].isNotNull(), c["prior"] + F.col("x") * c["low"] + F.coalesce(g, F.lit(0.0))))
        z = F.slice(z, 1, F.size("classes"))
        e = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
        each = each.withColumn("z", z).withColumn("e", e).withColumn("all", F.aggregate("e", F.lit(0.0), lambda s, v: s + v))
        rows = F.explode(F.zip_with("classes", "e", lambda c, v: F.struct(c["label"].alias("label"), (v / F.col("all")).alias("p"))))
        return each.select("id", "cluster", rows.alias("r")).select("id", "cluster", "r.label", "r.p")


def linear_svm(vectors: DataFrame, weights: DataFrame | None = None, rounds: int = 20, reg: float = 0.01):
    """Hinge loss with balanced weights (C1). ``vectors``: features, label (0 or 1); ``weights``: label, weight."""
    rows = vectors if weights is None else vectors.join(F.broadcast(weights.select(F.col("label").cast("double"), "weight")), "label")  # two rows
    return LinearSVC(maxIter=rounds, regParam=reg, **({} if weights is None else {"weightCol": "weight"})).fit(rows)


class OneClassSvm:
    """Linear one-class SVM (C2): weights as a table, the radius that of the constant feature."""

    def __init__(self, weights: DataFrame) -> None:
        self.weights = weights

    @classmethod
    def fit(cls, long: DataFrame, nu: float = 0.5, rounds: int = 20, rate: float = 0.5) -> OneClassSvm:
        """``long``: id, kmer, value of the one class."""
        own = linear.with_bias(long, -1.0)
        targets = own.select(F.lit("one").alias("model"), "id").distinct()
        settings = long.sparkSession.createDataFrame([("one", float(rate), float(nu))], "model string, rate double, nu double")
        return cls(linear.train_one_class(own, targets, settings, rounds))

    def predict(self, long: DataFrame) -> DataFrame:
        """``id, label``: 1 inside, -1 outside."""
        return linear.margins(linear.with_bias(long, -1.0), self.weights).select("id", F.when(F.col("margin") >= 0, 1).otherwise(-1).alias("label"))


def perceptron(vectors: DataFrame, width: int, labels: int, hidden: int = 16, rounds: int = 60, seed: int = 1):
    """Non-linear classifier on reduced vectors."""
    return MultilayerPerceptronClassifier(layers=[width, hidden, labels], maxIter=rounds, seed=seed).fit(vectors)


def search(vectors: DataFrame, estimator, grid: dict, seed: int = 1, metric: str = "accuracy"):
    """Grid search by mean accuracy on a held-out share: the best model, and a row for each setting (C14)."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(estimator, name), values)
    maps = builder.build()
    fitted = TrainValidationSplit(estimator=estimator, estimatorParamMaps=maps, evaluator=MulticlassClassificationEvaluator(metricName=metric), trainRatio=0.8, seed=seed).fit(vectors)
    rows = [(str({p.name: v for p, v in m.items()}), float(s)) for m, s in zip(maps, fitted.validationMetrics, strict=True)]
    return fitted.bestModel, vectors.sparkSession.createDataFrame(rows, "setting string, score double")


def external(rows: DataFrame, score: Callable[[np.ndarray], np.ndarray], labels: list[str]) -> DataFrame:
    """``id, label, p`` by any function from a matrix to class probabilities, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                p = np.asarray(score(np.array(batch["features"].tolist())))
                yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), len(labels)), "label": np.tile(labels, len(batch)), "p": p.ravel()})

    return rows.select("id", "features").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, label string, p double")


class Registry:
    """Models by rank in a folder (C11, C12): ranks that have one are not fitted again; a missing one is an error."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    def has(self, rank: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rank}/metadata")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def fit(self, ranks: list[str], fit: Callable[[str], object]) -> list[str]:
        fresh = [r for r in ranks if not self.has(r)]
        for rank in fresh:
            fit(rank).write().overwrite().save(f"{self.path}/{rank}")
        return fresh

    def load(self, ranks: list[str], kind) -> dict:
        if missing := [r for r in ranks if not self.has(r)]:
            raise FileNotFoundError(f"no model for {missing} in {self.path}")
        return {r: kind.load(f"{self.path}/{r}") for r in ranks}
