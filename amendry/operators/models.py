"""Fits: pairwise logistic regression and Bradley-Terry, and a certificate of their optimum; folds are in `folds`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amendry.functions import vectors as V
from amendry.operators.evaluation import fold_summary
from amendry.operators.folds import lopo  # noqa: F401


@dataclass
class LinearModel:
    """Weights on raw features: the scaler is folded in."""

    weights: list[float]
    bias: float

    def margin(self, features: Column | str) -> Column:
        return V.dot(F.array(*map(F.lit, self.weights)), features) + self.bias


#: Bytes of vectors in one partition of a fit, where that makes more partitions than the session has cores.
_PARTITION = 256 << 20


def _in_few(df: DataFrame, size: int) -> DataFrame:
    """`size` bytes of vectors in no more partitions than cores or whole `_PARTITION`s: in each step of a fit every
    partition sends its sums, so what reaches the driver would grow with their number."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // _PARTITION)))


def _fit(df: DataFrame, scaled: DataFrame, c: float, max_iter: int, center: bool, intercept: bool) -> LinearModel:
    """The scaler is fitted on the vectors of `scaled`; min C * sum of log losses + |w|^2 / 2 over scaled features, as MLlib's mean loss with regParam 1 / (C n)."""
    data = scaled.select(array_to_vector("features").alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=center, withStd=True).fit(data)
    n, number = df.count(), data.count()
    grow = ((number - 1) / number) ** 0.5 if number > 1 else 1.0  # MLlib divides by the sample deviation
    std = [s * grow for s in scaler.std.toArray().tolist()]
    mean = scaler.mean.toArray().tolist() if center else [0.0] * len(std)
    inverse = [1 / s if s > 0 else 0.0 for s in std]
    arrays = df.select(F.zip_with(F.zip_with("features", F.array(*map(F.lit, mean)), lambda x, m: x - m), F.array(*map(F.lit, inverse)), lambda x, i: x * i).alias("x"), "label")
    ready = arrays.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    ready = _in_few(ready, n * 8 * len(std)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = LogisticRegression(regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, fitIntercept=intercept, maxIter=max_iter, tol=1e-8).fit(ready)
    finally:
        ready.unpersist()
    weights = [w * i for w, i in zip(model.coefficients.toArray().tolist(), inverse)]
    return LinearModel(weights, float(model.intercept) - sum(w * m for w, m in zip(weights, mean)))


def fit_pairwise(df: DataFrame, c: float = 1.0, max_iter: int = 2000) -> LinearModel:
    """P(first candidate is chosen) from the columns features (array<double>) and label."""
    return _fit(df, df, c, max_iter, center=True, intercept=True)


def fit_bt(pairs: DataFrame, c: float = 1.0, max_iter: int = 2000) -> LinearModel:
    """Score weights from the columns better and worse (features): P = sigmoid(s(better) - s(worse)).

    Each pair counts in both directions; columns that only describe the source cancel. Scales are those of better and
    worse stacked.
    """
    both = pairs.select(F.explode(F.array(F.struct(V.minus("better", "worse").alias("features"), F.lit(1).alias("label")), F.struct(V.minus("worse", "better").alias("features"), F.lit(0).alias("label")))).alias("x")).select("x.*")
    stacked = pairs.select(F.explode(F.array("better", "worse")).alias("features"))
    return _fit(both, stacked, c, max_iter, center=False, intercept=False)


def optimality(df: DataFrame, model: LinearModel, kind: str = "pairwise", c: float = 1.0) -> DataFrame:
    """(pos, weight, gradient) of the objective that the fits minimise, at a model's weights: position 0 is the bias.

    Weights and gradient are those of scaled features; at the optimum every gradient is 0. Features are centred for
    "pairwise"; features that don't vary have weight and gradient 0. Expressions and one shuffle by position, no fit.
    """
    if kind == "bt":
        vectors = df.select(F.explode(F.array("better", "worse")).alias("v"))
        rows = df.select(V.minus("better", "worse").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("copies"))
    else:
        vectors = df.select(F.col("features").alias("v"))
        rows = df.select(F.col("features").alias("x"), (2.0 * F.col("label") - 1).alias("y"), F.lit(1.0).alias("copies"))
    scales = vectors.select(F.posexplode("v").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    pull = -F.col("y") * F.col("copies") * V.sigmoid(-F.col("y") * model.margin("x"))
    parts = rows.select("x", pull.alias("pull")).select("pull", F.posexplode("x").alias("pos", "x"))
    sums = parts.groupBy("pos").agg(F.sum("pull").alias("pulls"), F.sum(F.col("pull") * F.col("x")).alias("pulled"))
    weight = F.get(F.array(*map(F.lit, model.weights)), F.col("pos"))
    mean = F.lit(0.0) if kind == "bt" else F.col("mean")
    at = sums.join(scales, "pos").withColumn("weight", F.when(F.col("std") > 0, weight * F.col("std")).otherwise(0.0))
    slope = F.when(F.col("std") > 0, c * (F.col("pulled") - mean * F.col("pulls")) / F.col("std") + F.col("weight")).otherwise(0.0)
    rows = at.select((F.col("pos") + 1).alias("pos"), "weight", slope.alias("gradient"))
    return rows if kind == "bt" else rows.union(sums.where("pos = 0").select(F.lit(0).alias("pos"), F.lit(model.bias).alias("weight"), (c * F.col("pulls")).alias("gradient")))


def lopo_summary(folds: DataFrame) -> DataFrame:
    return fold_summary(folds)
