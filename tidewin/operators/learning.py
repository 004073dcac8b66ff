"""Learners of pyspark.ml on array features: fits, held-out balanced accuracy, permutation importance."""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decisions import balanced_accuracy
from .ordering import sums_before

LEARNERS = ("logistic", "svm", "forest", "trees")


def estimator(kind: str, seed: int = 1):
    """Logistic regression, a linear support vector machine, a random forest, or gradient-boosted trees."""
    from pyspark.ml import classification as C

    common = {"featuresCol": "features", "labelCol": "label"}
    if kind == "logistic":
        return C.LogisticRegression(maxIter=50, regParam=1e-3, **common)
    if kind == "svm":
        return C.LinearSVC(maxIter=50, regParam=1e-3, **common)
    if kind == "forest":
        return C.RandomForestClassifier(numTrees=30, maxDepth=6, seed=seed, **common)
    if kind == "trees":
        return C.GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **common)
    raise ValueError(f"no learner named {kind!r}; there are {LEARNERS}")


def _rows(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"features": array_to_vector(x), "label": F.col(y).cast("double")})


def fit(kind: str, df: DataFrame, x: str, y: str, seed: int = 1):
    """A fitted model; rows without features or label are left out."""
    return estimator(kind, seed).fit(_rows(df, x, y))


def compare(df: DataFrame, x: str, y: str, split: str) -> DataFrame:
    """learner, balanced_accuracy on the rows whose split isn't 'train'."""
    out = None
    for kind in LEARNERS:
        p = fit(kind, df.filter(F.col(split) == "train"), x, y).transform(_rows(df.filter(F.col(split) != "train"), x, y))
        part = balanced_accuracy(p, "label", "prediction").select(F.lit(kind).alias("learner"), "balanced_accuracy")
        out = part if out is None else out.unionAll(part)
    return out


def permutation_importance(model, df: DataFrame, row_id: str, x: str, y: str, n: int, seed: int = 1) -> DataFrame:
    """feature, importance: the balanced accuracy less the one with the feature's values dealt anew among the rows.

    Rows are numbered once in two random orders (hashes of the id); the row at a place in one gets the value of the
    row at the same place in the other, so every value is used once. All features share that one join.
    """
    rows = _rows(df, x, y).select(F.col(row_id).alias("_id"), F.col(x).alias("_x"), "label", F.lit(1).alias("_n"))

    def dealt(k: int) -> DataFrame:
        return sums_before(rows.withColumn("_h", F.xxhash64(F.lit(seed + k), "_id")), [], "_h", ["_n"])

    both = dealt(0).join(dealt(1).select(F.col("_x").alias("_other"), "_n_before"), "_n_before")
    t = both.select("label", "_x", "_other", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("feature"))
    t = t.withColumn("_v", F.transform("_x", lambda v, i: F.when(i == F.col("feature"), F.get("_other", F.col("feature"))).otherwise(v)))
    p = model.transform(t.withColumn("features", array_to_vector("_v")))
    scores = balanced_accuracy(p, "label", "prediction", ["feature"])
    base = scores.filter("feature = -1").select(F.col("balanced_accuracy").alias("_base"))
    return scores.filter("feature >= 0").join(F.broadcast(base)).select("feature", (F.col("_base") - F.col("balanced_accuracy")).alias("importance"))
