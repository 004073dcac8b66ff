"""Robust statistics, scalers and feature screening on long features (key, feature, value)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .ordering import exact_quantiles, named_quantiles, quantile_columns, quantile_near, ranked


def trimmed_p99(df: DataFrame, value: str, keys: list[str], k: float = 5.0, least: int = 10) -> DataFrame:
    """keys, n, n_kept, p99: of the values up to median + k*MAD if more than ``least`` are, else of all.

    Keys may be many, so their rows are joined as the planner finds by size. The values are staged; each of the three
    quantiles is found among the few values around it, so no task counts or sorts those of a key.
    """
    rows = staged(df.select(*keys, F.col(value).alias("_v")).filter("_v IS NOT NULL"), "trim")
    m = rows.join(quantile_near(rows, keys, "_v", 0.5, "_m"), keys).withColumn("_dev", F.abs(F.col("_v") - F.col("_m")))
    limit = m.join(quantile_near(m, keys, "_dev", 0.5, "_d"), keys)
    kept = F.col("_v") <= F.col("_m") + k * F.col("_d")
    counts = limit.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(kept, 1).otherwise(0)).alias("n_kept"))
    counts = staged(counts, "trim-counts")
    used = limit.join(counts, keys).filter(kept | (F.col("n_kept") <= least)).select(*keys, "_v")
    return counts.join(quantile_near(used, keys, "_v", 0.99, "p99"), keys).select(*keys, "n", "n_kept", "p99")


def structure_votes(df: DataFrame, row: str, feature: str, value: str, background: Column, p: float = 0.95) -> DataFrame:
    """row, votes: features of the row that exceed the background rows' p-quantile of that feature."""
    limit = quantile_columns(df.filter(background), [feature], value, {"_p": p})
    return df.join(F.broadcast(limit), feature).groupBy(row).agg(F.sum(F.when(F.col(value) > F.col("_p"), 1).otherwise(0)).cast("long").alias("votes"))


def fit_standard(df: DataFrame, feature: str, value: str) -> DataFrame:
    """feature, mean, std (ddof 0)."""
    return df.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def apply_standard(df: DataFrame, scaler: DataFrame, feature: str, value: str, eps: float = 1e-8, clip: float | None = 8.0, out: str = "z") -> DataFrame:
    """Adds z = (value - mean) / (std + eps), clipped; the scaler has a row per feature and is broadcast."""
    z = (F.col(value) - F.col("mean")) / (F.col("std") + eps)
    if clip is not None:
        z = F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))
    return df.join(F.broadcast(scaler), feature).withColumn(out, z).drop("mean", "std")


def fit_rank(df: DataFrame, feature: str, value: str, n: int = 1024) -> DataFrame:
    """feature, edges: n evenly spaced quantiles in order."""
    e = exact_quantiles(df, [feature], value, n)
    return e.groupBy(feature).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda x: x["q"]).alias("edges"))


def apply_rank(df: DataFrame, edges: DataFrame, feature: str, value: str, n: int = 1024, out: str = "r") -> DataFrame:
    """Adds the number of edges below the value, scaled to [-1, 1]."""
    below = F.size(F.filter("edges", lambda e: e < F.col(value)))
    return df.join(F.broadcast(edges), feature).withColumn(out, below / (n - 1) * 2 - 1).drop("edges")


def out_of_range(df: DataFrame, z: str, keys: list[str]) -> DataFrame:
    """keys, median_z, p90_z, mean_z, frac2, frac4 of |z|."""
    t = staged(df.groupBy(*keys, F.abs(F.col(z)).alias("_a")).agg(F.count("*").alias("_n")), "range-counts")
    over = lambda limit: (F.sum(F.when(F.col("_a") > limit, F.col("_n")).otherwise(0)) / F.sum("_n"))
    g = t.groupBy(*keys).agg((F.sum(F.col("_a") * F.col("_n")) / F.sum(F.when(F.col("_a").isNotNull(), F.col("_n")))).alias("mean_z"), over(2).alias("frac2"), over(4).alias("frac4"))
    return g.join(named_quantiles(ranked(t, keys, "_a", "_n"), keys, "_a", {"median_z": 0.5, "p90_z": 0.9}), keys)


def mean_difference(df: DataFrame, value: str, case: Column, keys: list[str]) -> DataFrame:
    """keys, smd: |mean(case) - mean(rest)| over the root of the mean variance; NULL without variance."""
    v = F.col(value)
    g = df.groupBy(*keys).agg(F.avg(F.when(case, v)).alias("a"), F.avg(F.when(~case, v)).alias("b"), F.var_pop(F.when(case, v)).alias("va"), F.var_pop(F.when(~case, v)).alias("vb"))
    return g.select(*keys, F.try_divide(F.abs(F.col("a") - F.col("b")), F.nullif(F.sqrt((F.col("va") + F.col("vb")) / 2), F.lit(0.0))).alias("smd"))
