"""Area under the ROC curve from ranks (Mann-Whitney), with ties counted half."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .ordering import average_ranks, rank_index


def auroc(df: DataFrame, score: str, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """keys, n_pos, n_neg, auc: one row per key; auc is NULL if a class is missing, null scores are dropped.

    Rows collapse to counts per distinct score before anything is ordered.
    """
    keys = keys or []
    w = rank_index(df, keys, score, **_sides(positive)).wins("p", "q")
    return w.select(*keys, F.col("p").alias("n_pos"), F.col("q").alias("n_neg"), F.try_divide("wins", (F.col("p") * F.col("q")).cast("double")).alias("auc"))


def _sides(positive: Column) -> dict[str, Column]:
    """Counts p of the rows for which ``positive`` holds, q of the others."""
    return {"p": F.sum(F.when(positive, 1).otherwise(0)), "q": F.sum(F.when(positive, 0).otherwise(1))}


def auroc_against_all(df: DataFrame, score: str, positive: Column, stratum: Column, least: int = 100, keys: list[str] | None = None) -> DataFrame:
    """keys, stratum, n_pos, n_neg, auc of each stratum's positives against all negatives; NULL below ``least`` positives.

    Negatives aren't copied into the strata: a positive's wins are the negatives below it, counted once.
    """
    keys = keys or []
    rows = df.filter(F.col(score).isNotNull()).select(*keys, score, positive.alias("_p"), stratum.alias("stratum"))
    counts = staged(rows.groupBy(*keys, "stratum", score).agg(*[c.alias(n) for n, c in _sides(F.col("_p")).items()]), "auroc-strata")
    neg = rank_index(counts, keys, score, q=F.sum("q")).ranked()
    pos = counts.filter("p > 0 AND stratum IS NOT NULL").select(*keys, "stratum", score, "p")
    got = pos.join(neg, [*keys, score]).groupBy(*keys, "stratum").agg(F.sum("p").alias("n_pos"), F.sum(F.col("p") * (F.col("q_before") + F.col("q") / F.lit(2.0))).alias("w"), F.max("q_all").alias("n_neg"))
    return got.select(*keys, "stratum", "n_pos", "n_neg", F.when(F.col("n_pos") >= least, F.try_divide("w", (F.col("n_pos") * F.col("n_neg")).cast("double"))).alias("auc"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, rho: Pearson correlation of average ranks; NULL where either side doesn't vary."""
    keys = keys or []
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_n"))
    rows = staged(rows, "spearman-pairs")
    rx = average_ranks(rows, keys, x, "rx", "_n").drop("n")
    ry = average_ranks(rows, keys, y, "ry", "_n").drop("n")
    both = rows.join(rx, [*keys, x]).join(ry, [*keys, y])
    n = F.sum("_n")
    sx, sy, sxy, sxx, syy = (F.sum(e * F.col("_n")) for e in (F.col("rx"), F.col("ry"), F.col("rx") * F.col("ry"), F.col("rx") * F.col("rx"), F.col("ry") * F.col("ry")))
    top = n * sxy - sx * sy
    low = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return both.groupBy(*keys).agg(n.alias("n"), F.when(low > 0, F.try_divide(top, low)).alias("rho"))


def mann_whitney_greater(df: DataFrame, value: str, case: Column, keys: list[str] | None = None) -> DataFrame:
    """keys, u, z, p: whether cases have larger values than the rest, by the normal limit with corrections for ties and continuity.

    NULL if a side is missing or all values are equal; null values are dropped. Rows collapse to counts per value first.
    """
    from ..functions.scalars import normal_tail

    keys = keys or []
    index = rank_index(df, keys, value, **_sides(case))
    tied = (F.col("p") + F.col("q")).cast("double")
    ties = index.rows.groupBy(*keys).agg(F.sum(tied * tied * tied - tied).alias("ties"))
    t = index.wins("p", "q").select(*keys, F.col("wins").alias("u"), F.col("p").cast("double").alias("n1"), F.col("q").cast("double").alias("n0"))
    t = t.join(ties, keys) if keys else t.crossJoin(F.broadcast(ties))
    n, n1n0 = F.col("n1") + F.col("n0"), F.col("n1") * F.col("n0")
    spread = F.sqrt(n1n0 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    t = t.withColumn("z", F.try_divide(F.col("u") - n1n0 / 2 - 0.5, F.nullif(spread, F.lit(0.0))))
    return t.select(*keys, "u", "z", normal_tail(F.col("z")).alias("p"))
