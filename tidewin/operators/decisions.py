"""Thresholds at a false-alarm rate, the three decision rules, and the metrics of decisions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import exact_quantiles, quantiles_of, ranked


def threshold_at_far(df: DataFrame, heads: dict[str, str], quiet: Column, far: float) -> DataFrame:
    """One row with a column tau_<head> per head: the interpolated (1 - far) quantile of the quiet rows' scores.

    Exact over any number of rows: the heads' scores are ranked by cells, in no task together.
    """
    long = df.filter(quiet).select(F.inline(F.array(*[F.struct(F.lit(h).alias("head"), F.col(c).alias("score")) for h, c in heads.items()])))
    q = exact_quantiles(long, ["head"], "score", [1.0 - far])
    return q.agg(*[F.max(F.when(F.col("head") == h, F.col("q"))).alias(f"tau_{h}") for h in heads])


def quantile_vector(df: DataFrame, value: str, keys: list[str], n: int = 1000) -> DataFrame:
    """keys and q: n evenly spaced quantiles in order, stored as 32-bit floats."""
    return vector_of(ranked(df, keys, value), value, keys, n)


def vector_of(ranks: DataFrame, value: str, keys: list[str], n: int = 1000) -> DataFrame:
    """``quantile_vector`` from the rows of a rank index."""
    e = quantiles_of(ranks, keys, value, n)
    return e.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda x: x["q"]).cast("array<float>").alias("q"))


def head_edges(df: DataFrame, heads: dict[str, str], ps: list[float] | int) -> DataFrame:
    """One row with an array per entry of ``heads`` (name: score column): the score's quantiles in order, from one index of all heads."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(h).alias("head"), F.col(c).alias("score")) for h, c in heads.items()])))
    q = exact_quantiles(long, ["head"], "score", ps).groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda x: x["q"]).alias("q"))
    return q.agg(*[F.max(F.when(F.col("head") == h, F.col("q"))).alias(h) for h in heads])


def stored_threshold(q: Column, far: float, n: int = 1000) -> Column:
    """The stored quantile whose index is nearest to (1 - far) of the way, half to even; NULL without a vector."""
    at = min(max(round((1 - far) * (n - 1)), 0), n - 1)
    return F.when(F.size(q) > 0, F.element_at(q, at + 1))


def strongest(scores: dict[str, Column], taus: dict[str, Column], order: tuple[str, ...], none: str = "nothing") -> Column:
    """The head with the largest score above its own threshold; of equal scores the first in ``order``."""
    over = {h: F.when(scores[h] > taus[h], scores[h]) for h in order}
    best = F.greatest(*over.values()) if len(over) > 1 else next(iter(over.values()))
    out = reduce(lambda acc, h: acc.when(over[h] == best, h) if acc is not None else F.when(over[h] == best, h), order, None)
    return out.otherwise(none)


def largest_margin(scores: dict[str, Column], taus: dict[str, Column], order: tuple[str, ...], none: str = "nothing") -> Column:
    """The head with the largest score less threshold, if that isn't negative; of equal margins the first in ``order``."""
    margin = {h: scores[h] - taus[h] for h in order}
    best = F.greatest(*margin.values())
    out = reduce(lambda acc, h: acc.when(margin[h] == best, h) if acc is not None else F.when(margin[h] == best, h), order, None)
    return F.when(best < 0, none).otherwise(out.otherwise(none))


def paired(on_a: Column, on_b: Column, a: Column, b: Column, name_a: str, name_b: str, none: str = "nothing") -> Column:
    """Two switches: both on, the stronger (the first at a tie); one on, that one."""
    return F.when(on_a & on_b, F.when(a >= b, name_a).otherwise(name_b)).when(on_a, name_a).when(on_b, name_b).otherwise(none)


def half_argmax(a: Column, b: Column, name_a: str, name_b: str, none: str = "nothing", least: float = 0.5) -> Column:
    """nothing unless the larger exceeds ``least``; a tie goes to the second."""
    return F.when(F.greatest(a, b) > least, F.when(a > b, name_a).otherwise(name_b)).otherwise(none)


def f1(precision: Column, recall: Column) -> Column:
    """NULL, not 0, where either is 0 or NULL."""
    return F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall))


def class_metrics(df: DataFrame, truth: str, decided: str, classes: list[str], keys: list[str] | None = None, none: str = "nothing") -> DataFrame:
    """keys, cls, n, tp, fp, fn, accuracy, recall, precision_, f1 for overall, every class, nothing and present.

    One scan: all classes are counted side by side and unpivoted afterwards. Ratios without a denominator are NULL.
    """
    keys = keys or []
    t, d = F.col(truth), F.col(decided)
    flags = {"overall": (F.lit(True), F.lit(True))} | {c: (t == c, d == c) for c in [*classes, none]} | {"present": (t != none, d != none)}
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    aggs = [F.count("*").alias("all_n"), count(t == d).alias("right")]
    for c, (is_t, is_d) in flags.items():
        aggs += [count(is_t).alias(f"n_{c}"), count(is_t & is_d).alias(f"tp_{c}"), count(~is_t & is_d).alias(f"fp_{c}"), count(is_t & ~is_d).alias(f"fn_{c}"), count(is_t == is_d).alias(f"ok_{c}")]
    g = df.filter(t.isNotNull() & d.isNotNull()).groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"n_{c}").alias("n"), F.col("right" if c == "overall" else f"tp_{c}").alias("tp"), F.col(f"fp_{c}").alias("fp"), F.col(f"fn_{c}").alias("fn"), F.col("right" if c == "overall" else f"ok_{c}").alias("ok"), F.col("all_n")) for c in flags])
    r = g.select(*keys, F.inline(rows))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), b.cast("double"))
    overall = F.col("cls") == "overall"
    out = r.select(*keys, "cls", "n", F.when(~overall, F.col("tp")).alias("tp"), F.when(~overall, F.col("fp")).alias("fp"), F.when(~overall, F.col("fn")).alias("fn"), ratio("ok", F.col("all_n")).alias("accuracy"), F.when(~overall, ratio("tp", F.col("tp") + F.col("fn"))).alias("recall"), F.when(~overall, ratio("tp", F.col("tp") + F.col("fp"))).alias("precision_"))
    return out.withColumn("f1", f1(F.col("precision_"), F.col("recall")))


def confusion(df: DataFrame, truth: str, decided: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or []), truth, decided).agg(F.count("*").alias("n"))


def balanced_accuracy(df: DataFrame, truth: str, decided: str, keys: list[str] | None = None) -> DataFrame:
    """keys, balanced_accuracy: the mean of the recalls of the classes that occur."""
    keys = keys or []
    g = df.groupBy(*keys, truth).agg(F.avg(F.when(F.col(truth) == F.col(decided), 1.0).otherwise(0.0)).alias("r"))
    return g.groupBy(*keys).agg(F.avg("r").alias("balanced_accuracy"))


def passed(score: Column, thresholds: list[float]) -> Column:
    """How many of the rising thresholds the score exceeds."""
    return reduce(lambda acc, t: acc + (score > t).cast("int"), thresholds, F.lit(0))


def grid(df: DataFrame, name: str, values: list) -> DataFrame:
    """Every row once for each value: an explode of a literal array, no join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def softmax(logits: Column) -> Column:
    """Shares of an array of logits; the largest is taken out first."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def fourway_heads(logits: Column) -> dict[str, Column]:
    """The presence of each class in a model with one output of four exclusive classes (nothing, human, vehicle, animal)."""
    p = softmax(logits)
    return {"human": p[1], "vehicle": p[2], "animal": p[3]}
