"""Dataset audit: histograms, balance, coverage, association, crossings, floors, concentration."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import staged
from .ordering import exact_quantiles, named_quantiles, rank_index


def bin_of(x: Column, lo: float, width: float, n: int, clip: bool = False) -> Column:
    """Half-open bins of equal width from ``lo``; the last is closed. Outside: NULL, or the end bins with ``clip``."""
    i = F.floor((x - lo) / width)
    hi = lo + width * n
    if clip:
        return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))
    return F.when((x >= lo) & (x <= hi), F.least(i, F.lit(n - 1)))


def share(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """by, n, share: each group's part of its ``within`` group (empty: of all)."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"))
    if within:
        return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))
    total = g.agg(F.sum("n").alias("_all"))
    return g.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def balance(df: DataFrame, cls: str, kind: str) -> DataFrame:
    """cls, kinds, tv: total variation between the shares of a class's kinds and the uniform; classes with two kinds or more."""
    s = share(df.filter(F.col(kind).isNotNull()), [cls, kind], [cls])
    g = s.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(cls)))
    return g.filter("_k >= 2").groupBy(cls).agg(F.max("_k").alias("kinds"), (F.sum(F.abs(F.col("share") - 1 / F.col("_k"))) / 2).alias("tv"))


def coverage(df: DataFrame, cls: str, x: Column, present: Column, lo: float, width: float, n: int, least: float = 0.01) -> DataFrame:
    """cls, coverage: the part of the n bins that hold at least ``least`` of the class's present rows."""
    h = df.filter(present).groupBy(cls, bin_of(x, lo, width, n, clip=True).alias("_b")).agg(F.count("*").alias("_n"))
    h = h.withColumn("_all", F.sum("_n").over(Window.partitionBy(cls)))
    return h.groupBy(cls).agg((F.sum(F.when(F.col("_n") >= least * F.col("_all"), 1).otherwise(0)) / n).alias("coverage"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, chi2, v of the table of counts. Cells that are empty count: their chi2 adds up to what the others leave.

    With row sums r, column sums c: chi2 = sum over filled cells of n*o*o/(r*c) - n, so the full grid is
    never built.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("o"))
    t = cells.withColumns({"r": F.sum("o").over(Window.partitionBy(a)), "c": F.sum("o").over(Window.partitionBy(b))})
    g = t.agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    chi2 = F.col("n") * F.col("s") - F.col("n")
    least = F.greatest(F.least("ka", "kb") - 1, F.lit(1))
    return g.select(F.col("n").cast("long").alias("n"), chi2.alias("chi2"), F.sqrt(F.greatest(F.try_divide(chi2, F.col("n") * least), F.lit(0.0))).alias("v"))


def quantile_bins(df: DataFrame, x: str, k: int, out: str) -> DataFrame:
    """Adds ``out``: right-closed bins between the distinct k-quantile edges, the first closed on both sides."""
    edges = exact_quantiles(df, [], x, [i / k for i in range(k + 1)]).agg(F.array_sort(F.collect_set("q")).alias("_e"))
    at = F.size(F.filter(F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0))), lambda e: e < F.col(x)))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, at).drop("_e")


def crossings(df: DataFrame, axes: list[str], keys: list[str]) -> DataFrame:
    """keys, axis_a, axis_b, realised, possible, coverage for each pair of axes: one explode, one scan."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i + 1:]]
    item = F.array(*[F.struct(F.lit(a).alias("axis_a"), F.lit(b).alias("axis_b"), F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb")) for a, b in pairs])
    distinct = df.select(*keys, *axes).distinct().select(*keys, F.inline(item)).distinct()
    g = distinct.groupBy(*keys, "axis_a", "axis_b").agg(F.count("*").alias("realised"), (F.countDistinct("va") * F.countDistinct("vb")).alias("possible"))
    return g.withColumn("coverage", F.col("realised") / F.col("possible"))


def missing_pairs(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys, a, b: pairs of a key's levels that never occur together. Levels are distinct values, few by nature."""
    d = df.select(*keys, a, b).distinct()
    la, lb = d.select(*keys, a).distinct(), d.select(*keys, b).distinct()
    grid = la.join(lb, keys) if keys else la.crossJoin(lb)
    return grid.join(d, [*keys, a, b], "left_anti")


def floor_gate(df: DataFrame, group: str, x: Column, lo: float, width: float, n: int, least: int, small: int = 50) -> DataFrame:
    """group, reachable, passed: 5 dB cells up to the group's 99.5 % point, and those with ``least`` rows; groups under ``small`` are skipped."""
    # one scan: everything follows from counts per distinct value
    rows = staged(df.groupBy(group, x.alias("_x")).agg(F.count("*").alias("_n")), "floor-counts")
    ranks = rank_index(rows, [group], "_x", n=F.sum("_n")).ranked()
    top = rows.groupBy(group).agg(F.sum("_n").alias("_all")).filter(F.col("_all") >= small).join(named_quantiles(ranks, [group], "_x", {"_top": 0.995}), group)
    counts = rows.groupBy(group, bin_of(F.col("_x"), lo, width, n, clip=True).alias("_b")).agg(F.sum("_n").alias("_n"))
    cells = top.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).filter(lo + F.col("_b") * width <= F.col("_top"))
    return cells.join(counts, [group, "_b"], "left").groupBy(group).agg(F.count("*").alias("reachable"), F.sum(F.when(F.col("_n") >= least, 1).otherwise(0)).cast("long").alias("passed"))


def concentration(df: DataFrame, family: str, bin_: Column, factor: float = 3.0, least_share: float = 0.3, least_rows: int = 50) -> DataFrame:
    """bin, family, share, global_share of families that hold too much of a bin."""
    rows = df.select(F.col(family).alias("family"), bin_.alias("bin"))
    g = rows.groupBy("family", "bin").agg(F.count("*").alias("n"))
    g = g.withColumn("_bn", F.sum("n").over(Window.partitionBy("bin")))
    g = g.withColumn("_fn", F.sum("n").over(Window.partitionBy("family")))
    total = g.agg(F.sum("n").alias("_all"))
    g = g.crossJoin(F.broadcast(total)).withColumns({"share": F.col("n") / F.col("_bn"), "global_share": F.col("_fn") / F.col("_all")})
    return g.filter((F.col("_bn") >= least_rows) & (F.col("share") > factor * F.col("global_share")) & (F.col("share") > least_share)).select("bin", "family", "share", "global_share")


#: Classes that a choice of heads leaves out of training, and quiet kinds whose background is ambient.
LEFT_OUT = {"2head_noanimal": ("animal",), "separate2": ("animal",), "1head_human": ("animal",), "1head_human_noveh": ("animal", "vehicle")}
AMBIENT = ("calm", "wind", "rain", "ambient")
CLASSES = ("human", "vehicle", "animal")


def train_cohort(df: DataFrame, heads: str, cls: str = "coarse", split: str = "split") -> DataFrame:
    """Rows of the training split that a choice of heads is fitted on; an unknown choice leaves no class out."""
    return df.filter((F.col(split) == "train") & ~F.coalesce(F.col(cls).isin(*LEFT_OUT.get(heads, ())), F.lit(False)))


def zero_signal(df: DataFrame, occupancy: list[str], cls: str = "coarse", kind: str = "subkind", ambient: tuple[str, ...] = AMBIENT) -> DataFrame:
    """Rows in which no class is active, without quiet scenes whose kind is a confuser; a null occupancy is not zero."""
    quiet = F.lit(True)
    for c in occupancy:
        quiet = quiet & (F.col(c) <= 0)
    confuser = (F.col(cls) == "nothing") & ~F.coalesce(F.col(kind).isin(*ambient), F.lit(False))
    return df.filter(F.coalesce(quiet & ~confuser, F.lit(False)))


def class_masks(levels: dict[str, Column], snr: dict[str, Column], cls: Column) -> dict[str, Column]:
    """Masks: <class> (detectable), <class>_only (and no other), <class>_faint (its scene, -20 to 0 dB, not labelled), nothing, noise, n_active."""
    on = {c: F.coalesce(v > 0, F.lit(False)) for c, v in levels.items()}
    out = dict(on)
    for c in levels:
        only = on[c]
        for other in levels:
            if other != c:
                only = only & ~on[other]
        out[f"{c}_only"] = only
        out[f"{c}_faint"] = F.coalesce((cls == c) & (snr[c] >= -20) & (snr[c] < 0) & ~on[c], F.lit(False))
    none = F.lit(True)
    count = F.lit(0)
    for v in on.values():
        none = none & ~v
        count = count + v.cast("int")
    return out | {"nothing": none, "noise": F.coalesce(cls == "nothing", F.lit(False)), "n_active": count}
