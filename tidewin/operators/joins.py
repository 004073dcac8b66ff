"""Joins that plain equality doesn't give: tolerance, intervals, as-of with interpolation, grids, neighbours."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .cells import running_max


def tolerance_semi(left: DataFrame, right: DataFrame, keys: list[str], at: str, eps: float, anti: bool = False) -> DataFrame:
    """Rows of ``left`` for which ``right`` has (or hasn't) a row with the same keys and |difference of at| < eps.

    The right side stands in three cells of width eps, so an equality join finds every candidate; the
    exact test follows in the same join.
    """
    cell = F.floor(F.col(at) / eps).cast("long")
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(at).alias("_r_at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_r_cell"))
    cond = (F.floor(left[at] / eps).cast("long") == F.col("_r_cell")) & (F.abs(left[at] - F.col("_r_at")) < eps)
    for k in keys:
        cond = cond & (left[k] == F.col(f"_r_{k}"))
    return left.join(r, cond, "left_anti" if anti else "left_semi")


def overlap(start: Column, stop: Column, lo: Column, hi: Column) -> Column:
    """Length that [start, stop] and [lo, hi] share."""
    return F.greatest(F.lit(0.0), F.least(stop, hi) - F.greatest(start, lo))


def overlap_of_list(intervals: Column, lo: Column, hi: Column) -> Column:
    """Sum of the overlaps of an array of [start, stop] pairs with a window."""
    return F.aggregate(intervals, F.lit(0.0), lambda acc, x: acc + overlap(x[0], x[1], lo, hi))


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: float | None = None, how: str = "left_semi") -> DataFrame:
    """Points with lo <= at < hi for a span of the same keys (left_semi) or for none (left_anti).

    One union and a running maximum: a point lies in a span if a span that began before it ends behind it. So a span is
    one row whatever its length (``width`` isn't needed any more), and long series are worked through in cells. Points with
    a null place or key lie in no span.
    """
    cols = points.columns
    s = spans.filter((F.col(lo) < F.col(hi)) & reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True)))
    packed = points.select(*keys, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_hi"), F.struct(*cols).alias("_row"))
    both = packed.unionByName(s.select(*keys, F.col(lo).cast("double").alias("_at"), F.lit(0).alias("_kind"), F.col(hi).cast("double").alias("_hi"), F.lit(None).cast(packed.schema["_row"].dataType).alias("_row")))
    t = running_max(both, F.col("_hi"), keys, ["_at", "_kind"], "_end").filter("_kind = 1")
    within = F.coalesce(F.col("_end") > F.col("_at"), F.lit(False))
    return t.filter(~within if how == "left_anti" else within).select("_row.*")


#: Levels of cells above the smallest.
LEVELS = 62


def _level(lo: Column, hi: Column, width: float) -> Column:
    """The level whose cells, ``width`` times a power of two, are the narrowest that are as wide as the span or wider."""
    return F.least(F.greatest(F.ceil(F.log2((hi - lo) / width)), F.lit(0)), F.lit(LEVELS)).cast("int")


def _held(spans: DataFrame, points: DataFrame, keys: list[str], span: tuple[str, str], at: str, width: float, strict: bool) -> DataFrame:
    """Spans with the points that begin in them (``strict``: behind their beginning). A span stands in two cells of its level at most, a point in one of each level in use."""
    lo, hi = F.col(span[0]), F.col(span[1])
    level = _level(lo, hi, width)
    used = sorted(r[0] for r in spans.select(level.alias("l")).distinct().collect())
    if not used:
        used = [0]
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))
    first = F.floor(lo / size).cast("long")
    last = F.greatest(first, (F.ceil(hi / size) - 1).cast("long"))
    s = spans.withColumn("_level", level).withColumn("_cell", F.explode(F.sequence(first, last)))
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in used]))).withColumn("_cell", F.floor(F.col(at) / size).cast("long"))
    within = (F.col(at) > lo if strict else F.col(at) >= lo) & (F.col(at) < hi)
    return s.join(p, [*keys, "_level", "_cell"]).filter(within).drop("_level", "_cell")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[str, str], other: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows with equal keys whose spans [start, stop) overlap, each pair once: all columns of ``left`` and the others of ``right``.

    Two spans overlap if the later one begins in the other, so the join is one of points in spans, both ways. Spans
    stand in cells of their own length's level (powers of two times ``width``, the smallest): a span of seconds and one
    of years add two rows at most, a point one row per level that spans use, LEVELS + 1 at most; a cell holds
    spans of a quarter of its width or more, so most that meet overlap. Empty and reversed spans, and rows with a null,
    overlap nothing. Names other than the keys must differ.
    """
    (a, b), (c, d) = span, other
    left, right = left.filter(F.col(a) < F.col(b)), right.filter(F.col(c) < F.col(d))
    names = [*left.columns, *[x for x in right.columns if x not in keys]]
    return _held(left, right, keys, span, c, width, False).select(*names).unionByName(_held(right, left, keys, other, a, width, True).select(*names))


def covered(left: DataFrame, right: DataFrame, keys: list[str], span: tuple[str, str], other: tuple[str, str], width: float, by: list[str]) -> DataFrame:
    """``by``, n, covered: the number of spans of ``right`` that overlap a row of ``left``, and the sum of the overlaps."""
    j = overlap_join(left, right, keys, span, other, width)
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.sum(overlap(F.col(span[0]), F.col(span[1]), F.col(other[0]), F.col(other[1]))).alias("covered"))


def positional_join(left: DataFrame, right: DataFrame, at: str, key: str) -> DataFrame:
    """Rows of both sides with the same place ``at``; both must have every place once, with the same ``key``.

    A place that one side lacks, or that has another key there, is an error when the rows are read: tables that
    belong together by order alone are never joined out of step.
    """
    r = right.withColumnsRenamed({at: "_at", key: "_key"})
    j = left.join(r, left[at] == r["_at"], "full")
    wrong = left[at].isNull() | F.col("_at").isNull() | ~left[key].eqNullSafe(F.col("_key"))
    ok = F.when(wrong, F.raise_error(F.concat(F.lit("tables differ at place "), F.coalesce(left[at], F.col("_at")).cast("string")))).otherwise(F.lit(True))
    return j.filter(ok).drop("_at", "_key")


def asof_interpolate(left: DataFrame, right: DataFrame, keys: list[str], at: str, x: str, y: str, out: str) -> DataFrame:
    """``left`` plus ``out``: y at ``at``, linear between right's points (x, y) of the same keys, clamped at the ends.

    One union, one sort per key, two running windows: no range join. Of several right rows with one x the
    mean of y counts. NULL where the key has no points.
    """
    r = right.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x).agg(F.avg(y).alias(y))
    cols = left.columns
    packed = left.select(*keys, F.col(at).alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_y"), F.struct(*cols).alias("_row"))
    both = packed.unionByName(r.select(*keys, F.col(x).alias("_x"), F.lit(0).alias("_kind"), F.col(y).cast("double").alias("_y"), F.lit(None).cast(packed.schema["_row"].dataType).alias("_row")))
    w = Window.partitionBy(*keys).orderBy("_x", "_kind")
    point = F.when(F.col("_kind") == 0, F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))
    prev = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    t = both.withColumns({"_p": prev, "_n": nxt}).filter("_kind = 1")
    value = F.when(F.col("_p").isNull(), F.col("_n.y")).when(F.col("_n").isNull(), F.col("_p.y")).when(F.col("_x") == F.col("_p.x"), F.col("_p.y")).otherwise(F.col("_p.y") + (F.col("_x") - F.col("_p.x")) * (F.col("_n.y") - F.col("_p.y")) / F.nullif(F.col("_n.x") - F.col("_p.x"), F.lit(0.0)))
    return t.select("_row.*", value.alias(out))


def invert_curve(curve: DataFrame, wanted: DataFrame, keys: list[str], d: str, v: str, target: str) -> DataFrame:
    """``wanted`` plus distance and clipped: where the running minimum of v over growing d falls to ``target``.

    Between points log10(d) is linear in v; targets beyond the ends are clipped and flagged. Missing v counts as
    minus infinity. A curve is a short array per key, so each wanted row looks its key up once.
    """
    w = Window.partitionBy(*keys).orderBy(d).rowsBetween(Window.unboundedPreceding, 0)
    env = curve.select(*keys, F.col(d).cast("double").alias("d"), F.min(F.coalesce(F.col(v), F.lit(float("-inf")))).over(w).alias("v"))
    arr = env.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("_c"))
    t = wanted.join(arr, keys, "left")
    tv = F.col(target)
    k = F.size(F.filter("_c", lambda p: p["v"] > tv))  # points above the target come first
    a, b = F.element_at("_c", F.greatest(k, F.lit(1))), F.element_at("_c", F.least(k + 1, F.size("_c")))
    part = F.try_divide(a["v"] - tv, a["v"] - b["v"])
    inner = F.pow(F.lit(10.0), F.log10(a["d"]) + part * (F.log10(b["d"]) - F.log10(a["d"])))
    first, last = F.element_at("_c", 1), F.element_at("_c", -1)
    dist = F.when(tv >= first["v"], first["d"]).when(tv <= last["v"], last["d"]).otherwise(inner)
    return t.withColumns({"distance": dist, "clipped": (tv > first["v"]) | (tv < last["v"])}).drop("_c")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


#: Values (vectors times their length) of a block of queries or rows, and of the distances that a task has at a time.
BLOCK_VALUES = 2_000_000
DISTANCES = 4_000_000
#: Pairs of blocks that a join is cut into if there is enough of it, so that small tables are many tasks' work too.
PAIRS = 48


def nearest(queries: DataFrame, rows: DataFrame, q_id: str, q_vec: str, r_id: str, r_vec: str, k: int, carry: list[str], block_values: int = BLOCK_VALUES) -> DataFrame:
    """q_id, place, d2, r_id and ``carry`` columns of the k nearest rows of each query, exact; ties by r_id.

    Both sides are dealt to blocks of at most about ``block_values`` values by a hash of the id, and each pair of blocks
    is a task's work: it gives k rows a query at most, and only these are ranked. Vectors that are null, hold a null or
    are of another length than the query have no distance (null) and come last.
    """
    q = queries.select(F.col(q_id).alias("q_id"), F.col(q_vec).cast("array<double>").alias("_qv"))
    r = rows.select(F.col(r_id).alias("r_id"), F.col(r_vec).cast("array<double>").alias("_rv"), *carry)
    size = lambda df, v: int(df.agg(F.sum(F.size(v))).first()[0] or 0)
    of_q, of_r = size(q, "_qv"), size(r, "_rv")
    n_q = max(1, -(-of_q // block_values))
    n_r = max(1, -(-of_r // block_values), min(-(-PAIRS // n_q), -(-of_r // max(1, block_values // 16))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = q.select("*", block("q_id", n_q).alias("_q"), every(n_r).alias("_r")).repartition(n_q * n_r, "_q", "_r")
    right = r.select("*", block("r_id", n_r).alias("_r"), every(n_q).alias("_q")).repartition(n_q * n_r, "_q", "_r")
    fields = [q.schema["q_id"], T.StructField("d2", T.DoubleType()), *[f for f in r.schema if f.name != "_rv"]]
    near = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(_nearest_of_blocks(k, carry), T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.asc_nulls_last("d2"), "r_id"))
    return near.withColumn("place", place).filter(F.col("place") <= k).select("q_id", "place", "d2", "r_id", *carry)


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all vectors, where each begins, and its length (-1: null, or holds a null)."""
    v = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten()
    ends = np.cumsum(n)
    missing = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    bad = v.is_null().to_numpy(zero_copy_only=False) | (missing[ends] > missing[ends - n])
    return flat.to_numpy(zero_copy_only=False).astype(float), ends - n, np.where(bad, -1, n)


def _nearest_of_blocks(k: int, carry: list[str]):
    """The k nearest rows of a block for each query of a block: products tell who can be among them, sums of squares decide."""

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        (qv, q_at, q_n), (rv, r_at, r_n) = _vectors(left["_qv"]), _vectors(right["_rv"])
        by_id = np.asarray(pc.sort_indices(right["r_id"]), np.int64)
        rank = np.empty(len(by_id), np.int64)
        rank[by_id] = np.arange(len(by_id))
        found = []
        for n in np.unique(q_n):
            qs, rs = np.flatnonzero(q_n == n), by_id[r_n[by_id] == n] if n >= 0 else by_id[:0]
            rest = by_id[~np.isin(by_id, rs)][: max(0, k - len(rs))]  # rows without a distance, if the others aren't enough
            found.append((np.repeat(qs, len(rest)), np.tile(rest, len(qs)), np.full(len(qs) * len(rest), np.nan), np.zeros(len(qs) * len(rest), bool)))
            if not len(rs):
                continue
            x, y = qv[q_at[qs][:, None] + np.arange(n)], rv[r_at[rs][:, None] + np.arange(n)]
            with np.errstate(over="ignore", invalid="ignore"):
                y2, step = (y * y).sum(1), max(1, DISTANCES // len(rs))
                for i in range(0, len(qs), step):
                    b = x[i : i + step]
                    b2 = (b * b).sum(1)
                    near2 = b2[:, None] + y2[None, :] - 2 * (b @ y.T)
                    # what isn't finite is always looked at; the rest within the rounding of both sums
                    near2[~np.isfinite(near2)] = -np.inf
                    slack = 16 * (n + 8) * np.finfo(float).eps * (b2 + y2[np.isfinite(y2)].max(initial=0.0))
                    counted = np.where(near2 == -np.inf, np.inf, near2)
                    last = np.partition(counted, k - 1, 1)[:, k - 1] if len(rs) > k else np.full(len(b), np.inf)
                    q, r = np.nonzero(near2 <= np.where(np.isfinite(slack), last + slack, np.inf)[:, None])
                    d2 = np.zeros(len(q))
                    for j in range(n):  # in the components' order, as a plain loop adds
                        e = b[q, j] - y[r, j]
                        d2 += e * e
                    o = np.lexsort((rank[rs[r]], d2, q))
                    q, r, d2 = q[o], r[o], d2[o]
                    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                    found.append((qs[i + q[keep]], rs[r[keep]], d2[keep], np.ones(int(keep.sum()), bool)))
        q, r, d2, there = (np.concatenate(p) if found else np.zeros(0, t) for p, t in zip(zip(*found) if found else [()] * 4, (np.int64, np.int64, float, bool), strict=True))
        rows = right.select(["r_id", *carry]).take(pa.array(r, pa.int64()))
        return pa.table([left["q_id"].take(pa.array(q, pa.int64())), pa.array(d2, pa.float64(), mask=~there), *rows.columns], names=["q_id", "d2", "r_id", *carry])

    return near
