"""Ordered series over many tasks: a series is cut into cells, what a cell says about later ones is carried, and used inside them.

A cell's message is an aggregate of its rows (a sum, a maximum, the last event, a composed map), so it is made by a
combined aggregate; messages meet in a window over cells, at most ``CELLS`` rows a series; then each cell is worked
through on its own. A table that the planner takes for small is one cell a series, and no job is spent on cutting it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources.scratch import staged
from .ordering import CELLS, cell_of, splitters

#: Rows that a cell is meant to hold.
CELL_ROWS = 1_000_000
#: A table below this many bytes, by the planner's estimate, isn't cut.
SMALL_BYTES = 64 << 20


def planned_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a table's size; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def deal(df: DataFrame, order: list[str], cells: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """``df`` plus ``_cell``, rising with the first order column (a number), if there is more than one; else ``df``.

    With ``keys``, only series of more than ``CELL_ROWS`` rows are cut, and if there is none, ``df`` stays; the others are
    whole, in cell 0. A table that is cut is staged, as each message reads it once more: what made it runs once.
    Cells of all series that are cut are of like size together: their bounds are rank splitters, so neither one long series
    nor a crowded hour fills a cell. Rows that tie in the first order column are of one cell. A null one is in the first, as
    it comes first. A table that is dealt already stays.
    """
    if "_cell" in df.columns:
        return df
    if cells is None and planned_bytes(df) < SMALL_BYTES:
        return df
    if keys is None:
        bounds = splitters(df, order[0], cells or min(CELLS, -(-df.count() // CELL_ROWS)))
        return df.withColumn("_cell", cell_of(order[0], bounds)) if bounds else df
    # at most one row of ``long`` per CELL_ROWS rows of the table
    long = staged(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CELL_ROWS), "long-series")
    rows = long.agg(F.sum("_n")).first()[0]
    if not rows:
        return df
    long = long.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.lit(True).alias("_long"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    of = [f"_of_{k}" for k in keys]
    bounds = splitters(df.join(F.broadcast(long), same), order[0], cells or min(CELLS, -(-int(rows) // CELL_ROWS)))
    if not bounds:
        return df
    cell = F.when(F.col("_long"), cell_of(order[0], bounds)).otherwise(0)
    return staged(df.join(F.broadcast(long), same, "left").withColumn("_cell", cell).drop(*of, "_long"), "cells")


def dealt(df: DataFrame) -> bool:
    return "_cell" in df.columns


def inside(df: DataFrame, keys: list[str], order: list[str]) -> WindowSpec:
    """The window over a series, or over a series' part in a cell."""
    return Window.partitionBy(*keys, *(["_cell"] if dealt(df) else [])).orderBy(*order)


def with_cells(rows: DataFrame, cells: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``rows`` plus the columns ``names`` of their series' cell; null keys are a series like any other."""
    on = [*keys, "_cell"]
    other = cells.select(*[F.col(k).alias(f"_of_{k}") for k in on], *names)
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(other, same, "left").drop(*[f"_of_{k}" for k in on])


FOLDS = {
    "sum": lambda c, before, key: F.sum(c).over(before),
    "max": lambda c, before, key: F.max(c).over(before),
    "last": lambda c, before, key: F.last(c, ignorenulls=True).over(before),
    "all_sum": lambda c, before, key: F.sum(c).over(key),
    "all_min": lambda c, before, key: F.min(c).over(key),
}


def carried(df: DataFrame, keys: list[str], **wanted: tuple[Column, str]) -> DataFrame:
    """A dealt ``df`` plus a column per entry of ``wanted``: its aggregate, folded over the series' earlier (or, all_: all) cells.

    ``wanted``: name -> (aggregate of a cell's rows, fold). NULL where there is no earlier cell.
    """
    key = Window.partitionBy(*keys)
    before = key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*keys, "_cell").agg(*[c.alias(n) for n, (c, _) in wanted.items()])
    cells = cells.select(*keys, "_cell", *[FOLDS[fold](F.col(n), before, key).alias(n) for n, (_, fold) in wanted.items()])
    return with_cells(df, cells, keys, list(wanted))


def back(df: DataFrame, was: DataFrame, *names: str) -> DataFrame:
    """``df`` without helper columns, and without ``_cell`` unless ``was``, the caller's table, has it."""
    return df.drop(*names, *([] if dealt(was) else ["_cell"]))


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "pos", total: str | None = None, ready: bool = False) -> DataFrame:
    """Adds ``out``, each row's place in its series from 0, and ``total``, the series' number of rows.

    ``ready``, here and below: ``df`` comes from ``deal``, which needn't look for long series again.
    """
    t = df if ready else deal(df, order, keys=keys)
    w = inside(t, keys, order)
    at = F.row_number().over(w) - 1
    if not dealt(t):
        return t.withColumns({out: at.cast("long")} | ({total: F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("long")} if total else {}))
    n = F.count(F.lit(1))
    t = carried(t, keys, _rows_of_earlier=(n, "sum"), **({total: (n, "all_sum")} if total else {}))
    return back(t.withColumn(out, (F.coalesce("_rows_of_earlier", F.lit(0)) + at).cast("long")), df, "_rows_of_earlier")


def running_sum(df: DataFrame, amount: Column, keys: list[str], order: list[str], out: str, before: bool = False, ready: bool = False) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the series' rows up to this one (``before``: without it)."""
    t = df.withColumn("_amount", amount)
    t = t if ready else deal(t, order, keys=keys)
    w = inside(t, keys, order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = F.coalesce(F.sum("_amount").over(w), F.lit(0))
    if not dealt(t):
        return t.withColumn(out, own).drop("_amount")
    t = carried(t, keys, _sum_of_earlier=(F.sum("_amount"), "sum"))
    return back(t.withColumn(out, F.coalesce("_sum_of_earlier", F.lit(0)) + own), df, "_amount", "_sum_of_earlier")


def running_max(df: DataFrame, value: Column, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the largest ``value`` of the series' rows up to this one; nulls don't count."""
    return running_max_each(df, {out: value}, keys, order)


def running_max_each(df: DataFrame, wanted: dict[str, Column], keys: list[str], order: list[str], ready: bool = False) -> DataFrame:
    """``running_max`` for several columns (name: value) that share one sort."""
    names = {n: f"_amount_{i}" for i, n in enumerate(wanted)}
    t = (df if ready else deal(df, order, keys=keys)).withColumns({names[n]: c for n, c in wanted.items()})
    w = inside(t, keys, order).rowsBetween(Window.unboundedPreceding, 0)
    own = {n: F.max(c).over(w) for n, c in names.items()}
    if not dealt(t):
        return t.select(*df.columns, *[c.alias(n) for n, c in own.items()])
    t = carried(t, keys, **{f"_most{c}": (F.max(c), "max") for c in names.values()})
    return t.select(*df.columns, *[F.greatest(c, f"_most{names[n]}").alias(n) for n, c in own.items()])


def running_last(df: DataFrame, wanted: dict[str, Column], keys: list[str], order: list[str], ready: bool = False) -> DataFrame:
    """Adds a column per entry of ``wanted``: its last value that isn't null, up to this row. All share one sort."""
    names = {n: f"_event_{i}" for i, n in enumerate(wanted)}
    t = (df if ready else deal(df, order, keys=keys)).withColumns({names[n]: c for n, c in wanted.items()})
    w = inside(t, keys, order).rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.last(e, ignorenulls=True).over(w) for n, e in names.items()}
    if not dealt(t):
        return t.select(*df.columns, *[c.alias(n) for n, c in last.items()])
    at = F.struct(*order)
    t = carried(t, keys, **{f"_was_{e}": (F.max(F.when(F.col(e).isNotNull(), F.struct(at.alias("at"), F.col(e).alias("v"))))["v"], "last") for e in names.values()})
    return t.select(*df.columns, *[F.coalesce(c, f"_was_{names[n]}").alias(n) for n, c in last.items()])


def previous(df: DataFrame, value: Column, keys: list[str], order: list[str], out: str, ready: bool = False) -> DataFrame:
    """Adds ``out``: the value of the series' row before; NULL at its first row."""
    t = (df if ready else deal(df, order, keys=keys)).withColumn("_value", value)
    w = inside(t, keys, order)
    if not dealt(t):
        return t.withColumn(out, F.lag("_value").over(w)).drop("_value")
    t = carried(t, keys, _last=(F.max(F.struct(F.struct(*order).alias("at"), F.col("_value").alias("v"))), "last"))
    return back(t.withColumn(out, F.when(F.row_number().over(w) == 1, F.col("_last.v")).otherwise(F.lag("_value").over(w))), df, "_value", "_last")


def tail_before(df: DataFrame, flag: str, m: int, keys: list[str], order: list[str], out: str) -> DataFrame:
    """A dealt ``df`` plus ``out``: the flags of the last ``m`` rows before its cell, oldest first (fewer at the start)."""
    cell = Window.partitionBy(*keys, "_cell")
    numbered = df.select(*keys, "_cell", flag, F.row_number().over(cell.orderBy(*order)).alias("_i"), F.count(F.lit(1)).over(cell).alias("_c"))
    ends = numbered.filter(F.col("_i") > F.col("_c") - m).groupBy(*keys, "_cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", flag))), lambda x: x[flag]).alias("_tail"))
    # a cell has a row at least, so m cells before hold m rows
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(-m, -1)
    seen = F.flatten(F.collect_list("_tail").over(before))
    ends = ends.select(*keys, "_cell", F.slice(seen, F.greatest(F.size(seen) - m, F.lit(0)) + 1, F.lit(m)).alias(out))
    return with_cells(df, ends, keys, [out])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with the maps y -> a*y + b composed from their segment's first row on; log2(rows) passes a batch."""
    seg, a0, b0 = None, 1.0, 0.0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        name = batch.column("_seg").to_numpy()
        a, b = batch.column("_a").to_numpy().copy(), batch.column("_b").to_numpy().copy()
        start = np.ones(n, bool)
        start[1:] = name[1:] != name[:-1]
        first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        at = np.arange(n) - first
        d = 1
        while d <= at.max():
            i = np.flatnonzero(at >= d)
            a_i, b_i = a[i] * a[i - d], a[i] * b[i - d] + b[i]
            a[i], b[i] = a_i, b_i
            d *= 2
        if name[0] == seg:  # the batch goes on where the last one ended
            head = first == 0
            a[head], b[head] = a[head] * a0, a[head] * b0 + b[head]
        seg, a0, b0 = name[-1], a[-1], b[-1]
        keep = [c for c in batch.schema.names if c not in ("_a", "_b", "_seg")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(a), pa.array(b)], names=[*keep, "_a", "_b"])


def recurrence(df: DataFrame, a: Column, b: Column, keys: list[str], order: list[str], out: str, start: float = 0.0, ready: bool = False) -> DataFrame:
    """Adds ``out``: y = a*y(before) + b along each series, from ``start``. Null coefficients leave y as it is (a 1, b 0).

    Maps compose, so a cell is a map: rows get the map from their cell's beginning, each series' cells (CELLS at most)
    are folded in order, and a row's value is its map of what its cell begins with. Values differ from a plain loop by
    rounding alone.
    """
    t = (df if ready else deal(df, order, keys=keys)).withColumns({"_a": F.coalesce(a.cast("double"), F.lit(1.0)), "_b": F.coalesce(b.cast("double"), F.lit(0.0))})
    cell = ["_cell"] if dealt(t) else []
    t = t.withColumn("_seg", F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], *[F.col(k).isNull() for k in keys], *cell)) if keys or cell else t.withColumn("_seg", F.lit(0).cast("long"))
    kept = [f for f in t.schema if f.name not in ("_a", "_b", "_seg")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _a double, _b double"
    moved = t.repartition(*[F.col(c) for c in [*keys, *cell]]) if keys or cell else t.coalesce(1)
    # a segment is told by a hash of its key and cell; equal hashes of neighbours are sorted apart by key
    rows = moved.sortWithinPartitions("_seg", *keys, *cell, *order).mapInArrow(_compose, schema)
    if not cell:
        return rows.withColumn(out, F.col("_a") * F.lit(start) + F.col("_b")).drop("_a", "_b")
    rows = staged(rows, "recurrence")
    ends = rows.groupBy(*keys, "_cell").agg(F.max(F.struct(F.struct(*order).alias("at"), "_a", "_b")).alias("_m"))
    steps = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_cell", F.col("_m._a").alias("a"), F.col("_m._b").alias("b")))).alias("_steps"))
    began = F.aggregate("_steps", F.struct(F.lit(start).cast("double").alias("y"), F.array().cast("array<double>").alias("ys")), lambda acc, s: F.struct((s["a"] * acc["y"] + s["b"]).alias("y"), F.concat(acc["ys"], F.array(acc["y"])).alias("ys")), lambda acc: acc["ys"])
    cells = steps.select(*keys, F.inline(F.arrays_zip(F.transform("_steps", lambda s: s["_cell"]).alias("_cell"), began.alias("_y0"))))
    t = with_cells(rows, cells, keys, ["_y0"])
    return back(t.withColumn(out, F.col("_a") * F.col("_y0") + F.col("_b")), df, "_a", "_b", "_y0")
