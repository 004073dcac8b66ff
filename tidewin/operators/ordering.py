"""Global order without a global sort: an index of distinct values with counts, and what is before each."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import staged

#: Distinct values that a cell is meant to hold, and cells at most. A cell of a key is one window partition, so a sort
#: is spread over so many tasks.
CELL_ROWS = 50_000
CELLS = 2048
#: A sketch of a key's values errs by one in so many ranks; a quantile is looked for twice as far around it.
SKETCH = 10_000


def splitters(rows: DataFrame, value: str, cells: int) -> list[float]:
    """At most ``cells - 1`` bounds between cells of like size, from a mergeable sketch whose rank error is a quarter of a cell.

    They depend on ranks alone, so neither outliers nor crowded ranges fill a cell; many rows of one value would, which
    is why callers give distinct values, or order by something else inside. Only the bounds come to the driver.
    """
    if cells < 2:
        return []
    v = rows.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    return sorted(set(v.agg(F.percentile_approx("v", [(i + 1) / cells for i in range(cells - 1)], 4 * cells)).first()[0] or []))


def cell_of(value: str, bounds: list[float]) -> Column:
    """How many of the rising bounds are below the value (NaN is above all): a binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    number, literal = F.col(value).cast("double"), F.lit(bounds)
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda acc, step: F.when(F.get(literal, acc + step - 1) < number, acc + step).otherwise(acc))


def celled(rows: DataFrame, value: str, cells: int = CELLS) -> DataFrame:
    """``rows`` plus ``_cell``: growing with ``value``; no cell has more than twice its share of rows of distinct values."""
    return rows.withColumn("_cell", cell_of(value, splitters(rows, value, cells)))


@dataclass
class RankIndex:
    """Distinct values of each key, in order, with their counts; every rank statistic reads it, none the input again.

    ``rows``: keys, value, the counts, ``_cell`` and each count's sum inside the cell before the row. ``single``: there
    is only one cell, so these sums are those of the key.
    """

    keys: list[str]
    value: str
    counts: list[str]
    rows: DataFrame
    single: bool

    def cells(self, **more: Column) -> DataFrame:
        """keys, _cell, sums of the counts and of ``more``, the counts' sums in the key's cells before, and in all."""
        total = self.rows.groupBy(*self.keys, "_cell").agg(*[F.sum(c).alias(c) for c in self.counts], *[c.alias(n) for n, c in more.items()])
        key = Window.partitionBy(*self.keys)
        below = key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        return total.select("*", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_before") for c in self.counts], *[F.sum(c).over(key).alias(f"{c}_all") for c in self.counts])

    def ranked(self) -> DataFrame:
        """keys, value, and for each count: itself, ``<count>_before`` and ``<count>_all``, the key's sums below the value and over all."""
        keep = [*self.keys, self.value, *self.counts]
        if self.single:
            key = Window.partitionBy(*self.keys, "_cell")
            return self.rows.select(*keep, *[F.col(f"_in_{c}").alias(f"{c}_before") for c in self.counts], *[F.sum(c).over(key).alias(f"{c}_all") for c in self.counts])
        rows = staged(self.rows, "rank-rows")
        at = RankIndex(self.keys, self.value, self.counts, rows, False).cells().select(*self.keys, "_cell", *[f"{c}_{end}" for c in self.counts for end in ("before", "all")])
        return rows.join(at, [*self.keys, "_cell"]).select(*keep, *[(F.col(f"{c}_before") + F.col(f"_in_{c}")).alias(f"{c}_before") for c in self.counts], *[f"{c}_all" for c in self.counts])

    def wins(self, p: str, q: str) -> DataFrame:
        """keys, p, q, wins: over all pairs of a row of count ``p`` and one of ``q``, how often p's value is larger (a tie is a half).

        A cell's wins are counted inside; those over the cells before are its p times their q.
        """
        inside = F.sum(F.col(p) * (F.col(f"_in_{q}") + F.col(q) / F.lit(2.0)))
        cells = self.cells(_w=inside)
        return cells.groupBy(*self.keys).agg(F.sum(p).alias(p), F.sum(q).alias(q), F.sum(F.col("_w") + F.col(p) * F.col(f"{q}_before")).alias("wins"))


def rank_index(df: DataFrame, keys: list[str], value: str, cells: int | None = None, **counts: Column) -> RankIndex:
    """An index of ``df`` on ``value`` (nulls left out) with the given sums per distinct value; one count of rows named n by default.

    The input is read once: counts per key and value, combined before the shuffle, are staged. Values are then dealt
    to cells of like size by splitters found on the counts, and ordered inside cells. Cells follow from the number of
    distinct values (``cells`` overrides it); results don't depend on them.
    """
    counts = counts or {"n": F.count("*")}
    grouped = staged(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for n, c in counts.items()]), "rank-counts")
    return index_of(grouped, keys, value, list(counts), cells)


def index_of(grouped: DataFrame, keys: list[str], value: str, counts: list[str], cells: int | None = None) -> RankIndex:
    """The index of a table that has one row per key and value already, and is cheap to read again."""
    cells = cells or min(CELLS, -(-grouped.count() // CELL_ROWS))
    bounds = splitters(grouped, value, cells)
    inside = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = grouped.filter(F.col(value).isNotNull()).select(*keys, value, *counts, cell_of(value, bounds).alias("_cell"))
    return RankIndex(keys, value, counts, rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in counts]), not bounds)


def sums_before(grouped: DataFrame, keys: list[str], value: str, counts: list[str], cells: int | None = None) -> DataFrame:
    """``grouped`` plus ``<count>_before``: the sum of each count over the key's rows with a smaller ``value``.

    ``grouped`` has one row per key and value (null values are dropped) and any further columns. It is staged, so
    what made it runs once.
    """
    rows = staged(grouped.filter(F.col(value).isNotNull()), "rank-rows")
    ranks = index_of(rows, keys, value, counts, cells).ranked()
    if set(grouped.columns) == {*keys, value, *counts}:
        return ranks.drop(*[f"{c}_all" for c in counts])
    return rows.join(ranks.select(*keys, value, *[f"{c}_before" for c in counts]), [*keys, value])


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank", weight: str | None = None, cells: int | None = None) -> DataFrame:
    """keys, value, n and the average rank (from 1) that its n rows share; ``weight``: a column that counts rows."""
    r = rank_index(df, keys, value, cells, n=F.sum(weight) if weight else F.count("*")).ranked()
    return r.select(*keys, value, "n", (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(out))


def ranked(df: DataFrame, keys: list[str], value: str, weight: str | None = None, cells: int | None = None) -> DataFrame:
    """keys, value, n, n_before, n_all: counts (or summed weights) of each distinct value, of smaller ones, of all."""
    return rank_index(df, keys, value, cells, n=F.sum(weight) if weight else F.count("*")).ranked()


def _covers(at):
    return (at >= F.col("n_before")) & (at < F.col("n_before") + F.col("n"))


def value_at(rank: DataFrame, keys: list[str], value: str, place, out: str) -> DataFrame:
    """keys and ``out``: the value at a rank (from 0; between two, interpolated) that may differ by key."""
    near = rank.withColumn("_at", place).filter(_covers(F.floor("_at")) | _covers(F.ceil("_at")))
    low, high = F.max(F.when(_covers(F.floor("_at")), F.col(value))), F.max(F.when(_covers(F.ceil("_at")), F.col(value)))
    at = F.max("_at")
    return near.groupBy(*keys).agg((low + (high - low) * (at - F.floor(at))).alias(out))


def quantile_near(rows: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """keys and ``out``: the interpolated quantile at the share ``p``, exact; of all values only those around it are ranked.

    ``rows`` is cheap to read again, and has no null in ``value``. A sketch gives two values around the quantile. What is
    below and between them is counted, so it is known whether the quantile lies there; if not (keys of few rows),
    all values of the key are ranked. The result has a row a key and is staged, so that the planner knows its size.
    """
    v = F.col(value)
    bounds = F.percentile_approx(v, [max(p - 2 / SKETCH, 0.0), min(p + 2 / SKETCH, 1.0)], SKETCH)
    near = staged(rows.groupBy(*keys).agg(F.count("*").alias("_all"), bounds.alias("_q")), "near")
    near = near.select(*keys, "_all", F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high"))
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    seen = rows.join(near, keys).groupBy(*keys, "_all", "_low", "_high").agg(one(v < F.col("_low")).alias("_below"), one(v <= F.col("_high")).alias("_upto"))
    place = p * (F.col("_all") - 1)
    seen = seen.withColumn("_there", (F.floor(place) >= F.col("_below")) & (F.ceil(place) < F.col("_upto")))
    seen = staged(seen.select(*keys, "_low", "_high", "_there", (place - F.when(F.col("_there"), F.col("_below")).otherwise(0)).alias("_place")), "near-bounds")
    few = rows.join(seen, keys).filter(~F.col("_there") | v.between(F.col("_low"), F.col("_high"))).select(*keys, value)
    return staged(value_at(ranked(few, keys, value).join(seen, keys), keys, value, F.col("_place"), out), "near-value")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, ps: list[float] | int, cells: int | None = None) -> DataFrame:
    """keys, p, q: linearly interpolated quantiles, exact at any size; null values are left out.

    ``ps``: the shares, or a number of evenly spaced ones from 0 to 1. Unlike the built-in aggregate, no task
    holds a key's values: they collapse to counts per distinct value, are ranked by cells, and only the
    rows at the wanted ranks travel on.
    """
    return quantiles_of(ranked(df, keys, value, cells=cells), keys, value, ps)


def quantiles_of(r: DataFrame, keys: list[str], value: str, ps: list[float] | int) -> DataFrame:
    """``exact_quantiles`` from the rows of an index: several sets of shares need one index."""
    place = lambda p: p * (F.col("n_all") - 1)
    if isinstance(ps, int):
        # only indices whose rank can fall on this row or next to it
        scale = (ps - 1) / F.greatest(F.col("n_all") - 1, F.lit(1))
        first = F.greatest(F.floor((F.col("n_before") - 1) * scale), F.lit(0))
        last = F.least(F.ceil((F.col("n_before") + F.col("n")) * scale), F.lit(ps - 1))
        last = F.when(F.col("n_all") == 1, F.lit(ps - 1)).otherwise(last)
        wanted = F.transform(F.sequence(first, F.greatest(first, last)), lambda i: i / F.lit(float(ps - 1)))
    else:
        wanted = F.array(*[F.lit(float(p)) for p in ps])
    hits = F.filter(wanted, lambda p: _covers(F.floor(place(p))) | _covers(F.ceil(place(p))))
    h = r.withColumn("_h", hits).filter(F.size("_h") > 0).withColumn("p", F.explode("_h"))
    return value_at(h, [*keys, "p"], value, place(F.col("p")), "q")


def quantile_columns(df: DataFrame, keys: list[str], value: str, named: dict[str, float], cells: int | None = None) -> DataFrame:
    """keys and one column per name with its exact quantile; NULL for a key without values isn't made: it has no row."""
    return named_quantiles(ranked(df, keys, value, cells=cells), keys, value, named)


def named_quantiles(r: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """``quantile_columns`` from the rows of an index."""
    q = quantiles_of(r, keys, value, sorted(set(named.values())))
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in named.items()])
