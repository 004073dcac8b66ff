"""Series in cells: the same rows as in one piece, a long series over many tasks, and the loops that they stand for."""
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewin.operators import cells, resampling, series
from tidewin.plans.catalogue import ORACLE_SQL, QUERIES

IN_CELLS = ["hysteresis", "hysteresis_sweep", "hyst_exit_select", "hysteresis_3way_grid", "n_of_m", "n_of_m_sweep", "events_islands", "events_total_per_hour", "runs_of_true", "context_k", "context_split_leaks", "contiguous_folds_purged", "running_ema", "rechunk_series", "window_quota", "interval_merge", "strided_downsample", "block_keys", "class_metrics", "gap_anti_join"]


@pytest.fixture
def cut(monkeypatch):
    monkeypatch.setattr(cells, "SMALL_BYTES", 0)
    monkeypatch.setattr(cells, "CELL_ROWS", 60)


@pytest.mark.parametrize("name", IN_CELLS)
def test_queries_are_the_same_in_cells(name, spark, small, cut):
    assert oracle.differences(spark, oracle.connect(small), small, QUERIES[name], ORACLE_SQL[name]) == ""


def rows_of_series(n=600):
    """A series with half of all rows, small ones, one without a key; ties in time, nulls."""
    rng = random.Random(6)
    keys = ["long"] * (n // 2) + [rng.choice(["a", "b", "c", None]) for _ in range(n - n // 2)]
    return [(k, rng.randint(0, n // 3) if k != "long" else i // 2, i, None if rng.random() < 0.05 else round(rng.random(), 2)) for i, k in enumerate(keys)]


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, i long, v double").repartition(5)


def by_series(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


OPS = {
    "hysteresis": lambda d: series.hysteresis(d, F.col("v"), F.lit(0.8), F.lit(0.4), ["k"], ["t", "i"], "y"),
    "n_of_m": lambda d: series.n_of_m(d, F.col("v") > 0.5, 3, 5, ["k"], ["t", "i"], "y"),
    "n_of_1": lambda d: series.n_of_m(d, F.col("v") > 0.5, 1, 1, ["k"], ["t", "i"], "y"),
    "positions": lambda d: cells.positions(d, ["k"], ["t", "i"], "y"),
    "running_sum": lambda d: cells.running_sum(d, F.col("i"), ["k"], ["t", "i"], "y"),
    "previous": lambda d: cells.previous(d, F.col("v"), ["k"], ["t", "i"], "y"),
    "last": lambda d: cells.running_last(d, {"y": F.col("v")}, ["k"], ["t", "i"]),
    "ema": lambda d: series.ema(d, F.col("v"), 0.9, ["k"], ["t", "i"], "y"),
    "recurrence": lambda d: cells.recurrence(d, F.col("v") - 0.5, F.col("i") % 3 - 1, ["k"], ["t", "i"], "y", 2.0),
    "quota": lambda d: series.quota(d, 7, ["k"], ["t", "i"]).withColumn("y", F.lit(1)),
    "islands": lambda d: series.islands(d, F.col("v") > 0.3, ["k"], ["t", "i"], "y"),
}


def loops(name, rows):
    out = {}
    for own in by_series(rows).values():
        on, y, ys, was, total, seen = False, 2.0, None, None, 0, None
        for at, (_, _, i, v) in enumerate(own):
            if name == "hysteresis":
                on = v is not None and (v > 0.8 or (on and v > 0.4))
                out[i] = on
            elif name in ("n_of_m", "n_of_1"):
                n, m = (3, 5) if name == "n_of_m" else (1, 1)
                above = [r[3] is not None and r[3] > 0.5 for r in own]
                out[i] = above[at] if len(own) < m else sum(above[max(0, at - m + 1) : at + 1]) >= n
            elif name == "positions":
                out[i] = at
            elif name == "running_sum":
                total += i
                out[i] = total
            elif name == "previous":
                out[i], was = was, v
            elif name == "last":
                seen = seen if v is None else v
                out[i] = seen
            elif name == "ema":
                ys = ys if v is None else v if ys is None else 0.9 * ys + 0.1 * v
                out[i] = ys
            elif name == "recurrence":
                y = y + i % 3 - 1 if v is None else (v - 0.5) * y + i % 3 - 1
                out[i] = y
            elif name == "islands":
                flag = v is not None and v > 0.3
                if flag:
                    out[i] = total
                total += not flag
            elif name == "quota":
                if len(own) <= 7 or at in np.round(np.linspace(0, len(own) - 1, 7)).astype(int):
                    out[i] = 1
    return out


@pytest.mark.parametrize("name", OPS)
def test_same_as_loops(name, spark, monkeypatch):
    rows = rows_of_series()
    want = loops(name, rows)
    for small, per_cell in ((cells.SMALL_BYTES, 0), (0, 40)):
        monkeypatch.setattr(cells, "SMALL_BYTES", small)
        monkeypatch.setattr(cells, "CELL_ROWS", per_cell or cells.CELL_ROWS)
        df = OPS[name](table(spark, rows))
        assert df.columns == ["k", "t", "i", "v", "y"]
        got = {r["i"]: r["y"] for r in df.collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-9) if isinstance(want[i], float) else got[i] == want[i] for i in want), name
        assert OPS[name](table(spark, [])).count() == 0


def test_a_long_series_is_worked_on_by_many_tasks(spark, monkeypatch):
    """Half of 20,000 rows are of one series; no window partition holds more than a few cells' rows."""
    monkeypatch.setattr(cells, "SMALL_BYTES", 0)
    monkeypatch.setattr(cells, "CELL_ROWS", 500)
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 997).alias("k"), (F.col("id") * F.col("id")).alias("t"), "id")
    dealt = cells.deal(df, ["t"])
    sizes = [r["n"] for r in dealt.groupBy("k", "_cell").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2 * 500 and len({r["_cell"] for r in dealt.select("_cell").distinct().collect()}) == 40
    plan = series.hysteresis(df.withColumn("v", F.col("id") % 10 / 10), F.col("v"), F.lit(0.7), F.lit(0.2), ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line and "_event_" in line]
    assert windows and all("_cell" in line.split("windowspecdefinition")[1] for line in windows)
    got = series.hysteresis(df.withColumn("v", F.col("id") % 10 / 10), F.col("v"), F.lit(0.7), F.lit(0.2), ["k"], ["t"])
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("v") > 0.7, True).when(F.col("v") <= 0.2, False)
    assert got.withColumn("want", F.coalesce(F.last(turn, True).over(w), F.lit(False))).filter("on <> want").count() == 0


def test_block_resamples_equal_loops(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, b, rng.randint(0, 9), None if rng.random() < 0.1 else rng.randint(0, 9)) for g in (0, 3, 77) for b in rng.sample(range(500), {0: 1, 3: 40, 77: 9}[g])] + [(None, 1, 5, 5)]
    monkeypatch.setattr(resampling, "DRAWS", 170)
    got = {r["rep"]: (r["x"], r["y"]) for r in resampling.block_resamples(spark.createDataFrame(rows, "g long, b long, x long, y long").repartition(3), "g", "b", ["x", "y"], 17).collect()}
    for rep in range(17):
        sums = [0, 0]
        for g in (0, 3, 77):
            own = sorted((b, x or 0, y or 0) for h, b, x, y in rows if h == g)
            for i in range(len(own)):
                pick = own[(rep * 7919 + i * 104729 + g * 1299709 + rep * i * 15485863) % 1000003 % len(own)]
                sums[0] += pick[1]
                sums[1] += pick[2]
        assert got[rep] == tuple(sums)


def test_spans_of_every_length(spark, monkeypatch):
    """Spans from milliseconds to years: every overlapping pair once, few rows a span and a point; points in spans, in one piece and in cells."""
    from tidewin.operators import joins

    rng = random.Random(9)
    year = 365 * 86400.0
    spans = lambda n, tag: [(rng.choice("aab"), f"{tag}{i}", x, x + rng.choice([0.001, 0.5, 1, 64, 64.0001, 3600, 86400, 30 * 86400, year, 5 * year]) * rng.uniform(0.5, 1)) for i, x in ((i, rng.choice([-1, 1]) * rng.uniform(0, 3 * year) if i % 3 else float(rng.randint(-5, 5) * 64)) for i in range(n))]
    left, right = spans(150, "l") + [("a", "empty", 5.0, 5.0), ("a", "null", None, 7.0), (None, "key", 0.0, 9.0)], spans(150, "r") + [("b", "back", 9.0, 3.0), (None, "key", 0.0, 9.0)]
    l, r = spark.createDataFrame(left, "k string, x string, a double, b double"), spark.createDataFrame(right, "k string, y string, c double, d double")
    got = sorted((p["x"], p["y"]) for p in joins.overlap_join(l, r, ["k"], ("a", "b"), ("c", "d"), 1.0).collect())
    proper = lambda rows: [q for q in rows if q[0] is not None and None not in q and q[2] < q[3]]
    want = sorted((p[1], q[1]) for p in proper(left) for q in proper(right) if p[0] == q[0] and p[2] < q[3] and q[2] < p[3])
    assert got == want and len(want) > 2000
    level = joins._level(F.col("a"), F.col("b"), 1.0)
    size = F.pow(F.lit(2.0), level)
    cells_of = l.filter("a < b").select((F.ceil(F.col("b") / size) - F.floor(F.col("a") / size)).alias("n"), level.alias("l"))
    assert cells_of.agg(F.max("n")).first()[0] <= 2 and cells_of.select("l").distinct().count() <= 30
    points = spark.createDataFrame([(k, i, t) for i, (k, _, t, _) in enumerate(left)], "k string, i long, t double")
    inside = {i for i, (k, _, t, _) in enumerate(left) if k and t is not None and any(q[0] == k and q[2] <= t < q[3] for q in proper(right))}
    for small, rows in ((cells.SMALL_BYTES, cells.CELL_ROWS), (0, 20)):
        monkeypatch.setattr(cells, "SMALL_BYTES", small)
        monkeypatch.setattr(cells, "CELL_ROWS", rows)
        assert {p["i"] for p in joins.interval_join(points, r, ["k"], "t", "c", "d").collect()} == inside
        anti = joins.interval_join(points, r, ["k"], "t", "c", "d", how="left_anti")
        assert anti.columns == points.columns and {p["i"] for p in anti.collect()} == set(range(len(left))) - inside
