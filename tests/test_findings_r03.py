"""What the third review found: work that grew in one task, in the plan or with the number of series, and ties between windows."""
import os

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from tidewin.operators import cells, joins, ordering, robust, series
from tidewin.plans.catalogue import ORACLE_SQL, QUERIES


def parquet_files(path):
    return [f for _, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet")]


def test_nearest_meets_in_many_tasks(spark):
    """No query is broadcast, ties go by id, and vectors without a distance come last."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(0, 2, 6)]) for i in range(300)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [1e200] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    near = joins.nearest(df.filter("id < 40"), df, "id", "v", "id", "v", 303, [], 300)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in near.collect():
        got.setdefault(r["q_id"], []).append((r["place"], r["r_id"], r["d2"]))
    for i, v in rows[:40]:
        want = sorted((sum((x - y) ** 2 if y < 1e100 else np.inf for x, y in zip(v, w)), j) for j, w in rows if w and None not in w)
        own = sorted(got[i])
        assert [j for _, j, _ in own] == [j for _, j in want] + [300, 301] and [d for *_, d in own[:300]] == [d for d, _ in want[:300]]


def test_equal_intervals_may_change_places_between_windows(spark, monkeypatch):
    """Rows that go on may come before the ones that begin a union, if both are of one interval."""
    real = series.running_sum
    monkeypatch.setattr(series, "running_sum", lambda df, *a, **k: real(df.coalesce(1).sortWithinPartitions("_new"), *a, **k))
    df = spark.createDataFrame([("a", x, x + 1) for x in (0, 5, 9) for _ in range(3)], "k string, lo int, hi int")
    assert sorted((r["lo"], r["hi"]) for r in series.merge_intervals(df, ["k"], "lo", "hi").collect()) == [(0, 1), (5, 6), (9, 10)]


def test_short_series_are_not_cut(spark, monkeypatch):
    """Many short series stay whole, however many rows they have together; beside a long one they are of one cell."""
    monkeypatch.setattr(cells, "SMALL_BYTES", 0)
    monkeypatch.setattr(cells, "CELL_ROWS", 50)
    short = spark.range(3000).select((F.col("id") % 100).alias("k"), F.col("id").alias("t"))
    assert not cells.dealt(cells.deal(short, ["t"], keys=["k"]))
    both = short.union(spark.range(1000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("t")))
    n = {r["k"]: r["n"] for r in cells.deal(both, ["t"], keys=["k"]).groupBy("k").agg(F.countDistinct("_cell").alias("n")).collect()}
    assert n.pop(None) >= 20 and set(n.values()) == {1}


@pytest.mark.parametrize("name", ["hysteresis_3way", "hyst_exit_select", "hysteresis_sweep"])
def test_no_row_is_multiplied_before_the_windows(spark, small, name):
    from tidewin.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate ") < plan.index("Window ") and "Generate " not in plan[plan.rindex("Window ") :]


def test_several_n_of_m_in_cells(spark, monkeypatch):
    """Specifications of one pass give what each gives alone, in one piece and in cells."""
    df = spark.range(400).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), (F.xxhash64("id") % 2 == 0).alias("v"))
    wanted = {"a": (1, 1), "b": (2, 3), "c": (4, 7)}
    for small, rows in ((cells.SMALL_BYTES, cells.CELL_ROWS), (0, 20)):
        monkeypatch.setattr(cells, "SMALL_BYTES", small)
        monkeypatch.setattr(cells, "CELL_ROWS", rows)
        for r in series.n_of_m_each(df, F.col("v"), wanted, ["k"], ["t"]).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("t", "v", *wanted))).alias("x")).collect():
            v = [x["v"] for x in r["x"]]
            for name, (n, m) in wanted.items():
                assert [x[name] for x in r["x"]] == [sum(v[max(0, i - m + 1) : i + 1]) >= n for i in range(len(v))]


def test_shards_are_written_by_as_many_tasks_as_they_need(spark, small, monkeypatch):
    from tidewin.plans import sinks

    monkeypatch.setattr(sinks, "SHARD_ROWS", 500)
    assert len({f.split("-")[1] for f in sinks._shards(spark, small, None).inputFiles() for f in [f.rsplit("/", 1)[-1]]}) >= 10


def test_streams_are_written_by_many_tasks(spark, small, monkeypatch):
    from tidewin.plans import streams

    paths = []
    real = streams.scratch
    monkeypatch.setattr(streams, "scratch", lambda s, name: paths.append(real(s, name)) or paths[-1])
    monkeypatch.setattr(streams, "FILE_ROWS", 60)
    streams._shuffled_stream(spark, small)
    n = len(parquet_files(paths[-1]))
    assert n % 4 == 0 and n >= 12
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        streams._stream(spark, small)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parquet_files(paths[-1])) == 4


def test_trims_rank_only_values_near_their_quantiles(spark, monkeypatch):
    """Three quantiles of 60,000 values rank a few of them, and are those of numpy; keys of few rows are ranked whole."""
    seen = []
    real = ordering.rank_index
    monkeypatch.setattr(ordering, "rank_index", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    rng = np.random.default_rng(14)
    v = {"big": rng.lognormal(size=60_000), "ties": rng.integers(0, 4, 31).astype(float), "six": rng.normal(size=6), "one": np.array([2.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in v.items() for x in xs] + [("one", None)], "g string, x double").repartition(7)
    got = {r["g"]: r[1:] for r in robust.trimmed_p99(df, "x", ["g"], 2.0).collect()}
    assert len(seen) == 3 and max(seen) < 600
    for g, xs in v.items():
        m = np.median(xs)
        kept = xs[xs <= m + 2 * np.median(np.abs(xs - m))]
        n, n_kept, p99 = got.pop(g)
        assert (n, n_kept) == (len(xs), len(kept)) and abs(p99 - np.quantile(kept if len(kept) > 10 else xs, 0.99)) < 1e-12
    assert not got


def test_held_exits_are_as_many_hystereses(spark, monkeypatch):
    """How many of several exits hold, against a loop for each exit; nulls change nothing; in one piece and in cells."""
    rng = np.random.default_rng(12)
    rows = [(int(i % 3), i, None if rng.random() < 0.1 else float(rng.integers(-10, 11))) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t int, v double").repartition(3)
    wanted = {"a": (7, [0, 2, 5, 7]), "b": (-6, [-3, -6]), "c": (9, [-8])}
    for small, size in ((cells.SMALL_BYTES, cells.CELL_ROWS), (0, 20)):
        monkeypatch.setattr(cells, "SMALL_BYTES", small)
        monkeypatch.setattr(cells, "CELL_ROWS", size)
        got = series.exits_held(df, {n: (F.col("v"), F.lit(on), [F.lit(x) for x in offs]) for n, (on, offs) in wanted.items()}, ["k"], ["t"])
        assert got.columns == ["k", "t", "v", "a", "b", "c"]
        got = {r["t"]: r for r in got.collect()}
        assert len(got) == len(rows)
        for n, (on, offs) in wanted.items():
            for k in range(3):
                last_on, last_off = -1, dict.fromkeys(offs, -1)
                for _, t, v in (r for r in rows if r[0] == k):
                    if v is not None:
                        last_on = t if v > on else last_on
                        last_off = {x: t if not v > x else at for x, at in last_off.items()}
                    assert got[t][n] == sum(last_on > at for at in last_off.values())


@pytest.mark.parametrize("value", ["value", "CASE WHEN event_id % 7 <> 0 THEN value END", "value - 600", "CASE WHEN event_type = 'signup' THEN value END"])
def test_the_grid_on_odd_scores(spark, small, tmp_path, value):
    """Scores that are missing or all below 0, and a head without thresholds, give the rows of the SQL; the work is a few columns a head and entry."""
    con = oracle.connect(small)
    con.sql(f"COPY (SELECT * REPLACE ({value} AS value) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    run = QUERIES["hysteresis_3way_grid"]
    assert oracle.differences(spark, con, str(tmp_path), run, ORACLE_SQL["hysteresis_3way_grid"]) == ""
    assert run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition") <= 2 * 12 + 4
