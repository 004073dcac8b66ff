"""Hand-made cases with known answers."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewin.functions import arrays as X
from tidewin.functions import scalars as S
from tidewin.operators import audit, decisions, joins, ordering, planning, robust, series
from tidewin.operators.auroc import auroc, auroc_against_all, spearman


def flags(df, *order):
    return [r["on"] for r in df.orderBy(*order).collect()]


def ordered(spark, values, key="a"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "k string, i int, v double")


@pytest.mark.parametrize("values, want", [([.9, .3, .6, .1, .6], [1, 0, 0, 0, 0]), ([.9, .6, .5, .6], [1, 1, 0, 0]), ([.6, .9, .6, None, .6], [0, 1, 1, 0, 0])])
def test_hysteresis(spark, values, want):
    h = series.hysteresis(ordered(spark, values), F.col("v"), F.lit(.8), F.lit(.5), ["k"], ["i"])
    assert flags(h, "i") == [bool(x) for x in want]


def test_hysteresis_against_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, float(v)) for k in range(8) for i, v in enumerate(rng.random(60))]
    got = {(r["k"], r["i"]): r["on"] for r in series.hysteresis(spark.createDataFrame(rows, "k int, i int, v double"), F.col("v"), F.lit(.8), F.lit(.4), ["k"], ["i"]).collect()}
    state = {}
    for k, i, v in rows:
        state[k] = v > .8 or (state.get(k, False) and v > .4)
        assert got[k, i] == state[k]


@pytest.mark.parametrize("values, want", [([.9, .1, .9, .1, .1], [0, 0, 1, 0, 0]), ([.9, .1], [1, 0])])
def test_n_of_m(spark, values, want):
    assert flags(series.n_of_m(ordered(spark, values), F.col("v") > .5, 2, 3, ["k"], ["i"]), "i") == [bool(x) for x in want]


def test_context(spark):
    df = spark.createDataFrame([("a", float(o)) for o in (0, 1, 2, 9)], "k string, o double")
    got = [r["context"] for r in series.context(df, 3, ["k"], "o", 1.0).orderBy("o").collect()]
    assert got == [[0, 0, 0], [0, 0, 1], [0, 1, 2], [3, 3, 3]]


def test_events(spark):
    df = spark.createDataFrame([("a", 0, True, True), ("a", 1, True, False), ("a", 2, False, False), ("a", 3, True, False), ("b", 0, False, True)], "k string, i int, o boolean, t boolean")
    got = {r["k"]: (r["detected"], r["false_events"], r["missed"]) for r in series.events(df, F.col("o"), F.col("t"), 2, ["k"], ["i"]).collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 0, 1)}


def test_auroc_ties_and_missing_class(spark):
    df = spark.createDataFrame([("a", 1., 1), ("a", 2., 1), ("a", 1., 0), ("a", 0., 0), ("b", 3., 1)], "k string, s double, y int")
    got = {r["k"]: r["auc"] for r in auroc(df, "s", F.col("y") == 1, ["k"]).collect()}
    assert got == {"a": .875, "b": None}


def test_auroc_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(s), int(y)) for k, s, y in zip(rng.integers(0, 3, 400), rng.integers(0, 30, 400), rng.integers(0, 2, 400))]
    got = {r["k"]: r["auc"] for r in auroc(spark.createDataFrame(rows, "k int, s double, y int"), "s", F.col("y") == 1, ["k"]).collect()}
    for k in range(3):
        p, n = [s for a, s, y in rows if a == k and y], [s for a, s, y in rows if a == k and not y]
        assert got[k] == pytest.approx(sum((a > b) + .5 * (a == b) for a in p for b in n) / len(p) / len(n))
    strata = {r["stratum"]: r["auc"] for r in auroc_against_all(spark.createDataFrame(rows, "k int, s double, y int"), "s", F.col("y") == 1, F.col("k"), 1).collect()}
    n = [s for _, s, y in rows if not y]
    for k in range(3):
        p = [s for a, s, y in rows if a == k and y]
        assert strata[k] == pytest.approx(sum((a > b) + .5 * (a == b) for a in p for b in n) / len(p) / len(n))


def test_spearman_constant_side(spark):
    df = spark.createDataFrame([("a", 1., 2.), ("a", 2., 3.), ("b", 1., 1.), ("b", 1., 2.)], "k string, x double, y double")
    assert {r["k"]: r["rho"] for r in spearman(df, "x", "y", ["k"]).collect()} == {"a": 1.0, "b": None}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=501), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {round(r["p"], 6): r["q"] for r in ordering.exact_quantiles(df, [], "v", ps).collect()}
    for p in ps:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)
    assert ordering.exact_quantiles(df.filter("v > 1e9"), [], "v", ps).count() == 0
    for size, n in ((501, 11), (501, 1000), (7, 64), (2, 5), (1, 3)):
        part = spark.createDataFrame([(float(v),) for v in values[:size]], "v double")
        got = [r["q"] for r in ordering.exact_quantiles(part, [], "v", n).orderBy("p").collect()]
        assert got == pytest.approx(np.quantile(values[:size], np.linspace(0, 1, n)).tolist(), abs=1e-12)


def test_interval_merge(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 3, 4)], "k string, lo int, hi int")
    assert sorted((r["lo"], r["hi"]) for r in series.merge_intervals(df, ["k"], "lo", "hi").collect()) == [(0, 2), (3, 4)]


def test_overlap(spark):
    df = spark.createDataFrame([([[0., 1.], [2., 5.]],)], "a array<array<double>>")
    assert df.select(joins.overlap_of_list(F.col("a"), F.lit(.5), F.lit(3.)).alias("o")).first()["o"] == 1.5


def test_tier_deal(spark):
    tiers = [("calm", .35), ("light", .20), ("moderate", .15), ("strong", .10), ("rain", .12), ("heavy", .08)]
    df = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(tiers)], "ord int, name string, w double")
    got = series.deal_largest_remainder(df, "w", F.lit(10), "ord").orderBy("ord").collect()
    assert [r["n"] for r in got] == [4, 2, 1, 1, 1, 1]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(S.gate_db(2.5, 3.0, 70.0)) == pytest.approx(10 * math.log10(2.5**2 / 420))
    assert one(S.quantise(F.lit(.3), .2)) == pytest.approx(.2)
    assert one(S.clip(F.lit(5.0), float("inf"))) == 5.0
    assert one(S.finite_or(F.lit(float("nan")))) == 0.0
    assert one(S.decibel(F.lit(1.0), F.lit(0.0))) is None
    assert one(X.interp(F.lit(1.5), [1, 2, 3], [10, 20, 0])) == 15 and one(X.interp(F.lit(9.0), [1, 2, 3], [10, 20, 0])) == 0
    assert one(S.level_number(F.lit("multiple"))) == 2 and one(S.level_number(F.lit("1"))) == 1


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.,), (5.,), (10.,), (11.,)], "x double")
    got = [r["b"] for r in df.select(audit.bin_of(F.col("x"), 0, 5, 2).alias("b"), "x").orderBy("x").collect()]
    assert got == [0, 1, 1, None]


def test_cramers_v_with_empty_cell(spark):
    rows = [("a", "x")] * 10 + [("b", "y")] * 10
    r = audit.cramers_v(spark.createDataFrame(rows, "p string, q string"), "p", "q").first()
    assert (r["n"], r["chi2"], r["v"]) == (20, pytest.approx(20), pytest.approx(1))


def test_stored_threshold_is_an_index(spark):
    df = spark.createDataFrame([("r", float(i)) for i in range(1000)], "k string, v double")
    q = decisions.quantile_vector(df, "v", ["k"])
    assert q.select(decisions.stored_threshold(F.col("q"), 0.1).alias("t")).first()["t"] == 899.0


def test_decisions(spark):
    df = spark.createDataFrame([(.9, .9, .1), (.2, .3, .1), (.6, .9, .9)], "h double, a double, v double")
    sc, tau = {k: F.col(k) for k in "hav"}, {k: F.lit(.5) for k in "hav"}
    got = [tuple(r) for r in df.select(decisions.strongest(sc, tau, ("h", "a", "v")), decisions.largest_margin(sc, tau, ("h", "v", "a"))).collect()]
    assert got == [("h", "h"), ("nothing", "nothing"), ("a", "v")]


def test_f1_is_null_at_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "nothing")], "t string, d string")
    got = {r["cls"]: r["f1"] for r in decisions.class_metrics(df, "t", "d", ["a", "b"]).collect()}
    assert got["a"] is None and got["b"] is None and got["present"] == pytest.approx(2 / 3)


def test_asof(spark):
    left = spark.createDataFrame([("a", 1, -1.), ("a", 2, .5), ("a", 3, 9.), ("a", 4, 1.), ("b", 5, 1.)], "k string, id int, t double")
    right = spark.createDataFrame([("a", 0., 0.), ("a", 1., 10.), ("a", 2., 20.)], "k string, x double, y double")
    got = {r["id"]: r["d"] for r in joins.asof_interpolate(left, right, ["k"], "t", "x", "y", "d").collect()}
    assert got == {1: 0., 2: 5., 3: 20., 4: 10., 5: None}


def test_tolerance_and_intervals(spark):
    a = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("s", 1.0)], "k string, t double")
    b = spark.createDataFrame([("r", 1.0000004)], "k string, t double")
    assert [tuple(r) for r in joins.tolerance_semi(a, b, ["k"], "t", 1e-6).collect()] == [("r", 1.0)]
    g = spark.createDataFrame([("r", .5, 2.0)], "k string, lo double, hi double")
    assert sorted(tuple(r) for r in joins.interval_join(a, g, ["k"], "t", "lo", "hi", 1.0, "left_anti").collect()) == [("r", 2.0), ("s", 1.0)]


def test_quota_equals_numpy(spark):
    for n, k in ((10, 4), (49, 24), (7, 7), (5, 9)):
        got = sorted(r["i"] for r in series.quota(ordered(spark, [0.] * n), k, ["k"], ["i"]).collect())
        assert got == sorted(set(np.round(np.linspace(0, n - 1, k)).astype(int))) if n > k else list(range(n))


def test_folds_purge(spark):
    rows = series.contiguous_folds(ordered(spark, [0.] * 10), 5, ["k"], ["i"], purge=1).orderBy("i").collect()
    assert [r["fold"] for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert [sorted(r["purged_for"]) for r in rows][1:4] == [[1], [0], [2]]


def test_scaler_clips(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, 1000.0)], "f int, v double")
    s = spark.createDataFrame([(0, 0.0, 1.0)], "f int, mean double, std double")
    assert max(r["z"] for r in robust.apply_standard(df, s, "f", "v").collect()) == 8.0


def test_run_grid_and_expand(spark):
    cells = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "k string, n long")
    assert sorted((r["k"], r["scene_id"]) for r in planning.expand(cells, "n", 100, ["k"]).collect()) == [("a", 100), ("a", 101), ("c", 102)]


def test_running_min_and_inversion(spark):
    curve = spark.createDataFrame([("a", 1., 20.), ("a", 10., 0.), ("a", 100., 5.)], "k string, d double, v double")
    want = spark.createDataFrame([("a", 10.), ("a", 30.), ("a", -5.)], "k string, t double")
    got = {r["t"]: (round(r["distance"], 6), r["clipped"]) for r in joins.invert_curve(curve, want, ["k"], "d", "v", "t").collect()}
    assert got == {10.: (round(10**.5, 6), False), 30.: (1., True), -5.: (100., True)}


def test_rank_scale_has_every_feature(spark, small):
    from tidewin.plans.catalogue import QUERIES

    n, features = spark.read.parquet(f"{small}/embeddings.parquet").agg(F.sum(F.size("embedding")), F.max(F.size("embedding"))).first()
    got = QUERIES["rank_scale"](spark, small).groupBy("feature").count().collect()
    assert {r["feature"] for r in got} == set(range(features)) and sum(r["count"] for r in got) == n


def test_cells_have_like_size(spark):
    """Whatever the values: no cell of distinct values has more than twice its share."""
    from tidewin.operators import ordering

    skewed = spark.range(60_000).select(F.exp(3 * F.randn(1)).alias("v"))
    for df in (skewed, skewed.unionAll(spark.sql("SELECT 1e300 v")), spark.range(60_000).select((F.col("id") / 1e9 + F.col("id") % 2).alias("v"))):
        sizes = [r["count"] for r in ordering.celled(df, "v", 64).groupBy("_cell").count().collect()]
        assert len(sizes) > 50 and max(sizes) <= 2 * 60_001 / 64
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),), (float("inf"),), (2.0,)], "v double").withColumn("n", F.lit(1))
    got = {str(r["v"]): r["n_before"] for r in ordering.sums_before(odd, [], "v", ["n"], 4).collect()}
    assert got == {"-inf": 0, "1.0": 1, "2.0": 2, "inf": 3, "nan": 4}
    assert ordering.sums_before(odd.limit(0), [], "v", ["n"]).count() == 0


def test_rechunk(spark):
    from tidewin.operators import series

    df = spark.createDataFrame([(1, 0, [1.0] * 5), (1, 1, []), (1, 2, None), (1, 3, [2.0] * 9), (2, 0, [3.0]), (3, 0, None)], "k long, o long, x array<double>")
    got = sorted((r["k"], r["chunk"], list(r["x"])) for r in series.rechunk(df, ["k"], ["o"], "x", 4).collect())
    assert got == [(1, 0, [1.0] * 4), (1, 1, [1.0] + [2.0] * 3), (1, 2, [2.0] * 4), (1, 3, [2.0] * 2), (2, 0, [3.0])]
    assert [r["k"] for r in series.rechunk(df, ["k"], ["o"], "x", 4, 2).collect()] == [1] * 4


def test_overlap_join_gives_each_pair_once(spark):
    import random

    from tidewin.operators import joins

    rng = random.Random(1)
    a = [(i, i % 3, x := rng.uniform(-50, 50), x + rng.choice([0, -1, 3, 40, 7.5])) for i in range(80)]
    b = [(100 + i, i % 3, x := float(rng.randint(-50, 50)), x + rng.choice([0, 5, 10, 25])) for i in range(80)]
    a, b = a + [(80, 0, None, 4.0), (81, 0, 4.0, None)], b + [(180, None, 1.0, 2.0)]
    left, right = spark.createDataFrame(a, "l long, k long, a double, b double"), spark.createDataFrame(b, "r long, k long, c double, d double")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and None not in p + q and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3])
    for width in (5.0, 1.0, 100.0):
        assert sorted((r["l"], r["r"]) for r in joins.overlap_join(left, right, ["k"], ("a", "b"), ("c", "d"), width).collect()) == want


def test_nearest_in_blocks(spark):
    import random

    from tidewin.operators import joins

    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = {i: [j for _, j in sorted((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w in rows)[:5]] for i, v in rows}
    for block in (10**6, 40):
        got = {}
        for r in joins.nearest(df, df, "id", "v", "id", "v", 5, [], block).orderBy("q_id", "place").collect():
            got.setdefault(r["q_id"], []).append(r["r_id"])
        assert got == want


def test_positional_join_tells_what_is_out_of_step(spark):
    from tidewin.operators import joins

    a = spark.createDataFrame([(0, "x", 1), (1, "y", 2)], "at long, key string, v long")
    assert joins.positional_join(a, a.withColumnRenamed("v", "w"), "at", "key").count() == 2
    for bad in ([(0, "x", 1)], [(0, "x", 1), (1, "z", 2)], [(0, "x", 1), (1, "y", 2), (2, "y", 2)]):
        with pytest.raises(Exception, match="differ at place"):
            joins.positional_join(a, spark.createDataFrame(bad, "at long, key string, w long"), "at", "key").collect()


def test_normal_tail(spark):
    from math import erfc

    from tidewin.functions.scalars import normal_tail

    for r in spark.range(-90, 301).select((F.col("id") / 10).alias("z")).select("z", normal_tail(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(erfc(r["z"] / 2**0.5) / 2, rel=1e-11, abs=1e-300)


def test_streams_over_batches(spark, tmp_path):
    """Two micro-batches, the second with a late row: state goes on, the late row is left out."""
    from tidewin.streaming import operators as T

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 10, 0.9), (1, 30, 0.6), (2, 10, 0.6)], "k long, t long, v double").coalesce(1).write.parquet(src)
    for name, plan in (("h", lambda s: T.hysteresis_stream(s, "k", "t", "v", 0.8, 0.5)), ("m", lambda s: T.n_of_m_stream(s, "k", "t", "v", 0.55, 2, 2))):
        out, state = str(tmp_path / f"out-{name}"), str(tmp_path / f"state-{name}")
        path = str(tmp_path / f"src-{name}")
        spark.read.parquet(src).coalesce(1).write.parquet(path)
        read = lambda p=path: spark.readStream.schema("k long, t long, v double").parquet(p)
        T.run_available(plan(read()), out, state)
        spark.createDataFrame([(1, 20, 0.1), (1, 40, 0.7), (1, 50, 0.4), (2, 20, 0.9)], "k long, t long, v double").coalesce(1).write.mode("append").parquet(path)
        got = {(r["k"], r["t"]): r["is_on"] for r in T.run_available(plan(read()), out, state).collect()}
        assert got == ({(1, 10): True, (1, 30): True, (2, 10): False, (1, 40): True, (1, 50): False, (2, 20): True} if name == "h" else {(1, 10): False, (1, 30): True, (2, 10): False, (1, 40): True, (1, 50): False, (2, 20): True})


def counted(spark, rows: int, parts: int = 3):
    """A table and an accumulator of how many of its rows were read: scans of the input."""
    import pyarrow as pa

    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            i = b.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(i % 7), pa.array((i * 7919 % 1013) / 1013.0), pa.array((i * 104729 % 997) / 997.0)], names=["id", "g", "x", "y"])

    return spark.range(0, rows, 1, parts).mapInArrow(run, "id long, g long, x double, y double"), read


@pytest.mark.parametrize("cells", [None, 16])
def test_rank_statistics_read_their_input_once(spark, monkeypatch, cells):
    """AUROC, strata, Spearman, quantiles and floors: one scan each, with one cell and with many, and the same rows."""
    from tidewin.operators import audit, auroc, ordering, robust

    if cells:
        monkeypatch.setattr(ordering, "CELL_ROWS", 70)
    n = 5_000
    case = F.col("id") % 3 == 0
    plain = spark.range(n).select("id", (F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 1013 / F.lit(1013.0)).alias("x"), (F.col("id") * 104729 % 997 / F.lit(997.0)).alias("y")).toPandas()
    for run, keys in (
        (lambda d: auroc.auroc(d, "x", case, ["g"]), ["g"]),
        (lambda d: auroc.auroc_against_all(d, "x", case, F.col("g"), least=1), ["stratum"]),
        (lambda d: auroc.spearman(d, "x", "y", ["g"]), ["g"]),
        (lambda d: auroc.mann_whitney_greater(d, "x", case), []),
        (lambda d: ordering.quantile_columns(d, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.999}), ["g"]),
        (lambda d: audit.floor_gate(d, "g", F.col("x"), 0, 0.1, 10, 50), ["g"]),
        (lambda d: robust.out_of_range(d, "x", ["g"]), ["g"]),
        (lambda d: robust.trimmed_p99(d, "x", ["g"]), ["g"]),
    ):
        df, read = counted(spark, n)
        got = run(df).toPandas()
        assert read.value == n
        want = run(spark.createDataFrame(plain)).toPandas()
        assert got.sort_values(keys).reset_index(drop=True).round(9).equals(want.sort_values(keys).reset_index(drop=True).round(9)) if keys else got.round(9).equals(want.round(9))
    a = plain.assign(c=plain.id % 3 == 0)
    for g, auc in counted_auc(a).items():
        df, _ = counted(spark, n)
        assert abs(auroc.auroc(df, "x", case, ["g"]).filter(F.col("g") == g).first()["auc"] - auc) < 1e-12
        break


def counted_auc(a):
    out = {}
    for g, rows in a.groupby("g"):
        pos, neg = rows[rows.c].x.to_numpy(), rows[~rows.c].x.to_numpy()
        out[g] = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    return out
