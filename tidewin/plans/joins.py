"""Join queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import query
from .views import EV, SG, ev, micros, read, sg, sql

DBL = "CAST({} AS DOUBLE)"


@query("interval_overlap", sql("o AS (SELECT o_custkey, CAST(epoch_us(o_orderdate) // 86400000000 AS DOUBLE) AS a, CAST(epoch_us(o_orderdate) // 86400000000 AS DOUBLE) + 10 + o_orderkey % 20 AS b FROM orders)", "w AS (SELECT a AS lo, a + 30 AS hi FROM (SELECT CAST(epoch_us(TIMESTAMP '1995-01-01') // 86400000000 AS DOUBLE) + 60 * i AS a FROM range(0, 12) AS t(i)))",
  "SELECT o_custkey, lo, count(*) AS n, round(sum(greatest(0, least(b, hi) - greatest(a, lo))), 6) AS covered FROM o JOIN w ON a < hi AND b > lo GROUP BY o_custkey, lo"))
def interval_overlap(spark, d):
    """Days of each 30-day window that a customer's orders cover; a 12-row window table is broadcast."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(micros("o_orderdate") / 86400000000).cast("double").alias("a")).withColumn("b", F.col("a") + 10 + F.col("o_orderkey") % 20)
    w = spark.range(12).select((F.lit(9131.0) + 60 * F.col("id")).alias("lo")).withColumn("hi", F.col("lo") + 30)
    j = o.join(F.broadcast(w), (F.col("a") < F.col("hi")) & (F.col("b") > F.col("lo")))
    return j.groupBy("o_custkey", "lo").agg(F.count("*").alias("n"), F.round(F.sum(J.overlap(F.col("a"), F.col("b"), F.col("lo"), F.col("hi"))), 6).alias("covered"))


@query("interval_overlap_array", sql(EV, "a AS (SELECT recording, pos, t0_s, list([t2, t2 + 3600]) AS iv FROM (SELECT recording, t0_s AS t2 FROM ev WHERE label = 'human') h JOIN ev USING (recording) GROUP BY ALL)",
  "SELECT recording, pos, round(list_sum([greatest(CAST(0 AS DOUBLE), least(i[2], t0_s + 7200) - greatest(i[1], t0_s)) FOR i IN iv]), 4) AS active_s FROM a WHERE list_sum([greatest(CAST(0 AS DOUBLE), least(i[2], t0_s + 7200) - greatest(i[1], t0_s)) FOR i IN iv]) > 0"))
def interval_overlap_array(spark, d):
    """Seconds of activity in two-hour windows whose spans overlap hour-long ones; no series is gathered in a row."""
    e = ev(spark, d)
    w = e.select("recording", "pos", F.col("t0_s").alias("lo"), (F.col("t0_s") + 7200.0).alias("hi"))
    act = e.filter("label = 'human'").select("recording", F.col("t0_s").alias("a"), (F.col("t0_s") + 3600.0).alias("b"))
    c = J.covered(w, act, ["recording"], ("lo", "hi"), ("a", "b"), 3600.0, ["recording", "pos"])
    return c.select("recording", "pos", F.round("covered", 4).alias("active_s"))


@query("gap_anti_join", sql(EV, "g AS (SELECT recording, t0_s AS lo, t0_s + 7200 AS hi FROM ev WHERE label = 'animal')", "SELECT recording, count(*) AS n, max(pos) AS last_pos FROM ev WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.recording = ev.recording AND ev.t0_s >= lo AND ev.t0_s < hi) GROUP BY recording"))
def gap_anti_join(spark, d):
    """Windows outside every gap [lo, hi)."""
    e = ev(spark, d)
    g = e.filter("label = 'animal'").select("recording", F.col("t0_s").alias("lo"), (F.col("t0_s") + 7200).alias("hi"))
    return J.interval_join(e, g, ["recording"], "t0_s", "lo", "hi", how="left_anti").groupBy("recording").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query("tolerance_semi", sql(EV, "r AS (SELECT recording, t0_s + CAST(0.0000004 AS DOUBLE) AS t FROM ev WHERE event_id % 7 = 0)", "SELECT event_id FROM ev WHERE EXISTS (SELECT 1 FROM r WHERE r.recording = ev.recording AND abs(r.t - ev.t0_s) < CAST(0.000001 AS DOUBLE))"))
def tolerance_semi(spark, d):
    e = ev(spark, d)
    r = e.filter("event_id % 7 = 0").select("recording", (F.col("t0_s") + 0.0000004).alias("t0_s"))
    return J.tolerance_semi(e, r, ["recording"], "t0_s", 1e-6).select("event_id")


@query("asof_interp", sql(EV, "l AS (SELECT event_id, recording, t0_s + CAST(1.5 AS DOUBLE) AS t FROM ev WHERE label <> 'human')", "r AS (SELECT recording, t0_s AS x, s_human AS y FROM ev WHERE label = 'human')",
  "p AS (SELECT l.event_id, l.t, max(x) FILTER (x <= t) AS x0, min(x) FILTER (x >= t) AS x1, arg_max(y, x) FILTER (x <= t) AS y0, arg_min(y, x) FILTER (x >= t) AS y1 FROM l JOIN r USING (recording) GROUP BY ALL)",
  "SELECT event_id, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x0 = x1 THEN y0 ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END, 6) AS distance FROM p"))
def asof_interp(spark, d):
    """A track's value at each window's centre, linear between the neighbours, clamped at the ends."""
    e = ev(spark, d)
    left = e.filter("label <> 'human'").select("event_id", "recording", (F.col("t0_s") + 1.5).alias("t"))
    right = e.filter("label = 'human'").select("recording", F.col("t0_s").alias("x"), F.col("s_human").alias("y"))
    return J.asof_interpolate(left, right, ["recording"], "t", "x", "y", "distance").filter("distance IS NOT NULL").select("event_id", F.round("distance", 6).alias("distance"))


CURVE = "c AS (SELECT label AS k, i + 1 AS d, min(CAST(avg_v AS DOUBLE)) OVER (PARTITION BY label ORDER BY i) AS v FROM (SELECT label, i, avg(v) - i / CAST(10 AS DOUBLE) AS avg_v FROM (SELECT label, unnest(range(len(x))) AS i, unnest(x) AS v FROM sg) GROUP BY label, i))"


@query("curve_inversion", sql(SG, CURVE, "w AS (SELECT label AS k, scene_id, -CAST(scene_id % 80 AS DOUBLE) / CAST(10 AS DOUBLE) AS target FROM sg)", "e AS (SELECT k, min(d) AS d_lo, max(d) AS d_hi, max(v) AS v_hi, min(v) AS v_lo FROM c GROUP BY k)",
  "p AS (SELECT w.k, scene_id, target, max(d) FILTER (v > target) AS da, min(v) FILTER (v > target) AS va, min(d) FILTER (v <= target) AS db, max(v) FILTER (v <= target) AS vb FROM w JOIN c ON c.k = w.k GROUP BY ALL)",
  "SELECT scene_id, round(CASE WHEN target >= v_hi THEN d_lo WHEN target <= v_lo THEN d_hi_at ELSE pow(CAST(10 AS DOUBLE), log10(da) + (va - target) / (va - vb) * (log10(db) - log10(da))) END, 5) AS distance, target > v_hi OR target < v_lo AS clipped FROM p JOIN e ON e.k = p.k JOIN (SELECT k AS kk, max(d) AS d_hi_at FROM c GROUP BY k) z ON z.kk = p.k"))
def curve_inversion(spark, d):
    """Distance at which a falling curve reaches a target, by a running minimum and a log-linear segment."""
    s = sg(spark, d)
    curve = s.select(F.col("label").alias("k"), F.posexplode("x").alias("i", "v")).groupBy("k", "i").agg((F.avg("v") - F.col("i") / 10).alias("v")).withColumn("d", F.col("i") + 1)
    wanted = s.select(F.col("label").alias("k"), "scene_id", (-(F.col("scene_id") % 80).cast("double") / 10).alias("target"))
    return J.invert_curve(curve, wanted, ["k"], "d", "v", "target").select("scene_id", F.round("distance", 5).alias("distance"), "clipped")


KNN = ["q AS (SELECT scene_id AS q_id, x AS qx FROM sg WHERE split = 'val')", "p AS (SELECT q_id, scene_id AS r_id, coarse, list_sum([pow(qx[i] - x[i], 2) FOR i IN range(1, len(x) + 1)]) AS d2 FROM sg CROSS JOIN q WHERE split = 'train')", "r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, r_id) AS place FROM p)"]


@query("knn_class", sql(SG, *KNN, "v AS (SELECT q_id, coarse, count(*) AS votes FROM r WHERE place <= 15 GROUP BY ALL)", "SELECT q_id, coarse, votes FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY votes DESC, coarse) AS k FROM v) WHERE k = 1"))
def knn_class(spark, d):
    """Majority class of the 15 nearest training scenes of each validation scene."""
    s = sg(spark, d)
    n = J.nearest(s.filter("split = 'val'"), s.filter("split = 'train'"), "scene_id", "x", "scene_id", "x", 15, ["coarse"])
    v = n.groupBy("q_id", "coarse").agg(F.count("*").alias("votes"))
    return v.groupBy("q_id").agg(F.min(F.struct(-F.col("votes"), "coarse")).alias("m")).select("q_id", F.col("m.coarse").alias("coarse"), (-F.col("m.col1")).alias("votes"))


@query("nearest_profile", sql(SG, "q AS (SELECT x AS qx FROM sg WHERE scene_id = 0)", "SELECT scene_id, round(sqrt(list_sum([pow(qx[i] - x[i], 2) FOR i IN range(1, len(x) + 1)])), 6) AS distance FROM sg CROSS JOIN q WHERE scene_id <> 0 ORDER BY distance, scene_id LIMIT 8"))
def nearest_profile(spark, d):
    s = sg(spark, d)
    q = s.filter("scene_id = 0").select(F.col("x").alias("qx"))
    return s.filter("scene_id <> 0").join(F.broadcast(q), F.lit(True)).select("scene_id", F.round(F.sqrt(J.squared_distance(F.col("qx"), F.col("x"))), 6).alias("distance")).orderBy("distance", "scene_id").limit(8)


@query("arm_semi_join", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_size > 20) GROUP BY l_returnflag")
def arm_semi_join(spark, d):
    p = read(spark, d, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33") & (F.col("p_size") > 20)).select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, d, "lineitem").join(p, "l_partkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("resume_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def resume_anti_join(spark, d):
    """What isn't done yet."""
    done = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("nearest_grid", sql(EV, "SELECT event_id, CASE WHEN s_vehicle < (CAST(0.1 AS DOUBLE) + CAST(0.2 AS DOUBLE)) / 2 THEN CAST(0.1 AS DOUBLE) WHEN s_vehicle < (CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 2 THEN CAST(0.2 AS DOUBLE) WHEN s_vehicle < (CAST(0.5 AS DOUBLE) + CAST(0.9 AS DOUBLE)) / 2 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS radius FROM ev"))
def nearest_grid(spark, d):
    """The nearer of the neighbouring grid points; the upper one at a midpoint."""
    from ..functions.arrays import nearest_on_grid

    return ev(spark, d).select("event_id", nearest_on_grid(F.col("s_vehicle"), [0.1, 0.2, 0.5, 0.9]).alias("radius"))


@query("set_operations", sql("a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45)", "b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 5)", "SELECT 'both' AS op, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)"))
def set_operations(spark, d):
    li = read(spark, d, "lineitem")
    a, b = (li.filter(c).select("l_partkey").distinct() for c in ("l_quantity > 45", "l_quantity < 5"))
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "only_a")).unionByName(n(a.union(b).distinct(), "either"))


@query("equi_inner_status", "SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment")
def equi_inner_status(spark, d):
    o = read(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_totalprice")
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
