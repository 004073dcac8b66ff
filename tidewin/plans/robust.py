"""Robust statistics and scaling queries, mostly on the long view of ``sg``."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import robust as R
from ..operators import series as S
from .registry import ORACLE_SQL, query
from .views import EV, LW, SG, SG_LONG, ev, lw, read, sg, sg_long, sql


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("robust_p99", sql(LW, "m AS (SELECT coarse, quantile_cont(snr, CAST(0.5 AS DOUBLE)) AS m FROM lw GROUP BY coarse)", "d AS (SELECT lw.coarse, snr, m FROM lw JOIN m USING (coarse))", "k AS (SELECT coarse, quantile_cont(abs(snr - m), CAST(0.5 AS DOUBLE)) AS d FROM d GROUP BY coarse)",
  "SELECT coarse, count(*) AS n, count(*) FILTER (snr <= m + CAST(1 AS DOUBLE) * d) AS n_kept, round(quantile_cont(snr, CAST(0.99 AS DOUBLE)) FILTER (snr <= m + CAST(1 AS DOUBLE) * d), 6) AS p99 FROM d JOIN k USING (coarse) GROUP BY coarse"))
def robust_p99(spark, d):
    return R.trimmed_p99(lw(spark, d), "snr", ["coarse"], 1.0).withColumn("p99", F.round("p99", 6))


@query("structure_votes", sql(SG, SG_LONG, "b AS (SELECT i, quantile_cont(v, CAST(0.95 AS DOUBLE)) AS p FROM sgl WHERE coarse = 'nothing' GROUP BY i)", "SELECT scene_id, count(*) FILTER (v > p) AS votes FROM sgl JOIN b USING (i) GROUP BY scene_id"))
def structure_votes(spark, d):
    return R.structure_votes(sg_long(sg(spark, d)), "scene_id", "i", "v", F.col("coarse") == "nothing")


@query("anchor_level", sql(SG, "s AS (SELECT scene_id, coarse, g, stddev_pop(v) AS s FROM (SELECT scene_id, coarse, unnest(range(len(x))) // 8 AS g, unnest(x) AS v FROM sg) GROUP BY ALL)", "SELECT coarse, round(quantile_cont(s, CAST(0.2 AS DOUBLE)), 6) AS level, round(CAST(0.1 AS DOUBLE) / quantile_cont(s, CAST(0.2 AS DOUBLE)), 5) AS gain FROM s GROUP BY coarse"))
def anchor_level(spark, d):
    """The 20 % point of the deviation of short segments, and the gain that brings it to 0.1."""
    s = sg_long(sg(spark, d)).groupBy("scene_id", "coarse", F.floor(F.col("i") / 8).alias("g")).agg(F.stddev_pop("v").alias("s"))
    q = F.percentile("s", F.lit(0.2))
    return s.groupBy("coarse").agg(r6(q, "level"), F.round(F.try_divide(F.lit(0.1), q), 5).alias("gain"))


Z = ["f AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS std FROM sgl WHERE split = 'train' GROUP BY i)", "z AS (SELECT sgl.*, greatest(least((v - mean) / (std + CAST(1e-8 AS DOUBLE)), 8), -8) AS z FROM sgl JOIN f USING (i))"]


def _z(spark, d, eps=1e-8, clip=8.0):
    f = sg_long(sg(spark, d))
    return R.apply_standard(f, R.fit_standard(f.filter("split = 'train'"), "i", "v"), "i", "v", eps, clip)


@query("standard_scale", sql(SG, SG_LONG, *Z, "SELECT scene_id, CAST(i AS BIGINT) AS feature, round(z, 5) AS z FROM z"))
def standard_scale(spark, d):
    """Fitted on the training split only."""
    return _z(spark, d).select("scene_id", F.col("i").cast("long").alias("feature"), F.round("z", 5).alias("z"))


@query("rank_scale", sql(SG, SG_LONG, "e AS (SELECT i, quantile_cont(v, [CAST(k AS DOUBLE) / CAST(63 AS DOUBLE) FOR k IN range(0, 64)]) AS edges FROM sgl WHERE split = 'train' GROUP BY i)", "SELECT scene_id, CAST(i AS BIGINT) AS feature, round(len(list_filter(edges, lambda e: e < v)) / CAST(63 AS DOUBLE) * 2 - 1, 6) AS r FROM sgl JOIN e USING (i)"))
def rank_scale(spark, d):
    """Every feature of every scene."""
    return _ranks(sg_long(sg(spark, d)))


def _ranks(f):
    return R.apply_rank(f, R.fit_rank(f.filter("split = 'train'"), "i", "v", 64), "i", "v", 64).select("scene_id", F.col("i").cast("long").alias("feature"), r6(F.col("r"), "r"))


@query("ood_z", sql(SG, SG_LONG, "f AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS std FROM sgl WHERE split = 'train' GROUP BY i)", "z AS (SELECT i, abs((v - mean) / (std + CAST(1e-10 AS DOUBLE))) AS a FROM sgl JOIN f USING (i) WHERE split = 'val')",
  "SELECT CAST(i AS BIGINT) AS feature, round(quantile_cont(a, CAST(0.5 AS DOUBLE)), 6) AS median_z, round(quantile_cont(a, CAST(0.9 AS DOUBLE)), 6) AS p90_z, round(avg(a), 6) AS mean_z, round(avg(CASE WHEN a > 2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS frac2, round(avg(CASE WHEN a > 4 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS frac4 FROM z GROUP BY i"))
def ood_z(spark, d):
    """How far validation features lie from the training distribution; no clipping."""
    o = R.out_of_range(_z(spark, d, 1e-10, None).filter("split = 'val'"), "z", ["i"])
    return o.select(F.col("i").cast("long").alias("feature"), *[r6(F.col(c), c) for c in ("median_z", "p90_z", "mean_z", "frac2", "frac4")])


@query("clip_saturation", sql(SG, SG_LONG, "f AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS std FROM sgl WHERE split = 'train' GROUP BY i)", "z AS (SELECT i, (v - mean) / (std + CAST(1e-8 AS DOUBLE)) AS z FROM sgl JOIN f USING (i))", "SELECT CAST(i AS BIGINT) AS feature, count(*) FILTER (z >= 2) AS high, count(*) FILTER (z <= -2) AS low, round(quantile_cont(abs(z), CAST(0.99 AS DOUBLE)), 6) AS p99 FROM z GROUP BY i"))
def clip_saturation(spark, d):
    """Rows at either end; the limit is 2 here, as the test data never reach 8."""
    z = _z(spark, d, clip=None)
    n = lambda e: F.sum(F.when(F.expr(e), 1).otherwise(0)).cast("long")
    return z.groupBy(F.col("i").cast("long").alias("feature")).agg(n("z >= 2").alias("high"), n("z <= -2").alias("low"), r6(F.percentile(F.abs("z"), F.lit(0.99)), "p99"))


@query("smd_features", sql(SG, SG_LONG, "SELECT CAST(i AS BIGINT) AS feature, round(abs(avg(v) FILTER (coarse = 'human') - avg(v) FILTER (coarse <> 'human')) / sqrt((var_pop(v) FILTER (coarse = 'human') + var_pop(v) FILTER (coarse <> 'human')) / 2), 6) AS smd FROM sgl GROUP BY i"))
def smd_features(spark, d):
    return R.mean_difference(sg_long(sg(spark, d)), "v", F.col("coarse") == "human", ["i"]).select(F.col("i").cast("long").alias("feature"), r6(F.col("smd"), "smd"))


@query("envelope_inside", sql(SG, SG_LONG, "e AS (SELECT i, quantile_cont(v, CAST(0.05 AS DOUBLE)) AS lo, quantile_cont(v, CAST(0.95 AS DOUBLE)) AS hi FROM sgl WHERE split = 'train' GROUP BY i)", "SELECT scene_id, count(*) FILTER (v BETWEEN lo AND hi) AS inside, bool_and(v BETWEEN lo AND hi) AS all_inside FROM sgl JOIN e USING (i) WHERE split = 'val' GROUP BY scene_id"))
def envelope_inside(spark, d):
    f = sg_long(sg(spark, d))
    e = f.filter("split = 'train'").groupBy("i").agg(F.percentile("v", F.lit(0.05)).alias("lo"), F.percentile("v", F.lit(0.95)).alias("hi"))
    t = f.filter("split = 'val'").join(F.broadcast(e), "i").withColumn("ok", F.col("v").between(F.col("lo"), F.col("hi")))
    return t.groupBy("scene_id").agg(F.sum(F.col("ok").cast("int")).cast("long").alias("inside"), F.bool_and("ok").alias("all_inside"))


@query("lsb_estimate", "WITH v AS (SELECT DISTINCT event_type, value FROM events), s AS (SELECT event_type, value, value - lag(value) OVER (PARTITION BY event_type ORDER BY value) AS step FROM v) SELECT event_type, count(*) AS n_levels, round(min(step), 6) AS lsb, round(log2((max(value) - min(value)) / min(step)), 4) AS bits FROM s GROUP BY event_type")
def lsb_estimate(spark, d):
    """Distinct levels, their least step, and the bits that the range then takes."""
    v = read(spark, d, "events").select("event_type", "value").distinct()
    s = v.withColumn("step", F.col("value") - F.lag("value").over(S.ordered(["event_type"], ["value"])))
    return s.groupBy("event_type").agg(F.count("*").alias("n_levels"), r6(F.min("step"), "lsb"), F.round(F.log2(F.try_divide(F.max("value") - F.min("value"), F.min("step"))), 4).alias("bits"))


@query("rail_fraction", "WITH m AS (SELECT event_type, max(value) AS hi, min(value) AS lo FROM events GROUP BY event_type) SELECT event_type, count(*) AS n, count(*) FILTER (value >= hi) AS at_high, count(*) FILTER (value <= lo) AS at_low FROM events JOIN m USING (event_type) GROUP BY event_type")
def rail_fraction(spark, d):
    e = read(spark, d, "events").select("event_type", "value")
    m = e.groupBy("event_type").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    n = lambda x: F.sum(F.when(F.expr(x), 1).otherwise(0)).cast("long")
    return e.join(F.broadcast(m), "event_type").groupBy("event_type").agg(F.count("*").alias("n"), n("value >= hi").alias("at_high"), n("value <= lo").alias("at_low"))


@query("amplitude_gates", sql(SG, SG_LONG, "w AS (SELECT scene_id, coarse, sqrt(avg(v * v)) AS rms, avg(CASE WHEN abs(v) >= CAST(0.2 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS clipped, kurtosis_pop(v) AS kurt FROM sgl GROUP BY ALL)", "SELECT coarse, round(quantile_cont(rms, CAST(0.05 AS DOUBLE)), 6) AS p5, round(quantile_cont(rms, CAST(0.5 AS DOUBLE)), 6) AS p50, round(quantile_cont(rms, CAST(0.95 AS DOUBLE)), 6) AS p95, round(avg(clipped), 6) AS clip_mean, round(quantile_cont(kurt, CAST(0.5 AS DOUBLE)), 5) AS kurtosis FROM w GROUP BY coarse"))
def amplitude_gates(spark, d):
    w = sg_long(sg(spark, d)).groupBy("scene_id", "coarse").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.avg(F.when(F.abs("v") >= 0.2, 1.0).otherwise(0.0)).alias("clipped"), F.kurtosis("v").alias("kurt"))
    q = F.percentile("rms", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    g = w.groupBy("coarse").agg(q.alias("q"), r6(F.avg("clipped"), "clip_mean"), F.round(F.percentile("kurt", F.lit(0.5)), 5).alias("kurtosis"))
    return g.select("coarse", *[r6(F.col("q")[i], n) for i, n in enumerate(("p5", "p50", "p95"))], "clip_mean", "kurtosis")


@query("label_cleaning_split", sql(EV, "SELECT event_id % 5 = 0 AS removed, count(*) AS n, round(avg(CASE WHEN (s_human > CAST(0.5 AS DOUBLE)) <> (label = 'human') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS error FROM ev GROUP BY ALL"))
def label_cleaning_split(spark, d):
    """Error inside and outside the set that cleaning removes."""
    wrong = (F.col("s_human") > 0.5) != (F.col("label") == "human")
    return ev(spark, d).groupBy((F.col("event_id") % 5 == 0).alias("removed")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(wrong, 1.0).otherwise(0.0)), 6).alias("error"))


@query("pearson_guarded", sql(SG, SG_LONG, "SELECT coarse, CASE WHEN var_pop(v) > 0 AND var_pop(i) > 0 THEN round(corr(v, CAST(i AS DOUBLE)), 6) END AS r FROM sgl GROUP BY coarse"))
def pearson_guarded(spark, d):
    """Correlation that is NULL, not an error, where a side doesn't vary."""
    g = sg_long(sg(spark, d)).groupBy("coarse").agg(F.covar_pop("v", "i").alias("c"), F.stddev_pop("v").alias("a"), F.stddev_pop("i").alias("b"))
    return g.select("coarse", F.when((F.col("a") > 0) & (F.col("b") > 0), r_(F.try_divide("c", F.col("a") * F.col("b")))).alias("r"))


def r_(c):
    return F.round(c, 6)


@query("mann_whitney_p", sql(EV, "r AS (SELECT label = 'human' AS y, rank() OVER (ORDER BY s_human) + (count(*) OVER (PARTITION BY s_human) - 1) / CAST(2 AS DOUBLE) AS r FROM ev WHERE label IN ('human', 'nothing'))", "u AS (SELECT sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / CAST(2 AS DOUBLE) AS u, CAST(count(*) FILTER (y) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT y) AS DOUBLE) AS n0 FROM r)", "SELECT round(u, 1) AS u, round((u - n1 * n0 / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 5) AS z FROM u"))
def mann_whitney_p(spark, d):
    """U and its normal deviate (no tie correction)."""
    from ..operators.auroc import auroc

    a = auroc(ev(spark, d).filter("label IN ('human', 'nothing')"), "s_human", F.col("label") == "human")
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    u = F.col("auc") * n1 * n0
    return a.select(F.round(u, 1).alias("u"), F.round((u - n1 * n0 / 2) / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 5).alias("z"))
