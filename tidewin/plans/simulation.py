"""The labelling of scenes end to end, splits and summaries of scenes."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as X
from ..operators import joins as J
from ..operators import series as S
from .registry import query
from .views import EV, LW, SG, ev, lw, read, sg, sql


@query("stratified_split", "SELECT p_type AS family, greatest(1, CAST(round_even(count(*) * CAST(0.15 AS DOUBLE), 0) AS BIGINT)) AS n_test, greatest(1, CAST(round_even(count(*) * CAST(0.15 AS DOUBLE), 0) AS BIGINT)) AS n_val FROM part GROUP BY p_type")
def stratified_split(spark, d):
    """Per family 15 % test, 15 % validation, the rest training, in the order of a hash."""
    w = Window.partitionBy("p_type")
    k = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * 0.15))
    at = F.row_number().over(w.orderBy(F.xxhash64(F.lit(3), "p_partkey"), "p_partkey"))
    t = read(spark, d, "part").select(F.col("p_type").alias("family"), "p_type", "p_partkey").withColumn("part", F.when(at <= k, "test").when(at <= 2 * k, "val").otherwise("train"))
    n = lambda x: F.sum(F.when(F.col("part") == x, 1).otherwise(0)).cast("long")
    return t.groupBy("family").agg(n("test").alias("n_test"), n("val").alias("n_val"))


@query("label_windows", sql(SG, "w AS (SELECT scene_id, coarse, split, k AS win, x[k * 16 + 1 : k * 16 + 32] AS a, CAST(k * 16 AS DOUBLE) AS lo FROM sg CROSS JOIN range(0, 3) AS t(k))", "f AS (SELECT *, CASE WHEN coarse = 'nothing' THEN 0 ELSE greatest(0, least(lo + 32, CAST(10 + scene_id % 40 AS DOUBLE)) - greatest(lo, CAST(scene_id % 20 AS DOUBLE))) / 32 END AS occ, sqrt(list_sum([v * v FOR v IN a]) / 32) AS rms FROM w)",
  "s AS (SELECT *, CASE WHEN occ > 0 THEN 20 * log10(greatest(rms, CAST(1e-12 AS DOUBLE)) / CAST(0.1 AS DOUBLE)) ELSE -99 END AS snr FROM f)",
  "SELECT scene_id, win, round(occ, 6) AS occ, round(snr, 5) AS snr, CAST(coarse <> 'nothing' AS INT) AS presence, CAST(coarse <> 'nothing' AND occ > 0 AS INT) AS emission, CAST(coarse <> 'nothing' AND occ > 0 AND rms > CAST(1e-6 AS DOUBLE) AS INT) AS received, CAST(coarse <> 'nothing' AND occ > 0 AND rms > CAST(1e-6 AS DOUBLE) AND snr >= 0 AS INT) AS detectable, CASE WHEN snr < -20 THEN 'nothing' WHEN snr < 0 THEN 'marginal' ELSE 'detectable' END AS zone FROM s"))
def label_windows(spark, d):
    """Scenes to labelled windows: cut, occupancy by interval overlap, level, the four states, the zone."""
    from ..functions import scalars as S

    s = sg(spark, d).withColumn("iv", F.array(F.array((F.col("scene_id") % 20).cast("double"), (10 + F.col("scene_id") % 40).cast("double"))))
    w = X.windows(s.select("scene_id", "coarse", "split", "iv", "x"), "x", 32, 16, "a").withColumn("lo", F.col("start").cast("double"))
    occ = F.when(F.col("coarse") == "nothing", 0.0).otherwise(J.overlap_of_list(F.col("iv"), F.col("lo"), F.col("lo") + 32) / 32)
    w = w.withColumns({"occ": occ, "rms": X.rms(F.col("a"))})
    w = w.withColumn("snr", F.when(F.col("occ") > 0, S.decibel(F.col("rms"), F.lit(0.1))).otherwise(S.ABSENT_SNR))
    a, b, c, e = S.four_states(F.col("coarse") != "nothing", F.col("occ"), F.col("rms"), F.col("snr"), 0.0)
    return w.select("scene_id", F.col("win").cast("long").alias("win"), F.round("occ", 6).alias("occ"), F.round("snr", 5).alias("snr"), a.alias("presence"), b.alias("emission"), c.alias("received"), e.alias("detectable"), S.zone(F.col("snr")).alias("zone"))


@query("in_pass_flag", sql(EV, "p AS (SELECT recording, 3600 * CAST(1 + recording % 48 AS DOUBLE) AS lead FROM (SELECT DISTINCT recording FROM ev))", "SELECT recording, count(*) AS n, count(*) FILTER (t0_s + CAST(1.5 AS DOUBLE) BETWEEN lead AND lead + 86400) AS in_pass FROM ev JOIN p USING (recording) GROUP BY recording"))
def in_pass_flag(spark, d):
    """Window centres inside a pass, both ends included."""
    e = ev(spark, d)
    p = e.select("recording").distinct().withColumn("lead", 3600 * (1 + F.col("recording") % 48).cast("double"))
    t = e.join(p, "recording").withColumn("f", (F.col("t0_s") + 1.5).between(F.col("lead"), F.col("lead") + 86400))
    return t.groupBy("recording").agg(F.count("*").alias("n"), F.sum(F.col("f").cast("int")).cast("long").alias("in_pass"))


@query("station_recall", sql(LW, "s AS (SELECT coarse, station, count(*) FILTER (level > 0) AS pos, count(*) FILTER (level = 0) AS neg, count(*) FILTER (level > 0 AND snr > 0) / nullif(CAST(count(*) FILTER (level > 0) AS DOUBLE), 0) AS recall FROM lw GROUP BY coarse, station)", "SELECT coarse, count(*) AS stations, round(min(recall), 6) AS worst, round(quantile_cont(recall, CAST(0.5 AS DOUBLE)), 6) AS median FROM s WHERE pos >= 50 AND neg >= 30 GROUP BY coarse"))
def station_recall(spark, d):
    """Recall per station with enough rows of both kinds; the worst and the median."""
    n = lambda e: F.sum(F.when(F.expr(e), 1).otherwise(0))
    s = lw(spark, d).groupBy("coarse", "station").agg(n("level > 0").alias("pos"), n("level = 0").alias("neg"), F.try_divide(n("level > 0 AND snr > 0").cast("double"), n("level > 0").cast("double")).alias("recall"))
    return s.filter("pos >= 50 AND neg >= 30").groupBy("coarse").agg(F.count("*").alias("stations"), F.round(F.min("recall"), 6).alias("worst"), F.round(F.percentile("recall", F.lit(0.5)), 6).alias("median"))


@query("family_nanmean", sql(LW, "r AS (SELECT family, station % 5 AS run, CASE WHEN count(*) FILTER (level = 2) >= 20 THEN avg(snr) FILTER (level = 2) END AS v FROM lw GROUP BY ALL)", "SELECT family, count(v) AS n, round(avg(v), 6) AS mean FROM r GROUP BY family"))
def family_nanmean(spark, d):
    """Mean over the replicates that have the metric."""
    two = F.when(F.col("level") == 2, F.col("snr"))
    r = lw(spark, d).groupBy("family", (F.col("station") % 5).alias("run")).agg(F.when(F.count(two) >= 20, F.avg(two)).alias("v"))
    return r.groupBy("family").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("amplitude_ratios", sql(SG, "w AS (SELECT coarse, split, list_max([abs(v) FOR v IN x]) AS peak, sqrt(list_sum([v * v FOR v IN x]) / len(x)) AS rms FROM sg)", "g AS (SELECT coarse, split, quantile_cont(peak, CAST(0.5 AS DOUBLE)) AS peak, quantile_cont(peak / rms, CAST(0.5 AS DOUBLE)) AS crest, stddev_pop(rms) / avg(rms) AS cv FROM w GROUP BY ALL)",
  "SELECT a.coarse, round(a.peak / b.peak, 6) AS peak_ratio, round(20 * log10(a.peak / b.peak), 5) AS peak_db, round(a.crest, 6) AS crest_a, round(b.crest, 6) AS crest_b, round(a.cv, 6) AS cv_a, round(b.cv, 6) AS cv_b FROM g a JOIN g b ON a.coarse = b.coarse AND a.split = 'val' AND b.split = 'train'"))
def amplitude_ratios(spark, d):
    """One domain's amplitudes over the other's: two grouped summaries side by side."""
    w = sg(spark, d).select("coarse", "split", F.array_max(F.transform("x", F.abs)).alias("peak"), X.rms(F.col("x")).alias("rms"))
    both = []
    for tag, split in (("a", "val"), ("b", "train")):
        own = lambda c, split=split: F.when(F.col("split") == split, c)
        both += [F.percentile(own(F.col("peak")), F.lit(0.5)).alias(f"peak_{tag}"), F.round(F.percentile(own(F.col("peak") / F.col("rms")), F.lit(0.5)), 6).alias(f"crest_{tag}"), F.round(F.try_divide(F.stddev_pop(own(F.col("rms"))), F.avg(own(F.col("rms")))), 6).alias(f"cv_{tag}")]
    g = w.groupBy("coarse").agg(*both).filter("peak_a IS NOT NULL AND peak_b IS NOT NULL")
    return g.select("coarse", F.round(F.col("peak_a") / F.col("peak_b"), 6).alias("peak_ratio"), F.round(20 * F.log10(F.col("peak_a") / F.col("peak_b")), 5).alias("peak_db"), "crest_a", "crest_b", "cv_a", "cv_b")


@query("context_split_leaks", sql(EV, "b AS (SELECT recording, pos, (pos // 10) % 3 = 0 AS val FROM ev)", "SELECT count(*) AS n_windows, CAST(sum(CASE WHEN val <> lag1 OR val <> lag2 THEN 1 ELSE 0 END) AS BIGINT) AS leaks FROM (SELECT val, coalesce(lag(val, 1) OVER w, val) AS lag1, coalesce(lag(val, 2) OVER w, val) AS lag2 FROM b WINDOW w AS (PARTITION BY recording ORDER BY pos))"))
def context_split_leaks(spark, d):
    """Contexts whose rows lie in different splits: the count must be 0 in a sound split, here it isn't."""
    e = ev(spark, d).select("recording", "pos", ((F.floor(F.col("pos") / 10) % 3) == 0).alias("val"))
    c = S.context(S.deal(e, ["pos"], keys=["recording"]), 3, ["recording"], "pos", 1.0)
    c = S.previous(c, F.col("val"), ["recording"], ["pos"], "was", ready=True)
    c = S.running_last(c, {"changed": F.when(F.col("was") != F.col("val"), F.col("pos"))}, ["recording"], ["pos"], ready=True)
    leak = F.col("changed") > F.col("context")[0]  # behind the context's first row
    return c.agg(F.count("*").alias("n_windows"), F.sum(F.when(leak, 1).otherwise(0)).cast("long").alias("leaks"))


@query("epoch_units", sql(EV, "m AS (SELECT recording, CASE WHEN recording % 2 = 0 THEN CAST(us // 1000 AS DOUBLE) ELSE CAST(us // 1000000 AS DOUBLE) END AS ts FROM ev)", "q AS (SELECT recording, quantile_cont(ts, CAST(0.5 AS DOUBLE)) AS med FROM m GROUP BY recording)", "SELECT recording, CAST(floor(min(CASE WHEN med > CAST(100000000000 AS DOUBLE) THEN ts / 1000 ELSE ts END)) AS BIGINT) AS first_s FROM m JOIN q USING (recording) GROUP BY recording"))
def epoch_units(spark, d):
    """Seconds or milliseconds, told by a series' median."""
    from ..functions.scalars import seconds_of_epoch

    m = ev(spark, d).select("recording", F.when(F.col("recording") % 2 == 0, F.floor(F.col("us") / 1000).cast("double")).otherwise(F.floor(F.col("us") / 1000000).cast("double")).alias("ts"))
    q = m.groupBy("recording").agg(F.percentile("ts", F.lit(0.5)).alias("med"))
    return m.join(q, "recording").groupBy("recording").agg(F.floor(F.min(seconds_of_epoch(F.col("ts"), F.col("med")))).cast("long").alias("first_s"))
