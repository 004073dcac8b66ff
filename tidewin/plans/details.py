"""Smaller rules: folds, caps, squashing, peaks, grids, band integrals."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import sigmoid
from ..operators import sampling as P
from .arrays import _power, dft_sql
from .registry import query
from .views import EV, LW, SG, SG_LONG, ev, lw, sg, sg_long, sql


@query("random_folds", sql(EV, "n AS (SELECT recording, count(*) AS n FROM ev GROUP BY recording)", "SELECT recording, f AS fold, (n - f + 4) // 5 AS n FROM n CROSS JOIN range(0, 5) AS t(f)"))
def random_folds(spark, d):
    """Five folds in a seeded order; sizes are what any permutation gives."""
    t = P.hash_folds(ev(spark, d), 5, ["event_id"], ["recording"])
    return t.groupBy("recording", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


@query("cap_by_kind", sql(EV, "r AS (SELECT recording, label, pos, row_number() OVER (PARTITION BY recording, label ORDER BY pos) AS k FROM ev)", "SELECT label, count(*) AS n, CAST(sum(pos) AS BIGINT) AS s FROM r WHERE k <= CASE label WHEN 'human' THEN 3 WHEN 'vehicle' THEN 5 ELSE 1000000 END GROUP BY label"))
def cap_by_kind(spark, d):
    """Caps by kind, from a literal map; kinds without one keep all rows."""
    caps = F.create_map(F.lit("human"), F.lit(3), F.lit("vehicle"), F.lit(5))
    return P.cap_by(ev(spark, d), ["recording", "label"], ["pos"], F.try_element_at(caps, F.col("label"))).groupBy("label").agg(F.count("*").alias("n"), F.sum("pos").alias("s"))


@query("sample_per_class", sql(EV, "r AS (SELECT label, event_id, row_number() OVER (PARTITION BY label ORDER BY md5('3|' || event_id), event_id) AS k FROM ev)", "SELECT label, event_id FROM r WHERE k <= 40"))
def sample_per_class(spark, d):
    """Forty windows of each class, without replacement, in the order of a hash."""
    return P.sample_capped(ev(spark, d), ["label"], ["event_id"], 40, 3).select("label", "event_id")


@query("group_holdout", sql(LW, "h AS (SELECT *, CAST('0x' || substr(md5('5|' || profile), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < CAST(0.2 AS DOUBLE) AS held_out FROM lw)", "SELECT held_out, count(*) AS n, count(DISTINCT profile) AS profiles FROM h GROUP BY held_out"))
def group_holdout(spark, d):
    """A fifth of the profiles is held out, with all of their windows."""
    return P.holdout_groups(lw(spark, d), "profile", 0.2, 5).groupBy("held_out").agg(F.count("*").alias("n"), F.countDistinct("profile").alias("profiles"))


@query("presence_from_logits", sql(EV, "SELECT label, round(avg(1 / (1 + exp(-(4 * s_human - 2)))), 6) AS human, round(avg(1 / (1 + exp(-(4 * s_vehicle - 2)))), 6) AS vehicle FROM ev GROUP BY label"))
def presence_from_logits(spark, d):
    return ev(spark, d).groupBy("label").agg(F.round(F.avg(sigmoid(4 * F.col("s_human") - 2)), 6).alias("human"), F.round(F.avg(sigmoid(4 * F.col("s_vehicle") - 2)), 6).alias("vehicle"))


@query("peaks_by_height", sql(SG, SG_LONG, "n AS (SELECT scene_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM sgl WINDOW w AS (PARTITION BY scene_id ORDER BY i))", "SELECT scene_id, count(*) AS n, min(i) AS first_i FROM n WHERE v > a AND v > b AND v >= CAST(0.1 AS DOUBLE) GROUP BY scene_id"))
def peaks_by_height(spark, d):
    """Local maxima above a height, by the neighbours in order."""
    w = Window.partitionBy("scene_id").orderBy("i")
    t = sg_long(sg(spark, d)).select("scene_id", "i", "v", F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b")).filter("v > a AND v > b AND v >= 0.1")
    return t.groupBy("scene_id").agg(F.count("*").alias("n"), F.min("i").cast("long").alias("first_i"))


@query("linear_resample", sql(SG, "g AS (SELECT scene_id, x, j, j * CAST(1.5 AS DOUBLE) AS p FROM sg CROSS JOIN range(0, 43) AS t(j))", "SELECT scene_id, j, round(x[CAST(floor(p) AS INT) + 1] + (p - floor(p)) * (x[least(CAST(floor(p) AS INT) + 2, 64)] - x[CAST(floor(p) AS INT) + 1]), 6) + 0 AS y FROM g"))
def linear_resample(spark, d):
    """A signal read at every 1.5 samples, linear in between."""
    t = sg(spark, d).select("scene_id", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(42).cast("long"))).alias("j")).withColumn("p", F.col("j") * 1.5)
    lo = F.floor("p").cast("int")
    a, b = F.element_at("x", lo + 1), F.element_at("x", F.least(lo + 2, F.size("x")))
    return t.select("scene_id", "j", (F.round(a + (F.col("p") - lo) * (b - a), 6) + 0.0).alias("y"))


@query("hf_rolloff", sql(SG, *dft_sql(64, "1, 33"), "f AS (SELECT scene_id, quantile_cont(p, CAST(0.5 AS DOUBLE)) AS floor_p FROM pw WHERE k BETWEEN 28 AND 32 GROUP BY scene_id)", "SELECT scene_id, CAST(max(k) AS BIGINT) AS k_max FROM pw JOIN f USING (scene_id) WHERE p > floor_p * pow(CAST(10 AS DOUBLE), CAST(0.3 AS DOUBLE)) GROUP BY scene_id"))
def hf_rolloff(spark, d):
    """The highest bin 3 dB above the floor at the top of the band, within one row's array."""
    t = _power(spark, d, list(range(1, 33)))
    floor = F.element_at(F.array_sort(F.slice("p", 28, 5)), 3)
    over = F.filter(F.transform("p", lambda v, i: F.when(v > floor * F.pow(F.lit(10.0), F.lit(0.3)), i + 1)), lambda k: k.isNotNull())
    return t.select("scene_id", F.array_max(over).cast("long").alias("k_max")).filter("k_max IS NOT NULL")


@query("band_fraction_trapezoid", sql(SG, *dft_sql(64, "1, 33"), "n AS (SELECT scene_id, k, p, lag(p) OVER (PARTITION BY scene_id ORDER BY k) AS q FROM pw)", "SELECT scene_id, round(sum((p + q) / 2) FILTER (k BETWEEN 4 AND 10) / sum((p + q) / 2), 6) AS fraction FROM n WHERE q IS NOT NULL GROUP BY scene_id"))
def band_fraction_trapezoid(spark, d):
    """Share of a band by the trapezoid rule."""
    t = _power(spark, d, list(range(1, 33))).select("scene_id", F.posexplode("p").alias("j", "p"))
    w = Window.partitionBy("scene_id").orderBy("j")
    t = t.withColumn("a", (F.col("p") + F.lag("p").over(w)) / 2).filter("a IS NOT NULL").withColumn("k", F.col("j") + 1)
    return t.groupBy("scene_id").agg(F.round(F.try_divide(F.sum(F.when(F.col("k").between(4, 10), F.col("a"))), F.sum("a")), 6).alias("fraction"))


@query("finite_or_zero", sql(EV, "SELECT recording, round(sum(CASE WHEN s_vehicle = 0 THEN 0 ELSE s_human / s_vehicle END), 4) AS s FROM ev GROUP BY recording"))
def finite_or_zero(spark, d):
    """Ratios that aren't finite become 0."""
    from ..functions.scalars import finite_or

    ratio = F.when(F.col("s_vehicle") == 0, F.lit(float("inf"))).otherwise(F.col("s_human") / F.nullif(F.col("s_vehicle"), F.lit(0.0)))
    return ev(spark, d).groupBy("recording").agg(F.round(F.sum(finite_or(ratio)), 4).alias("s"))
