"""AUROC queries, over ``ev``, ``sg`` and the labelled documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import auroc as A
from .registry import query
from .views import EV, EV_LONG, LW, SG, SG_LONG, ev, ev_long, lw, read, sg, sg_long, sql


def rank_sql(rows: str, keys: str, score: str, pos: str) -> str:
    """AUROC by average ranks, as an independent formula."""
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""rk AS (SELECT {head}{pos} AS y, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {head}{score}) - 1) / CAST(2 AS DOUBLE) AS r FROM {rows} WHERE {score} IS NOT NULL),
au AS (SELECT {head}count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg, (sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / CAST(2 AS DOUBLE)) / nullif(CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y), 0) AS auc FROM rk {tail})"""


@query("auroc_score", sql(EV, EV_LONG, rank_sql("evl", "head", "score", "label = head"), "SELECT head, n_pos, n_neg, round(auc, 6) AS auc FROM au"))
def auroc_score(spark, d):
    """Each head against its own class."""
    return A.auroc(ev_long(ev(spark, d)), "score", F.col("label") == F.col("head"), ["head"]).withColumn("auc", F.round("auc", 6))


@query("auroc_documents", sql("j AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id))", rank_sql("j", "", "n_chars", "quality = 1"), "SELECT n_pos, n_neg, round(auc, 6) AS auc FROM au"))
def auroc_documents(spark, d):
    j = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return A.auroc(j, "n_chars", F.col("quality") == 1).withColumn("auc", F.round("auc", 6))


FEATURES = "f AS (SELECT i AS feature, v, coarse <> 'nothing' AS y, coarse, i // 8 AS family FROM sgl)"


@query("auroc_per_feature", sql(SG, SG_LONG, FEATURES, rank_sql("f", "feature", "v", "y"), "SELECT CAST(feature AS BIGINT) AS feature, n_pos, n_neg, round(auc, 6) AS auc FROM au"))
def auroc_per_feature(spark, d):
    """Every feature as a score, on the long view: one pass whatever the number of features."""
    f = sg_long(sg(spark, d))
    return A.auroc(f, "v", F.col("coarse") != "nothing", ["i"]).select(F.col("i").cast("long").alias("feature"), "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query("auroc_family_rollup", sql(SG, SG_LONG, FEATURES, rank_sql("f", "feature", "v", "y"), """SELECT CAST(feature // 8 AS BIGINT) AS family, count(*) AS n, round(quantile_cont(auc, CAST(0.5 AS DOUBLE)), 6) AS median_auc, round(max(auc), 6) AS max_auc, round(max(abs(auc - CAST(0.5 AS DOUBLE))), 6) AS max_dev FROM au GROUP BY feature // 8"""))
def auroc_family_rollup(spark, d):
    a = A.auroc(sg_long(sg(spark, d)), "v", F.col("coarse") != "nothing", ["i"])
    return a.groupBy(F.floor(F.col("i") / 8).cast("long").alias("family")).agg(F.count("*").alias("n"), F.round(F.percentile("auc", F.lit(0.5)), 6).alias("median_auc"), F.round(F.max("auc"), 6).alias("max_auc"), F.round(F.max(F.abs(F.col("auc") - 0.5)), 6).alias("max_dev"))


@query("auroc_one_vs_rest", sql(SG, SG_LONG, "c AS (SELECT * FROM (VALUES ('human'), ('vehicle'), ('animal')) AS v(cls))", "f AS (SELECT cls, i AS feature, v, coarse = cls AS y FROM sgl CROSS JOIN c)", rank_sql("f", "cls, feature", "v", "y"), "SELECT cls, round(max(auc), 6) AS max_auc FROM au GROUP BY cls"))
def auroc_one_vs_rest(spark, d):
    f = sg_long(sg(spark, d)).withColumn("cls", F.explode(F.array(F.lit("human"), F.lit("vehicle"), F.lit("animal"))))
    return A.auroc(f, "v", F.col("coarse") == F.col("cls"), ["cls", "i"]).groupBy("cls").agg(F.round(F.max("auc"), 6).alias("max_auc"))


@query("feature_choice", sql(SG, SG_LONG, FEATURES, rank_sql("f", "feature", "v", "y"), "ch AS (SELECT feature FROM au WHERE abs(round(auc, 6) - CAST(0.5 AS DOUBLE)) >= CAST(0.02 AS DOUBLE) AND feature % 4 <> 3)", "SELECT CAST(feature AS BIGINT) AS feature, count(*) AS n, round(avg(v), 6) + 0 AS mean FROM f JOIN ch USING (feature) GROUP BY feature"))
def feature_choice(spark, d):
    """Features that a scorecard marks as telling classes apart and as representatives; the others' rows aren't read on."""
    f = sg_long(sg(spark, d))
    card = A.auroc(f, "v", F.col("coarse") != "nothing", ["i"]).select("i", (F.abs(F.round("auc", 6) - 0.5) >= 0.02).alias("discriminative"), (F.col("i") % 4 != 3).alias("is_rep"))
    chosen = f.join(card.filter("discriminative AND is_rep"), "i", "left_semi")
    return chosen.groupBy(F.col("i").cast("long").alias("feature")).agg(F.count("*").alias("n"), (F.round(F.avg("v"), 6) + 0.0).alias("mean"))


STRATA = "b AS (SELECT *, CAST(floor(snr / CAST(5 AS DOUBLE)) AS BIGINT) AS bin FROM lw)"


@query("auroc_stratified", sql(LW, STRATA, """s AS (SELECT DISTINCT bin AS stratum FROM b WHERE level > 0)""", """f AS (SELECT stratum, qty * occ AS v, level > 0 AS y FROM b JOIN s ON level = 0 OR bin = stratum)""", rank_sql("f", "stratum", "v", "y"),
  "SELECT stratum, n_pos, n_neg, CASE WHEN n_pos >= 100 THEN round(auc, 6) END AS auc FROM au"))
def auroc_stratified(spark, d):
    """Positives of each 5 dB bin against all negatives; NULL below 100 positives."""
    df = lw(spark, d).withColumn("v", F.col("qty") * F.col("occ"))
    return A.auroc_against_all(df, "v", F.col("level") > 0, F.floor(F.col("snr") / 5).cast("long")).withColumn("auc", F.round("auc", 6))


@query("auroc_gated", sql(LW, "f AS (SELECT coarse, qty * occ AS v, level > 0 AS y FROM lw WHERE level = 0 OR snr >= CAST(2 AS DOUBLE))", rank_sql("f", "coarse", "v", "y"), "SELECT coarse, n_pos, n_neg, round(auc, 6) AS auc FROM au"))
def auroc_gated(spark, d):
    """Positives below the gate are left out, negatives stay."""
    df = lw(spark, d).filter("level = 0 OR snr >= 2").withColumn("v", F.col("qty") * F.col("occ"))
    return A.auroc(df, "v", F.col("level") > 0, ["coarse"]).withColumn("auc", F.round("auc", 6))


@query("auroc_multiplicity", sql(LW, "f AS (SELECT coarse, snr AS v, level >= 2 AS y FROM lw WHERE level > 0)", rank_sql("f", "coarse", "v", "y"), "SELECT coarse, n_pos, n_neg, round(auc, 6) AS auc FROM au"))
def auroc_multiplicity(spark, d):
    """Several against one, among windows where the class is present."""
    return A.auroc(lw(spark, d).filter("level > 0"), "snr", F.col("level") >= 2, ["coarse"]).withColumn("auc", F.round("auc", 6))


@query("auroc_by_series_min_median", sql(EV, rank_sql("ev", "recording", "s_human", "label <> 'nothing'"), """SELECT count(*) AS n_series, round(min(auc), 6) AS min_auc, round(quantile_cont(auc, CAST(0.5 AS DOUBLE)), 6) AS median_auc FROM au WHERE n_pos >= 5 AND n_neg >= 5"""))
def auroc_by_series_min_median(spark, d):
    a = A.auroc(ev(spark, d), "s_human", F.col("label") != "nothing", ["recording"]).filter("n_pos >= 5 AND n_neg >= 5")
    return a.agg(F.count("*").alias("n_series"), F.round(F.min("auc"), 6).alias("min_auc"), F.round(F.percentile("auc", F.lit(0.5)), 6).alias("median_auc"))


@query("spearman_scores", sql(EV, """r AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY s_human) + (count(*) OVER (PARTITION BY label, s_human) - 1) / CAST(2 AS DOUBLE) AS rx, rank() OVER (PARTITION BY label ORDER BY s_vehicle) + (count(*) OVER (PARTITION BY label, s_vehicle) - 1) / CAST(2 AS DOUBLE) AS ry FROM ev)""", "SELECT label, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY label"))
def spearman_scores(spark, d):
    return A.spearman(ev(spark, d), "s_human", "s_vehicle", ["label"]).withColumn("rho", F.round("rho", 6))


@query("pd_vs_snr", sql(LW, "h AS (SELECT coarse, CAST(floor(snr / CAST(3 AS DOUBLE)) AS BIGINT) * 3 AS snr_lo, count(*) AS n, avg(CASE WHEN level > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS pd FROM lw GROUP BY ALL HAVING count(*) >= 30)",
  "SELECT coarse, snr_lo, n, round(pd, 6) AS pd, min(CASE WHEN pd >= CAST(0.8 AS DOUBLE) THEN snr_lo END) OVER (PARTITION BY coarse) AS crossing FROM h"))
def pd_vs_snr(spark, d):
    """Detection share per 3 dB bin with 30 windows or more, and the first bin that reaches 0.8."""
    from pyspark.sql.window import Window

    h = lw(spark, d).groupBy("coarse", (F.floor(F.col("snr") / 3) * 3).cast("long").alias("snr_lo")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("level") > 0, 1.0).otherwise(0.0)).alias("pd")).filter("n >= 30")
    return h.select("coarse", "snr_lo", "n", F.round("pd", 6).alias("pd"), F.min(F.when(F.col("pd") >= 0.8, F.col("snr_lo"))).over(Window.partitionBy("coarse")).alias("crossing"))


@query("domain_drop_set", sql(SG, SG_LONG, "f AS (SELECT i AS feature, v, split = 'val' AS y FROM sgl)", rank_sql("f", "feature", "v", "y"), """SELECT CAST(feature AS BIGINT) AS feature, round(abs(auc - CAST(0.5 AS DOUBLE)) * 2, 6) AS strength, round(abs(auc - CAST(0.5 AS DOUBLE)) * 2, 6) >= CAST(0.1 AS DOUBLE) AND feature % 3 <> 0 AS dropped FROM au"""))
def domain_drop_set(spark, d):
    """Features that tell the two domains apart without helping the task (here: importance by a fixed rule)."""
    a = A.auroc(sg_long(sg(spark, d)), "v", F.col("split") == "val", ["i"]).withColumn("strength", F.round(F.abs(F.col("auc") - 0.5) * 2, 6))
    return a.select(F.col("i").cast("long").alias("feature"), "strength", ((F.col("strength") >= 0.1) & (F.col("i") % 3 != 0)).alias("dropped"))
