"""Audit queries over ``lw``."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit as A
from ..operators.ordering import exact_quantiles, quantile_columns
from .registry import query
from .views import EV, LW, ev, lw, read, sql

D1 = "CAST(1 AS DOUBLE)"


def r6(c, name):
    return F.round(c, 6).alias(name)


TV = ["s AS (SELECT coarse, subkind, count(*) AS n FROM lw GROUP BY ALL)", "k AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY coarse) AS DOUBLE) AS sh, count(*) OVER (PARTITION BY coarse) AS k FROM s)",
      "tv AS (SELECT coarse, max(k) AS kinds, sum(abs(sh - CAST(1 AS DOUBLE) / k)) / 2 AS tv FROM k WHERE k >= 2 GROUP BY coarse)"]


@query("balance_tv", sql(LW, *TV, "SELECT coarse, kinds, round(tv, 6) AS tv, round(1 - avg(tv) OVER (), 6) AS balance FROM tv"))
def balance_tv(spark, d):
    b = A.balance(lw(spark, d), "coarse", "subkind")
    mean = b.agg((1 - F.avg("tv")).alias("m"))
    return b.crossJoin(F.broadcast(mean)).select("coarse", "kinds", r6(F.col("tv"), "tv"), r6(F.col("m"), "balance"))


COV = ["h AS (SELECT coarse, least(greatest(CAST(floor((snr + 30) / 5) AS BIGINT), 0), 7) AS b, count(*) AS n FROM lw WHERE level > 0 GROUP BY ALL)", "c AS (SELECT *, sum(n) OVER (PARTITION BY coarse) AS a FROM h)",
       "cov AS (SELECT coarse, count(*) FILTER (n >= CAST(0.01 AS DOUBLE) * a) / CAST(8 AS DOUBLE) AS coverage FROM c GROUP BY coarse)"]


@query("coverage_bins", sql(LW, *COV, "SELECT coarse, round(coverage, 6) AS coverage, round(min(coverage) OVER (), 6) AS least FROM cov"))
def coverage_bins(spark, d):
    c = A.coverage(lw(spark, d), "coarse", F.col("snr"), F.col("level") > 0, -30, 5, 8)
    least = c.agg(F.min("coverage").alias("least"))
    return c.crossJoin(F.broadcast(least)).select("coarse", r6(F.col("coverage"), "coverage"), r6(F.col("least"), "least"))


def v_sql(rows: str, a: str, b: str) -> list[str]:
    """Chi-squared over the full grid, empty cells included."""
    return [f"o AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {rows} GROUP BY ALL)", "ra AS (SELECT a, sum(o) AS r FROM o GROUP BY a)", "cb AS (SELECT b, sum(o) AS c FROM o GROUP BY b)", "nn AS (SELECT sum(o) AS n FROM o)",
            "g AS (SELECT coalesce(o.o, 0) AS o, greatest(CAST(r AS DOUBLE) * c / n, CAST(1e-12 AS DOUBLE)) AS e FROM ra CROSS JOIN cb CROSS JOIN nn LEFT JOIN o ON o.a = ra.a AND o.b = cb.b)",
            "SELECT CAST(max(n) AS BIGINT) AS n, round(sum((o - e) * (o - e) / e), 4) AS chi2, round(sqrt(sum((o - e) * (o - e) / e) / (max(n) * greatest(least((SELECT count(*) FROM ra), (SELECT count(*) FROM cb)) - 1, 1))), 6) AS v FROM g CROSS JOIN nn"]


@query("cramers_v", sql(LW, *v_sql("lw", "coarse", "condition")))
def cramers_v(spark, d):
    return A.cramers_v(lw(spark, d), "coarse", "condition").select("n", F.round("chi2", 4).alias("chi2"), r6(F.col("v"), "v"))


@query("cramers_v_qcut", sql(LW, "e AS (SELECT list_distinct(quantile_cont(gain, [CAST(i AS DOUBLE) / CAST(5 AS DOUBLE) FOR i IN range(0, 6)])) AS e FROM lw)", "es AS (SELECT list_sort(e) AS e FROM e)", "q AS (SELECT coarse, len(list_filter(e[2:len(e) - 1], lambda x: x < gain)) AS bin FROM lw CROSS JOIN es)", *v_sql("q", "coarse", "bin")))
def cramers_v_qcut(spark, d):
    q = A.quantile_bins(lw(spark, d), "gain", 5, "bin")
    return A.cramers_v(q, "coarse", "bin").select("n", F.round("chi2", 4).alias("chi2"), r6(F.col("v"), "v"))


@query("floor_gate", sql(LW, "t AS (SELECT subkind, quantile_cont(snr, CAST(0.995 AS DOUBLE)) AS top FROM lw GROUP BY subkind HAVING count(*) >= 50)", "c AS (SELECT subkind, least(greatest(CAST(floor((snr + 30) / 5) AS BIGINT), 0), 7) AS b, count(*) AS n FROM lw GROUP BY ALL)", "g AS (SELECT subkind, b FROM t CROSS JOIN range(0, 8) AS r(b) WHERE -30 + b * 5 <= top)",
  "SELECT subkind, count(*) AS reachable, count(*) FILTER (n >= 300) AS passed FROM g LEFT JOIN c USING (subkind, b) GROUP BY subkind"))
def floor_gate(spark, d):
    return A.floor_gate(lw(spark, d), "subkind", F.col("snr"), -30, 5, 8, 300)


AXES = ["subkind", "condition", "level", "split"]
CROSS = ["p AS (" + " UNION ALL ".join(f"SELECT coarse, '{a}' AS axis_a, '{b}' AS axis_b, CAST({a} AS VARCHAR) AS va, CAST({b} AS VARCHAR) AS vb FROM lw" for i, a in enumerate(AXES) for b in AXES[i + 1:]) + ")"]


@query("pair_crossings", sql(LW, *CROSS, "SELECT coarse, axis_a, axis_b, count(DISTINCT va || '|' || vb) AS realised, count(DISTINCT va) * count(DISTINCT vb) AS possible, round(count(DISTINCT va || '|' || vb) / CAST(count(DISTINCT va) * count(DISTINCT vb) AS DOUBLE), 6) AS coverage FROM p GROUP BY ALL"))
def pair_crossings(spark, d):
    return A.crossings(lw(spark, d), AXES, ["coarse"]).withColumn("coverage", F.round("coverage", 6))


@query("missing_pairs", sql(LW, "w AS (SELECT coarse, family, CAST(floor(snr / 5) AS BIGINT) AS bin FROM lw WHERE snr < -10)", "SELECT a.coarse, a.family, b.bin FROM (SELECT DISTINCT coarse, family FROM w) a JOIN (SELECT DISTINCT coarse, bin FROM w) b ON a.coarse = b.coarse WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.coarse = a.coarse AND w.family = a.family AND w.bin = b.bin)"))
def missing_pairs(spark, d):
    w = lw(spark, d).filter("snr < -10").withColumn("bin", F.floor(F.col("snr") / 5).cast("long"))
    return A.missing_pairs(w, "family", "bin", ["coarse"])


@query("cdi_min", sql(LW, *TV, *COV, "sub AS (SELECT 'B' AS name, greatest(least((1 - avg(tv)) / CAST(0.85 AS DOUBLE), 1), 0) AS score FROM tv UNION ALL SELECT 'C', greatest(least(min(coverage), 1), 0) FROM cov UNION ALL SELECT 'P', CAST(0.9 AS DOUBLE))", "SELECT round(min(score), 6) AS cdi, arg_min(name, score) AS bottleneck FROM sub"))
def cdi_min(spark, d):
    """The combined score is the least of the sub-scores, and its name."""
    w = lw(spark, d)
    b = A.balance(w, "coarse", "subkind").agg(F.lit("B").alias("name"), F.greatest(F.least((1 - F.avg("tv")) / 0.85, F.lit(1.0)), F.lit(0.0)).alias("score"))
    c = A.coverage(w, "coarse", F.col("snr"), F.col("level") > 0, -30, 5, 8).agg(F.lit("C").alias("name"), F.greatest(F.least(F.min("coverage"), F.lit(1.0)), F.lit(0.0)).alias("score"))
    p = spark.range(1).select(F.lit("P").alias("name"), F.lit(0.9).alias("score"))
    return b.unionByName(c).unionByName(p).agg(r6(F.min("score"), "cdi"), F.min_by("name", "score").alias("bottleneck"))


@query("class_mass", sql(LW, "SELECT coarse, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM lw GROUP BY coarse"))
def class_mass(spark, d):
    return A.share(lw(spark, d), ["coarse"], []).withColumn("share", F.round("share", 6))


@query("subkind_given_class", sql(LW, "SELECT coarse, subkind, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY coarse) AS DOUBLE), 6) AS share FROM lw GROUP BY coarse, subkind"))
def subkind_given_class(spark, d):
    return A.share(lw(spark, d), ["coarse", "subkind"], ["coarse"]).withColumn("share", F.round("share", 6))


@query("condition_given_class", sql(LW, "SELECT coarse, condition, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY coarse) AS DOUBLE), 6) AS share FROM lw GROUP BY coarse, condition"))
def condition_given_class(spark, d):
    return A.share(lw(spark, d), ["coarse", "condition"], ["coarse"]).withColumn("share", F.round("share", 6))


@query("snr_histogram", sql(LW, "h AS (SELECT coarse, CAST(least(floor((snr + 30) / 2.5::DOUBLE), 19) AS BIGINT) AS bin FROM lw WHERE snr >= -30 AND snr <= 20)", "SELECT coarse, bin, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY coarse) AS DOUBLE), 6) AS share FROM h GROUP BY coarse, bin"))
def snr_histogram(spark, d):
    """np.histogram's bins: half-open, the last closed; values outside are left out."""
    h = lw(spark, d).withColumn("bin", A.bin_of(F.col("snr"), -30, 2.5, 20).cast("long")).filter("bin IS NOT NULL")
    return A.share(h, ["coarse", "bin"], ["coarse"]).withColumn("share", F.round("share", 6))


@query("q_span", sql(LW, "SELECT coarse, round(min(snr), 6) AS lo, round(max(snr), 6) AS hi, round(quantile_cont(snr, CAST(0.5 AS DOUBLE)), 6) AS mid, round(20 * (max(snr) - min(snr)), 5) AS span_db FROM lw WHERE isfinite(snr) GROUP BY coarse"))
def q_span(spark, d):
    f = lw(spark, d).filter(~F.isnan("snr") & (F.abs("snr") < F.lit(float("inf"))))
    g = f.groupBy("coarse").agg(r6(F.min("snr"), "lo"), r6(F.max("snr"), "hi"), F.round(20 * (F.max("snr") - F.min("snr")), 5).alias("span_db"))
    return g.join(quantile_columns(f, ["coarse"], "snr", {"mid": 0.5}), "coarse").withColumn("mid", F.round("mid", 6))


@query("family_concentration", sql(LW, "w AS (SELECT condition AS family, CAST(floor(snr / 5) AS BIGINT) AS bin FROM lw)", "g AS (SELECT family, bin, count(*) AS n FROM w GROUP BY ALL)", "s AS (SELECT *, sum(n) OVER (PARTITION BY bin) AS bn, n / CAST(sum(n) OVER (PARTITION BY bin) AS DOUBLE) AS share, sum(n) OVER (PARTITION BY family) / CAST(sum(n) OVER () AS DOUBLE) AS gs FROM g)",
  "SELECT bin, family, round(share, 6) AS share, round(gs, 6) AS global_share FROM s WHERE bn >= 50 AND share > CAST(1.01 AS DOUBLE) * gs AND share > CAST(0.2 AS DOUBLE)"))
def family_concentration(spark, d):
    """Thresholds are lowered here so that the even test data shows rows."""
    c = A.concentration(lw(spark, d), "condition", F.floor(F.col("snr") / 5).cast("long"), 1.01, 0.2, 50)
    return c.select("bin", "family", r6(F.col("share"), "share"), r6(F.col("global_share"), "global_share"))


@query("cooccurrence", sql(EV, "SELECT count(*) FILTER (p >= 2) AS both, count(*) FILTER (p >= 1) AS any_present, round(count(*) FILTER (p >= 2) / CAST(count(*) FILTER (p >= 1) AS DOUBLE), 6) AS share FROM (SELECT CAST(s_human > CAST(0.7 AS DOUBLE) AS INT) + CAST(s_animal > CAST(0.7 AS DOUBLE) AS INT) + CAST(s_vehicle > CAST(0.7 AS DOUBLE) AS INT) AS p FROM ev)"))
def cooccurrence(spark, d):
    p = F.expr("CAST(s_human > 0.7 AS INT) + CAST(s_animal > 0.7 AS INT) + CAST(s_vehicle > 0.7 AS INT)")
    n = lambda k: F.sum(F.when(p >= k, 1).otherwise(0)).cast("long")
    return ev(spark, d).agg(n(2).alias("both"), n(1).alias("any_present"), F.round(F.try_divide(n(2).cast("double"), n(1).cast("double")), 6).alias("share"))


@query("occ_consistency", sql(LW, "SELECT coarse, count(*) FILTER (level > 0 AND occ <= 0) AS level_without_occ, count(*) FILTER (level = 0 AND occ > 0) AS occ_without_level, round(count(*) FILTER (snr < -20) / CAST(count(*) AS DOUBLE), 6) AS sub_floor_share FROM lw GROUP BY coarse"))
def occ_consistency(spark, d):
    n = lambda e: F.sum(F.when(F.expr(e), 1).otherwise(0)).cast("long")
    return lw(spark, d).groupBy("coarse").agg(n("level > 0 AND occ <= 0").alias("level_without_occ"), n("level = 0 AND occ > 0").alias("occ_without_level"), F.round(n("snr < -20").cast("double") / F.count("*"), 6).alias("sub_floor_share"))


@query("noise_floor", sql(LW, "m AS (SELECT condition AS family, split AS dataset, station % 10 AS run, avg(snr) AS value FROM lw GROUP BY ALL)", "SELECT family, dataset, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS lo, round(max(value), 6) AS hi, string_agg(CAST(run AS VARCHAR), ',' ORDER BY run) AS members FROM m GROUP BY family, dataset HAVING count(*) >= 2"))
def noise_floor(spark, d):
    """Spread of replicate runs: count, mean, sample deviation, range and members of each family with two runs or more."""
    m = lw(spark, d).groupBy(F.col("condition").alias("family"), F.col("split").alias("dataset"), (F.col("station") % 10).alias("run")).agg(F.avg("snr").alias("value"))
    g = m.groupBy("family", "dataset").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"), r6(F.stddev_samp("value"), "std"), r6(F.min("value"), "lo"), r6(F.max("value"), "hi"), F.array_join(F.transform(F.array_sort(F.collect_list("run")), lambda x: x.cast("string")), ",").alias("members"))
    return g.filter("n >= 2")


@query("weighted_by_seed", sql(LW, "m AS (SELECT coarse, station % 3 AS seed, condition, count(*) AS w, avg(CASE WHEN level > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS recall FROM lw GROUP BY ALL)", "SELECT coarse, seed, CAST(sum(w) AS BIGINT) AS n, round(sum(recall * w) / sum(w), 6) AS recall FROM m GROUP BY coarse, seed"))
def weighted_by_seed(spark, d):
    m = lw(spark, d).groupBy("coarse", (F.col("station") % 3).alias("seed"), "condition").agg(F.count("*").alias("w"), F.avg(F.when(F.col("level") > 0, 1.0).otherwise(0.0)).alias("recall"))
    return m.groupBy("coarse", "seed").agg(F.sum("w").alias("n"), F.round(F.sum(F.col("recall") * F.col("w")) / F.sum("w"), 6).alias("recall"))


@query("across_seeds", sql(LW, "m AS (SELECT coarse, station % 3 AS seed, avg(snr) AS v FROM lw GROUP BY ALL)", "SELECT coarse, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(DISTINCT seed) AS n_seeds FROM m GROUP BY coarse"))
def across_seeds(spark, d):
    m = lw(spark, d).groupBy("coarse", (F.col("station") % 3).alias("seed")).agg(F.avg("snr").alias("v"))
    return m.groupBy("coarse").agg(r6(F.avg("v"), "mean"), r6(F.stddev_samp("v"), "std"), F.countDistinct("seed").alias("n_seeds"))


DIST = [(0, 5), (5, 10), (10, 20), (20, 30), (30, None)]


@query("distance_bins", sql(LW, "b AS (SELECT coarse, CASE WHEN qty >= 0 AND qty < 5 THEN '0-5' WHEN qty >= 5 AND qty < 10 THEN '5-10' WHEN qty >= 10 AND qty < 20 THEN '10-20' WHEN qty >= 20 AND qty < 30 THEN '20-30' WHEN qty >= 30 THEN '30+' END AS bin, snr > 0 AS hit FROM lw)", "SELECT coarse, bin, count(*) AS n, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS recall FROM b WHERE bin IS NOT NULL GROUP BY coarse, bin HAVING count(*) >= 30"))
def distance_bins(spark, d):
    """Half-open bins, the last open; support of 30 rows."""
    q = F.col("qty")
    case = None
    for lo, hi in DIST:
        cond = (q >= lo) & (q < hi) if hi is not None else q >= lo
        name = f"{lo}-{hi}" if hi is not None else f"{lo}+"
        case = F.when(cond, name) if case is None else case.when(cond, name)
    b = lw(spark, d).select("coarse", case.alias("bin"), (F.col("snr") > 0).alias("hit")).filter("bin IS NOT NULL")
    return b.groupBy("coarse", "bin").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), 6).alias("recall")).filter("n >= 30")


@query("background_share", sql(LW, "b AS (SELECT coarse, quantile_cont(snr, CAST(0.9 AS DOUBLE)) AS p1, quantile_cont(qty, CAST(0.9 AS DOUBLE)) AS p2 FROM lw WHERE level = 0 GROUP BY coarse)", "SELECT coarse, count(*) AS n, round(count(*) FILTER (snr <= p1 AND qty <= p2) / CAST(count(*) AS DOUBLE), 6) AS share FROM lw JOIN b USING (coarse) WHERE level > 0 GROUP BY coarse"))
def background_share(spark, d):
    """Share of windows that two measures can't tell from background."""
    w = lw(spark, d)
    quiet = w.filter("level = 0")
    long = quiet.select("coarse", F.expr("stack(2, 'p1', snr, 'p2', qty) AS (measure, v)"))
    b = exact_quantiles(long, ["coarse", "measure"], "v", [0.9]).groupBy("coarse").agg(*[F.max(F.when(F.col("measure") == m, F.col("q"))).alias(m) for m in ("p1", "p2")])
    return w.filter("level > 0").join(F.broadcast(b), "coarse").groupBy("coarse").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.expr("snr <= p1 AND qty <= p2"), 1.0).otherwise(0.0)), 6).alias("share"))


@query("background_predicate", sql(LW, "SELECT split, count(*) AS n FROM lw WHERE level = 0 AND occ <= CAST(0.02 AS DOUBLE) AND condition NOT LIKE '1-%' GROUP BY split"))
def background_predicate(spark, d):
    """Zero level, no occupancy, confusing conditions left out: all of it reaches the scans as filters."""
    return lw(spark, d).filter(F.expr("level = 0 AND occ <= 0.02 AND condition NOT LIKE '1-%'")).groupBy("split").agg(F.count("*").alias("n"))


@query("topk_per_group", sql(LW, "r AS (SELECT coarse, family, subkind, round(avg(snr), 6) AS score FROM lw GROUP BY ALL)", "SELECT coarse, family, subkind, score FROM (SELECT *, row_number() OVER (PARTITION BY coarse ORDER BY score DESC, family, subkind) AS k FROM r) WHERE k <= 5"))
def topk_per_group(spark, d):
    r = lw(spark, d).groupBy("coarse", "family", "subkind").agg(F.round(F.avg("snr"), 6).alias("score"))
    k = F.row_number().over(Window.partitionBy("coarse").orderBy(F.desc("score"), "family", "subkind"))
    return r.withColumn("k", k).filter("k <= 5").drop("k")


@query("strata_map", sql("t AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)", "m AS (SELECT * FROM (VALUES ('ASIA', 'soft'), ('EUROPE', 'hard')) AS v(r_name, stratum))", "SELECT coalesce(stratum, 'other') AS stratum, count(*) AS n FROM t LEFT JOIN m USING (r_name) GROUP BY ALL"))
def strata_map(spark, d):
    """Lookup with a default: a left join with a literal table and coalesce."""
    t = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.expr("n_regionkey = r_regionkey"))
    m = spark.createDataFrame([("ASIA", "soft"), ("EUROPE", "hard")], "r_name string, stratum string")
    return t.join(F.broadcast(m), "r_name", "left").groupBy(F.coalesce("stratum", F.lit("other")).alias("stratum")).agg(F.count("*").alias("n"))


@query("stratified_sample", sql(LW, "s AS (SELECT coarse, condition, count(*) AS n FROM lw GROUP BY ALL)", "SELECT coarse, condition, greatest(1, CAST(round_even(n * CAST(0.1 AS DOUBLE), 0) AS BIGINT)) AS quota FROM s"))
def stratified_sample(spark, d):
    """Rows kept of each stratum: max(1, round(n * fraction)), half to even; rows are chosen by a seeded hash."""
    from ..operators.sampling import sample_strata

    return sample_strata(lw(spark, d), ["coarse", "condition"], 0.1, ["station", "profile", "snr", "qty"]).groupBy("coarse", "condition").agg(F.count("*").alias("quota"))


@query("thin_bins", sql(LW, "h AS (SELECT coarse, level, snr, CAST(least(greatest(floor((snr + 30) / 5), 0), 9) AS BIGINT) AS bin FROM lw)", "c AS (SELECT coarse, bin, count(*) AS n, round(count(*) FILTER (level > 0) / CAST(count(*) AS DOUBLE), 6) AS presence, round(count(*) FILTER (snr < -10) / CAST(count(*) AS DOUBLE), 6) AS sub_floor FROM h GROUP BY coarse, bin)", "SELECT *, n < 300 AS thin FROM c"))
def thin_bins(spark, d):
    """Presence and sub-floor shares by class and 5 dB bin; bins with under 300 windows are marked as thin."""
    h = lw(spark, d).withColumn("bin", A.bin_of(F.col("snr"), -30, 5, 10, clip=True).cast("long"))
    part = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return h.groupBy("coarse", "bin").agg(F.count("*").alias("n"), part(F.col("level") > 0).alias("presence"), part(F.col("snr") < -10).alias("sub_floor")).withColumn("thin", F.col("n") < 300)
