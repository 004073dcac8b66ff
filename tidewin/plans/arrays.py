"""Array queries: every feature that higher-order functions express, on windows of ``sg``'s signals."""
from __future__ import annotations



from pyspark.sql import functions as F

from ..functions import arrays as X
from .registry import query
from .views import SG, sg, sql

N, HOP = 32, 16
WIN = f"""win AS (SELECT scene_id, w AS win, x[w * {HOP} + 1 : w * {HOP} + {N}] AS a FROM sg CROSS JOIN range(0, 3) AS t(w))"""
LONG = "wl AS (SELECT scene_id, win, unnest(range(len(a))) AS i, unnest(a) AS v FROM win)"


def _win(spark, d):
    return X.windows(sg(spark, d).select("scene_id", "x"), "x", N, HOP, "a").select("scene_id", F.col("win").cast("long").alias("win"), "a")


def r6(c, name, digits=6):
    return (F.round(c, digits) + 0.0).alias(name)


@query("array_windows", sql(SG, WIN, "SELECT scene_id, win, len(a) AS n, round(a[1], 6) AS first, round(a[len(a)], 6) AS last FROM win"))
def array_windows(spark, d):
    """Windows of 32 samples every 16, by sequence, explode and slice."""
    return _win(spark, d).select("scene_id", "win", F.size("a").cast("long").alias("n"), r6(F.element_at("a", 1), "first"), r6(F.element_at("a", -1), "last"))


@query("array_segments", sql(SG, "SELECT scene_id, w AS win, round(list_sum(x[w * 20 + 1 : w * 20 + 20]), 6) AS s FROM sg CROSS JOIN range(0, 3) AS t(w)"))
def array_segments(spark, d):
    """Segments without overlap; what is left at the end is dropped."""
    w = X.windows(sg(spark, d).select("scene_id", "x"), "x", 20, 20, "a")
    return w.select("scene_id", F.col("win").cast("long").alias("win"), r6(X.total(F.col("a")), "s"))


@query("array_windows_short", sql(SG, "SELECT scene_id, len(x[1:100]) AS n FROM sg"))
def array_windows_short(spark, d):
    """A signal shorter than the window gives one truncated window in the labelling path."""
    return X.windows(sg(spark, d).select("scene_id", "x"), "x", 100, 50, "a", short=True).select("scene_id", F.size("a").cast("long").alias("n"))


@query("win_rms_p2p_zcr", sql(SG, WIN, LONG, "z AS (SELECT *, lag(sign(v)) OVER (PARTITION BY scene_id, win ORDER BY i) AS ls FROM wl)", f"SELECT scene_id, win, round(sqrt(avg(v * v)), 6) AS rms, round(max(v) - min(v), 6) AS p2p, round(var_pop(v), 6) AS variance, round(count(*) FILTER (ls IS NOT NULL AND ls <> sign(v)) / CAST({N} AS DOUBLE), 6) AS zcr, round(ln(sqrt(avg(v * v)) + CAST(1e-12 AS DOUBLE)), 5) AS log_rms FROM z GROUP BY scene_id, win"))
def win_rms_p2p_zcr(spark, d):
    a = F.col("a")
    return _win(spark, d).select("scene_id", "win", r6(X.rms(a), "rms"), r6(X.peak_to_peak(a), "p2p"), r6(X.variance(a), "variance"), r6(X.zero_crossing_rate(a), "zcr"), F.round(F.ln(X.rms(a) + 1e-12), 5).alias("log_rms"))


@query("win_moments", sql(SG, WIN, LONG, "m AS (SELECT scene_id, win, avg(v) AS m FROM wl GROUP BY ALL)", "c AS (SELECT scene_id, win, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4 FROM wl JOIN m USING (scene_id, win) GROUP BY ALL)", "SELECT scene_id, win, round(m3 / pow(m2, CAST(1.5 AS DOUBLE)), 5) AS skewness, round(m4 / (m2 * m2) - 3, 5) AS kurtosis FROM c"))
def win_moments(spark, d):
    """Biased moments; kurtosis is the excess."""
    t = _win(spark, d).withColumn("m", X.mean(F.col("a")))
    t = t.withColumns({f"m{k}": X.moment(F.col("a"), F.col("m"), k) for k in (2, 3, 4)})
    return t.select("scene_id", "win", r6(F.try_divide("m3", F.pow("m2", F.lit(1.5))), "skewness", 5), r6(F.try_divide("m4", F.col("m2") * F.col("m2")) - 3, "kurtosis", 5))


@query("win_autocorr", sql(SG, WIN, LONG, "p AS (SELECT scene_id, win, v AS a, lead(v, 4) OVER w AS b4, lead(v, 8) OVER w AS b8 FROM wl WINDOW w AS (PARTITION BY scene_id, win ORDER BY i))", "SELECT scene_id, win, round(corr(a, b4), 5) AS lag4, round(corr(a, b8) FILTER (b8 IS NOT NULL), 5) AS lag8 FROM p GROUP BY scene_id, win"))
def win_autocorr(spark, d):
    a = F.col("a")
    return _win(spark, d).select("scene_id", "win", r6(X.lag_correlation(a, 4), "lag4", 5), r6(X.lag_correlation(a, 8), "lag8", 5))


@query("win_energy_concentration", sql(SG, WIN, LONG, "r AS (SELECT scene_id, win, v * v AS e, row_number() OVER (PARTITION BY scene_id, win ORDER BY v * v DESC) AS k FROM wl)", f"SELECT scene_id, win, round(sum(e) FILTER (k <= {N // 4}) / sum(e), 6) AS concentration FROM r GROUP BY scene_id, win"))
def win_energy_concentration(spark, d):
    return _win(spark, d).select("scene_id", "win", r6(X.top_quarter_share(F.col("a")), "concentration"))


@query("win_burst", sql(SG, WIN, LONG, "r AS (SELECT scene_id, win, sqrt(avg(v * v)) AS rms FROM wl GROUP BY ALL)", "f AS (SELECT wl.scene_id, wl.win, i, abs(v) > rms AS f, abs(v) >= 2 * rms AS big FROM wl JOIN r ON r.scene_id = wl.scene_id AND r.win = wl.win)", "g AS (SELECT *, i - row_number() OVER (PARTITION BY scene_id, win, f ORDER BY i) AS g FROM f)", "b AS (SELECT scene_id, win, g, count(*) AS len FROM g WHERE f GROUP BY ALL)",
  "SELECT scene_id, win, CAST(count(*) AS BIGINT) AS n_bursts, round(avg(len), 6) AS mean_len, max(len) AS max_len FROM b GROUP BY scene_id, win"))
def win_burst(spark, d):
    """Runs of samples above the window's RMS."""
    t = _win(spark, d).withColumn("rms", X.rms(F.col("a")))
    text = F.array_join(F.transform("a", lambda v: F.when(F.abs(v) > F.col("rms"), "1").otherwise("0")), "")
    lens = F.transform(F.filter(F.split(text, "0+"), lambda s: s != ""), lambda s: F.length(s).cast("double"))
    return t.select("scene_id", "win", lens.alias("l")).filter(F.size("l") > 0).select("scene_id", "win", F.size("l").cast("long").alias("n_bursts"), r6(X.mean(F.col("l")), "mean_len"), F.array_max("l").cast("long").alias("max_len"))


@query("win_sta_lta", sql(SG, WIN, LONG, "s AS (SELECT scene_id, win, i, avg(abs(v)) OVER (PARTITION BY scene_id, win ORDER BY i ROWS 3 PRECEDING) AS sta, abs(v) AS a FROM wl)", "SELECT scene_id, win, round(max(sta) FILTER (i >= 3) / avg(a), 6) AS ratio FROM s GROUP BY scene_id, win"))
def win_sta_lta(spark, d):
    """Largest moving mean of 4 absolute samples over the mean of all."""
    ab = F.transform("a", lambda v: F.abs(v))
    t = _win(spark, d).withColumn("b", ab)
    sums = F.transform(F.sequence(F.lit(1), F.lit(N - 3)), lambda k: X.total(F.slice("b", k, F.lit(4))) / 4)
    return t.select("scene_id", "win", r6(F.try_divide(F.array_max(sums), X.mean(F.col("b"))), "ratio"))


@query("temporal_centroid", sql(SG, WIN, LONG, f"SELECT scene_id, win, round(sum(v * v * i) / (sum(v * v) * {N}), 6) AS centroid FROM wl GROUP BY scene_id, win"))
def temporal_centroid(spark, d):
    return _win(spark, d).select("scene_id", "win", r6(X.temporal_centroid(F.col("a")), "centroid"))


@query("temporal_entropy", sql(SG, WIN, LONG, "h AS (SELECT scene_id, win, least(CAST(floor((v - lo) / nullif(hi - lo, 0) * 10) AS BIGINT), 9) AS b, count(*) AS n FROM (SELECT *, min(v) OVER (PARTITION BY scene_id, win) AS lo, max(v) OVER (PARTITION BY scene_id, win) AS hi FROM wl) GROUP BY ALL)", f"SELECT scene_id, win, round(-sum(n / CAST({N} AS DOUBLE) * log2(n / CAST({N} AS DOUBLE))), 5) AS entropy FROM h GROUP BY scene_id, win"))
def temporal_entropy(spark, d):
    """Entropy of a ten-bin histogram of the samples."""
    a = F.col("a")
    t = _win(spark, d).withColumns({"lo": F.array_min(a), "span": F.array_max(a) - F.array_min(a)})
    bins = F.transform("a", lambda v: F.least(F.floor((v - F.col("lo")) / F.nullif(F.col("span"), F.lit(0.0)) * 10), F.lit(9)))
    t = t.withColumn("b", bins)
    p = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.size(F.filter("b", lambda v: v == k)) / float(N))
    return t.select("scene_id", "win", r6(-X.sum_of(p, lambda v: F.when(v > 0, v * F.log2(F.when(v > 0, v))).otherwise(0.0)), "entropy", 5))


def dft_sql(n: int, bins: str) -> list[str]:
    return [f"pw AS (SELECT scene_id, k, pow(sum(v * cos(2 * pi() * k * i / {n})), 2) + pow(sum(v * sin(2 * pi() * k * i / {n})), 2) AS p FROM (SELECT scene_id, unnest(range(len(x))) AS i, unnest(x) AS v FROM sg) CROSS JOIN range({bins}) AS t(k) GROUP BY ALL)"]


def _power(spark, d, bins):
    """Power per bin. The explode of one element keeps the optimiser from repeating the transform wherever p is used."""
    return sg(spark, d).select("scene_id", F.explode(F.array(X.dft_power(F.col("x"), 64, bins))).alias("p"))


@query("band_fraction_dft", sql(SG, *dft_sql(64, "1, 33"), "SELECT scene_id, round(sum(p) FILTER (k BETWEEN 1 AND 5) / sum(p), 6) AS low, round(sum(p) FILTER (k BETWEEN 6 AND 20) / sum(p), 6) AS mid, round(sum(p) FILTER (k > 20) / sum(p), 6) AS high FROM pw GROUP BY scene_id"))
def band_fraction_dft(spark, d):
    """Shares of power by band; the transform of 64 samples is a product with literal cosines."""
    p = F.col("p")
    t = _power(spark, d, list(range(1, 33)))
    f = lambda a, n: F.try_divide(X.total(F.slice(p, a, n)), X.total(p))
    return t.select("scene_id", r6(f(1, 5), "low"), r6(f(6, 15), "mid"), r6(f(21, 12), "high"))


@query("spectral_stats_dft", sql(SG, *dft_sql(64, "1, 33"), "SELECT scene_id, round(sum(k * p) / sum(p), 5) AS centroid, arg_max(k, p) AS dominant, round(exp(avg(ln(p + CAST(1e-12 AS DOUBLE)))) / avg(p), 5) AS flatness, round(regr_slope(log10(p + CAST(1e-12 AS DOUBLE)), log10(CAST(k AS DOUBLE))), 4) AS slope FROM pw GROUP BY scene_id"))
def spectral_stats_dft(spark, d):
    t = _power(spark, d, list(range(1, 33))).select("scene_id", F.posexplode("p").alias("j", "p")).withColumn("k", (F.col("j") + 1).cast("long"))
    lp = F.log10(F.col("p") + 1e-12)
    return t.groupBy("scene_id").agg(F.round(F.try_divide(F.sum(F.col("k") * F.col("p")), F.sum("p")), 5).alias("centroid"), F.max_by("k", "p").alias("dominant"), F.round(F.try_divide(F.exp(F.avg(F.ln(F.col("p") + 1e-12))), F.avg("p")), 5).alias("flatness"), F.round(F.regr_slope(lp, F.log10(F.col("k").cast("double"))), 4).alias("slope"))


@query("median_psd", sql(SG, *dft_sql(64, "1, 33"), "SELECT CAST(k AS BIGINT) AS k, round(quantile_cont(p, CAST(0.5 AS DOUBLE)), 5) AS median_p FROM pw GROUP BY k"))
def median_psd(spark, d):
    t = _power(spark, d, list(range(1, 33))).select(F.posexplode("p").alias("j", "p"))
    return t.groupBy((F.col("j") + 1).cast("long").alias("k")).agg(F.round(F.percentile("p", F.lit(0.5)), 5).alias("median_p"))


@query("signal_excess", sql(SG, *dft_sql(64, "1, 33"), "q AS (SELECT k, coarse = 'nothing' AS quiet, quantile_cont(p, CAST(0.5 AS DOUBLE)) AS m FROM pw JOIN sg USING (scene_id) GROUP BY ALL)", "SELECT CAST(a.k AS BIGINT) AS k, round(greatest(a.m - f.m, 0), 5) AS excess FROM q a JOIN q f ON a.k = f.k AND f.quiet AND NOT a.quiet"))
def signal_excess(spark, d):
    """Median power of active scenes above the quiet floor, per bin, not below 0."""
    t = sg(spark, d).select("coarse", F.posexplode(X.dft_power(F.col("x"), 64, list(range(1, 33)))).alias("j", "p"))
    quiet = F.col("coarse") == "nothing"
    g = t.groupBy((F.col("j") + 1).cast("long").alias("k")).agg(F.percentile(F.when(~quiet, F.col("p")), F.lit(0.5)).alias("a"), F.percentile(F.when(quiet, F.col("p")), F.lit(0.5)).alias("f"))
    return g.select("k", r6(F.greatest(F.col("a") - F.col("f"), F.lit(0.0)), "excess", 5))


@query("overlap_add", sql(SG, "e AS (SELECT label, (scene_id % 7) * 10 + i AS pos, v FROM (SELECT scene_id, label, unnest(range(len(x))) AS i, unnest(x) AS v FROM sg))", "SELECT label, pos, round(sum(v), 5) AS v, count(*) AS n FROM e GROUP BY label, pos"))
def overlap_add(spark, d):
    """Superposition of signals at offsets."""
    e = sg(spark, d).select("label", "scene_id", F.posexplode("x").alias("i", "v"))
    return e.groupBy("label", ((F.col("scene_id") % 7) * 10 + F.col("i")).alias("pos")).agg(r6(F.sum("v"), "v", 5), F.count("*").alias("n"))


@query("quantise_clip", sql(SG, "v AS (SELECT scene_id, unnest(x) AS v FROM sg)", "SELECT scene_id, round(sum(round_even(least(greatest(v, CAST(-0.2 AS DOUBLE)), CAST(0.2 AS DOUBLE)) / CAST(0.0625 AS DOUBLE), 0) * CAST(0.0625 AS DOUBLE)), 6) + 0 AS s FROM v GROUP BY scene_id"))
def quantise_clip(spark, d):
    """Rail at 0.2, then steps of 1/16, half to even."""
    from ..functions.scalars import clip, quantise

    q = F.transform("x", lambda v: quantise(clip(v, 0.2), 0.0625))
    return sg(spark, d).select("scene_id", r6(X.total(q), "s"))


@query("sparse_projection_topk", sql(SG, "pr AS (SELECT scene_id, h, sum(v) AS a FROM (SELECT scene_id, unnest(range(len(x))) AS i, unnest(x) AS v FROM sg) CROSS JOIN range(0, 16) AS t(h) WHERE (i * 7 + h * 11) % 5 = 0 GROUP BY ALL)", "SELECT scene_id, h FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY a DESC, h) AS k FROM pr) WHERE k <= 4"))
def sparse_projection_topk(spark, d):
    """A fixed sparse projection and its four strongest outputs."""
    outs = F.array(*[F.struct((-sum((F.col("x")[i] for i in range(64) if (i * 7 + h * 11) % 5 == 0), F.lit(0.0))).alias("a"), F.lit(h).cast("long").alias("h")) for h in range(16)])
    return sg(spark, d).select("scene_id", F.explode(F.slice(F.array_sort(outs), 1, 4)).alias("s")).select("scene_id", "s.h")


