"""Signal queries. Their scenes are chunks of 30 s, cut anew from each label's arrays of ``sg``; features are also in SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..operators import signals as G
from . import feature_sql as Q
from .registry import query
from .views import SG, sg, sql


def long_signals(spark, d):
    """Chunks of 30 s (30,000 samples) of each label, one row each."""
    c = S.rechunk(sg(spark, d), ["label"], ["scene_id"], "x", 30_000)
    return c.select((F.col("label").cast("long") * 100_000 + F.col("chunk")).alias("scene_id"), "x")


def _features(name, groups, doc, oracle=None, only=None):
    def run(spark, d):
        f = G.scene_features(long_signals(spark, d), "scene_id", "x", groups, 1_500)
        if oracle is None:
            return f
        names = only or [c for c in f.columns if c not in ("scene_id", "start")]
        return f.select("scene_id", "start", *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in names])

    run.__doc__ = doc
    query(name, "WITH RECURSIVE " + sql(*oracle()).removeprefix("WITH ") if oracle else None)(run)


_features("features_filtered", tuple(G.X.GROUPS), "What filters give: band levels, envelopes, modulation, impulses.", Q.filtered, Q.FILTERED)
_features("features_spectral", ("legacy", "phys", "eng", "tonal", "stat2", "cooc"), "What comes from the window and its spectrum alone, without filters.", Q.spectral, Q.SPECTRAL)
_features("features_window", ("legacy",), "Level, moments, bursts, order in time, and the whole spectrum's shape.", Q.window, Q.WINDOW)
_features("features_cepstral", ("cep",), "Cepstra of two triangular banks.", Q.cepstra)
_features("features_wavelet", ("wpe",), "Wavelet packet energies.", Q.wavelets)
_features("features_ar_higuchi", ("ar",), "Autoregression and fractal dimension.", Q.autoregressive)
_features("features_all", tuple(G.X.GROUPS), "All 132.")


@query("band_rms_fft", sql(SG, "f AS (SELECT scene_id, k, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS w, pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2) AS p FROM (SELECT scene_id, unnest(range(len(x))) AS i, unnest(x) AS v FROM sg) CROSS JOIN range(0, 33) AS t(k) GROUP BY ALL)",
  "SELECT scene_id, round(sqrt(sum(w * p) FILTER (k BETWEEN 2 AND 10)) / 64, 6) AS low, round(sqrt(sum(w * p) FILTER (k BETWEEN 11 AND 31)) / 64, 6) AS high FROM f GROUP BY scene_id"))
def band_rms_fft(spark, d):
    """Brick-wall bands of 64 samples at 64 Hz."""
    b = G.band_levels(sg(spark, d), "scene_id", "x", 64.0, {"low": (2, 10), "high": (11, 31)})
    return b.select("scene_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("welch_psd", sql(*Q.welch()))
def welch_psd(spark, d):
    """Density in thousandths, as the samples are small."""
    p = G.welch_psd(long_signals(spark, d), "scene_id", "x", 1000.0, 1024)
    return p.select("scene_id", F.round("f", 6).alias("f"), F.round(F.col("p") * 1000, 6).alias("p"))


@query("resample_poly", sql(*Q.resampled()))
def resample_poly(spark, d):
    """Five samples for four: the number, the sum and the mean place of the new ones."""
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda x, v: x + v), 6) + 0.0
    r = G.resampled(long_signals(spark, d), "scene_id", "x", 5, 4)
    return r.select("scene_id", F.size("y").alias("n"), total(F.col("y")).alias("s"), total(F.transform("y", lambda v, i: v * i / F.size("y"))).alias("moment"))


@query("spectral_lines", sql(*Q.lines()))
def spectral_lines(spark, d):
    """Peaks of 1 dB or more over the running median of the spectrum."""
    p = G.spectral_lines(long_signals(spark, d), "scene_id", "x", 1000.0, 1024, least_db=1.0)
    return p.select("scene_id", F.round("f", 6).alias("f"), F.round("prominence_db", 6).alias("prominence_db"))


@query("coupling_bumps")
def coupling_bumps(spark, d):
    return G.residual_bumps(long_signals(spark, d), "scene_id", "x", 1000.0, 1024)


@query("sensor_render", sql(*Q.sensor()))
def sensor_render(spark, d):
    r = G.sensor_response(long_signals(spark, d), "scene_id", "x", 1000.0, gain=2.0, rail=0.5, lsb=0.001)
    return r.select("scene_id", F.size("y").alias("n"), F.round(F.array_max("y"), 6).alias("peak"))


@query("ml_gbt_importance")
def ml_gbt_importance(spark, d):
    """Gradient-boosted trees on the signals' samples and the importance of each; never value-equal to another library."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    s = sg(spark, d).select(array_to_vector("x").alias("features"), (F.col("coarse") != "nothing").cast("double").alias("label"))
    m = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(s)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.featureImportances.toArray())], "feature int, importance double")


@query("pca_2")
def pca_2(spark, d):
    """Two principal components; their signs are arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    s = sg(spark, d).select("scene_id", array_to_vector("x").alias("v"))
    t = PCA(k=2, inputCol="v", outputCol="pc").fit(s).transform(s)
    return t.select("scene_id", vector_to_array("pc").alias("p")).select("scene_id", F.col("p")[0].alias("pc1"), F.col("p")[1].alias("pc2"))
