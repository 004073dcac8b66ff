"""Signal routines against plain definitions."""
import numpy as np
import pytest

from tidewin.functions import dsp, features
from tidewin.operators import signals


def recursion(x, zpk):
    """The filter sample by sample, as a cascade of second-order sections of conjugate poles."""
    zeros, poles, gain = zpk
    up = sorted([p for p in poles if p.imag > 0], key=abs)
    zs = sorted([z.real for z in zeros])
    pairs = [(zs[i], zs[-1 - i]) for i in range(len(up))]
    y = x * gain
    for p, (a, b) in zip(up, pairs):
        num = np.poly([a, b])
        out = np.zeros(len(y))
        for i in range(len(y)):
            out[i] = sum(num[k] * y[i - k] for k in range(3) if i >= k) + (2 * p.real * out[i - 1] if i else 0) - (abs(p) ** 2 * out[i - 2] if i > 1 else 0)
        y = out
    return y


@pytest.mark.parametrize("edges", [(5, 25), (20, 90), (90, 180), 20.0])
def test_filter_is_the_recursion(edges):
    x = np.random.default_rng(0).normal(size=1500)
    zpk = dsp.butterworth(4, edges, 1000.0)
    assert np.allclose(dsp.causal(x, [zpk])[0], recursion(x, zpk), atol=1e-10)
    h = np.abs(dsp.response(zpk, 2000))
    for f in np.atleast_1d(edges):
        assert h[int(f * 2)] == pytest.approx(2**-0.5, rel=2e-2)


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 3, 0, 2.5, 0, 1])
    assert dsp.peaks(x).tolist() == [1, 4, 7, 9]
    assert dsp.peaks(x, 1.5).tolist() == [4, 7, 9]
    assert dsp.peaks(x, None, 3).tolist() == [1, 4, 7]
    assert dsp.peaks(np.ones(5)).tolist() == [] and dsp.peaks(np.zeros(2)).tolist() == []


def test_welch_of_white_noise_and_tone():
    rng = np.random.default_rng(1)
    f, p = dsp.welch(rng.normal(size=200_000), 1000.0, 512)
    assert np.median(p[5:-5]) == pytest.approx(2 / 1000, rel=0.05)
    f, p = dsp.welch(np.sin(2 * np.pi * 125 * np.arange(8192) / 1000), 1000.0, 1024)
    assert f[p.argmax()] == pytest.approx(125, abs=1) and p.sum() * (f[1] - f[0]) == pytest.approx(0.5, rel=0.02)


def test_resample_keeps_a_slow_tone():
    t = np.arange(2000)
    y = dsp.resample(np.sin(2 * np.pi * t / 100), 5, 4)
    assert len(y) == 2500 and np.abs(y - np.sin(2 * np.pi * np.arange(2500) / 125))[100:-100].max() < 2e-3


def test_wavelets_keep_energy_inside():
    rng = np.random.default_rng(2)
    x = rng.normal(size=4096)
    assert (dsp.DB4_LOW**2).sum() == pytest.approx(1) and dsp.DB4_LOW.sum() == pytest.approx(2**0.5) and (dsp.DB4_HIGH * dsp.DB4_LOW).sum() == pytest.approx(0, abs=1e-12)
    a, d = dsp.split(x)
    assert len(a) == (4096 + 7) // 2 and (a**2).sum() + (d**2).sum() == pytest.approx((x**2).sum(), rel=0.02)
    assert len(dsp.packet_energies(x)) == 16


def test_autoregression_and_dimension():
    rng = np.random.default_rng(3)
    x = np.zeros(50_000)
    for i in range(1, len(x)):
        x[i] = 0.7 * x[i - 1] + rng.normal()
    r = np.array([(x[k:] * x[: len(x) - k]).mean() for k in range(9)])
    a = dsp.autoregression(r, 8)
    full = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(8)] for i in range(8)]), -r[1:])
    assert np.allclose(a, full) and a[0] == pytest.approx(-0.7, abs=0.02)
    assert dsp.higuchi(np.cumsum(rng.normal(size=3000))) == pytest.approx(0.5, abs=0.1) and dsp.higuchi(np.arange(3000.0)) == pytest.approx(0, abs=1e-2)


def test_band_rms_and_medians():
    x = np.sin(2 * np.pi * 10 * np.arange(1000) / 1000)
    assert dsp.band_rms(x, 5, 15, 1000.0) == pytest.approx(2**-0.5) and dsp.band_rms(x, 20, 90, 1000.0) == pytest.approx(0, abs=1e-9)
    v = np.array([1.0, 5, 2, 8, 3])
    assert dsp.running_median(v, 3).tolist() == [1, 2, 5, 3, 3]
    m = dsp.cosine_matrix(26)
    assert np.allclose(m @ m.T, np.eye(26))


def test_feature_bank():
    names = features.feature_names()
    assert len(names) == 132 and len(set(names)) == 132
    assert names[:2] == ["energy_low_freq", "energy_car_approach"] and names[31] == "centroid_human_band" and names[58] == "tonality_max" and names[101] == "higuchi_fd" and names[-1] == "veh_foot_simultaneity"
    t = np.arange(6000) / 1000
    f = features.window_features(features.Scene(np.sin(2 * np.pi * 37 * t)), 1500)
    assert f["dominant_freq"] == pytest.approx(37, abs=0.2) and f["rms_total"] == pytest.approx(2**-0.5, rel=1e-2) and f["energy_car_peak"] > 20 * f["energy_human_peak"]
    assert all(np.isfinite(v) for v in features.window_features(features.Scene(np.zeros(3000)), 0).values())
    assert features.select_features("cumulative:phys7") == names[:39] and features.select_features(["zcr", "rms_total"]) == ["rms_total", "zcr"]
    with pytest.raises(ValueError):
        features.select_features("cumulative:none")


def test_scene_features_rows(spark):
    x = np.random.default_rng(4).normal(size=7500).tolist()
    df = spark.createDataFrame([(1, x), (2, x[:100]), (3, None)], "scene_id long, x array<double>")
    rows = signals.scene_features(df, "scene_id", "x", ("legacy", "wpe")).collect()
    assert [(r["scene_id"], r["start"]) for r in rows] == [(1, s) for s in (0, 1500, 3000, 4500)]
    want = features.window_features(features.Scene(np.array(x)), 3000, ("legacy", "wpe"))
    assert all(rows[2][k] == pytest.approx(v, rel=1e-5, abs=1e-6) for k, v in want.items())


def test_every_feature_is_compared_with_sql():
    """All 132 names of the bank are outputs of a query that has SQL."""
    from tidewin.plans import feature_sql as Q
    from tidewin.plans.catalogue import ORACLE_SQL

    names = {*Q.FILTERED, *Q.SPECTRAL, *Q.WINDOW, *features.feature_names(("cep", "wpe", "ar"))}
    assert names == set(features.feature_names()) and len(names) == 132
    assert {"features_filtered", "features_spectral", "features_window", "features_cepstral", "features_wavelet", "features_ar_higuchi"} <= set(ORACLE_SQL)
