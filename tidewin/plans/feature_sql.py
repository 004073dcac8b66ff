"""The same features in SQL: transforms as sums over sines, medians by windows, filters and recursions step by step."""
from __future__ import annotations

from ..functions import dsp
from ..functions import features as X
from .views import SG

#: Chunks of 30 s of each label's samples, one after the other.
SIG = "sig AS MATERIALIZED (SELECT CAST(label * 100000 + p // 30000 AS BIGINT) AS scene_id, p % 30000 AS i, v FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY scene_id, j) - 1 AS p, v FROM (SELECT label, scene_id, unnest(range(len(x))) AS j, unnest(x) AS v FROM sg)))"
ST = "st AS MATERIALIZED (SELECT scene_id, 1500 * k AS start FROM (SELECT scene_id, count(*) AS len FROM sig GROUP BY scene_id) CROSS JOIN range(0, 19) AS t(k) WHERE 1500 * k + 3000 <= len)"
WIN = "win AS MATERIALIZED (SELECT scene_id, start, i - start AS n, v FROM sig JOIN st USING (scene_id) WHERE i >= start AND i < start + 3000)"
TW = "tw AS MATERIALIZED (SELECT m, cos(2 * pi() * m / 3000) AS c, sin(2 * pi() * m / 3000) AS s FROM range(0, 3000) AS t(m))"
SP = """sp AS MATERIALIZED (SELECT scene_id, start, k, CAST(k AS DOUBLE) / 3 AS f, sqrt(pow(sum(v * c), 2) + pow(sum(v * s), 2)) AS mag, pow(sum(v * c), 2) + pow(sum(v * s), 2) AS psd
  FROM win CROSS JOIN range(0, 1501) AS t(k) JOIN tw ON m = (n * k) % 3000 GROUP BY scene_id, start, k)"""
BASE = [SG, SIG, ST, WIN, TW, SP]
SITE = "(" + " OR ".join(f"abs(f - {h}) <= CAST(0.75 AS DOUBLE)" for h in X.SITE_LINES) + ")"
OVER = [
    "pad AS (SELECT scene_id, start, k, f, mag, psd FROM sp UNION ALL SELECT scene_id, start, k, NULL, NULL, 0 FROM st CROSS JOIN (SELECT unnest(list_concat(range(-25, 0), range(1501, 1526))) AS k))",
    "md AS (SELECT *, quantile_cont(psd, CAST(0.5 AS DOUBLE)) OVER (PARTITION BY scene_id, start ORDER BY k ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS med FROM pad)",
    f"ov AS MATERIALIZED (SELECT scene_id, start, k, f, mag, psd, psd / (med + CAST(1e-12 AS DOUBLE)) AS ov, {SITE} AS site FROM md WHERE f IS NOT NULL)",
]


def small(x: str, name: str) -> str:
    """As stored: a 32-bit number, then to four digits."""
    return f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 4) + 0 AS {name}"


def cepstra() -> list[str]:
    mel = "700 * (pow(10, (l0 + (l1 - l0) * j / 25) / 2595) - 1)"
    edges = f"ed AS (SELECT 'mfcc' AS bank, j, {mel} AS e FROM range(0, 26) AS t(j) CROSS JOIN (SELECT 2595 * log10(1 + CAST(1 AS DOUBLE) / 700) AS l0, 2595 * log10(1 + CAST(200 AS DOUBLE) / 700) AS l1) UNION ALL SELECT 'lfcc', j, 2 * pow(CAST(100 AS DOUBLE), CAST(j AS DOUBLE) / 25) FROM range(0, 26) AS t(j))"
    tri = "tri AS (SELECT a.bank, a.j AS b, a.e AS lo, m.e AS mid, h.e AS hi FROM ed a JOIN ed m ON m.bank = a.bank AND m.j = a.j + 1 JOIN ed h ON h.bank = a.bank AND h.j = a.j + 2)"
    lg = "lg AS (SELECT scene_id, start, bank, b, ln(sum(mag * greatest(0, least((f - lo) / greatest(mid - lo, CAST(1e-9 AS DOUBLE)), (hi - f) / greatest(hi - mid, CAST(1e-9 AS DOUBLE))))) + CAST(1e-10 AS DOUBLE)) AS y FROM sp CROSS JOIN tri GROUP BY scene_id, start, bank, b)"
    cols = ", ".join(small(f"sum(y * cos(pi() * {i} * (b + CAST(0.5 AS DOUBLE)) / 24) * sqrt(CAST(2 AS DOUBLE) / 24)) FILTER (bank = '{bank}')", f"{bank}_{i}") for bank in ("mfcc", "lfcc") for i in range(1, 9))
    return [*BASE, edges, tri, lg, f"SELECT scene_id, CAST(start AS INT) AS start, {cols} FROM lg GROUP BY scene_id, start"]


def autoregressive() -> list[str]:
    r = "r AS (SELECT scene_id, start, " + ", ".join(f"sum(CASE WHEN k IN (0, 1500) THEN 1 ELSE 2 END * psd * cos(2 * pi() * k * {l} / 3000)) / 3000 AS r{l}" for l in range(9)) + " FROM sp GROUP BY scene_id, start)"
    steps = ["l0 AS (SELECT *, r0 + CAST(1e-30 AS DOUBLE) AS e0 FROM r)"]
    for i in range(8):
        dot = " + ".join([f"r{i + 1}"] + [f"a{i}_{j} * r{i - j}" for j in range(i)])
        steps.append(f"k{i} AS (SELECT *, -({dot}) / e{i} AS g{i} FROM l{i})")
        new = [f"a{i}_{j} + g{i} * a{i}_{i - 1 - j} AS a{i + 1}_{j}" for j in range(i)] + [f"g{i} AS a{i + 1}_{i}", f"e{i} * (1 - g{i} * g{i} + CAST(1e-30 AS DOUBLE)) AS e{i + 1}"]
        steps.append(f"l{i + 1} AS (SELECT *, {', '.join(new)} FROM k{i})")
    hl = "hl AS (SELECT a.scene_id, a.start, lag, sum(abs(b.v - a.v) / ((2999 - a.n % lag) // lag)) * 2999 / (lag * lag) + CAST(1e-30 AS DOUBLE) AS len FROM win a CROSS JOIN range(1, 9) AS t(lag) JOIN win b ON b.scene_id = a.scene_id AND b.start = a.start AND b.n = a.n + lag GROUP BY a.scene_id, a.start, lag)"
    hg = "hg AS (SELECT scene_id, start, regr_slope(ln(len), -ln(CAST(lag AS DOUBLE))) AS h FROM hl GROUP BY scene_id, start)"
    return [*BASE, r, *steps, hl, hg, "SELECT scene_id, CAST(start AS INT) AS start, " + ", ".join(small(f"a8_{j}", f"ar_{j + 1}") for j in range(8)) + f", {small('h', 'higuchi_fd')} FROM l8 JOIN hg USING (scene_id, start)"]


def wavelets() -> list[str]:
    taps = "h AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for j, (a, b) in enumerate(zip(dsp.DB4_LOW.tolist(), dsp.DB4_HIGH.tolist()))) + ") AS v(j, lo, hi))"
    out, n = ["p0 AS MATERIALIZED (SELECT scene_id, start, 0 AS node, n AS q, v FROM win)"], 3000
    for level in range(4):
        place = "2 * q + 1 - j"
        source = f"CASE WHEN {place} < 0 THEN -1 - ({place}) WHEN {place} >= {n} THEN {2 * n - 1} - ({place}) ELSE {place} END"
        m = (n + 7) // 2
        out.append(f"t{level} AS (SELECT q, {source} AS source, lo, hi FROM range(0, {m}) AS t(q) CROSS JOIN h)")
        out.append(f"p{level + 1} AS MATERIALIZED (SELECT scene_id, start, node * 2 + b AS node, t{level}.q, sum(v * CASE b WHEN 0 THEN lo ELSE hi END) AS v FROM t{level} JOIN p{level} ON p{level}.q = source CROSS JOIN range(0, 2) AS u(b) GROUP BY scene_id, start, node * 2 + b, t{level}.q)")
        n = m
    e = "e AS (SELECT scene_id, start, node, sum(v * v) AS e FROM p4 GROUP BY scene_id, start, node)"
    return [SG, SIG, ST, WIN, taps, *out, e, "SELECT scene_id, CAST(start AS INT) AS start, " + ", ".join(small(f"sum(e) FILTER (node = {i}) / (sum(e) + CAST(1e-20 AS DOUBLE))", f"wpe_{i}") for i in range(16)) + " FROM e GROUP BY scene_id, start"]


def _comb(name: str, low: int, high: int, skip: bool) -> list[str]:
    base = f"{name}b AS (SELECT scene_id, start, k, f FROM ov WHERE f >= {low} AND f <= {high}" + (" AND NOT site)" if skip else ")")
    order = f"{name}o AS (SELECT b.scene_id, b.start, b.k, o, max(ov.ov) AS top, bool_or(site) AS on_site, count(*) AS n FROM {name}b b CROSS JOIN range(1, 4) AS t(o) JOIN ov ON ov.scene_id = b.scene_id AND ov.start = b.start AND ov.k BETWEEN o * b.k - 1 AND o * b.k + 1 GROUP BY b.scene_id, b.start, b.k, o)"
    sums = f"{name}s AS (SELECT scene_id, start, k, sum(top) / count(*) AS s FROM {name}o WHERE n = 3 AND NOT on_site GROUP BY scene_id, start, k HAVING count(*) >= 2)"
    best = f"{name}x AS (SELECT st.scene_id, st.start, coalesce(max(s), 0) AS best, coalesce(arg_min(k, k) FILTER (s = mx), (SELECT min(k) FROM {name}b)) / CAST(3 AS DOUBLE) AS f0 FROM st LEFT JOIN (SELECT *, max(s) OVER (PARTITION BY scene_id, start) AS mx FROM {name}s) q USING (scene_id, start) GROUP BY st.scene_id, st.start)"
    return [base, order, sums, best]


def _moments(x: str) -> str:
    return f"avg({x}) AS m, avg({x} * {x}) AS m2, avg({x} * {x} * {x}) AS m3, avg({x} * {x} * {x} * {x}) AS m4"


#: Features that come from the window and its spectrum alone: name and group of sums below.
SPECTRAL = ["event_count", "centroid_car_band", "centroid_human_band", "log_rms", "centroid_foot_band", "comb_salience", "comb_f0", "n_lines", "line_stability", "line_mains", "tonality_max", "spectral_crest", "n_sharp_lines", "max_line_prom", "tonal_index", "heli_comb_salience", "pump_band_frac", "tonal_in_foot", "centroid_var", "rms_cv_sub", "spectral_flux", "temporal_centroid", "spec_skew", "spec_kurt", "comb_stability", "spectral_entropy_full"]


def spectral() -> list[str]:
    time = """tm AS (SELECT w.scene_id, w.start, rms, count(*) FILTER (abs(v) > a AND abs(v) > b AND abs(v) >= 2 * rms) AS event_count, sum(n * v * v) / ((sum(v * v) + CAST(1e-20 AS DOUBLE)) * 3000) AS temporal_centroid
      FROM (SELECT *, lag(abs(v)) OVER w AS a, lead(abs(v)) OVER w AS b, sqrt(avg(v * v) OVER (PARTITION BY scene_id, start)) AS rms FROM win WINDOW w AS (PARTITION BY scene_id, start ORDER BY n)) w GROUP BY w.scene_id, w.start, rms)"""
    line = """ln AS (SELECT *, lag(x) OVER w AS xa, lead(x) OVER w AS xb, lag(y) OVER w AS ya, lead(y) OVER w AS yb FROM (SELECT *, CASE WHEN f >= 10 AND f <= 180 AND NOT site THEN ov ELSE 0 END AS x, CASE WHEN f >= 10 AND f <= 200 AND NOT site THEN ov ELSE 0 END AS y FROM ov) WINDOW w AS (PARTITION BY scene_id, start ORDER BY k))"""
    cen = lambda lo, hi: f"sum(f * mag) FILTER (f >= {lo} AND f <= {hi}) / (sum(mag) FILTER (f >= {lo} AND f <= {hi}) + CAST(1e-10 AS DOUBLE))"
    agg = f"""ag AS (SELECT scene_id, start, {cen(34, 48)} AS centroid_car_band, {cen(60, 80)} AS centroid_human_band, {cen(20, 90)} AS centroid_foot_band,
      count(*) FILTER (x > xa AND x > xb AND x >= 6) AS n_lines, count(*) FILTER (y > ya AND y > yb AND y >= 8) AS n_sharp_lines, avg(ov) FILTER (site) AS line_mains, max(ov) FILTER (f >= 10 AND f <= 180) AS tonality_max,
      max(psd) / (avg(psd) + CAST(1e-20 AS DOUBLE)) AS spectral_crest, max(y) AS max_line_prom, coalesce(sum(psd) FILTER (y > 8), 0) / (sum(psd) FILTER (f >= 10 AND f <= 200) + CAST(1e-20 AS DOUBLE)) AS tonal_index,
      sum(psd) FILTER (f >= 75 AND f <= 180) / (sum(psd) + CAST(1e-10 AS DOUBLE)) AS pump_band_frac, coalesce(sum(psd) FILTER (y > 8 AND f >= 20 AND f <= 90), 0) / (sum(psd) FILTER (f >= 20 AND f <= 90) + CAST(1e-20 AS DOUBLE)) AS tonal_in_foot,
      sum(psd) AS power FROM ln GROUP BY scene_id, start)"""
    shape = """sh AS (SELECT scene_id, start, avg(pow(psd - m, 3)) / pow(avg(pow(psd - m, 2)), CAST(1.5 AS DOUBLE)) AS spec_skew, avg(pow(psd - m, 4)) / pow(avg(pow(psd - m, 2)), 2) - 3 AS spec_kurt,
      -sum(psd / (power + CAST(1e-10 AS DOUBLE)) * log2(psd / (power + CAST(1e-10 AS DOUBLE)) + CAST(1e-12 AS DOUBLE))) AS spectral_entropy_full FROM (SELECT sp.*, power, power / 1501 AS m FROM sp JOIN ag USING (scene_id, start)) GROUP BY scene_id, start)"""
    third = """th AS MATERIALIZED (SELECT scene_id, start, n // 1000 AS part, k, sqrt(pow(sum(v * c), 2) + pow(sum(v * s), 2)) AS mag FROM win CROSS JOIN range(0, 501) AS t(k) JOIN tw ON m = (n * k * 3) % 3000 GROUP BY scene_id, start, n // 1000, k)"""
    db = "db AS (SELECT *, log10(mag * mag + CAST(1e-12 AS DOUBLE)) AS d FROM th)"
    cent = "ce AS (SELECT scene_id, start, stddev_pop(c) AS centroid_var FROM (SELECT scene_id, start, part, sum(k * mag) / (sum(mag) + CAST(1e-10 AS DOUBLE)) AS c FROM th GROUP BY scene_id, start, part) GROUP BY scene_id, start)"
    lev = "lv AS (SELECT scene_id, start, stddev_pop(l) / (avg(l) + CAST(1e-12 AS DOUBLE)) AS rms_cv_sub FROM (SELECT scene_id, start, n // 1000 AS part, sqrt(avg(v * v)) AS l FROM win GROUP BY scene_id, start, n // 1000) GROUP BY scene_id, start)"
    wide = "wd AS (SELECT scene_id, start, k, max(d) FILTER (part = 0) AS a, max(d) FILTER (part = 1) AS b, max(d) FILTER (part = 2) AS c, stddev_pop(d) AS sd FROM db GROUP BY scene_id, start, k)"
    both = "wx AS (SELECT scene_id, start, (sum(abs(b - a)) + sum(abs(c - b))) / (2 * count(*)) AS spectral_flux, avg(sd) FILTER (k BETWEEN 10 AND 100) AS comb_stability, (corr(a, b) FILTER (k BETWEEN 10 AND 100) + corr(a, c) FILTER (k BETWEEN 10 AND 100) + corr(b, c) FILTER (k BETWEEN 10 AND 100)) / 3 AS line_stability FROM wd GROUP BY scene_id, start)"
    named = {"log_rms": "log10(rms + CAST(1e-12 AS DOUBLE))", "comb_salience": "cx.best", "comb_f0": "cx.f0", "heli_comb_salience": "hx.best"}
    cols = ", ".join(small(named.get(n, n), n) for n in SPECTRAL)
    joins = " ".join(f"JOIN {t} USING (scene_id, start)" for t in ("ag", "sh", "ce", "lv", "wx", "cx", "hx"))
    return [*BASE, *OVER, time, line, agg, shape, third, db, cent, lev, wide, both, *_comb("c", 25, 58, True), *_comb("h", 12, 22, False), f"SELECT scene_id, CAST(start AS INT) AS start, {cols} FROM tm {joins}"]


#: What the window's samples and the whole spectrum say: level, shape, bursts, order in time.
WINDOW = ["rms_total", "peak_to_peak", "variance", "zcr", "kurtosis", "skewness", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flatness", "spectral_entropy", "dominant_freq", "sta_lta_ratio", "mean_burst_len", "activity_concentration", "temporal_entropy", "burst_efficiency", "autocorr_250", "autocorr_500"]


def window() -> list[str]:
    tiny = "CAST(1e-10 AS DOUBLE)"
    by = "GROUP BY scene_id, start"
    level = f"lv AS MATERIALIZED (SELECT scene_id, start, avg(v) AS m, sqrt(avg(v * v)) AS rms, sum(v * v) AS energy, min(v) AS lo, max(v) AS hi, var_pop(v) AS variance, avg(abs(v)) AS level FROM win {by})"
    moved = "mv AS MATERIALIZED (SELECT w.scene_id, w.start, n, v, m, rms, energy, lo, hi, lag(sign(v)) OVER o AS was, avg(abs(v)) OVER (PARTITION BY w.scene_id, w.start ORDER BY n ROWS 99 PRECEDING) AS sta, lead(v, 250) OVER o AS b250, lead(v, 500) OVER o AS b500, row_number() OVER (PARTITION BY w.scene_id, w.start ORDER BY v * v DESC) AS place FROM win w JOIN lv ON lv.scene_id = w.scene_id AND lv.start = w.start WINDOW o AS (PARTITION BY w.scene_id, w.start ORDER BY n))"
    time = f"""tm AS (SELECT scene_id, start, count(*) FILTER (was <> sign(v)) / CAST(3000 AS DOUBLE) AS zcr, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3 AS kurtosis, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), CAST(1.5 AS DOUBLE)) AS skewness, max(sta) FILTER (n >= 99) AS sta,
      sum(v * v) FILTER (place <= 750) / (max(energy) + {tiny}) AS activity_concentration, coalesce(sum(v * v) FILTER (abs(v) > rms), 0) / (max(energy) + {tiny}) AS burst_efficiency, corr(v, b250) FILTER (b250 IS NOT NULL) AS autocorr_250, corr(v, b500) FILTER (b500 IS NOT NULL) AS autocorr_500 FROM mv {by})"""
    burst = f"""bu AS (SELECT scene_id, start, avg(len) AS mean_burst_len FROM (SELECT scene_id, start, g, count(*) AS len, min(n) AS first, max(n) AS last FROM (SELECT *, n - row_number() OVER (PARTITION BY scene_id, start ORDER BY n) AS g FROM mv WHERE abs(v) > rms) {by}, g) WHERE first > 0 AND last < 2999 {by})"""
    bins = f"""hi AS (SELECT scene_id, start, bin, count(*) / (3000 * max((hi - lo) / 50)) AS d FROM (SELECT *, least(CAST(floor((v - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin FROM mv) {by}, bin)"""
    spread = f"hs AS (SELECT scene_id, start, -sum(d / (t + {tiny}) * log2(d / (t + {tiny}) + {tiny})) AS temporal_entropy FROM (SELECT *, sum(d) OVER (PARTITION BY scene_id, start) AS t FROM hi) {by})"
    total = f"tt AS MATERIALIZED (SELECT scene_id, start, sum(mag) + {tiny} AS total, sum(psd) + {tiny} AS power, sum(f * mag) / (sum(mag) + {tiny}) AS centre, exp(avg(ln(psd + {tiny}))) / (avg(psd) + {tiny}) AS flat, arg_min(f, k) FILTER (mag = top) AS dominant FROM (SELECT *, max(mag) OVER (PARTITION BY scene_id, start) AS top FROM sp) {by})"
    shape = f"""ss AS (SELECT scene_id, start, sqrt(sum(pow(f - centre, 2) * mag) / max(total)) AS spectral_bandwidth, -sum(psd / power * log2(psd / power + {tiny})) AS spectral_entropy, coalesce(min(f) FILTER (run >= CAST(0.95 AS DOUBLE) * power), 500) AS spectral_rolloff
      FROM (SELECT sp.*, total, power, centre, sum(psd) OVER (PARTITION BY scene_id, start ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM sp JOIN tt USING (scene_id, start)) {by})"""
    named = {"rms_total": "rms", "peak_to_peak": "hi - lo", "spectral_centroid": "centre", "spectral_flatness": "flat", "dominant_freq": "dominant", "sta_lta_ratio": f"sta / (level + {tiny})", "mean_burst_len": "coalesce(mean_burst_len, 0)"}
    cols = ", ".join(small(named.get(n, n), n) for n in WINDOW)
    return [*BASE, level, moved, time, burst, bins, spread, total, shape, f"SELECT scene_id, CAST(start AS INT) AS start, {cols} FROM lv JOIN tm USING (scene_id, start) JOIN hs USING (scene_id, start) JOIN tt USING (scene_id, start) JOIN ss USING (scene_id, start) LEFT JOIN bu USING (scene_id, start)"]


def _sections(zpk) -> list[tuple[float, float]]:
    """Denominators (a1, a2) of second-order sections, one per pair of conjugate poles."""
    return [(-2 * p.real, abs(p) ** 2) for p in sorted((p for p in zpk[1] if p.imag > 0), key=abs)]


BANDS = {**X.ENERGY_BANDS, **X.WIDE_BANDS}


def _recursion(name: str, rows: str, filters: dict, band: bool) -> list[str]:
    """``name``: scene_id, fid, i, y: cascades of second-order sections, sample by sample, over ``rows`` (scene_id, fid, i, v)."""
    n = 4 if band else 2
    coef = f"{name}c AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([f"'{k}'", f"CAST({z[2]!r} AS DOUBLE)", *[f"CAST({float(c)!r} AS DOUBLE)" for s in _sections(z) for c in s]]) + ")" for k, z in filters.items()) + ") AS v(fid, g, " + ", ".join(f"a{j}, b{j}" for j in range(n)) + "))"
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS s{j}, CAST(0 AS DOUBLE) AS t{j}" for j in range(n))
    ins = ["(g * x.v)"]
    for j in range(n):
        ins.append(f"({ins[-1][1:-1]} + r.s{j})")
    step = []
    for j in range(n):
        u, y = ins[j], ins[j + 1]
        step += [f"{'' if band else f'2 * {u}'} - a{j} * {y} + r.t{j}", f"{'-' if band else ''}{u} - b{j} * {y}"]
    rec = f"{name}r AS (SELECT scene_id, fid, -1 AS i, CAST(0 AS DOUBLE) AS y, {zero} FROM (SELECT DISTINCT scene_id, fid FROM {rows}) UNION ALL SELECT r.scene_id, r.fid, r.i + 1, {ins[-1]}, {', '.join(step)} FROM {name}r r JOIN {rows} x ON x.scene_id = r.scene_id AND x.fid = r.fid AND x.i = r.i + 1 JOIN {name}c c ON c.fid = r.fid)"
    return [coef, rec, f"{name} AS MATERIALIZED (SELECT scene_id, fid, i, y FROM {name}r WHERE i >= 0)"]


def _apart(name: str, fid: str, times: int, distance: int) -> list[str]:
    """``name``: scene_id, i of the picks of an envelope: the highest first, those too close to it go."""
    near = f"{name}n AS (SELECT scene_id, i, y, lag(y) OVER w AS a, lead(y) OVER w AS b, quantile_cont(y, CAST(0.5 AS DOUBLE)) OVER (PARTITION BY scene_id) AS med FROM env WHERE fid = '{fid}' WINDOW w AS (PARTITION BY scene_id ORDER BY i))"
    cand = f"{name}c AS (SELECT scene_id, list({{'y': y, 'i': i}} ORDER BY y DESC, i DESC) AS rest FROM {name}n WHERE y > a AND y > b AND y >= {times} * (med + CAST(1e-12 AS DOUBLE)) GROUP BY scene_id)"
    pick = f"{name}g AS (SELECT scene_id, rest, CAST([] AS BIGINT[]) AS kept FROM {name}c UNION ALL SELECT scene_id, list_filter(rest, lambda p: abs(p.i - rest[1].i) >= {distance}), list_append(kept, rest[1].i) FROM {name}g WHERE len(rest) > 0)"
    return [near, cand, pick, f"{name} AS MATERIALIZED (SELECT scene_id, unnest(kept) AS i FROM {name}g WHERE len(rest) = 0)"]


FILTERED = [
    *[f"energy_{k}" for k in X.ENERGY_BANDS], "ratio_car_human", "ratio_human_car", "frac_wind_1_5", "frac_veh_5_25", "frac_foot_20_90", "frac_high_90_180", "ratio_veh_foot", "hop_band_frac", "highband_kurtosis", "band_occupancy",
    "beat_depth", "cad_freq", "cad_salience", "cad_harm2", "cad_harm4", "footfall_rate", "mod_peak_count", "env_entropy", "env_cv", "env_ac_strength", "gust_mod",
    "mod_e_1_3", "mod_e_3_8", "mod_e_8_12", "mod_ratio_low_mid", "mod_peak2_ratio", "mod_flatness", "mod_centroid",
    "iii_mean", "iii_cv", "impulse_density", "iii_entropy", "iii_skew", "iii_range_norm", "impulse_amp_cv", "attack_sharpness", "rain_impulse_rate", "veh_foot_simultaneity"]


def filtered() -> list[str]:
    band = _recursion("band", "bx", {k: dsp.butterworth(4, e, X.FS) for k, e in BANDS.items()}, True)
    smooth = dsp.butterworth(4, 20.0, X.FS)
    low = _recursion("low", "ex", dict.fromkeys(("all", "eng", "rain"), smooth), False)
    parts = [SG, SIG, ST, WIN, "bx AS MATERIALIZED (SELECT scene_id, fid, i, v FROM sig CROSS JOIN (VALUES " + ", ".join(f"('{k}')" for k in BANDS) + ") AS f(fid))", *band,
      "ex AS MATERIALIZED (SELECT scene_id, 'all' AS fid, i, abs(v) AS v FROM sig UNION ALL SELECT scene_id, fid, i, abs(y) FROM band WHERE fid IN ('eng', 'rain'))", *low,
      "env AS MATERIALIZED (SELECT scene_id, fid, i, greatest(y, 0) AS y FROM low)", *_apart("imp", "all", 2, 80), *_apart("drop_", "rain", 3, 20),
      "rm AS (SELECT scene_id, start, sqrt(avg(v * v)) AS rms FROM win GROUP BY scene_id, start)",
      "bl AS (SELECT scene_id, start, " + ", ".join(f"sqrt(avg(y * y) FILTER (fid = '{k}')) AS l_{k}" for k in BANDS) + " FROM band JOIN st USING (scene_id) WHERE i >= start AND i < start + 3000 GROUP BY scene_id, start)",
      "rk AS (SELECT scene_id, start, avg(pow(y - m, 4)) / pow(avg(pow(y - m, 2)), 2) - 3 AS highband_kurtosis FROM (SELECT scene_id, start, y, avg(y) OVER (PARTITION BY scene_id, start) AS m FROM band JOIN st USING (scene_id) WHERE fid = 'rain' AND i >= start AND i < start + 3000) GROUP BY scene_id, start)",
      "ew AS MATERIALIZED (SELECT scene_id, start, fid, i - start AS n, y, avg(y) OVER (PARTITION BY scene_id, start, fid) AS m FROM env JOIN st USING (scene_id) WHERE i >= start AND i < start + 3000)",
      "ev_ AS (SELECT scene_id, start, stddev_pop(y) FILTER (fid = 'eng') / (avg(y) FILTER (fid = 'eng') + CAST(1e-12 AS DOUBLE)) AS beat_depth, stddev_pop(y) FILTER (fid = 'all') / (avg(y) FILTER (fid = 'all') + CAST(1e-12 AS DOUBLE)) AS env_cv FROM ew GROUP BY scene_id, start)",
      "mo AS MATERIALIZED (SELECT scene_id, start, k, k * CAST(1000 AS DOUBLE) / 8192 AS f, pow(sum((y - m) * cos(2 * pi() * (k * n % 8192) / 8192)), 2) + pow(sum((y - m) * sin(2 * pi() * (k * n % 8192) / 8192)), 2) AS p FROM ew CROSS JOIN range(0, 140) AS t(k) WHERE fid = 'all' GROUP BY scene_id, start, k)",
      "fl AS (SELECT scene_id, start, quantile_cont(p, CAST(0.5 AS DOUBLE)) + CAST(1e-20 AS DOUBLE) AS fl FROM mo WHERE f >= CAST(0.3 AS DOUBLE) AND f <= 12 GROUP BY scene_id, start)",
      # within the band a peak needs neighbours in it
      "pk AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b FROM (SELECT mo.*, fl FROM mo JOIN fl USING (scene_id, start) WHERE f >= CAST(0.5 AS DOUBLE) AND f <= 8) WINDOW w AS (PARTITION BY scene_id, start ORDER BY k))",
      "p2 AS (SELECT scene_id, start, count(*) FILTER (p > a AND p > b AND p >= 3 * fl) AS mod_peak_count, list(p ORDER BY p DESC) FILTER (p > a AND p > b AND p >= 3 * fl) AS tops FROM pk GROUP BY scene_id, start)",
      "ca AS (SELECT scene_id, start, arg_max(k, p) FILTER (f >= CAST(0.8 AS DOUBLE) AND f <= 4) AS k0, max(p) FILTER (f >= CAST(0.8 AS DOUBLE) AND f <= 4) AS p0, arg_max(f, p) FILTER (f >= CAST(0.8 AS DOUBLE) AND f <= 10) AS footfall_rate FROM mo GROUP BY scene_id, start)",
      "ha AS (SELECT scene_id, start, sum(p) FILTER (abs(k - k0) <= 2) + CAST(1e-20 AS DOUBLE) AS base, sum(p) FILTER (abs(k - 2 * k0) <= 2) AS h2, sum(p) FILTER (abs(k - 4 * k0) <= 2) AS h4 FROM mo JOIN ca USING (scene_id, start) GROUP BY scene_id, start)",
      "ms AS (SELECT scene_id, start, " + ", ".join(f"sum(p) FILTER (f >= CAST({a} AS DOUBLE) AND f <= CAST({b} AS DOUBLE)) AS s{i}" for i, (a, b) in enumerate(((0.3, 12), (1, 3), (3, 8), (8, 12), (0.05, 0.5), (0.05, 12)))) + ", sum(f * p) FILTER (f >= CAST(0.3 AS DOUBLE) AND f <= 12) AS fp, exp(avg(ln(p + CAST(1e-20 AS DOUBLE))) FILTER (f >= CAST(0.3 AS DOUBLE) AND f <= 12)) / (avg(p) FILTER (f >= CAST(0.3 AS DOUBLE) AND f <= 12) + CAST(1e-20 AS DOUBLE)) AS mod_flatness FROM mo GROUP BY scene_id, start)",
      "en AS (SELECT scene_id, start, -sum(p / (s0 + CAST(1e-20 AS DOUBLE)) * log2(p / (s0 + CAST(1e-20 AS DOUBLE)) + CAST(1e-20 AS DOUBLE))) AS env_entropy FROM mo JOIN ms USING (scene_id, start) WHERE f >= CAST(0.3 AS DOUBLE) AND f <= 12 GROUP BY scene_id, start)",
      "el AS (SELECT scene_id, start, list(y - m ORDER BY n) AS e FROM ew WHERE fid = 'all' GROUP BY scene_id, start)",
      "ac AS (SELECT scene_id, start, max(a) FILTER (lag_ > 0) / (max(a) FILTER (lag_ = 0) + CAST(1e-20 AS DOUBLE)) AS env_ac_strength FROM (SELECT scene_id, start, lag_, list_inner_product(e[1:3000 - lag_], e[lag_ + 1:3000]) AS a FROM el CROSS JOIN (SELECT unnest(list_concat([0], range(250, 1250))) AS lag_)) GROUP BY scene_id, start)",
      "iw AS (SELECT st.scene_id, st.start, i, y, row_number() OVER w AS nth, (i - lag(i) OVER w) / CAST(1000 AS DOUBLE) AS gap, coalesce((SELECT e2.y FROM env e2 WHERE e2.fid = 'all' AND e2.scene_id = st.scene_id AND e2.i = greatest(imp.i - 10, 0)), 0) AS y10 FROM st JOIN imp USING (scene_id) JOIN env USING (scene_id, i) WHERE fid = 'all' AND i >= start AND i < start + 3000 WINDOW w AS (PARTITION BY st.scene_id, st.start ORDER BY i))",
      "ia AS (SELECT scene_id, start, count(*) AS n, avg(gap) AS gm, stddev_pop(gap) AS gs, quantile_cont(gap, CAST(0.9 AS DOUBLE)) AS g9, quantile_cont(gap, CAST(0.1 AS DOUBLE)) AS g1, quantile_cont(gap, CAST(0.5 AS DOUBLE)) AS g5, min(gap) AS lo, max(gap) AS hi, stddev_pop(y) / (avg(y) + CAST(1e-12 AS DOUBLE)) AS amp, avg((y - y10) / CAST(0.01 AS DOUBLE)) FILTER (nth <= 20) AS rise FROM iw GROUP BY scene_id, start)",
      "ib AS (SELECT scene_id, start, avg(pow(gap - gm, 3)) / pow(avg(pow(gap - gm, 2)), CAST(1.5 AS DOUBLE)) AS iii_skew FROM iw JOIN ia USING (scene_id, start) WHERE gap IS NOT NULL GROUP BY scene_id, start)",
      "ih AS (SELECT scene_id, start, -sum(p * log2(p + CAST(1e-12 AS DOUBLE))) AS iii_entropy FROM (SELECT scene_id, start, c / (sum(c) OVER (PARTITION BY scene_id, start) + CAST(1e-12 AS DOUBLE)) AS p FROM (SELECT scene_id, start, least(CAST(floor((gap - lo) / (hi - lo) * 8) AS INT), 7) AS b, count(*) AS c FROM iw JOIN ia USING (scene_id, start) WHERE gap IS NOT NULL GROUP BY ALL)) GROUP BY scene_id, start)",
      "dr AS (SELECT st.scene_id, st.start, count(d.i) / CAST(3 AS DOUBLE) AS rain_impulse_rate FROM st LEFT JOIN drop_ d ON d.scene_id = st.scene_id AND d.i >= start AND d.i < start + 3000 GROUP BY st.scene_id, st.start)"]
    tiny = "(rms + CAST(1e-12 AS DOUBLE))"
    named = {f"energy_{k}": f"l_{k}" for k in X.ENERGY_BANDS} | {
      "ratio_car_human": "(l_car_peak + CAST(1e-10 AS DOUBLE)) / (l_human_peak + CAST(1e-10 AS DOUBLE))", "ratio_human_car": "(l_human_peak + CAST(1e-10 AS DOUBLE)) / (l_car_peak + CAST(1e-10 AS DOUBLE))",
      "frac_wind_1_5": f"l_wind / {tiny}", "frac_veh_5_25": f"l_veh / {tiny}", "frac_foot_20_90": f"l_foot / {tiny}", "frac_high_90_180": f"l_high / {tiny}", "ratio_veh_foot": "l_veh / (l_foot + CAST(1e-12 AS DOUBLE))", "hop_band_frac": f"l_hop / {tiny}",
      "band_occupancy": " + ".join(f"CAST(l_{k} / {tiny} > CAST(0.15 AS DOUBLE) AS INT)" for k in ("wind", "veh", "foot", "high")),
      "cad_freq": "k0 * CAST(1000 AS DOUBLE) / 8192", "cad_salience": "p0 / fl", "cad_harm2": "h2 / base", "cad_harm4": "h4 / base", "gust_mod": "s4 / (s5 + CAST(1e-20 AS DOUBLE))",
      "mod_e_1_3": "s1 / (s0 + CAST(1e-20 AS DOUBLE))", "mod_e_3_8": "s2 / (s0 + CAST(1e-20 AS DOUBLE))", "mod_e_8_12": "s3 / (s0 + CAST(1e-20 AS DOUBLE))", "mod_ratio_low_mid": "s1 / (s2 + CAST(1e-20 AS DOUBLE))", "mod_peak2_ratio": "CASE WHEN mod_peak_count > 1 THEN tops[2] / (tops[1] + CAST(1e-20 AS DOUBLE)) ELSE 0 END", "mod_centroid": "fp / (s0 + CAST(1e-20 AS DOUBLE))",
      "iii_mean": "CASE WHEN n >= 3 THEN gm ELSE 0 END", "iii_cv": "CASE WHEN n >= 3 THEN gs / (gm + CAST(1e-9 AS DOUBLE)) ELSE 0 END", "impulse_density": "coalesce(n, 0) / CAST(3 AS DOUBLE)", "iii_entropy": "CASE WHEN n >= 4 THEN iii_entropy ELSE 0 END", "iii_skew": "CASE WHEN n >= 4 THEN iii_skew ELSE 0 END",
      "iii_range_norm": "CASE WHEN n >= 4 THEN (g9 - g1) / (g5 + CAST(1e-9 AS DOUBLE)) ELSE 0 END", "impulse_amp_cv": "CASE WHEN n >= 4 THEN amp ELSE 0 END", "attack_sharpness": "CASE WHEN n >= 2 THEN rise ELSE 0 END", "veh_foot_simultaneity": f"l_veh / {tiny} * least(coalesce(n, 0) / CAST(3 AS DOUBLE), 5)"}
    cols = ", ".join(small(named.get(c, c), c) for c in FILTERED)
    joins = " ".join(f"JOIN {t} USING (scene_id, start)" for t in ("bl", "rk", "ev_", "fl", "p2", "ca", "ha", "ms", "en", "ac", "dr")) + " " + " ".join(f"LEFT JOIN {t} USING (scene_id, start)" for t in ("ia", "ib", "ih"))
    return [*parts, f"SELECT scene_id, CAST(start AS INT) AS start, {cols} FROM rm {joins}"]


WELCH = ["lw_ AS (SELECT scene_id, count(*) AS len FROM sig GROUP BY scene_id)", "sg_ AS (SELECT scene_id, 512 * k AS start FROM lw_ CROSS JOIN range(0, 58) AS t(k) WHERE 512 * k + 1024 <= len)",
  "ws AS (SELECT scene_id, start, i - start AS n, (v - avg(v) OVER (PARTITION BY scene_id, start)) * (CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) * cos(2 * pi() * (i - start) / 1024)) AS y FROM sig JOIN sg_ USING (scene_id) WHERE i >= start AND i < start + 1024)",
  "wp AS (SELECT scene_id, start, k, (pow(sum(y * cos(2 * pi() * (k * n % 1024) / 1024)), 2) + pow(sum(y * sin(2 * pi() * (k * n % 1024) / 1024)), 2)) * CASE WHEN k IN (0, 512) THEN 1 ELSE 2 END / (1000 * CAST(384 AS DOUBLE)) AS p FROM ws CROSS JOIN range(0, 513) AS t(k) GROUP BY scene_id, start, k)",
  "wf AS MATERIALIZED (SELECT scene_id, k, k * CAST(1000 AS DOUBLE) / 1024 AS f, avg(p) AS p FROM wp GROUP BY scene_id, k)"]


def welch() -> list[str]:
    return [SG, SIG, *WELCH, "SELECT scene_id, round(f, 6) AS f, round(p * 1000, 6) AS p FROM wf"]


def lines() -> list[str]:
    pad = "lp AS (SELECT scene_id, k, f, 10 * log10(p + CAST(1e-12 AS DOUBLE)) AS d FROM wf UNION ALL SELECT scene_id, k, NULL, 0 FROM lw_ CROSS JOIN (SELECT unnest(list_concat(range(-15, 0), range(513, 528))) AS k))"
    med = "lm AS (SELECT scene_id, k, f, d - quantile_cont(d, CAST(0.5 AS DOUBLE)) OVER (PARTITION BY scene_id ORDER BY k ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS o FROM lp)"
    near = "lo AS (SELECT *, lag(o) OVER w AS a, lead(o) OVER w AS b FROM (SELECT * FROM lm WHERE f IS NOT NULL) WINDOW w AS (PARTITION BY scene_id ORDER BY k))"
    return [SG, SIG, *WELCH, pad, med, near, "SELECT scene_id, round(f, 6) AS f, round(o, 6) AS prominence_db FROM lo WHERE o > a AND o > b AND o >= 1"]


def resampled() -> list[str]:
    bessel = lambda x: f"(SELECT sum(pow({x} / 2, 2 * k) / pow(gamma(k + 1), 2)) FROM range(0, 40) AS b(k))"
    taps = f"hp AS (SELECT j, CASE WHEN j = 0 THEN 1 ELSE sin(pi() * j / 5) / (pi() * j / 5) END * {bessel('5 * sqrt(greatest(1 - pow(CAST(j AS DOUBLE) / 50, 2), 0))')} AS h FROM range(-50, 51) AS t(j))"
    norm = "hn AS (SELECT j, h * 5 / sum(h) OVER () AS h FROM hp)"
    out = "ro AS (SELECT scene_id, unnest(range(CAST(ceil(len * CAST(1.25 AS DOUBLE)) AS BIGINT))) AS m FROM (SELECT scene_id, count(*) AS len FROM sig GROUP BY scene_id))"
    y = "rj AS (SELECT scene_id, m, (4 * m - j) // 5 AS i, h FROM ro CROSS JOIN hn WHERE (4 * m - j) % 5 = 0 AND 4 * m >= j), ry AS (SELECT scene_id, m, sum(v * h) AS y FROM rj JOIN sig USING (scene_id, i) GROUP BY scene_id, m)"
    return [SG, SIG, taps, norm, out, y, "SELECT scene_id, CAST(count(*) AS INT) AS n, round(sum(y), 6) + 0 AS s, round(sum(y * m) / count(*), 6) + 0 AS moment FROM ro LEFT JOIN ry USING (scene_id, m) GROUP BY scene_id"]


def sensor() -> list[str]:
    w0, z = "(2 * pi() * 10)", "CAST(0.6 AS DOUBLE)"
    dft = "sf AS MATERIALIZED (SELECT scene_id, len, k, sum(v * cos(2 * pi() * (k * i % len) / len)) AS re, -sum(v * sin(2 * pi() * (k * i % len) / len)) AS im FROM sig JOIN (SELECT scene_id, len, unnest(range(0, len // 2 + 1)) AS k FROM (SELECT scene_id, count(*) AS len FROM sig GROUP BY scene_id)) USING (scene_id) GROUP BY scene_id, len, k)"
    # H = s^2 / (s^2 + 2 z w0 s + w0^2) at s = i w: -w^2 / ((w0^2 - w^2) + i 2 z w0 w)
    h = f"sh_ AS (SELECT *, 2 * pi() * k * 1000 / len AS w, {w0} * {w0} - pow(2 * pi() * k * 1000 / len, 2) AS a, 2 * {z} * {w0} * 2 * pi() * k * 1000 / len AS b FROM sf)"
    g = "sr AS MATERIALIZED (SELECT scene_id, len, k, CASE WHEN k = 0 OR 2 * k = len THEN 1 ELSE 2 END * -w * w * (re * a + im * b) / (a * a + b * b) AS re, CASE WHEN k = 0 OR 2 * k = len THEN 0 ELSE 2 END * -w * w * (im * a - re * b) / (a * a + b * b) AS im FROM sh_)"
    y = "sy AS (SELECT scene_id, i, sum(re * cos(2 * pi() * (k * i % len) / len) - im * sin(2 * pi() * (k * i % len) / len)) / len * 2 AS y FROM sr JOIN (SELECT scene_id, i FROM sig) USING (scene_id) GROUP BY scene_id, i, len)"
    return [SG, SIG, dft, h, g, y, "SELECT scene_id, CAST(count(*) AS INT) AS n, round(max(round_even(least(greatest(y, -CAST(0.5 AS DOUBLE)), CAST(0.5 AS DOUBLE)) * 1000, 0) / 1000), 6) AS peak FROM sy GROUP BY scene_id"]
