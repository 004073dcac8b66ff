"""Scalar expressions with the engine's rounding, sentinel and NULL rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Detection floors in dB, the sentinel of an absent class, and the smallest ratio.
DET_FLOOR_DB = {"vehicle": -12.0, "human": -8.0, "animal": -9.0}
ABSENT_SNR = -99.0
TINY = 1e-12


def clip(x: Column, limit: Column | float) -> Column:
    """Into [-limit, limit]; an infinite limit changes nothing."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return F.greatest(F.least(x, limit), -limit)


def quantise(x: Column, step: float) -> Column:
    """To multiples of ``step``, half to even."""
    return F.bround(x / step) * step


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or(x: Column, other: float = 0.0) -> Column:
    """NaN, infinities and NULL become ``other``."""
    return F.when(finite(x), x).otherwise(other)


def decibel(signal: Column, noise: Column) -> Column:
    """20*log10 of the ratio, the signal not below 1e-12; NULL where the noise isn't positive."""
    return F.when(noise > 0, 20 * F.log10(F.greatest(signal, F.lit(TINY)) / noise))


def level_of_count(n: Column) -> Column:
    return F.when(n <= 0, "none").when(n == 1, "single").otherwise("multiple")


def level_number(level: Column) -> Column:
    """none, single, multiple to 0, 1, 2; numbers as text stay numbers."""
    return F.when(level == "none", 0).when(level == "single", 1).when(level == "multiple", 2).otherwise(level.try_cast("int"))


def zone(snr: Column) -> Column:
    return F.when(snr >= 0, "detectable").when(snr >= -20, "marginal").otherwise("nothing")


def eval_zone(snr: Column, cls: Column) -> Column:
    floor = F.lit(-20.0)
    for name, db in DET_FLOOR_DB.items():
        floor = F.when(cls == name, db).otherwise(floor)
    return F.when(snr >= floor, "detectable").otherwise("nothing")


def zone3(snr: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.when(snr < lo, 0).when(snr < hi, 1).otherwise(2)


def soft_target(snr: Column) -> Column:
    return F.when(snr < -20, 0.0).otherwise(1 / (1 + F.exp(-snr / 6)))


def gate_db(d_prime: float, seconds: Column | float, band_hz: Column | float) -> Column:
    """10*log10(d'^2 / (2*T*B))."""
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    b = band_hz if isinstance(band_hz, Column) else F.lit(band_hz)
    return 10 * F.log10(F.lit(d_prime * d_prime) / (2 * s * b))


def four_states(present: Column, emitted: Column, rms: Column, snr: Column, gate: Column | float) -> tuple[Column, Column, Column, Column]:
    """scene presence, emission active, received signal, detectable: each needs the one before it."""
    a = F.coalesce(present, F.lit(False))
    b = a & F.coalesce(emitted > 0, F.lit(False))
    c = b & F.coalesce(rms > 1e-6, F.lit(False))
    e = c & F.coalesce(snr >= gate, F.lit(False))
    return tuple(x.cast("int") for x in (a, b, c, e))


# The thresholds of the three rules below (wind in m/s, rain in mm, lines in Hz).

def hourly_condition(wind: Column, rain: Column) -> Column:
    return F.when(rain > 5, "rain_heavy").when(rain > 0.5, "rain_light").when(wind >= 10, "wind_high").when(wind >= 6, "wind_mid").when(wind >= 3, "wind_low").otherwise("calm")


def daily_condition(wind_max: Column, rain_sum: Column) -> Column:
    return F.when(rain_sum >= 5, "rain_heavy").when(rain_sum >= 0.5, "rain_light").when(wind_max >= 12, "wind_high").when(wind_max >= 7, "wind_mid").when(wind_max >= 4, "wind_low").otherwise("calm")


def line_kind(hz: Column) -> Column:
    """What a spectral line probably is; the first rule that holds."""
    k = F.round(hz / 50)
    mains = k.between(1, 9) & (F.abs(hz - 50 * k) <= 1.5)
    return F.when(mains, "mains").when(hz.between(44, 47) | hz.between(53, 57), "rig").when(hz.between(140, 180), "spurious").when(hz.between(4, 80), "machinery").otherwise("other")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cosine_rate(step: Column, total: int, warm: int, top: float) -> Column:
    """Linear warm-up from 0 to ``top``, then half a cosine to 0."""
    part = F.least(F.lit(1.0), (step - warm) / F.lit(float(max(1, total - warm))))
    return F.when(step < warm, top * step / max(1, warm)).otherwise(top * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * part)))


def seconds_of_epoch(x: Column, median: Column) -> Column:
    """Epoch seconds, from milliseconds if the series' median says so."""
    return F.when(median > 1e11, x / 1000).otherwise(x)


def coupling_anchor(fc: Column) -> Column:
    """The anchored coupling centre without jitter."""
    return coupling_jittered(fc, F.lit(1.0))


# Centre, reference and bounds of the anchored coupling (Hz).

def coupling_jittered(fc: Column, factor: Column) -> Column:
    """The anchored centre times a positive factor of median 1, inside the physical span."""
    return F.least(F.greatest(53.0 * F.sqrt(fc / 127.3) * factor, F.lit(30.0)), F.lit(150.0))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal: a power series near 0, a continued fraction further out; about 1e-14 relative."""
    a = F.abs(z)
    density = F.exp(-a * a / 2) / F.sqrt(2 * F.pi())
    steps = lambda n: F.sequence(F.lit(1), F.lit(n))
    start = F.struct(a.alias("term"), a.alias("sum"))
    step = lambda acc, k: F.struct((acc["term"] * a * a / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * a * a / (2 * k + 1)).alias("sum"))
    near = 0.5 - density * F.aggregate(steps(80), start, step)["sum"]
    far = density / F.aggregate(F.reverse(steps(120)), a, lambda acc, k: a + k / acc)
    tail = F.when(a < 2.5, near).otherwise(far)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def thousandths(x: Column) -> Column:
    """Metres to millimetres, volts to millivolts: units that are 1,000 times smaller."""
    return x * 1000


def inches_to_mm(x: Column) -> Column:
    return x * 25.4
