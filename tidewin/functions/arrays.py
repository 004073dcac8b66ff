"""Array expressions on signals: windows, moments, bursts, spectra of short arrays; all inside the JVM."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def sum_of(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v))


def windows(df: DataFrame, x: str, n: int, hop: int, out: str = "w", short: bool = False) -> DataFrame:
    """One row per window of n samples every ``hop``: win (from 0), start, ``out``. Too short an array has none, or one with ``short``."""
    last = F.size(x) - n
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(hop))
    starts = F.when(last >= 0, starts).otherwise(F.array(F.lit(0)) if short else F.array().cast("array<int>"))
    t = df.select(*[c for c in df.columns if c != x], F.col(x).alias("_x"), F.posexplode(starts).alias("win", "start"))
    return t.withColumn(out, F.slice("_x", F.col("start") + 1, F.lit(n))).drop("_x")


def rms(a: Column) -> Column:
    return F.sqrt(F.try_divide(sum_of(a, lambda v: v * v), F.size(a).cast("double")))


def peak_to_peak(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def variance(a: Column, m: Column | None = None) -> Column:
    m = mean(a) if m is None else m
    return F.try_divide(sum_of(a, lambda v: (v - m) * (v - m)), F.size(a).cast("double"))


def zero_crossing_rate(a: Column) -> Column:
    """Changes of sign (as numpy's sign) between neighbours, over the length."""
    s = F.transform(a, lambda v: F.signum(v))
    pairs = F.zip_with(F.slice(s, 2, F.size(s)), F.slice(s, 1, F.size(s) - 1), lambda p, q: F.when(p != q, 1.0).otherwise(0.0))
    return F.try_divide(total(pairs), F.size(a).cast("double"))


def moment(a: Column, m: Column, k: int) -> Column:
    return F.try_divide(sum_of(a, lambda v: F.pow(v - m, F.lit(float(k)))), F.size(a).cast("double"))


def lag_correlation(a: Column, k: int) -> Column:
    """Pearson correlation of a[k:] and a[:-k]; 0 where it isn't defined."""
    n = F.size(a) - k
    u, v = F.slice(a, 1, n), F.slice(a, k + 1, n)
    mu, mv = mean(u), mean(v)
    num = total(F.zip_with(u, v, lambda p, q: (p - mu) * (q - mv)))
    den = F.sqrt(sum_of(u, lambda p: (p - mu) * (p - mu)) * sum_of(v, lambda q: (q - mv) * (q - mv)))
    return F.when(den > 0, num / F.nullif(den, F.lit(0.0))).otherwise(0.0)


def top_quarter_share(a: Column) -> Column:
    """Energy of the quarter of samples with most energy, over all."""
    e = F.reverse(F.array_sort(F.transform(a, lambda v: v * v)))
    return F.coalesce(F.try_divide(total(F.slice(e, 1, F.greatest(F.floor(F.size(a) / 4).cast("int"), F.lit(1)))), total(e)), F.lit(0.0))


def count_over(a: Column, limit: Column) -> Column:
    return F.size(F.filter(a, lambda v: F.abs(v) > limit))


def temporal_centroid(a: Column) -> Column:
    """Mean place of the energy, as a share of the length."""
    w = F.zip_with(a, F.sequence(F.lit(0), F.size(a) - 1), lambda v, i: v * v * i)
    return F.coalesce(F.try_divide(total(w), sum_of(a, lambda v: v * v) * F.size(a)), F.lit(0.0))


def dft_power(a: Column, n: int, bins: list[int]) -> Column:
    """|X[k]|^2 of an array of n samples for each bin, with the cosines as literals."""
    out = []
    for k in bins:
        c = F.array(*[F.lit(math.cos(2 * math.pi * k * i / n)) for i in range(n)])
        s = F.array(*[F.lit(math.sin(2 * math.pi * k * i / n)) for i in range(n)])
        re, im = total(F.zip_with(a, c, lambda p, q: p * q)), total(F.zip_with(a, s, lambda p, q: p * q))
        out.append(re * re + im * im)
    return F.array(*out)


def nearest_on_grid(x: Column, grid: list[float]) -> Column:
    """The nearer neighbour in a rising grid; at a midpoint the upper."""
    out = F.lit(float(grid[-1]))
    for a, b in reversed(list(zip(grid, grid[1:]))):
        out = F.when(x < (a + b) / 2, float(a)).otherwise(out)
    return out


def interp(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation over literal points, clamped."""
    out = F.lit(float(ys[-1]))
    for i in reversed(range(len(xs) - 1)):
        a, b, p, q = xs[i], xs[i + 1], ys[i], ys[i + 1]
        out = F.when(x < b, p + (x - a) * ((q - p) / (b - a))).otherwise(out)
    return F.when(x <= xs[0], float(ys[0])).otherwise(out)


def decode_f32(blob: Column) -> Column:
    """array<float> from little-endian 32-bit floats, by bit arithmetic on the bytes; an empty blob gives an empty array."""
    digits = F.hex(blob)

    def one(i: Column) -> Column:
        pair = lambda k: F.substring(digits, i * 8 + 2 * k + 1, F.lit(2))
        return _f32(F.conv(F.concat(pair(3), pair(2), pair(1), pair(0)), 16, 10).cast("long"))

    n = F.floor(F.octet_length(blob) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one)).when(n == 0, F.array().cast("array<float>"))


def _f32(bits: Column) -> Column:
    sign = F.when(F.shiftrightunsigned(bits, 31) == 1, -1.0).otherwise(1.0)
    e = F.shiftrightunsigned(bits, 23).bitwiseAND(F.lit(255))
    m = bits.bitwiseAND(F.lit((1 << 23) - 1))
    normal = (1 + m / float(1 << 23)) * F.pow(F.lit(2.0), (e - 127).cast("double"))
    small = (m / float(1 << 23)) * F.lit(2.0**-126)
    special = F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * F.when(e == 255, special).when(e == 0, small).otherwise(normal)).cast("float")
