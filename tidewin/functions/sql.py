"""The scalar rules as SQL functions, and sliding windows as a table function, for plans written in SQL.

The scalar functions are SQL expressions: they are inlined into the plan and stay inside generated code.
"""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SCALARS = {
    "soft_target(snr DOUBLE)": ("DOUBLE", "CASE WHEN snr < -20 THEN 0D ELSE 1 / (1 + exp(-snr / 6)) END"),
    "snr_zone(snr DOUBLE)": ("STRING", "CASE WHEN snr >= 0 THEN 'detectable' WHEN snr >= -20 THEN 'marginal' ELSE 'nothing' END"),
    "zone3(snr DOUBLE, lo DOUBLE, hi DOUBLE)": ("INT", "CASE WHEN snr < lo THEN 0 WHEN snr < hi THEN 1 ELSE 2 END"),
    "gate_db(d_prime DOUBLE, seconds DOUBLE, band DOUBLE)": ("DOUBLE", "10 * log10(d_prime * d_prime / (2 * seconds * band))"),
    "quantise_even(x DOUBLE, step DOUBLE)": ("DOUBLE", "bround(x / step) * step"),
    "clip_at(x DOUBLE, r DOUBLE)": ("DOUBLE", "greatest(least(x, r), -r)"),
    "decibel(s DOUBLE, n DOUBLE)": ("DOUBLE", "CASE WHEN n > 0 THEN 20 * log10(greatest(s, 1e-12D) / n) END"),
    "hourly_condition(wind DOUBLE, rain DOUBLE)": ("STRING", "CASE WHEN rain > 5 THEN 'rain_heavy' WHEN rain > 0.5D THEN 'rain_light' WHEN wind >= 10 THEN 'wind_high' WHEN wind >= 6 THEN 'wind_mid' WHEN wind >= 3 THEN 'wind_low' ELSE 'calm' END"),
    "overlap(a DOUBLE, b DOUBLE, lo DOUBLE, hi DOUBLE)": ("DOUBLE", "greatest(0D, least(b, hi) - greatest(a, lo))"),
}


@udtf(returnType="win int, start int, w array<double>")
class SignalWindows:
    """signal_windows(x, n, hop): the whole windows of an array; in DataFrame plans ``arrays.windows`` needs no Python."""

    def eval(self, x: list, n: int, hop: int):
        for k, start in enumerate(range(0, len(x or []) - n + 1, hop)):
            yield k, start, x[start : start + n]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("signal_windows", SignalWindows)
