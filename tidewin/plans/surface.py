"""Plans written in SQL, on the registered functions."""
from __future__ import annotations

from ..functions.sql import register
from .registry import query
from .views import LW, SG, lw, sg, sql


@query("sql_functions", sql(LW, "SELECT CASE WHEN snr >= 0 THEN 'detectable' WHEN snr >= -20 THEN 'marginal' ELSE 'nothing' END AS zone, CASE WHEN snr < -8 THEN 0 WHEN snr < 2 THEN 1 ELSE 2 END AS z3, count(*) AS n, round(avg(CASE WHEN snr < -20 THEN 0 ELSE 1 / (1 + exp(-snr / 6)) END), 6) AS soft, round(sum(round_even(snr / CAST(0.5 AS DOUBLE), 0) * CAST(0.5 AS DOUBLE)), 3) AS q FROM lw GROUP BY ALL"))
def sql_functions(spark, d):
    register(spark)
    return spark.sql("SELECT snr_zone(snr) AS zone, zone3(snr, -8D, 2D) AS z3, count(*) AS n, round(avg(soft_target(snr)), 6) AS soft, round(sum(quantise_even(snr, 0.5D)), 3) AS q FROM {lw} GROUP BY ALL", lw=lw(spark, d))


@query("sql_window_function", sql(SG, "SELECT scene_id, w AS win, round(list_sum(x[w * 16 + 1 : w * 16 + 32]), 6) + 0 AS s FROM sg CROSS JOIN range(0, 3) AS t(w)"))
def sql_window_function(spark, d):
    """The table function, laterally joined."""
    register(spark)
    return spark.sql("SELECT scene_id, CAST(win AS BIGINT) AS win, round(aggregate(w, 0D, (a, v) -> a + v), 6) + 0D AS s FROM {sg}, LATERAL signal_windows(x, 32, 16)", sg=sg(spark, d))
