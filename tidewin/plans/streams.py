"""Streaming twins, run over what is there and compared with the batch operators' SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.readers import list_files
from ..sources.scratch import scratch, staged
from ..streaming import event_time as E
from ..streaming import operators as T
from .registry import query
from .series import OFF, ON, hyst_sql
from .views import EV, ev, sql


def _stream(spark, d):
    path = scratch(spark, "stream-in")
    e = ev(spark, d).select("recording", "us", "pos", "s_human", "label", F.timestamp_micros("us").alias("at"))
    e.write.parquet(path)  # one batch takes all files, so neither their number nor the rows' order matters
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _run(spark, result, mode="append"):
    return T.run_available(result, scratch(spark, "stream-out"), scratch(spark, "stream-state"), mode)


@query("streaming_hysteresis", sql(EV, hyst_sql("h", "ev", "recording", "s_human", ON, OFF), "SELECT recording, us, is_on FROM h"))
def streaming_hysteresis(spark, d):
    """Keyed state of one boolean; equal to the set-based form."""
    return _run(spark, T.hysteresis_stream(_stream(spark, d), "recording", "us", "s_human", 0.8, 0.5)).select("recording", "us", "is_on")


@query("streaming_n_of_m", sql(EV, "SELECT recording, us, sum(CAST(s_human > CAST(0.6 AS DOUBLE) AS INT)) OVER (PARTITION BY recording ORDER BY t0_s, pos ROWS 2 PRECEDING) >= 2 AS is_on FROM ev"))
def streaming_n_of_m(spark, d):
    return _run(spark, T.n_of_m_stream(_stream(spark, d), "recording", "us", "s_human", 0.6, 2, 3)).select("recording", "us", "is_on")


@query("streaming_sliding_counts", sql(EV, "w AS (SELECT label, us // 43200000000 * 43200000000 - k * 43200000000 AS start_us FROM ev CROSS JOIN range(0, 2) AS t(k))", "m AS (SELECT max(us) // 1000 * 1000 - 3600000000 AS mark FROM ev)", "SELECT label, start_us, count(*) AS n FROM w CROSS JOIN m WHERE start_us + 86400000000 <= mark GROUP BY label, start_us"))
def streaming_sliding_counts(spark, d):
    """Closed windows only: append mode gives a window when the watermark has passed it."""
    c = T.sliding_counts(_stream(spark, d), "at", ["label"], "1 day", "12 hours", "1 hour")
    return _run(spark, c).select("label", F.unix_micros("w.start").alias("start_us"), "n")


@query("streaming_sessions", sql(EV, "b AS (SELECT recording, us, CASE WHEN us - lag(us) OVER (PARTITION BY recording ORDER BY us) < 28800000000 THEN 0 ELSE 1 END AS first FROM ev)", "s AS (SELECT recording, us, sum(first) OVER (PARTITION BY recording ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM b)", "m AS (SELECT max(us) // 1000 * 1000 - 3600000000 AS mark FROM ev)", "SELECT recording, min(us) AS start_us, count(*) AS n FROM s CROSS JOIN m GROUP BY recording, k, mark HAVING max(us) + 28800000000 <= mark"))
def streaming_sessions(spark, d):
    s = T.sessions(_stream(spark, d), "at", "recording", "8 hours", "1 hour")
    return _run(spark, s).select("recording", F.unix_micros("w.start").alias("start_us"), "n")


MARK = "m AS (SELECT max(us) // 1000 * 1000 - 3600000000 AS mark FROM ev)"


def _in_event_time(spark, d, plan):
    with E.rocks(spark):
        return _run(spark, plan(_shuffled_stream(spark, d)))


#: Rows that a file of a batch is meant to hold.
FILE_ROWS = 500_000


def _shuffled_stream(spark, d):
    """Four batches: events arrive up to 20 minutes after their time, out of order, none later than the watermark allows.

    A batch is as many files as its rows need, the same number for all batches.
    """
    path = scratch(spark, "stream-in")
    e = ev(spark, d).select("recording", "us", "s_human", F.timestamp_micros("us").alias("at"), (F.col("us") + F.pmod(F.xxhash64("us"), F.lit(1_200_000_000))).alias("arrives"))
    e = staged(e, "arrivals")
    lo, hi, n = e.agg(F.min("arrives"), F.max("arrives"), F.count("*")).first()
    files = max(1, -(-n // (4 * FILE_ROWS)))
    for k in range(4):  # one after the other, as files are read in the order of their writing
        part = e.filter(F.floor((F.col("arrives") - lo) * 4 / (hi - lo + 1)) == k).drop("arrives")
        part.repartition(files).write.mode("append").parquet(path)
        for _ in range((k + 1) * files - len(list_files(spark, path, r"part-.*"))):  # a task without rows writes none
            spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("streaming_hysteresis_event_time", sql(EV, hyst_sql("h", "ev", "recording", "s_human", ON, OFF), MARK, "SELECT recording, us, is_on FROM h CROSS JOIN m WHERE us <= mark"))
def streaming_hysteresis_event_time(spark, d):
    """Rows out of order, in several batches: what the watermark has passed is what the set-based form gives."""
    return _in_event_time(spark, d, lambda s: E.hysteresis(s, "recording", "at", "s_human", 0.8, 0.5, "1 hour", 10**13)).select("recording", "us", "is_on")


@query("streaming_n_of_m_event_time", sql(EV, MARK, "n AS (SELECT recording, us, sum(CAST(s_human > CAST(0.6 AS DOUBLE) AS INT)) OVER (PARTITION BY recording ORDER BY t0_s, pos ROWS 2 PRECEDING) >= 2 AS is_on FROM ev)", "SELECT recording, us, is_on FROM n CROSS JOIN m WHERE us <= mark"))
def streaming_n_of_m_event_time(spark, d):
    return _in_event_time(spark, d, lambda s: E.n_of_m(s, "recording", "at", "s_human", 0.6, 2, 3, "1 hour", 10**13)).select("recording", "us", "is_on")


@query("streaming_tumbling_counts", sql(EV, MARK, "SELECT label, us // 86400000000 * 86400000000 AS start_us, count(*) AS n FROM ev CROSS JOIN m WHERE us // 86400000000 * 86400000000 + 86400000000 <= mark GROUP BY 1, 2"))
def streaming_tumbling_counts(spark, d):
    """Closed days only."""
    c = T.sliding_counts(_stream(spark, d), "at", ["label"], "1 day", "1 day", "1 hour")
    return _run(spark, c).select("label", F.unix_micros("w.start").alias("start_us"), "n")
