"""Queries over ordered series of windows."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import decisions as D
from ..operators import series as S
from ..operators.resampling import block_resamples
from .decisions import EVT, HAV, TAU, _taus, _with_taus
from .registry import query
from .views import EV, ev, read, sql

KEY, ORDER = ["recording"], ["t0_s", "pos"]


def hyst_sql(name: str, rows: str, keys: str, value: str, on: str, off: str) -> str:
    """Hysteresis by the last on-crossing and the last off-crossing: another form than the engine's."""
    w = f"(PARTITION BY {keys} ORDER BY t0_s, pos ROWS UNBOUNDED PRECEDING)"
    return f"""{name} AS (SELECT *, coalesce(last_a > coalesce(last_off, -1), FALSE) AS is_on FROM (
  SELECT *, max(CASE WHEN {value} > {on} THEN pos END) OVER {w} AS last_a, max(CASE WHEN NOT ({value} > {off}) THEN pos END) OVER {w} AS last_off FROM {rows}))"""


ON, OFF = "CAST(0.8 AS DOUBLE)", "CAST(0.5 AS DOUBLE)"


@query("hysteresis", sql(EV, hyst_sql("h", "ev", "recording", "s_human", ON, OFF), "SELECT event_id, recording, pos, is_on FROM h"))
def hysteresis(spark, d):
    return S.hysteresis(ev(spark, d), F.col("s_human"), F.lit(0.8), F.lit(0.5), KEY, ORDER, "is_on").select("event_id", "recording", "pos", "is_on")


@query("hysteresis_sweep", sql(EV, "fr AS (SELECT CAST(i AS DOUBLE) / CAST(10 AS DOUBLE) AS frac FROM range(4, 11) AS t(i))", f"evf AS (SELECT ev.*, frac, {ON} * frac AS t_off FROM ev CROSS JOIN fr)", hyst_sql("h", "evf", "frac, recording", "s_human", ON, "t_off"),
  """SELECT frac, count(*) FILTER (is_on) AS n_on, round(count(*) FILTER (is_on AND label = 'human') / CAST(count(*) FILTER (label = 'human') AS DOUBLE), 6) AS recall, round(count(*) FILTER (is_on AND label = 'nothing') / CAST(count(*) FILTER (label = 'nothing') AS DOUBLE), 6) AS far FROM h GROUP BY frac"""))
def hysteresis_sweep(spark, d):
    """Off thresholds at 0.4 to 1.0 of the on threshold: switches of one sort; no row is multiplied before it."""
    fracs = [i / 10 for i in range(4, 11)]
    turns = {f"on_{i}": (F.col("s_human"), F.lit(0.8), F.lit(0.8) * F.lit(f)) for i, f in enumerate(fracs)}
    h = S.switches(ev(spark, d), turns, KEY, ORDER)
    h = h.select("label", F.inline(F.array(*[F.struct(F.lit(f).alias("frac"), F.col(f"on_{i}").alias("is_on")) for i, f in enumerate(fracs)])))
    n = lambda e: F.sum(F.when(F.expr(e), 1).otherwise(0))
    return h.groupBy("frac").agg(n("is_on").cast("long").alias("n_on"), F.round(F.try_divide(n("is_on AND label = 'human'").cast("double"), n("label = 'human'").cast("double")), 6).alias("recall"), F.round(F.try_divide(n("is_on AND label = 'nothing'").cast("double"), n("label = 'nothing'").cast("double")), 6).alias("far"))


EXITS3 = [0.4, 0.7, 1.0]


def _three_way(spark, d):
    """exit, label, decided: the switches of all heads and exits are last turns over one sort; no row is multiplied before it."""
    turns = {f"on_{h}_{x}": (F.col(f"s_{h}"), F.col(f"tau_{h}"), F.col(f"tau_{h}") * F.lit(e)) for h in HAV for x, e in enumerate(EXITS3)}
    t = S.switches(_with_taus(spark, d), turns, KEY, ORDER)
    each = []
    for x, e in enumerate(EXITS3):
        on = {h: F.when(F.col(f"on_{h}_{x}"), F.col(f"s_{h}")) for h in HAV}
        best = F.greatest(*on.values())
        decided = F.when(on["human"] == best, "human").when(on["animal"] == best, "animal").when(on["vehicle"] == best, "vehicle").otherwise("nothing")
        each.append(F.struct(F.lit(e).alias("exit"), decided.alias("decided")))
    return t.select("label", F.inline(F.array(*each)))


GRID3 = ["evx AS (SELECT evt.*, exit_ AS exit FROM evt CROSS JOIN (VALUES (CAST(0.4 AS DOUBLE)), (CAST(0.7 AS DOUBLE)), (CAST(1 AS DOUBLE))) AS v(exit_))",
  hyst_sql("h1", "evx", "exit, recording", "s_human", "tau_human", "tau_human * exit").replace("is_on", "on_human").replace("last_", "l1_"),
  hyst_sql("h2", "h1", "exit, recording", "s_animal", "tau_animal", "tau_animal * exit").replace("is_on", "on_animal").replace("last_", "l2_"),
  hyst_sql("h3", "h2", "exit, recording", "s_vehicle", "tau_vehicle", "tau_vehicle * exit").replace("is_on", "on_vehicle").replace("last_", "l3_"),
  """sc AS (SELECT exit, label, CASE WHEN on_human THEN s_human ELSE -1 END AS a, CASE WHEN on_animal THEN s_animal ELSE -1 END AS b, CASE WHEN on_vehicle THEN s_vehicle ELSE -1 END AS c FROM h3)""",
  """dc AS (SELECT exit, label, CASE WHEN greatest(a, b, c) < 0 THEN 'nothing' WHEN a >= b AND a >= c THEN 'human' WHEN b >= c THEN 'animal' ELSE 'vehicle' END AS decided FROM sc)"""]


@query("hysteresis_3way", sql(EV, TAU, EVT, *GRID3, "SELECT exit, label, decided, count(*) AS n FROM dc GROUP BY exit, label, decided"))
def hysteresis_3way(spark, d):
    """Independent heads, the strongest that is on; three exits."""
    return D.confusion(_three_way(spark, d), "label", "decided", ["exit"])


@query("hyst_exit_select", sql(EV, TAU, EVT, *GRID3, "ac AS (SELECT exit, avg(CASE WHEN label = decided THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy FROM dc GROUP BY exit)",
  "SELECT exit, round(accuracy, 6) AS accuracy, row_number() OVER (ORDER BY round(accuracy, 9) DESC, exit DESC) = 1 AS chosen FROM ac"))
def hyst_exit_select(spark, d):
    """The exit with the best accuracy; at a tie the largest."""
    a = _three_way(spark, d).groupBy("exit").agg(F.avg(F.when(F.col("label") == F.col("decided"), 1.0).otherwise(0.0)).alias("accuracy"))
    best = a.agg(F.max(F.struct(F.round("accuracy", 9).alias("a"), F.col("exit").alias("e"))).alias("m")).select(F.col("m.e").alias("top"))
    return a.crossJoin(F.broadcast(best)).select("exit", F.round("accuracy", 6).alias("accuracy"), (F.col("exit") == F.col("top")).alias("chosen"))


def nm_sql(n: int, m: int) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY recording) < {m} THEN s_human > CAST(0.6 AS DOUBLE) ELSE sum(CAST(s_human > CAST(0.6 AS DOUBLE) AS INT)) OVER (PARTITION BY recording ORDER BY t0_s, pos ROWS {m - 1} PRECEDING) >= {n} END"


@query("n_of_m", sql(EV, f"SELECT event_id, pos, {nm_sql(2, 3)} AS is_on FROM ev"))
def n_of_m(spark, d):
    return S.n_of_m(ev(spark, d), F.col("s_human") > 0.6, 2, 3, KEY, ORDER, "is_on").select("event_id", "pos", "is_on")


@query("n_of_m_sweep", sql(EV, "s AS (" + " UNION ALL ".join(f"SELECT '{n}of{m}' AS spec, label, {nm_sql(n, m)} AS is_on FROM ev" for n, m in ((2, 3), (3, 5), (4, 7))) + ")",
  "SELECT spec, count(*) FILTER (is_on) AS n_on, round(count(*) FILTER (is_on AND label = 'human') / CAST(count(*) FILTER (label = 'human') AS DOUBLE), 6) AS recall FROM s GROUP BY spec"))
def n_of_m_sweep(spark, d):
    """All specifications in one pass: the windows share their partitioning and their sort."""
    specs = [(2, 3), (3, 5), (4, 7)]
    e = S.n_of_m_each(ev(spark, d), F.col("s_human") > 0.6, {f"{n}of{m}": (n, m) for n, m in specs}, KEY, ORDER)
    long = e.select("label", F.expr(f"stack({len(specs)}, " + ", ".join(f"'{n}of{m}', `{n}of{m}`" for n, m in specs) + ") AS (spec, is_on)"))
    c = lambda x: F.sum(F.when(F.expr(x), 1).otherwise(0))
    return long.groupBy("spec").agg(c("is_on").cast("long").alias("n_on"), F.round(F.try_divide(c("is_on AND label = 'human'").cast("double"), c("label = 'human'").cast("double")), 6).alias("recall"))


ISL = """fl AS (SELECT recording, pos, t0_s, s_human > CAST(0.5 AS DOUBLE) AS f, label = 'human' AS truth FROM ev)""", """il AS (SELECT *, pos - row_number() OVER (PARTITION BY recording ORDER BY pos) AS g FROM fl WHERE f)""", """rn AS (SELECT recording, g, count(*) AS n, bool_or(truth) AS hit, min(pos) AS first_pos, max(pos) AS last_pos FROM il GROUP BY recording, g HAVING count(*) >= 2)"""


@query("events_islands", sql(EV, *ISL, """ev2 AS (SELECT recording, bool_or(truth) AS has FROM fl GROUP BY recording)""", """x AS (SELECT recording, has, count(n) FILTER (hit) AS detected, count(n) FILTER (NOT hit) AS false_events FROM ev2 LEFT JOIN rn USING (recording) GROUP BY recording, has)""",
  """SELECT recording, detected, false_events, CAST(CASE WHEN has AND detected = 0 THEN 1 ELSE 0 END AS BIGINT) AS missed FROM x"""))
def events_islands(spark, d):
    return S.events(ev(spark, d), F.col("s_human") > 0.5, F.col("label") == "human", 2, KEY, ["pos"])


@query("events_total_per_hour", sql(EV, *ISL, """SELECT count(*) FILTER (hit) AS detected, count(*) FILTER (NOT hit) AS false_events, round(count(*) FILTER (NOT hit) / ((SELECT max(t0_s) - min(t0_s) FROM ev) / CAST(3600 AS DOUBLE)), 6) AS false_per_hour FROM rn"""))
def events_total_per_hour(spark, d):
    """The rate uses the span of all start times together."""
    e = ev(spark, d)
    total = S.events(e, F.col("s_human") > 0.5, F.col("label") == "human", 2, KEY, ["pos"]).agg(F.sum("detected").alias("detected"), F.sum("false_events").alias("false_events"))
    span = e.agg(((F.max("t0_s") - F.min("t0_s")) / 3600).alias("h"))
    return total.crossJoin(F.broadcast(span)).select("detected", "false_events", F.round(F.try_divide(F.col("false_events").cast("double"), F.col("h")), 6).alias("false_per_hour"))


@query("runs_of_true", sql(EV, "fl AS (SELECT recording, pos, s_vehicle > CAST(0.4 AS DOUBLE) AS f FROM ev)", "il AS (SELECT *, pos - row_number() OVER (PARTITION BY recording ORDER BY pos) AS g FROM fl WHERE f)", "SELECT recording, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM il GROUP BY recording, g HAVING count(*) >= 5"))
def runs_of_true(spark, d):
    return S.runs_of_true(ev(spark, d), F.col("s_vehicle") > 0.4, 5, KEY, ["pos"]).select("recording", F.col("first").alias("first_pos"), F.col("last").alias("last_pos"), "n")


@query("context_k", sql("b AS (SELECT conv_id, turn, row_number() OVER w - 1 AS rn, CASE WHEN lag(turn) OVER w IS NULL OR abs(turn - lag(turn) OVER w - 1) >= CAST(0.001 AS DOUBLE) THEN row_number() OVER w - 1 END AS br FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))",
  "s AS (SELECT *, max(br) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS st FROM b)", "SELECT conv_id, turn, greatest(rn - 2, st) AS c0, greatest(rn - 1, st) AS c1, rn AS c2 FROM s"))
def context_k(spark, d):
    c = S.context(read(spark, d, "conversations").select("conv_id", "turn"), 3, ["conv_id"], "turn", 1.0)
    return c.select("conv_id", "turn", *[F.col("context")[i].alias(f"c{i}") for i in range(3)])


@query("contiguous_folds_purged", sql(EV, "n AS (SELECT recording, pos, count(*) OVER (PARTITION BY recording) AS n FROM ev)", "f AS (SELECT recording, pos, n, k FROM n CROSS JOIN range(0, 5) AS t(k))",
  "SELECT recording, k AS fold, count(*) FILTER (pos >= k * n // 5 AND pos < (k + 1) * n // 5) AS n_test, count(*) FILTER (pos < k * n // 5 - 2 OR pos >= (k + 1) * n // 5 + 2) AS n_train FROM f GROUP BY recording, k"))
def contiguous_folds_purged(spark, d):
    """Five contiguous folds per recording; training leaves out two rows on either side of the test block."""
    f = S.contiguous_folds(ev(spark, d), 5, KEY, ["pos"], purge=2)
    long = f.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    test, near = F.col("fold") == F.col("k"), F.array_contains("purged_for", F.col("k"))
    return long.groupBy("recording", F.col("k").cast("long").alias("fold")).agg(F.sum(test.cast("int")).cast("long").alias("n_test"), F.sum((~test & ~near).cast("int")).cast("long").alias("n_train"))


@query("fold_schemes", sql(EV, "n AS (SELECT recording, pos, count(*) OVER (PARTITION BY recording) AS n FROM ev)", "s AS (SELECT 'contiguous' AS scheme, pos * 5 // n AS fold FROM n UNION ALL SELECT 'seg20', (pos // 20) % 5 FROM n UNION ALL SELECT 'interleaved', pos % 5 FROM n)", "SELECT scheme, fold, count(*) AS n FROM s GROUP BY scheme, fold"))
def fold_schemes(spark, d):
    e = ev(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("recording")))
    long = e.select(F.expr("stack(3, 'contiguous', pos * 5 div n, 'seg20', (pos div 20) % 5, 'interleaved', pos % 5) AS (scheme, fold)"))
    return long.groupBy("scheme", "fold").agg(F.count("*").alias("n"))


BLOCK = "CAST(floor(t0_s / CAST(86400 AS DOUBLE)) AS BIGINT)"


@query("block_keys", sql(EV, f"SELECT recording, {BLOCK} AS block, count(*) AS n, count(*) FILTER (label = 'human') AS n_human FROM ev GROUP BY ALL"))
def block_keys(spark, d):
    return ev(spark, d).groupBy("recording", F.floor(F.col("t0_s") / 86400).cast("long").alias("block")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == "human", 1).otherwise(0)).cast("long").alias("n_human"))


@query("bootstrap_ci_hash", sql(EV, f"b AS (SELECT recording, {BLOCK} AS block, count(*) FILTER (label = 'human') AS den, count(*) FILTER (label = 'human' AND s_human > CAST(0.5 AS DOUBLE)) AS num FROM ev GROUP BY ALL)",
  "i AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY recording) AS m FROM b)",
  "r AS (SELECT rep, i.recording, (rep * 7919 + i.idx * 104729 + i.recording * 1299709 + rep * i.idx * 15485863) % 1000003 % i.m AS pick FROM i CROSS JOIN range(0, 1000) AS t(rep))",
  "v AS (SELECT rep, sum(num) / nullif(CAST(sum(den) AS DOUBLE), 0) AS ratio FROM r JOIN i ON i.recording = r.recording AND i.idx = r.pick GROUP BY rep)",
  "SELECT round(quantile_cont(ratio, CAST(0.025 AS DOUBLE)), 6) AS lo, round(quantile_cont(ratio, CAST(0.5 AS DOUBLE)), 6) AS mid, round(quantile_cont(ratio, CAST(0.975 AS DOUBLE)), 6) AS hi FROM v"))
def bootstrap_ci_hash(spark, d):
    """Block bootstrap of recall within recordings: draws come from arithmetic on ids, so any engine repeats them.

    Windows collapse to one row per block first; tasks add what their recordings draw to 1,000 counters.
    """
    b = ev(spark, d).groupBy("recording", F.floor(F.col("t0_s") / 86400).cast("long").alias("block")).agg(F.sum(F.when(F.col("label") == "human", 1).otherwise(0)).alias("den"), F.sum(F.when(F.expr("label = 'human' AND s_human > 0.5"), 1).otherwise(0)).alias("num"))
    v = block_resamples(b, "recording", "block", ["num", "den"]).select(F.try_divide(F.col("num").cast("double"), F.col("den").cast("double")).alias("ratio"))
    q = v.agg(F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select(*[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("lo", "mid", "hi"))])


@query("gap_jitter_stats", sql(EV, "g AS (SELECT recording, CAST(us - lag(us) OVER (PARTITION BY recording ORDER BY pos) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS dt FROM ev)", "m AS (SELECT recording, quantile_cont(dt, CAST(0.5 AS DOUBLE)) AS med FROM g WHERE dt IS NOT NULL GROUP BY recording)",
  "SELECT recording, round(max(med), 4) AS median_dt, round(stddev_pop(dt), 3) AS std_dt, count(*) FILTER (dt > CAST(1.5 AS DOUBLE) * med) AS n_gaps FROM g JOIN m USING (recording) WHERE dt IS NOT NULL GROUP BY recording"))
def gap_jitter_stats(spark, d):
    g = ev(spark, d).select("recording", ((F.col("us") - F.lag("us").over(S.ordered(KEY, ["pos"]))) / F.lit(1e6)).alias("dt")).filter("dt IS NOT NULL")
    m = g.groupBy("recording").agg(F.percentile("dt", F.lit(0.5)).alias("med"))
    return g.join(m, "recording").groupBy("recording").agg(F.round(F.max("med"), 4).alias("median_dt"), F.round(F.stddev_pop("dt"), 3).alias("std_dt"), F.sum(F.when(F.col("dt") > 1.5 * F.col("med"), 1).otherwise(0)).cast("long").alias("n_gaps"))


@query("sta_lta", sql(EV, "r AS (SELECT recording, avg(s_human) OVER (PARTITION BY recording ORDER BY pos ROWS 2 PRECEDING) / nullif(avg(s_human) OVER (PARTITION BY recording ORDER BY pos ROWS 29 PRECEDING), 0) AS ratio FROM ev)", "SELECT recording, round(max(ratio), 6) AS max_ratio, count(*) FILTER (round(ratio, 9) > CAST(1.5 AS DOUBLE)) AS n_over FROM r GROUP BY recording"))
def sta_lta(spark, d):
    w = S.ordered(KEY, ["pos"])
    r = ev(spark, d).select("recording", F.try_divide(F.avg("s_human").over(w.rowsBetween(-2, 0)), F.avg("s_human").over(w.rowsBetween(-29, 0))).alias("ratio"))
    return r.groupBy("recording").agg(F.round(F.max("ratio"), 6).alias("max_ratio"), F.sum(F.when(F.round("ratio", 9) > 1.5, 1).otherwise(0)).cast("long").alias("n_over"))


@query("daily_resample", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value, round(sum(value), 3) AS sum_value FROM events GROUP BY CAST(ts AS DATE)")
def daily_resample(spark, d):
    return read(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.max("value"), 6).alias("max_value"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.sum("value"), 3).alias("sum_value"))


@query("session_islands", sql(EV, "b AS (SELECT recording, pos, us, CASE WHEN us - lag(us) OVER (PARTITION BY recording ORDER BY pos) < 28800000000 THEN 0 ELSE 1 END AS new FROM ev)", "s AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM b)", "SELECT recording, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY recording, g"))
def session_islands(spark, d):
    """Sessions with gaps under eight hours, by Spark's own session window."""
    e = ev(spark, d).withColumn("at", F.timestamp_micros("us"))
    return e.groupBy("recording", F.session_window("at", "8 hours")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).select("recording", "n", "first_us", "last_us")


@query("sliding_time_windows", sql(EV, "w AS (SELECT label, us // 43200000000 * 43200000000 - k * 43200000000 AS start_us FROM ev CROSS JOIN range(0, 2) AS t(k))", "SELECT label, start_us, count(*) AS n FROM w GROUP BY label, start_us"))
def sliding_time_windows(spark, d):
    """One-day windows that start every twelve hours."""
    e = ev(spark, d).withColumn("at", F.timestamp_micros("us"))
    return e.groupBy("label", F.window("at", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("label", F.unix_micros("w.start").alias("start_us"), "n")


@query("window_id_dense", sql(EV, "SELECT event_id, row_number() OVER (ORDER BY recording, pos) - 1 AS window_id FROM ev"))
def window_id_dense(spark, d):
    """Contiguous ids over all series: row numbers inside a series plus the sizes of the series before it."""
    e = ev(spark, d)
    from ..operators.ordering import sums_before

    size = sums_before(e.groupBy("recording").agg(F.count("*").alias("n")), [], "recording", ["n"])
    return e.join(size.select("recording", "n_before"), "recording").select("event_id", (F.col("n_before") + F.col("pos")).alias("window_id"))


@query("running_ema", sql(EV, "SELECT recording, round(sum(s_human * CAST(0.9 AS DOUBLE) ** (m - pos) * CASE WHEN pos = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END), 6) AS ema FROM (SELECT *, max(pos) OVER (PARTITION BY recording) AS m FROM ev) GROUP BY recording"))
def running_ema(spark, d):
    """Exponential mean with decay 0.9 at the end of each series: a recurrence, composed in cells of a series."""
    e = S.ema(ev(spark, d).select("recording", "pos", "s_human"), F.col("s_human"), 0.9, KEY, ["pos"])
    return e.groupBy("recording").agg(F.round(F.max_by("ema", "pos"), 6).alias("ema"))
