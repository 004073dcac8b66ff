"""Queries on decisions and their metrics, over ``ev``."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators.ordering import exact_quantiles, named_quantiles, ranked
from .registry import query
from .views import EV, EV_LONG, ev, ev_long, sql

HAV = ("human", "animal", "vehicle")
HVA = ("human", "vehicle", "animal")
SCORES = {h: F.col for h in HAV}
QUIET = "label = 'nothing'"


def _scores():
    return {h: F.col(f"s_{h}") for h in HAV}


def _with_taus(spark, d, far=0.1):
    e = ev(spark, d)
    tau = D.threshold_at_far(e, {h: f"s_{h}" for h in HAV}, F.expr(QUIET), far)
    return e.join(F.broadcast(tau))  # one row


def _taus():
    return {h: F.col(f"tau_{h}") for h in HAV}


def _strongest(order=HAV):
    return D.strongest(_scores(), _taus(), order)


TAU = """tau AS (SELECT quantile_cont(s_human, CAST(0.9 AS DOUBLE)) AS tau_human, quantile_cont(s_animal, CAST(0.9 AS DOUBLE)) AS tau_animal,
  quantile_cont(s_vehicle, CAST(0.9 AS DOUBLE)) AS tau_vehicle FROM ev WHERE label = 'nothing')"""
EVT = "evt AS (SELECT * FROM ev CROSS JOIN tau)"
DECIDED = """dec AS (SELECT *, CASE
  WHEN s_human > tau_human AND s_human >= coalesce(CASE WHEN s_animal > tau_animal THEN s_animal END, -1) AND s_human >= coalesce(CASE WHEN s_vehicle > tau_vehicle THEN s_vehicle END, -1) THEN 'human'
  WHEN s_animal > tau_animal AND s_animal >= coalesce(CASE WHEN s_vehicle > tau_vehicle THEN s_vehicle END, -1) THEN 'animal'
  WHEN s_vehicle > tau_vehicle THEN 'vehicle' ELSE 'nothing' END AS decided FROM evt)"""
METRICS = """flags AS (SELECT 'overall' AS cls, TRUE AS t, TRUE AS d, label = decided AS hit FROM dec
  UNION ALL SELECT c, label = c, decided = c, (label = c) = (decided = c) FROM dec CROSS JOIN (VALUES ('human'), ('animal'), ('vehicle'), ('nothing')) AS v(c)
  UNION ALL SELECT 'present', label <> 'nothing', decided <> 'nothing', (label <> 'nothing') = (decided <> 'nothing') FROM dec),
agg AS (SELECT cls, count(*) FILTER (t) AS n, count(*) FILTER (t AND d) AS tp, count(*) FILTER (NOT t AND d) AS fp, count(*) FILTER (t AND NOT d) AS fn, count(*) FILTER (hit) AS ok, count(*) AS a FROM flags GROUP BY cls),
pr AS (SELECT *, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision_ FROM agg)"""


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("threshold_far_quantile", sql(EV, EV_LONG, """SELECT head, round(quantile_cont(score, CAST(0.9 AS DOUBLE)), 6) AS tau_interpolated,
  round(CAST(CAST(quantile_cont(score, CAST(899 AS DOUBLE) / CAST(999 AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS tau_stored, count(*) AS n_quiet
  FROM evl WHERE label = 'nothing' GROUP BY head"""))
def threshold_far_quantile(spark, d):
    """Both threshold rules at a false-alarm rate of 0.1: interpolated, and the nearest of 1,000 stored quantiles."""
    quiet = ev_long(ev(spark, d)).filter(QUIET)
    ranks = ranked(quiet, ["head"], "score")
    direct = named_quantiles(ranks, ["head"], "score", {"tau_interpolated": 0.9}).join(ranks.groupBy("head").agg(F.sum("n").alias("n_quiet")), "head")
    q = D.vector_of(ranks, "score", ["head"])
    stored = q.select("head", D.stored_threshold(F.col("q"), 0.1).cast("double").alias("tau_stored"))
    return _rounded(direct.join(stored, "head"), "tau_interpolated", "tau_stored")


@query("threshold_sweep", sql(EV, """q AS (SELECT quantile_cont(s_human, [CAST(0.99 AS DOUBLE), CAST(0.98 AS DOUBLE), CAST(0.95 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS q FROM ev WHERE label = 'nothing')""",
  """taus AS (SELECT unnest([CAST(0.01 AS DOUBLE), CAST(0.02 AS DOUBLE), CAST(0.05 AS DOUBLE), CAST(0.1 AS DOUBLE)]) AS far, unnest(q) AS tau FROM q)""",
  """SELECT far, round(tau, 6) AS tau, round(count(*) FILTER (label = 'human' AND s_human > tau) / CAST(count(*) FILTER (label = 'human') AS DOUBLE), 6) AS recall,
  round(count(*) FILTER (label = 'human' AND s_human > tau) / nullif(CAST(count(*) FILTER (s_human > tau) AS DOUBLE), 0), 6) AS precision_,
  round(count(*) FILTER (label = 'nothing' AND s_human > tau) / CAST(count(*) FILTER (label = 'nothing') AS DOUBLE), 6) AS realised_far
  FROM ev CROSS JOIN taus GROUP BY far, tau"""))
def threshold_sweep(spark, d):
    """Recall, precision and realised rate of the human head at four false-alarm rates."""
    fars = [0.01, 0.02, 0.05, 0.1]
    e = ev(spark, d)
    pairs = exact_quantiles(e.filter(QUIET), [], "s_human", [1.0 - f for f in fars]).select(F.round(1 - F.col("p"), 9).alias("far"), F.col("q").alias("tau"))
    on = F.col("s_human") > F.col("tau")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    human, quiet = F.col("label") == "human", F.expr(QUIET)
    out = e.crossJoin(F.broadcast(pairs)).groupBy("far", "tau").agg(F.try_divide(n(human & on), n(human)).alias("recall"), F.try_divide(n(human & on), n(on)).alias("precision_"), F.try_divide(n(quiet & on), n(quiet)).alias("realised_far"))
    return _rounded(out, "tau", "recall", "precision_", "realised_far")


@query("decide_strongest", sql(EV, TAU, EVT, DECIDED, "SELECT label, decided, count(*) AS n FROM dec GROUP BY label, decided"))
def decide_strongest(spark, d):
    return D.confusion(_with_taus(spark, d).withColumn("decided", _strongest()), "label", "decided")


@query("decide_margin", sql(EV, TAU, EVT, """m AS (SELECT *, s_human - tau_human AS mh, s_vehicle - tau_vehicle AS mv, s_animal - tau_animal AS ma FROM evt)""",
  """SELECT label, decided, count(*) AS n FROM (SELECT label, CASE WHEN greatest(mh, mv, ma) < 0 THEN 'nothing' WHEN mh >= mv AND mh >= ma THEN 'human' WHEN mv >= ma THEN 'vehicle' ELSE 'animal' END AS decided FROM m) GROUP BY label, decided"""))
def decide_margin(spark, d):
    return D.confusion(_with_taus(spark, d).withColumn("decided", D.largest_margin(_scores(), _taus(), HVA)), "label", "decided")


@query("decide_paired", sql(EV, TAU, EVT, """SELECT label, decided, count(*) AS n FROM (SELECT label, CASE WHEN s_human > tau_human AND s_vehicle > tau_vehicle THEN CASE WHEN s_human >= s_vehicle THEN 'human' ELSE 'vehicle' END
  WHEN s_human > tau_human THEN 'human' WHEN s_vehicle > tau_vehicle THEN 'vehicle' ELSE 'nothing' END AS decided FROM evt) GROUP BY label, decided"""))
def decide_paired(spark, d):
    s, t = _scores(), _taus()
    rule = D.paired(s["human"] > t["human"], s["vehicle"] > t["vehicle"], s["human"], s["vehicle"], "human", "vehicle")
    return D.confusion(_with_taus(spark, d).withColumn("decided", rule), "label", "decided")


@query("decide_half_argmax", sql(EV, """SELECT label, decided, count(*) AS n FROM (SELECT label, CASE WHEN greatest(s_human, s_vehicle) > CAST(0.5 AS DOUBLE) THEN CASE WHEN s_human > s_vehicle THEN 'human' ELSE 'vehicle' END ELSE 'nothing' END AS decided FROM ev) GROUP BY label, decided"""))
def decide_half_argmax(spark, d):
    s = _scores()
    return D.confusion(ev(spark, d).withColumn("decided", D.half_argmax(s["human"], s["vehicle"], "human", "vehicle")), "label", "decided")


@query("decide_masked", sql(EV, TAU, EVT, """SELECT label, decided, count(*) AS n FROM (SELECT label, CASE WHEN s_human > tau_human AND (s_vehicle <= tau_vehicle OR s_human >= s_vehicle) THEN 'human' WHEN s_vehicle > tau_vehicle THEN 'vehicle' ELSE 'nothing' END AS decided FROM evt) GROUP BY label, decided"""))
def decide_masked(spark, d):
    """The animal head is left out before the decision."""
    return D.confusion(_with_taus(spark, d).withColumn("decided", _strongest(("human", "vehicle"))), "label", "decided")


@query("class_metrics", sql(EV, TAU, EVT, DECIDED, METRICS, """SELECT cls, CAST(n AS BIGINT) AS n, CASE WHEN cls <> 'overall' THEN tp END AS tp, CASE WHEN cls <> 'overall' THEN fp END AS fp, CASE WHEN cls <> 'overall' THEN fn END AS fn,
  round(ok / CAST(a AS DOUBLE), 6) AS accuracy, CASE WHEN cls <> 'overall' THEN round(recall, 6) END AS recall, CASE WHEN cls <> 'overall' THEN round(precision_, 6) END AS precision_,
  CASE WHEN cls <> 'overall' AND recall > 0 AND precision_ > 0 THEN round(2 * precision_ * recall / (precision_ + recall), 6) END AS f1 FROM pr"""))
def class_metrics(spark, d):
    """The flagship: thresholds at a false-alarm rate of 0.1, strongest-head decisions, metrics of every class."""
    df = _with_taus(spark, d).withColumn("decided", _strongest())
    return _rounded(D.class_metrics(df, "label", "decided", list(HAV)), "accuracy", "recall", "precision_", "f1")


@query("confusion_matrix", sql(EV, TAU, EVT, DECIDED, """SELECT label, count(*) FILTER (decided = 'human') AS human, count(*) FILTER (decided = 'animal') AS animal, count(*) FILTER (decided = 'vehicle') AS vehicle, count(*) FILTER (decided = 'nothing') AS nothing FROM dec GROUP BY label"""))
def confusion_matrix(spark, d):
    df = _with_taus(spark, d).withColumn("decided", _strongest())
    names = [*HAV, "nothing"]
    return df.groupBy("label").pivot("decided", names).agg(F.count(F.lit(1))).select("label", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in names])


@query("balanced_accuracy_grid", sql(EV, """g AS (SELECT CAST(i AS DOUBLE) / CAST(20 AS DOUBLE) AS thr FROM range(1, 20) AS t(i))""",
  """r AS (SELECT thr, label = 'human' AS y, avg(CASE WHEN (s_human > thr) = (label = 'human') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS r FROM ev CROSS JOIN g WHERE label IN ('human', 'nothing') GROUP BY ALL)""",
  """SELECT thr, round(balanced_accuracy, 6) AS balanced_accuracy, row_number() OVER (ORDER BY round(balanced_accuracy, 9) DESC, thr) = 1 AS is_best FROM (SELECT thr, avg(r) AS balanced_accuracy FROM r GROUP BY thr)"""))
def balanced_accuracy_grid(spark, d):
    """Balanced accuracy of human against nothing on 19 thresholds; the best one, the lowest at a tie, is marked."""
    thresholds = [i / 20 for i in range(1, 20)]
    e = ev(spark, d).filter("label IN ('human', 'nothing')")
    # counts per number of thresholds passed say all that the grid needs
    g = e.groupBy((F.col("label") == "human").alias("y"), D.passed(F.col("s_human"), thresholds).alias("k")).agg(F.count("*").alias("n"))
    g = g.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("thr")) for i, t in enumerate(thresholds)])))
    right = F.when((F.col("k") > F.col("t.i")) == F.col("y"), F.col("n")).otherwise(0)
    r = g.groupBy(F.col("t.thr").alias("thr"), "y").agg((F.sum(right) / F.sum("n")).alias("r"))
    b = r.groupBy("thr").agg(F.avg("r").alias("balanced_accuracy"))
    best = b.agg(F.max(F.struct(F.round("balanced_accuracy", 9), -F.col("thr"))).alias("m")).select((-F.col("m.col2")).alias("top"))
    return b.crossJoin(F.broadcast(best)).select("thr", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), (F.col("thr") == F.col("top")).alias("is_best"))


@query("oracle_threshold_grid", sql(EV, """q AS (SELECT quantile_cont(s_human, [CAST(i AS DOUBLE) / CAST(9 AS DOUBLE) FOR i IN range(0, 10)]) AS qh, quantile_cont(s_vehicle, [CAST(i AS DOUBLE) / CAST(9 AS DOUBLE) FOR i IN range(0, 10)]) AS qv FROM ev)""",
  """a AS (SELECT i, j, round(avg(CASE WHEN label = CASE WHEN s_human > qh[i] AND s_vehicle > qv[j] THEN CASE WHEN s_human >= s_vehicle THEN 'human' ELSE 'vehicle' END WHEN s_human > qh[i] THEN 'human' WHEN s_vehicle > qv[j] THEN 'vehicle' ELSE 'nothing' END THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS accuracy
  FROM ev CROSS JOIN q CROSS JOIN range(1, 11) AS a(i) CROSS JOIN range(1, 11) AS b(j) WHERE label <> 'animal' GROUP BY i, j)""",
  "SELECT i, j, accuracy FROM a ORDER BY accuracy DESC, i, j LIMIT 10"))
def oracle_threshold_grid(spark, d):
    """Accuracy of the paired rule on a grid of quantile pairs; the ten best pairs."""
    e = ev(spark, d)
    edges = D.head_edges(e, {"qh": "s_human", "qv": "s_vehicle"}, 10)
    t = e.filter("label <> 'animal'").crossJoin(F.broadcast(edges))
    below = lambda q, s: F.size(F.filter(q, lambda x: x < F.col(s)))
    # each row counts once, by the thresholds it passes; the grid is laid over these few hundred counts
    g = t.groupBy(below("qh", "s_human").alias("a"), below("qv", "s_vehicle").alias("b"), (F.col("s_human") >= F.col("s_vehicle")).alias("hv"), "label").agg(F.count("*").alias("n"))
    one_to_ten = F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))
    g = g.withColumn("i", F.explode(one_to_ten)).withColumn("j", F.explode(one_to_ten))
    rule = D.paired(F.col("a") >= F.col("i"), F.col("b") >= F.col("j"), F.col("hv").cast("int"), F.lit(1), "human", "vehicle")
    a = g.groupBy("i", "j").agg(F.round(F.sum(F.when(F.col("label") == rule, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))
    return a.orderBy(F.desc("accuracy"), "i", "j").limit(10)


@query("head_rates_rollup", sql(EV, TAU, EVT, """SELECT coalesce(label, 'ALL') AS label, count(*) AS n, round(avg(CAST(CAST(s_human > tau_human AS INT) AS DOUBLE)), 6) AS human_on, round(avg(CAST(CAST(s_vehicle > tau_vehicle AS INT) AS DOUBLE)), 6) AS vehicle_on,
  round(avg(CAST(CAST(s_human > tau_human AND s_vehicle <= tau_vehicle AS INT) AS DOUBLE)), 6) AS human_only, round(avg(CAST(CAST(s_human > tau_human AND s_vehicle > tau_vehicle AS INT) AS DOUBLE)), 6) AS both_on
  FROM evt GROUP BY ROLLUP (label)"""))
def head_rates_rollup(spark, d):
    """How often heads are on, per label and over all: one grouping set instead of a loop over subsets."""
    h, v = F.expr("s_human > tau_human"), F.expr("s_vehicle > tau_vehicle")
    rate = lambda c, name: F.round(F.avg(c.cast("int").cast("double")), 6).alias(name)
    g = _with_taus(spark, d).rollup("label").agg(F.grouping("label").alias("g"), F.count("*").alias("n"), rate(h, "human_on"), rate(v, "vehicle_on"), rate(h & ~v, "human_only"), rate(h & v, "both_on"))
    return g.withColumn("label", F.when(F.col("g") == 1, "ALL").otherwise(F.col("label"))).drop("g")


@query("error_taxonomy", sql(EV, TAU, EVT, DECIDED, """SELECT recording, count(*) AS n, count(*) FILTER (label <> 'nothing' AND decided = 'nothing') AS missed, count(*) FILTER (label = 'nothing' AND decided <> 'nothing') AS false_alarm,
  count(*) FILTER (label <> 'nothing' AND decided <> 'nothing' AND label <> decided) AS confused, round(avg(CASE WHEN label <> decided THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS error_rate FROM dec GROUP BY recording"""))
def error_taxonomy(spark, d):
    df = _with_taus(spark, d).withColumn("decided", _strongest())
    n = lambda e: F.sum(F.when(F.expr(e), 1).otherwise(0)).cast("long")
    return df.groupBy("recording").agg(F.count("*").alias("n"), n("label <> 'nothing' AND decided = 'nothing'").alias("missed"), n("label = 'nothing' AND decided <> 'nothing'").alias("false_alarm"), n("label <> 'nothing' AND decided <> 'nothing' AND label <> decided").alias("confused"), F.round(F.avg(F.when(F.expr("label <> decided"), 1.0).otherwise(0.0)), 6).alias("error_rate"))


@query("far_per_hour", sql(EV, TAU, EVT, DECIDED, """SELECT decided AS head, count(*) AS false_alarms, round(count(*) / (max(a.n) * CAST(1.5 AS DOUBLE) / CAST(3600 AS DOUBLE)), 6) AS per_hour
  FROM dec CROSS JOIN (SELECT count(*) AS n FROM ev WHERE label = 'nothing') AS a WHERE label = 'nothing' AND decided <> 'nothing' GROUP BY decided"""))
def far_per_hour(spark, d):
    """False alarms of each head per hour of quiet windows, at 1.5 s a window."""
    quiet = _with_taus(spark, d).withColumn("decided", _strongest()).filter(QUIET)
    hours = quiet.agg((F.count("*") * 1.5 / 3600).alias("hours"))
    g = quiet.filter("decided <> 'nothing'").groupBy(F.col("decided").alias("head")).agg(F.count("*").alias("false_alarms"))
    return g.crossJoin(F.broadcast(hours)).select("head", "false_alarms", F.round(F.try_divide(F.col("false_alarms").cast("double"), F.col("hours")), 6).alias("per_hour"))


@query("leaderboard_pivot", sql(EV, EV_LONG, """m AS (SELECT head, label, avg(score) AS a, count(*) AS n FROM evl GROUP BY head, label)""",
  """SELECT head, round(max(a) FILTER (label = 'human'), 6) AS human, round(max(a) FILTER (label = 'animal'), 6) AS animal, round(max(a) FILTER (label = 'vehicle'), 6) AS vehicle, round(max(a) FILTER (label = 'nothing'), 6) AS nothing,
  string_agg(label, ',' ORDER BY label) FILTER (n >= 1900) AS flags FROM m GROUP BY head"""))
def leaderboard_pivot(spark, d):
    """Metric rows to columns with flags joined to a list: one conditional aggregate in place of a lookup per cell."""
    m = ev_long(ev(spark, d)).groupBy("head", "label").agg(F.avg("score").alias("a"), F.count("*").alias("n"))
    cells = [F.round(F.max(F.when(F.col("label") == c, F.col("a"))), 6).alias(c) for c in (*HAV, "nothing")]
    return m.groupBy("head").agg(*cells, F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") >= 1900, F.col("label")))), ",").alias("flags")).withColumn("flags", F.when(F.col("flags") != "", F.col("flags")))


@query("head_class_metrics_long", sql(EV, EV_LONG, TAU, """t AS (SELECT 'human' AS head, tau_human AS tau FROM tau UNION ALL SELECT 'animal', tau_animal FROM tau UNION ALL SELECT 'vehicle', tau_vehicle FROM tau)""",
  """SELECT head, count(*) FILTER (label = head AND score > tau) AS tp, count(*) FILTER (label <> head AND score > tau) AS fp, count(*) FILTER (label = head AND score <= tau) AS fn FROM evl JOIN t USING (head) GROUP BY head"""))
def head_class_metrics_long(spark, d):
    """Each head as a detector of its own class, on the long view with a broadcast threshold table."""
    long = ev_long(ev(spark, d))
    tau = exact_quantiles(long.filter(QUIET), ["head"], "score", [0.9]).select("head", F.col("q").alias("tau"))
    n = lambda e: F.sum(F.when(F.expr(e), 1).otherwise(0)).cast("long")
    return long.join(F.broadcast(tau), "head").groupBy("head").agg(n("label = head AND score > tau").alias("tp"), n("label <> head AND score > tau").alias("fp"), n("label = head AND score <= tau").alias("fn"))
