"""Full grids, cohort filters, tests of rank, four-way outputs, overlap and positional joins, chunks, learners."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import audit as A
from ..operators import decisions as D
from ..operators import joins as J
from ..operators import series as S
from ..operators.auroc import mann_whitney_greater
from ..operators.resampling import block_resamples
from ..sources.scratch import staged
from .registry import query
from .views import EV, LW, SG, ev, lw, sg, sql

ENTRIES = (0.001, 0.002, 0.005, 0.01)
EXITS = tuple(i / 10 for i in range(10, -1, -1))
VARIANTS = {"full": ("human", "animal", "vehicle"), "masked": ("human", "vehicle")}

_TAUS = "tx AS (" + " UNION ALL ".join(f"SELECT {k} AS k, " + ", ".join(f"quantile_cont(s_{h}, CAST({1 - f!r} AS DOUBLE)) AS t_{h}" for h in VARIANTS["full"]) + " FROM ev WHERE label = 'nothing'" for k, f in enumerate(ENTRIES)) + ")"
_EVX = "evx AS (SELECT ev.*, tx.*, fr, CAST(fr AS DOUBLE) / CAST(10 AS DOUBLE) AS frac FROM ev CROSS JOIN tx CROSS JOIN range(0, 11) AS f(fr))"
_ON = "onx AS (SELECT label, event_id, k, fr, s_human, s_animal, s_vehicle, " + ", ".join(f"coalesce(max(CASE WHEN s_{h} > t_{h} THEN pos END) OVER w > coalesce(max(CASE WHEN NOT (s_{h} > t_{h} * frac) THEN pos END) OVER w, -1), FALSE) AS on_{h}" for h in VARIANTS["full"]) + " FROM evx WINDOW w AS (PARTITION BY k, fr, recording ORDER BY t0_s, pos ROWS UNBOUNDED PRECEDING))"
_DEC = """dx AS (SELECT k, fr, variant, label, event_id,
  CASE WHEN on_human AND s_human >= CASE WHEN on_animal AND variant = 'full' THEN s_animal ELSE -1 END AND s_human >= CASE WHEN on_vehicle THEN s_vehicle ELSE -1 END THEN 'human'
    WHEN on_animal AND variant = 'full' AND s_animal >= CASE WHEN on_vehicle THEN s_vehicle ELSE -1 END THEN 'animal' WHEN on_vehicle THEN 'vehicle' ELSE 'nothing' END AS decided
  FROM onx CROSS JOIN (VALUES ('full'), ('masked')) AS v(variant))"""
_SUB = "sx AS (SELECT *, 'all' AS subset FROM dx UNION ALL SELECT *, 'cleaned' FROM dx WHERE event_id % 5 <> 0)"


def _share(a: str, b: str, name: str, least: bool = False) -> str:
    return f"round(count(*) FILTER ({a}) / " + (f"greatest(CAST(count(*) FILTER ({b}) AS DOUBLE), 1)" if least else f"nullif(CAST(count(*) FILTER ({b}) AS DOUBLE), 0)") + f", 6) AS {name}"


_METRICS = ", ".join([
    "round(count(*) FILTER (decided = label) / CAST(count(*) AS DOUBLE), 6) AS accuracy",
    _share("decided = 'human' AND label = 'human'", "label = 'human'", "human_recall", True), _share("decided = 'human' AND label = 'human'", "decided = 'human'", "human_precision"),
    _share("decided = 'vehicle' AND label = 'vehicle'", "label = 'vehicle'", "vehicle_recall", True), _share("decided = 'vehicle' AND label = 'vehicle'", "decided = 'vehicle'", "vehicle_precision"),
    _share("decided = 'nothing' AND label = 'nothing'", "label = 'nothing'", "nothing_recall", True),
    "round(count(*) FILTER ((decided <> 'nothing') = (label <> 'nothing')) / CAST(count(*) AS DOUBLE), 6) AS present_accuracy",
    _share("decided <> 'nothing' AND label <> 'nothing'", "label <> 'nothing'", "present_recall"), _share("decided <> 'nothing' AND label <> 'nothing'", "decided <> 'nothing'", "present_precision")])


@query("hysteresis_3way_grid", sql(EV, _TAUS, _EVX, _ON, _DEC, _SUB, f"SELECT variant, subset, CAST(k AS INT) AS entry, CAST(fr AS INT) AS exit_tenths, {_METRICS} FROM sx GROUP BY variant, subset, k, fr"))
def hysteresis_3way_grid(spark, d):
    """Independent heads over four entries, eleven exits, with and without the animal head, on all and on cleaned windows.

    Of a row and an entry, how many exits each head holds and how the scores compare decide at all exits: rows are
    counted by these, and only the counts are laid over exits and variants. The thresholds, 12 numbers, are literals.
    """
    e = ev(spark, d)
    heads = VARIANTS["full"]
    quiet = e.filter("label = 'nothing'")
    taus = D.head_edges(quiet, {h: f"s_{h}" for h in heads}, [1 - f for f in ENTRIES]).first()
    tau = {(h, k): taus[h] and taus[h][len(ENTRIES) - 1 - k] for h in heads for k in range(len(ENTRIES))}
    number = lambda x: F.lit(x).cast("double")
    turns = {f"{h}_{k}": (F.col(f"s_{h}"), number(t), [number(t) * F.lit(x) for x in EXITS]) for (h, k), t in tau.items()}
    t = S.exits_held(e.select("label", "event_id", "recording", "t0_s", "pos", *[f"s_{h}" for h in heads]), turns, ["recording"], ["t0_s", "pos"])
    # of a negative threshold the largest share is the lowest exit: what it holds counts from there, and is told by its sign
    held = lambda h, k: (F.col(f"{h}_{k}") if (tau[h, k] or 0) >= 0 else -F.col(f"{h}_{k}")).alias(h)
    none = F.lit(-1)
    over = {"human_animal": F.col("s_human") >= F.col("s_animal"), "human_vehicle": F.col("s_human") >= F.col("s_vehicle"), "animal_vehicle": F.col("s_animal") >= F.col("s_vehicle"), "human_none": F.col("s_human") >= none, "animal_none": F.col("s_animal") >= none}
    t = t.select("label", F.coalesce(F.col("event_id") % 5 != 0, F.lit(False)).alias("clean"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in over.items()],
                 F.inline(F.array(*[F.struct(F.lit(k).alias("entry"), *[held(h, k) for h in heads]) for k in range(len(ENTRIES))])))
    t = t.groupBy(*t.columns).agg(F.count("*").alias("n"))
    t = D.grid(D.grid(t, "variant", list(VARIANTS)), "exit_tenths", list(range(11)))
    on = {h: F.when(F.col(h) >= 0, F.col("exit_tenths") < F.col(h)).otherwise(F.col("exit_tenths") >= 11 + F.col(h)) for h in heads}
    on["animal"] = on["animal"] & (F.col("variant") == "full")
    beats = lambda a, b: F.when(on[b], F.col(f"{a}_{b}")).otherwise(F.col(f"{a}_none"))
    decided = F.when(on["human"] & beats("human", "animal") & beats("human", "vehicle"), "human").when(on["animal"] & beats("animal", "vehicle"), "animal").when(on["vehicle"], "vehicle").otherwise("nothing")
    t = t.withColumn("decided", decided)
    n = t.groupBy("variant", "entry", "exit_tenths", "label", "decided").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("clean"), F.col("n")).otherwise(0)).alias("cleaned"))
    n = n.unpivot(["variant", "entry", "exit_tenths", "label", "decided"], ["all", "cleaned"], "subset", "n")
    count = lambda cond: F.sum(F.when(F.expr(cond), F.col("n")).otherwise(0)).cast("double")

    def share(a, b, least=False):
        return F.round(F.try_divide(count(a), F.greatest(count(b), F.lit(1.0)) if least else F.nullif(count(b), F.lit(0.0))), 6)

    metrics = [share("decided = label", "true").alias("accuracy")]
    for h in ("human", "vehicle"):
        metrics += [share(f"decided = '{h}' AND label = '{h}'", f"label = '{h}'", True).alias(f"{h}_recall"), share(f"decided = '{h}' AND label = '{h}'", f"decided = '{h}'").alias(f"{h}_precision")]
    metrics += [share("decided = 'nothing' AND label = 'nothing'", "label = 'nothing'", True).alias("nothing_recall"), share("(decided <> 'nothing') = (label <> 'nothing')", "true").alias("present_accuracy")]
    metrics += [share("decided <> 'nothing' AND label <> 'nothing'", f"{side} <> 'nothing'").alias(name) for side, name in (("label", "present_recall"), ("decided", "present_precision"))]
    return n.groupBy("variant", "subset", "entry", "exit_tenths").agg(*metrics)


_Q40 = "[CAST(0.3 AS DOUBLE) + CAST(0.695 AS DOUBLE) * CAST(i AS DOUBLE) / CAST(39 AS DOUBLE) FOR i IN range(0, 40)]"


@query("oracle_grid_40", sql(EV, f"q AS (SELECT quantile_cont(s_human, {_Q40}) AS qh, quantile_cont(s_vehicle, {_Q40}) AS qv FROM ev)",
  "g AS (SELECT label, s_human AS ph, s_vehicle AS pv, i - 1 AS i, j - 1 AS j, qh[i] AS th, qv[j] AS tv FROM ev CROSS JOIN q CROSS JOIN range(1, 41) AS a(i) CROSS JOIN range(1, 41) AS b(j) WHERE label <> 'animal')",
  "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, count(*) FILTER (label = CASE WHEN ph < th AND pv < tv THEN 'nothing' WHEN ph - th >= pv - tv THEN 'human' ELSE 'vehicle' END) AS n_right FROM g GROUP BY i, j"))
def oracle_grid_40(spark, d):
    """Right decisions of the larger margin on a grid of 40 x 40 pairs of quantile thresholds.

    For one human threshold the vehicle thresholds that make a row's decision right are one range, as the margins
    grow with them: a row counts at the range's two ends, and running sums give the grid.
    """
    e = ev(spark, d)
    shares = [0.3 + 0.695 * i / 39 for i in range(40)]
    edges = D.head_edges(e, {"qh": "s_human", "qv": "s_vehicle"}, shares)
    t = e.filter("label <> 'animal'").select("label", "s_human", "s_vehicle").crossJoin(F.broadcast(edges))
    t = t.select("label", "s_human", "s_vehicle", "qv", F.posexplode("qh").alias("i", "th"))
    steps = F.array(*[F.lit(1 << b) for b in (5, 4, 3, 2, 1, 0)])

    def first(holds):
        """How many of the rising vehicle thresholds come before the first for which ``holds``."""
        return F.aggregate(steps, F.lit(0), lambda acc, s: F.when((acc + s <= 40) & ~holds(F.get("qv", acc + s - 1)), acc + s).otherwise(acc))

    human_from = first(lambda tv: F.coalesce(F.col("s_human") - F.col("th") >= F.col("s_vehicle") - tv, F.lit(True)))
    quiet_from = F.when(F.col("s_human") < F.col("th"), first(lambda tv: F.coalesce(F.col("s_vehicle") < tv, F.lit(True)))).otherwise(F.lit(40))
    t = t.withColumns({"h": human_from, "z": quiet_from})
    lo = F.when(F.col("label") == "nothing", F.col("z")).when(F.col("label") == "human", F.col("h")).otherwise(F.lit(0))
    hi = F.when(F.col("label") == "nothing", F.lit(40)).when(F.col("label") == "human", F.col("z")).otherwise(F.least("h", "z"))
    ends = t.select("i", lo.alias("lo"), hi.alias("hi")).filter("lo < hi").select("i", F.inline(F.array(F.struct(F.col("lo").alias("j"), F.lit(1).alias("by")), F.struct(F.col("hi").alias("j"), F.lit(-1).alias("by")))))
    at = ends.groupBy("i", "j").agg(F.sum("by").alias("by"))
    every = spark.range(1600).select((F.col("id") / 40).cast("int").alias("i"), (F.col("id") % 40).cast("int").alias("j"))
    w = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(at, ["i", "j"], "left").select("i", "j", F.coalesce(F.sum("by").over(w), F.lit(0)).cast("long").alias("n_right"))


BLOCKS = "CAST(floor(t0_s / CAST(86400 AS DOUBLE)) AS BIGINT)"


@query("bootstrap_ci_1000", sql(EV, f"b AS (SELECT recording, {BLOCKS} AS block, count(*) AS den, count(*) FILTER ((label = 'human') = (s_human > CAST(0.5 AS DOUBLE))) AS num FROM ev GROUP BY ALL)",
  "i AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY recording) AS m FROM b)",
  "r AS (SELECT rep, i.recording, (rep * 7919 + i.idx * 104729 + i.recording * 1299709 + rep * i.idx * 15485863) % 1000003 % i.m AS pick FROM i CROSS JOIN range(0, 1000) AS t(rep))",
  "v AS (SELECT rep, sum(num) / CAST(sum(den) AS DOUBLE) AS ratio FROM r JOIN i ON i.recording = r.recording AND i.idx = r.pick GROUP BY rep)",
  "SELECT round(quantile_cont(ratio, CAST(0.025 AS DOUBLE)), 6) AS lo, round(quantile_cont(ratio, CAST(0.975 AS DOUBLE)), 6) AS hi, count(*) AS replicates FROM v"))
def bootstrap_ci_1000(spark, d):
    """Accuracy with the bounds of 1,000 block resamples inside recordings; draws come from arithmetic on ids."""
    block = F.floor(F.col("t0_s") / 86400).cast("long")
    right = (F.col("label") == "human") == (F.col("s_human") > 0.5)
    b = ev(spark, d).groupBy("recording", block.alias("block")).agg(F.count("*").alias("den"), F.sum(F.when(right, 1).otherwise(0)).alias("num"))
    v = block_resamples(b, "recording", "block", ["num", "den"]).select((F.col("num") / F.col("den").cast("double")).alias("ratio"))
    q = v.agg(F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("*").alias("replicates"))
    return q.select(F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"), "replicates")


_TAIL = """CASE WHEN abs(z) < 2.5 THEN CAST(0.5 AS DOUBLE) - exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(pow(abs(z), 2 * k + 1) / exp(lgamma(2 * k + 2) - lgamma(k + 1) - k * ln(CAST(2 AS DOUBLE)))) FROM range(0, 80) AS t(k))
  ELSE exp(-z * z / 2) / sqrt(2 * pi()) / list_reduce(list_concat([abs(z)], [CAST(121 - k AS DOUBLE) FOR k IN range(1, 121)]), lambda acc, k: abs(z) + k / acc) END"""


@query("mann_whitney_one_sided", sql(EV, "s AS (SELECT recording % 7 AS site, label = 'human' AS y, CASE WHEN label = 'human' THEN round(s_human * 20) + recording % 7 ELSE round(s_human * 20) + 1 END AS v FROM ev WHERE label IN ('human', 'nothing'))",
  "r AS (SELECT site, y, v, rank() OVER (PARTITION BY site ORDER BY v) + (count(*) OVER (PARTITION BY site, v) - 1) / CAST(2 AS DOUBLE) AS r FROM s)", "t AS (SELECT site, sum(c * c * c - c) AS ties FROM (SELECT site, v, CAST(count(*) AS DOUBLE) AS c FROM s GROUP BY site, v) GROUP BY site)",
  "u AS (SELECT site, sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / CAST(2 AS DOUBLE) AS u, CAST(count(*) FILTER (y) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT y) AS DOUBLE) AS n0 FROM r GROUP BY site)",
  "z AS (SELECT site, u, (u - n1 * n0 / 2 - CAST(0.5 AS DOUBLE)) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM u JOIN t USING (site))",
  f"p AS (SELECT site, u, z, {_TAIL} AS tail FROM z)", "SELECT site, round(u, 1) AS u, round(z, 6) AS z, round(CASE WHEN z >= 0 THEN tail ELSE 1 - tail END, 9) AS p FROM p"))
def mann_whitney_one_sided(spark, d):
    """Whether persons score higher than background, by site, with many ties."""
    e = ev(spark, d).filter("label IN ('human', 'nothing')").withColumn("site", F.col("recording") % 7)
    e = e.withColumn("v", F.round(F.col("s_human") * 20) + F.when(F.col("label") == "human", F.col("site")).otherwise(1))
    t = mann_whitney_greater(e, "v", F.col("label") == "human", ["site"])
    return t.select("site", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"), F.round("p", 9).alias("p"))


_L = "[CAST(0.5 AS DOUBLE), 4 * s_human - 2, 3 * s_vehicle - 1, 2 * s_animal - 1]"


@query("fourway_heads", sql(EV, f"l AS (SELECT event_id, [exp(x) FOR x IN {_L}] AS e FROM ev)", "SELECT event_id, round(e[2] / list_sum(e), 6) AS human, round(e[3] / list_sum(e), 6) AS vehicle, round(e[4] / list_sum(e), 6) AS animal FROM l"))
def fourway_heads(spark, d):
    """Presences out of one exclusive output of four classes."""
    logits = F.array(F.lit(0.5), 4 * F.col("s_human") - 2, 3 * F.col("s_vehicle") - 1, 2 * F.col("s_animal") - 1)
    return ev(spark, d).select("event_id", *[F.round(c, 6).alias(n) for n, c in D.fourway_heads(logits).items()])


_COHORT = "c AS (SELECT scene_id, label, CASE WHEN label % 4 = 0 THEN 'nothing' WHEN label % 4 = 1 THEN 'human' WHEN label % 4 = 2 THEN 'vehicle' ELSE 'animal' END AS coarse, split FROM sg)"


@query("train_cohorts", sql(SG, _COHORT, "h AS (SELECT * FROM (VALUES ('3head', ''), ('2head_noanimal', 'animal'), ('1head_human', 'animal'), ('1head_human_noveh', 'animal vehicle')) AS v(heads, gone))",
  "SELECT heads, coarse, count(*) AS n FROM c CROSS JOIN h WHERE split = 'train' AND NOT contains(gone, coarse) GROUP BY heads, coarse"))
def train_cohorts(spark, d):
    """What each choice of heads is trained on."""
    c = sg(spark, d).withColumn("coarse", F.element_at(F.array(*map(F.lit, ("nothing", "human", "vehicle", "animal"))), F.col("label").cast("int") % 4 + 1))
    out = None
    for heads in ("3head", "2head_noanimal", "1head_human", "1head_human_noveh"):
        part = A.train_cohort(c, heads).select(F.lit(heads).alias("heads"), "coarse")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("heads", "coarse").agg(F.count("*").alias("n"))


_OCC = "o AS (SELECT *, CASE WHEN coarse = 'R' THEN 'nothing' ELSE 'human' END AS kind_of, CASE WHEN level = 0 THEN 'calm' WHEN level = 1 THEN 'machinery' ELSE 'wind' END AS kind, occ - CAST(0.02 AS DOUBLE) AS occ_a, gain - CAST(0.03 AS DOUBLE) AS occ_b FROM lw)"


@query("zero_signal_windows", sql(LW, _OCC, "SELECT split, kind_of, kind, count(*) AS n FROM o WHERE occ_a <= 0 AND occ_b <= 0 AND NOT (kind_of = 'nothing' AND kind = 'machinery') GROUP BY split, kind_of, kind"))
def zero_signal_windows(spark, d):
    """Windows without activity of any class, confusers left out."""
    t = lw(spark, d).withColumns({"kind_of": F.when(F.col("coarse") == "R", "nothing").otherwise("human"), "kind": F.element_at(F.array(*map(F.lit, ("calm", "machinery", "wind"))), F.col("level") + 1), "occ_a": F.col("occ").cast("double") - 0.02, "occ_b": F.col("gain").cast("double") - 0.03})
    return A.zero_signal(t, ["occ_a", "occ_b"], "kind_of", "kind").groupBy("split", "kind_of", "kind").agg(F.count("*").alias("n"))


_LEVELS = "m AS (SELECT split, CASE coarse WHEN 'A' THEN 'human' WHEN 'N' THEN 'vehicle' ELSE 'nothing' END AS cls, CASE WHEN coarse = 'A' THEN level ELSE 0 END AS h, CASE WHEN coarse = 'N' THEN level WHEN occ > CAST(0.08 AS DOUBLE) THEN 1 ELSE 0 END AS v, CASE WHEN gain > CAST(0.07 AS DOUBLE) THEN 1 ELSE 0 END AS a, snr FROM lw)"
_MASK = ["h > 0 AS human", "v > 0 AS vehicle", "a > 0 AS animal", "h > 0 AND v = 0 AND a = 0 AS human_only", "v > 0 AND h = 0 AND a = 0 AS vehicle_only", "a > 0 AND h = 0 AND v = 0 AS animal_only",
  "cls = 'human' AND snr >= -20 AND snr < 0 AND h = 0 AS human_faint", "cls = 'vehicle' AND snr >= -20 AND snr < 0 AND v = 0 AS vehicle_faint", "FALSE AS animal_faint", "h = 0 AND v = 0 AND a = 0 AS nothing", "cls = 'nothing' AS noise"]


@query("class_masks", sql(LW, _LEVELS, f"b AS (SELECT split, {', '.join(_MASK)}, CAST(h > 0 AS INT) + CAST(v > 0 AS INT) + CAST(a > 0 AS INT) AS n_active FROM m)",
  "SELECT split, " + ", ".join(f"count(*) FILTER ({x.rsplit(' AS ', 1)[1]}) AS {x.rsplit(' AS ', 1)[1]}" for x in _MASK) + ", CAST(sum(n_active) AS BIGINT) AS n_active FROM b GROUP BY split"))
def class_masks(spark, d):
    """Detectable, exclusive, faint and quiet windows."""
    t = lw(spark, d)
    cls = F.when(F.col("coarse") == "A", "human").when(F.col("coarse") == "N", "vehicle").otherwise("nothing")
    level = {"human": F.when(F.col("coarse") == "A", F.col("level")).otherwise(0), "vehicle": F.when(F.col("coarse") == "N", F.col("level")).when(F.col("occ") > 0.08, 1).otherwise(0), "animal": F.when(F.col("gain") > 0.07, 1).otherwise(0)}
    masks = A.class_masks(level, dict.fromkeys(level, F.col("snr")), cls)
    m = t.select("split", *[c.alias(n) for n, c in masks.items()])
    return m.groupBy("split").agg(*[F.sum(F.col(n).cast("int")).cast("long").alias(n) for n in masks])


@query("eval_zones", sql(LW, "SELECT coarse, CASE WHEN snr >= CASE coarse WHEN 'N' THEN -12 WHEN 'A' THEN -8 WHEN 'R' THEN -9 END THEN 'detectable' ELSE 'nothing' END AS zone, count(*) AS n, round(sum(gain) * 1000, 3) AS milli, round(sum(qty) * CAST(25.4 AS DOUBLE), 3) AS mm FROM lw GROUP BY ALL"))
def eval_zones(spark, d):
    """Each class's own floor decides whether a window counts; units in thousandths and inches."""
    cls = F.when(F.col("coarse") == "N", "vehicle").when(F.col("coarse") == "A", "human").otherwise("animal")
    t = lw(spark, d).select("coarse", scalars.eval_zone(F.col("snr"), cls).alias("zone"), "gain", "qty")
    return t.groupBy("coarse", "zone").agg(F.count("*").alias("n"), F.round(scalars.thousandths(F.sum("gain")), 3).cast("double").alias("milli"), F.round(scalars.inches_to_mm(F.sum("qty").cast("double")), 3).alias("mm"))


_SPANS = ["a AS (SELECT event_id, recording, t0_s AS lo, t0_s + CAST(7200 AS DOUBLE) AS hi FROM ev)", "b AS (SELECT recording, t0_s + CAST(100 AS DOUBLE) AS a, t0_s + CAST(100 AS DOUBLE) + CAST(600 AS DOUBLE) * (event_id % 30) AS b FROM ev WHERE label = 'human')"]


@query("overlap_join", sql(EV, *_SPANS, "SELECT event_id, count(*) AS n, round(sum(least(hi, b) - greatest(lo, a)), 4) AS covered FROM a JOIN b USING (recording) WHERE a < hi AND lo < b AND a < b GROUP BY event_id"))
def overlap_join(spark, d):
    """Seconds of activity in each two-hour window, by cells of two hours: each pair once, no range join."""
    e = ev(spark, d)
    w = e.select("event_id", "recording", F.col("t0_s").alias("lo"), (F.col("t0_s") + 7200.0).alias("hi"))
    act = e.filter("label = 'human'").select("recording", (F.col("t0_s") + 100.0).alias("a"), (F.col("t0_s") + 100.0 + 600.0 * (F.col("event_id") % 30)).alias("b"))
    c = J.covered(w, act, ["recording"], ("lo", "hi"), ("a", "b"), 7200.0, ["event_id"])
    return c.withColumn("covered", F.round("covered", 4))


@query("positional_join", sql(EV, "SELECT event_id, round(s_human, 6) AS s_human, round(s_vehicle * 2, 6) AS extra FROM ev"))
def positional_join(spark, d):
    """Windows and a matrix that belong together by order; a place out of step is an error."""
    e = ev(spark, d).withColumn("at", F.col("event_id"))
    rows = e.select("at", "event_id", F.round("s_human", 6).alias("s_human"))
    matrix = e.select("at", F.col("event_id"), F.round(F.col("s_vehicle") * 2, 6).alias("extra"))
    return J.positional_join(rows, matrix, "at", "event_id").select("event_id", "s_human", "extra")


@query("rechunk_series", sql(SG, "l AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY scene_id, i) - 1 AS p, v FROM (SELECT label, scene_id, unnest(range(len(x))) AS i, unnest(x) AS v FROM sg))",
  "SELECT CAST(label AS BIGINT) AS label, p // 150 AS chunk, count(*) AS n, round(sum(v), 6) + 0 AS s, round(sum(v * (p % 150)), 6) + 0 AS weighted FROM l GROUP BY ALL HAVING count(*) >= 40"))
def rechunk_series(spark, d):
    """Arrays of 64 samples in chunks of 150; a rest of fewer than 40 is left out."""
    c = S.rechunk(sg(spark, d), ["label"], ["scene_id"], "x", 150, 40)
    weighted = F.aggregate(F.transform("x", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return c.select(F.col("label").cast("long").alias("label"), "chunk", F.size("x").cast("long").alias("n"), (F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6) + 0.0).alias("s"), (F.round(weighted, 6) + 0.0).alias("weighted"))


_PEAKS = ["n AS (SELECT scene_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM (SELECT scene_id, unnest(range(len(x))) AS i, unnest(x) AS v FROM sg) WINDOW w AS (PARTITION BY scene_id ORDER BY i))",
  "c AS (SELECT scene_id, list({'v': v, 'i': i} ORDER BY v DESC, i DESC) AS rest FROM n WHERE v > a AND v > b AND v >= CAST(0.05 AS DOUBLE) GROUP BY scene_id)",
  "g AS (SELECT scene_id, rest, CAST([] AS BIGINT[]) AS kept FROM c UNION ALL SELECT scene_id, list_filter(rest, lambda p: abs(p.i - rest[1].i) >= 5), list_append(kept, rest[1].i) FROM g WHERE len(rest) > 0)"]


@query("peaks_apart", "WITH RECURSIVE " + sql(SG, *_PEAKS, "SELECT scene_id, CAST(len(kept) AS BIGINT) AS n, CAST(list_sum(kept) AS BIGINT) AS places, list_min(kept) AS first_i FROM g WHERE len(rest) = 0").removeprefix("WITH "))
def peaks_apart(spark, d):
    """Local maxima of a least height and distance: the highest first, those too close to it go."""
    from ..functions import dsp
    from ..operators.signals import per_scene

    def work(v):
        at = dsp.peaks(v, 0.05, 5)
        if len(at):
            yield len(at), int(at.sum()), int(at[0])

    return per_scene(sg(spark, d), "scene_id", "x", "n bigint, places bigint, first_i bigint", work)


@query("hilbert_envelope", sql(SG, "f AS (SELECT scene_id, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, -sum(v * sin(2 * pi() * k * i / 64)) AS im FROM (SELECT scene_id, unnest(range(len(x))) AS i, unnest(x) AS v FROM sg) CROSS JOIN range(0, 33) AS t(k) GROUP BY ALL)",
  "z AS (SELECT scene_id, n, sum(w * (re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64))) / 64 AS a, sum(w * (re * sin(2 * pi() * k * n / 64) + im * cos(2 * pi() * k * n / 64))) / 64 AS b FROM (SELECT *, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS w FROM f) CROSS JOIN range(0, 64) AS t(n) GROUP BY ALL)",
  "SELECT scene_id, round(avg(sqrt(a * a + b * b)), 6) AS mean, round(max(sqrt(a * a + b * b)), 6) AS top FROM z GROUP BY scene_id"))
def hilbert_envelope(spark, d):
    """The size of the analytic signal."""
    from ..functions import dsp
    from ..operators.signals import per_scene

    def work(v):
        e = dsp.analytic_envelope(v)
        yield float(e.mean()), float(e.max())

    return per_scene(sg(spark, d), "scene_id", "x", "mean double, top double", work).select("scene_id", F.round("mean", 6).alias("mean"), F.round("top", 6).alias("top"))


@query("learners")
def learners(spark, d):
    """Held-out balanced accuracy of four learners (no other library gives the same models)."""
    from ..operators import learning as L

    s = sg(spark, d).select("x", (F.col("coarse") != "nothing").cast("double").alias("y"), "split")
    return L.compare(s, "x", "y", "split")


@query("permutation_importance")
def permutation_importance(spark, d):
    """Fall of the balanced accuracy when one feature's values are dealt anew among the held-out rows."""
    from ..operators import learning as L

    s = sg(spark, d).select("scene_id", "x", (F.col("coarse") != "nothing").cast("double").alias("y"), "split")
    model = L.fit("logistic", s.filter("split = 'train'"), "x", "y")
    return L.permutation_importance(model, staged(s.filter("split = 'val'"), "held-out"), "scene_id", "x", "y", 64)
