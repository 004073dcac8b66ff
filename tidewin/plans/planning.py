"""Planning, labelling and cost queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import planning as P
from ..operators import series as S
from .registry import query
from .views import EV, LW, ev, lw, read, sql

TIERS = [("calm", 0.35), ("wind_low", 0.20), ("wind_mid", 0.15), ("wind_high", 0.10), ("rain_light", 0.12), ("rain_heavy", 0.08)]


def r6(c, name, digits=6):
    return (F.round(c, digits) + 0.0).alias(name)


@query("tier_deal", "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', CAST({w} AS DOUBLE))" for i, (n, w) in enumerate(TIERS)) + ") AS v(ord, tier, w)), c AS (SELECT c_mktsegment AS seg, count(*) % 97 + 10 AS n FROM customer GROUP BY 1), s AS (SELECT seg, n, ord, tier, floor(w * n) AS f, w * n - floor(w * n) AS r FROM t CROSS JOIN c), k AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY r DESC, ord) AS k, n - sum(f) OVER (PARTITION BY seg) AS rest FROM s) SELECT seg, tier, CAST(f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM k")
def tier_deal(spark, d):
    """Largest remainder: floors, then one more for the largest remainders, ties in declared order."""
    t = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(TIERS)], "ord int, tier string, w double")
    c = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg((F.count("*") % 97 + 10).alias("total"))
    return S.deal_largest_remainder(c.join(F.broadcast(t), F.lit(True)), "w", F.col("total"), "ord", ["seg"]).select("seg", "tier", "n")


@query("window_quota", sql(EV, "n AS (SELECT *, count(*) OVER (PARTITION BY recording) AS n FROM ev)", "g AS (SELECT DISTINCT n.n, CAST(round_even(j * ((n.n - 1) / CAST(23 AS DOUBLE)), 0) AS BIGINT) AS at_pos FROM (SELECT DISTINCT n FROM n) n CROSS JOIN range(0, 24) AS t(j))", "SELECT recording, pos FROM n WHERE n <= 24 OR EXISTS (SELECT 1 FROM g WHERE g.n = n.n AND g.at_pos = n.pos)"))
def window_quota(spark, d):
    """24 windows of each series at even strides."""
    return S.quota(ev(spark, d), 24, ["recording"], ["pos"]).select("recording", "pos")


@query("strided_downsample", sql(EV, "SELECT recording, count(*) AS n, CAST(sum(pos) AS BIGINT) AS s FROM ev WHERE pos % 4 = 0 GROUP BY recording"))
def strided_downsample(spark, d):
    return S.strided(ev(spark, d), 4, ["recording"], ["pos"]).groupBy("recording").agg(F.count("*").alias("n"), F.sum("pos").alias("s"))


@query("cap_per_group", sql(EV, "SELECT recording, max(pos) AS last_pos, count(*) AS n FROM ev WHERE pos < 8 GROUP BY recording"))
def cap_per_group(spark, d):
    from ..operators.sampling import cap_per_group as cap

    return cap(ev(spark, d), ["recording"], ["pos"], 8).groupBy("recording").agg(F.max("pos").alias("last_pos"), F.count("*").alias("n"))


@query("round_robin_shards", sql(EV, "SELECT recording, pos % 7 AS shard, count(*) AS n FROM ev GROUP BY ALL"))
def round_robin_shards(spark, d):
    from ..operators.sampling import round_robin

    return round_robin(ev(spark, d), 7, ["pos"], ["recording"]).groupBy("recording", F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"))


@query("label_states", sql(LW, "s AS (SELECT coarse, level > 0 AS p, level > 0 AND occ > 0 AS e, level > 0 AND occ > 0 AND gain > CAST(0.000001 AS DOUBLE) AS r, level > 0 AND occ > 0 AND gain > CAST(0.000001 AS DOUBLE) AND snr >= 0 AS t FROM lw)", "SELECT coarse, count(*) FILTER (p) AS presence, count(*) FILTER (e) AS emission, count(*) FILTER (r) AS received, count(*) FILTER (t) AS detectable FROM s GROUP BY coarse"))
def label_states(spark, d):
    """Presence, emission, reception, detection: each state needs the one before it."""
    a, b, c, e = X.four_states(F.col("level") > 0, F.col("occ"), F.col("gain"), F.col("snr"), F.lit(0.0))
    return lw(spark, d).groupBy("coarse").agg(F.sum(a).alias("presence"), F.sum(b).alias("emission"), F.sum(c).alias("received"), F.sum(e).alias("detectable"))


@query("zone_soft", sql(LW, "z AS (SELECT CASE WHEN snr >= 0 THEN 'detectable' WHEN snr >= -20 THEN 'marginal' ELSE 'nothing' END AS zone, CASE WHEN snr >= CASE coarse WHEN 'A' THEN -8 WHEN 'N' THEN -9 ELSE -12 END THEN 1 ELSE 0 END AS over_floor, CASE WHEN snr < CAST(-8 AS DOUBLE) THEN 0 WHEN snr < CAST(2 AS DOUBLE) THEN 1 ELSE 2 END AS zone3, CASE WHEN snr < -20 THEN 0 ELSE 1 / (1 + exp(-snr / 6)) END AS soft FROM lw)", "SELECT zone, zone3, count(*) AS n, CAST(sum(over_floor) AS BIGINT) AS over_floor, round(avg(soft), 6) AS soft FROM z GROUP BY zone, zone3"))
def zone_soft(spark, d):
    cls = F.when(F.col("coarse") == "A", "human").when(F.col("coarse") == "N", "animal").otherwise("vehicle")
    t = lw(spark, d).select(X.zone(F.col("snr")).alias("zone"), X.zone3(F.col("snr"), -8.0, 2.0).alias("zone3"), X.soft_target(F.col("snr")).alias("soft"), (X.eval_zone(F.col("snr"), cls) == "detectable").cast("int").alias("o"))
    return t.groupBy("zone", "zone3").agg(F.count("*").alias("n"), F.sum("o").alias("over_floor"), F.round(F.avg("soft"), 6).alias("soft"))


_CLS = "CASE WHEN coarse = 'A' THEN 'human' WHEN coarse = 'N' THEN 'animal' ELSE 'vehicle' END"


@query("gates_theory", sql(LW, f"w AS (SELECT {_CLS} AS cls, CAST(qty AS BIGINT) % 5 + 1 AS t, snr FROM lw)",
  "g AS (SELECT *, 10 * log10(pow(CAST(2.5 AS DOUBLE), 2) / (2 * CAST(t AS DOUBLE) * CASE WHEN cls = 'vehicle' THEN CAST(20 AS DOUBLE) ELSE CAST(70 AS DOUBLE) END)) AS gate FROM w)",
  "SELECT cls, t, round(max(gate), 4) AS gate_db, count(*) AS n, count(*) FILTER (snr >= gate) AS over_gate FROM g GROUP BY cls, t"))
def gates_theory(spark, d):
    """Windows of one to five seconds against the gate that theory gives for their class's bandwidth and their length."""
    w = lw(spark, d).select(F.when(F.col("coarse") == "A", "human").when(F.col("coarse") == "N", "animal").otherwise("vehicle").alias("cls"), (F.col("qty").cast("long") % 5 + 1).alias("t"), "snr")
    gate = X.gate_db(2.5, F.col("t").cast("double"), F.when(F.col("cls") == "vehicle", 20.0).otherwise(70.0))
    return w.withColumn("gate", gate).groupBy("cls", "t").agg(F.round(F.max("gate"), 4).alias("gate_db"), F.count("*").alias("n"), F.sum(F.when(F.col("snr") >= F.col("gate"), 1).otherwise(0)).cast("long").alias("over_gate"))


@query("interval_merge", "WITH o AS (SELECT o_custkey AS k, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 20 + o_orderkey % 60 AS b FROM orders), n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM o), g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT k, min(a) AS a, max(b) AS b FROM g GROUP BY k, g")
def interval_merge(spark, d):
    from .views import micros

    a = F.floor(micros("o_orderdate") / 86400000000).cast("long")
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), a.alias("a"), (a + 20 + F.col("o_orderkey") % 60).alias("b"))
    return S.merge_intervals(o, ["k"], "a", "b")


_NETS = """c AS (SELECT p_partkey AS net, 10 + p_size AS n_in, CASE WHEN p_partkey % 3 = 0 THEN [16 * (1 + p_partkey % 5)] ELSE [16 * (1 + p_partkey % 5), 8 * (1 + p_partkey % 7)] END AS w,
  CASE WHEN p_size % 2 = 0 THEN 4 ELSE 0 END AS rank, 3 AS heads, 1 + p_size % 4 AS t, p_partkey % 4 = 0 AS once, [CAST(p_retailprice AS DOUBLE) / 10000, CAST(p_size AS DOUBLE) / 100] AS fire FROM part)"""


@query("energy_cost", sql(_NETS, """m AS (SELECT net, 0 AS i, CASE WHEN rank > 0 THEN n_in * rank + rank * w[1] ELSE n_in * w[1] END AS macs, t, once, CAST(0 AS DOUBLE) AS rate FROM c
  UNION ALL SELECT net, k, w[k] * CASE WHEN k = len(w) THEN heads ELSE w[k + 1] END, t, once, fire[k] FROM c CROSS JOIN range(1, 3) AS r(k) WHERE k <= len(w))""",
  "s AS (SELECT net, sum(macs) AS macs, sum(rate * t * macs) AS sops, max(CASE WHEN i = 0 THEN macs * CASE WHEN once THEN 1 ELSE t END END) AS stem FROM m GROUP BY net)",
  "SELECT net, CAST(macs AS BIGINT) AS macs, round(sops, 4) AS sops, round((stem * CAST(4.6 AS DOUBLE) + sops * CAST(0.9 AS DOUBLE)) / 1000000, 6) AS energy_uj, round(macs * CAST(4.6 AS DOUBLE) / (stem * CAST(4.6 AS DOUBLE) + sops * CAST(0.9 AS DOUBLE)), 6) AS ratio FROM s"))
def energy_cost(spark, d):
    """Operations and energy of spiking networks, one per part, and the ratio to the same network without spikes."""
    k16, k8 = (F.col("p_partkey") % 5 + 1) * 16, (F.col("p_partkey") % 7 + 1) * 8
    c = read(spark, d, "part").select(
        F.col("p_partkey").alias("net"), (10 + F.col("p_size")).alias("n_in"), F.when(F.col("p_partkey") % 3 == 0, F.array(k16)).otherwise(F.array(k16, k8)).cast("array<int>").alias("w"),
        F.when(F.col("p_size") % 2 == 0, 4).otherwise(0).alias("rank"), F.lit(3).alias("heads"), (1 + F.col("p_size") % 4).alias("t"), (F.col("p_partkey") % 4 == 0).alias("once"), F.array(F.col("p_retailprice") / 10000, F.col("p_size") / 100.0).alias("fire"))
    k = P.cost_model(F.col("n_in"), F.col("w"), F.col("rank"), F.col("heads"), F.col("t"), F.col("once"), F.col("fire"))
    return c.select("net", k["macs"].cast("long").alias("macs"), F.round(k["sops"], 4).alias("sops"), F.round(k["energy_uj"], 6).alias("energy_uj"), F.round(k["ratio"], 6).alias("ratio"))


@query("plan_builder", "WITH c AS (SELECT s_nationkey AS cell, count(*) * 3 AS n, avg(s_acctbal) AS vs FROM supplier GROUP BY 1), k AS (SELECT cell, CAST(CASE WHEN vs >= 4000 THEN n ELSE 0 END AS BIGINT) AS n FROM c), b AS (SELECT cell, n, coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k) SELECT cell, CAST(1000000 + before + j AS BIGINT) AS scene_id FROM b CROSS JOIN range(0, 1000) AS t(j) WHERE j < n")
def plan_builder(spark, d):
    """Cells expand to their counts with contiguous ids; cells that fail the velocity rule get none."""
    c = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("cell")).agg((F.count("*") * 3).alias("n"), F.avg("s_acctbal").alias("vs"))
    c = c.select("cell", F.when(F.col("vs") >= 4000, F.col("n")).otherwise(0).cast("long").alias("n"))
    return P.expand(c, "n", 1_000_000, ["cell"]).select("cell", "scene_id")


@query("run_grid", """WITH o AS (SELECT p_brand AS label, CASE WHEN count(*) % 2 = 0 THEN 64 + max(p_size) END AS width, CASE WHEN count(*) % 3 = 0 THEN CAST(min(p_size) AS DOUBLE) / 1000 END AS lr FROM part GROUP BY 1),
  done AS (SELECT DISTINCT p_brand || '_rep' || (1 + p_partkey % 3) AS run_id FROM part WHERE p_size = 7),
  g AS (SELECT label, r AS replicate, coalesce(width, 128) AS width, coalesce(lr, CAST(0.001 AS DOUBLE)) AS lr, label || '_rep' || r AS run_id FROM o CROSS JOIN range(1, 4) AS t(r))
  SELECT run_id, label, replicate, width, lr FROM g ANTI JOIN done USING (run_id)""")
def run_grid(spark, d):
    """Every brand's settings, three times each, without the runs that parts of size 7 say are done."""
    part = read(spark, d, "part")
    n = F.count("*")
    o = part.groupBy(F.col("p_brand").alias("label")).agg(F.when(n % 2 == 0, 64 + F.max("p_size")).cast("int").alias("width"), F.when(n % 3 == 0, F.min("p_size").cast("double") / 1000).alias("lr"))
    done = part.filter("p_size = 7").select(F.format_string("%s_rep%d", F.col("p_brand"), 1 + F.col("p_partkey") % 3).alias("run_id")).distinct()
    return P.run_grid({"width": 128, "lr": 0.001}, o, 3, done).select("run_id", "label", F.col("replicate").cast("long").alias("replicate"), "width", "lr")


@query("winner_rule", sql(LW, "r AS (SELECT condition, family, round(avg(CASE WHEN level > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 2) AS accuracy, round(avg(qty), 6) AS energy FROM lw GROUP BY ALL)", "SELECT condition, family, accuracy, energy, place FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY accuracy DESC, energy) AS place FROM r) WHERE place <= 3"))
def winner_rule(spark, d):
    """The three best by accuracy; of equals the one with less energy."""
    r = lw(spark, d).groupBy("condition", "family").agg(F.round(F.avg(F.when(F.col("level") > 0, 1.0).otherwise(0.0)), 2).alias("accuracy"), F.round(F.avg("qty"), 6).alias("energy"))
    return P.winners(r, "accuracy", "energy", 3, ["condition"]).withColumn("place", F.col("place").cast("long"))


COND = "CASE WHEN rain > 5 THEN 'rain_heavy' WHEN rain > CAST(0.5 AS DOUBLE) THEN 'rain_light' WHEN wind >= 10 THEN 'wind_high' WHEN wind >= 6 THEN 'wind_mid' WHEN wind >= 3 THEN 'wind_low' ELSE 'calm' END"
DAILY = "CASE WHEN rain >= 5 THEN 'rain_heavy' WHEN rain >= CAST(0.5 AS DOUBLE) THEN 'rain_light' WHEN wind >= 12 THEN 'wind_high' WHEN wind >= 7 THEN 'wind_mid' WHEN wind >= 4 THEN 'wind_low' ELSE 'calm' END"


@query("weather_conditions", f"WITH w AS (SELECT l_quantity / 3 AS wind, l_tax * 100 AS rain FROM lineitem) SELECT {COND} AS hourly, {DAILY} AS daily, count(*) AS n FROM w GROUP BY ALL")
def weather_conditions(spark, d):
    """Hourly and daily rules differ in limits and in strictness; both are kept."""
    w = read(spark, d, "lineitem").select((F.col("l_quantity") / 3).alias("wind"), (F.col("l_tax") * 100).alias("rain"))
    return w.groupBy(X.hourly_condition(F.col("wind"), F.col("rain")).alias("hourly"), X.daily_condition(F.col("wind"), F.col("rain")).alias("daily")).agg(F.count("*").alias("n"))


@query("weather_day_pick", "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_tax) AS rain, max(l_quantity) AS wind FROM lineitem GROUP BY 1), r AS (SELECT CAST(day AS VARCHAR) AS day, round(rain, 6) AS rain, wind FROM d), a AS (SELECT day FROM r ORDER BY rain DESC, day LIMIT 10), b AS (SELECT day FROM r WHERE rain <= CAST(0.3 AS DOUBLE) ORDER BY wind, day LIMIT 5) SELECT day FROM a UNION SELECT day FROM b")
def weather_day_pick(spark, d):
    """The ten wettest days and the five calmest dry ones."""
    r = read(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.round(F.sum("l_tax"), 6).alias("rain"), F.max("l_quantity").alias("wind"))
    a = r.orderBy(F.desc("rain"), "day").limit(10)
    b = r.filter("rain <= 0.3").orderBy("wind", "day").limit(5)
    return a.select("day").union(b.select("day")).distinct()


@query("line_classes", "WITH h AS (SELECT CAST(p_size AS DOUBLE) * 10 + (p_partkey % 5) AS hz FROM part), c AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM range(1, 10) AS t(k) WHERE abs(hz - 50 * k) <= 1.5) THEN 'mains' WHEN hz BETWEEN 44 AND 47 OR hz BETWEEN 53 AND 57 THEN 'rig' WHEN hz BETWEEN 140 AND 180 THEN 'spurious' WHEN hz BETWEEN 4 AND 80 THEN 'machinery' ELSE 'other' END AS kind FROM h) SELECT kind, count(*) AS n FROM c GROUP BY 1")
def line_classes(spark, d):
    hz = F.col("p_size").cast("double") * 10 + F.col("p_partkey") % 5
    return read(spark, d, "part").select(hz.alias("hz")).groupBy(X.line_kind(F.col("hz")).alias("kind")).agg(F.count("*").alias("n"))


@query("numerical_stencil", """WITH p AS (SELECT p_partkey, p_retailprice / CAST(2 AS DOUBLE) AS vr, CAST(p_size AS DOUBLE) AS q, p_size % 7 = 0 AS inv, CAST(1 + p_size % 5 AS DOUBLE) AS vp FROM part),
a AS (SELECT *, greatest(vr, 80) / 1000 AS v, vr >= 800 AND NOT inv AS stiff FROM p),
b AS (SELECT *, least(greatest(CAST(6.9 AS DOUBLE) * q * v / (pi() * 25), CAST(0.06 AS DOUBLE)), CAST(0.32 AS DOUBLE)) AS r_max FROM a),
c AS (SELECT *, r_max / v + CASE WHEN stiff THEN CAST(1.5 AS DOUBLE) ELSE CAST(2.5 AS DOUBLE) END + CASE WHEN inv THEN CAST(1.5 AS DOUBLE) ELSE 0 END AS t, least(greatest(CAST(1.25 AS DOUBLE) * 2 * pi() * 250 / v, 10000), 24000) AS kmax FROM b),
e AS (SELECT *, floor(least(greatest(greatest(kmax * CAST(0.85 AS DOUBLE), CAST(0.239 AS DOUBLE) * kmax * vp * t), 8000), 30000)) AS nk FROM c)
SELECT p_partkey, round(r_max, 6) AS r_max, round(kmax, 4) AS kmax, CAST(nk AS BIGINT) AS nk, CAST(ceil(round(t / CAST(0.002 AS DOUBLE) / 2, 9)) * 2 AS BIGINT) AS nt, round(least(CAST(2.15 AS DOUBLE) * kmax / nk * vp, 9 / t), 6) AS alpha FROM e""")
def numerical_stencil(spark, d):
    """The wave solver's grid for a profile: a chain of limits on its velocities and damping."""
    p = read(spark, d, "part")
    s = P.stencil(F.col("p_retailprice") / 2, F.col("p_size").cast("double"), F.col("p_retailprice") / 2, F.col("p_size") % 7 == 0, (1 + F.col("p_size") % 5).cast("double"))
    return p.select("p_partkey", F.round(s["r_max"], 6).alias("r_max"), F.round(s["kmax"], 4).alias("kmax"), s["nk"].alias("nk"), s["nt"].alias("nt"), F.round(s["alpha"], 6).alias("alpha"))


@query("ordinal_levels", "SELECT CASE WHEN n <= 0 THEN 'none' WHEN n = 1 THEN 'single' ELSE 'multiple' END AS level, count(*) AS n_customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1")
def ordinal_levels(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return c.groupBy(X.level_of_count(F.coalesce("n", F.lit(0))).alias("level")).agg(F.count("*").alias("n_customers"))


@query("cosine_rate", sql(EV, "SELECT pos, round(CASE WHEN pos < 5 THEN CAST(0.1 AS DOUBLE) * pos / 5 ELSE CAST(0.05 AS DOUBLE) * (1 + cos(pi() * (pos - 5) / 95)) END, 6) AS rate FROM (SELECT DISTINCT pos FROM ev)"))
def cosine_rate(spark, d):
    return ev(spark, d).select("pos").distinct().select("pos", (F.round(X.cosine_rate(F.col("pos"), 100, 5, 0.1), 6) + 0.0).alias("rate"))


@query("snr_map", sql(LW, "g AS (SELECT subkind, coarse, CAST(floor(qty / 10) AS BIGINT) AS d_idx, snr FROM lw)", "SELECT subkind, coarse, d_idx, count(*) AS reps, round(quantile_cont(snr, CAST(0.5 AS DOUBLE)), 6) AS med, round(quantile_cont(snr, CAST(0.1 AS DOUBLE)), 6) AS p10, round(quantile_cont(snr, CAST(0.9 AS DOUBLE)), 6) AS p90 FROM g GROUP BY ALL"))
def snr_map(spark, d):
    """Median and 10/90 % points over repetitions, per profile, class and distance."""
    q = F.percentile("snr", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9)))
    g = lw(spark, d).groupBy("subkind", "coarse", F.floor(F.col("qty") / 10).cast("long").alias("d_idx")).agg(F.count("*").alias("reps"), q.alias("q"))
    return g.select("subkind", "coarse", "d_idx", "reps", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("med", "p10", "p90"))])


@query("path_closest_approach", "WITH p AS (SELECT s_suppkey, i, -50 + CAST(i AS DOUBLE) AS x, 5 + s_suppkey % 20 + CAST(0.2 AS DOUBLE) * i AS y FROM supplier CROSS JOIN range(0, 101) AS t(i)) SELECT s_suppkey, round(min(sqrt(x * x + y * y)), 6) AS closest_m, arg_min(i, x * x + y * y) AS at_step FROM p GROUP BY s_suppkey")
def path_closest_approach(spark, d):
    """The least distance of a straight path from the sensor, over its steps as an array."""
    s = read(spark, d, "supplier").select("s_suppkey")
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long")), lambda i: F.struct((F.pow(i.cast("double") - 50, F.lit(2.0)) + F.pow(5 + F.col("s_suppkey") % 20 + i * 0.2, F.lit(2.0))).alias("d2"), i.alias("i")))
    m = F.array_min(steps)
    return s.select("s_suppkey", F.round(F.sqrt(m["d2"]), 6).alias("closest_m"), m["i"].alias("at_step"))


@query("hash_samplers", None)
def hash_samplers(spark, d):
    """Repeatable draws: uniform, triangular and the target distribution (no other engine has the same hash)."""
    u, v = P.uniform(1, "event_id"), P.uniform(2, "event_id")
    return ev(spark, d).select("event_id", u.alias("u"), P.triangular(u, 0.0, 1.0, 4.0).alias("tri"), P.target_snr(u, v).alias("target"))
