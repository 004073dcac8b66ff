"""Stand-in relations over the test tables, as DataFrames and as the same SQL for the oracle.

ev: evaluation windows with three head scores. sg: scenes with a signal. lw: label windows for audits.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.cells import carried, deal, dealt, positions

HEADS = ("human", "animal", "vehicle")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str):
    """Epoch microseconds of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"unix_date(CAST({col} AS DATE)) * 86400000000L + hour({col}) * 3600000000L + minute({col}) * 60000000L + CAST(extract(SECOND FROM {col}) * 1000000 AS BIGINT)")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("recording"), "event_type", "value", micros("ts").alias("us"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))
    e = deal(e, ["us"], keys=["recording"])
    first = F.min("us").over(Window.partitionBy("recording"))
    if dealt(e):  # long recordings are cut into cells
        e, first = carried(e, ["recording"], first_us=(F.min("us"), "all_min")), F.col("first_us")
    e = positions(e, ["recording"], ["us", "event_id"], ready=True)
    label = F.when(F.col("event_type") == "purchase", "vehicle").when(F.col("event_type") == "signup", "human").when(F.col("event_type") == "error", "animal").otherwise("nothing")
    return e.select(
        "event_id", "recording",
        "pos", ((F.col("us") - first) / F.lit(1e6)).alias("t0_s"),
        "us", label.alias("label"),
        (F.col("value") / 500).alias("s_human"), (F.col("k") / 100).alias("s_vehicle"),
        (((F.col("event_id") * 37) % 101).cast("double") / F.lit(101.0)).alias("s_animal"))


EV = """ev AS (
  SELECT event_id, user_id AS recording,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS t0_s,
    epoch_us(ts) AS us,
    CASE event_type WHEN 'purchase' THEN 'vehicle' WHEN 'signup' THEN 'human' WHEN 'error' THEN 'animal' ELSE 'nothing' END AS label,
    value / CAST(500 AS DOUBLE) AS s_human,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(100 AS DOUBLE) AS s_vehicle,
    CAST((event_id * 37) % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS s_animal
  FROM events)"""


def ev_long(df: DataFrame) -> DataFrame:
    """One row per window and head: keys plus head, score."""
    return df.select("event_id", "recording", "pos", "t0_s", "us", "label", F.expr("stack(3, 'human', s_human, 'animal', s_animal, 'vehicle', s_vehicle) AS (head, score)"))


EV_LONG = """evl AS (
  SELECT event_id, recording, pos, t0_s, us, label, 'human' AS head, s_human AS score FROM ev
  UNION ALL SELECT event_id, recording, pos, t0_s, us, label, 'animal', s_animal FROM ev
  UNION ALL SELECT event_id, recording, pos, t0_s, us, label, 'vehicle', s_vehicle FROM ev)"""


def sg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    coarse = F.when(F.col("label") <= 3, "nothing").when(F.col("label") <= 5, "human").when(F.col("label") <= 7, "vehicle").otherwise("animal")
    return e.select(F.col("vec_id").alias("scene_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label", coarse.alias("coarse"), F.when(F.col("vec_id") % 10 == 0, "val").otherwise("train").alias("split"))


SG = """sg AS (
  SELECT vec_id AS scene_id, CAST(embedding AS DOUBLE[]) AS x, label,
    CASE WHEN label <= 3 THEN 'nothing' WHEN label <= 5 THEN 'human' WHEN label <= 7 THEN 'vehicle' ELSE 'animal' END AS coarse,
    CASE WHEN vec_id % 10 = 0 THEN 'val' ELSE 'train' END AS split
  FROM embeddings)"""


def sg_long(df: DataFrame) -> DataFrame:
    """One row per scene and sample: i counts from 0."""
    return df.select("scene_id", "label", "coarse", "split", F.posexplode("x").alias("i", "v"))


SG_LONG = "sgl AS (SELECT scene_id, label, coarse, split, unnest(range(len(x))) AS i, unnest(x) AS v FROM sg)"


def lw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("condition"))
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("subkind"), F.col("p_brand").alias("family"))
    level = F.when(F.col("l_quantity") < 10, 0).when(F.col("l_quantity") < 30, 1).otherwise(2)
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select(
        F.col("l_returnflag").alias("coarse"), "subkind", "family", "condition", level.alias("level"),
        (20 * F.log10(F.col("l_extendedprice") / 20000)).alias("snr"), F.col("l_discount").alias("occ"), F.col("l_tax").alias("gain"),
        F.col("l_linestatus").alias("split"), F.col("l_quantity").alias("qty"), F.col("l_suppkey").alias("station"), F.col("o_custkey").alias("profile"))


LW = """lw AS (
  SELECT l_returnflag AS coarse, p_type AS subkind, p_brand AS family, o_orderpriority AS condition,
    CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE 2 END AS level,
    CAST(20 AS DOUBLE) * log10(l_extendedprice / CAST(20000 AS DOUBLE)) AS snr, l_discount AS occ, l_tax AS gain,
    l_linestatus AS split, l_quantity AS qty, l_suppkey AS station, o_custkey AS profile
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def sql(*parts: str) -> str:
    """WITH the given relations (all but the last), the last is the SELECT."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
