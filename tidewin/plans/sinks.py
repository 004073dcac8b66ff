"""Queries that write and read again."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import formats, readers, sinks
from ..sources.scratch import scratch
from .registry import query
from .views import EV, SG, ev, read, sg, sql


@query("upsert_rows", "WITH n AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 1000000, 0 FROM customer WHERE c_custkey % 97 = 0) SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT c_custkey, round(c_acctbal, 2) FROM n")
def upsert_rows(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    n = c.filter("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.filter("c_custkey % 97 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")))
    return sinks.upsert(c, n, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("register_windows", sql(EV, "SELECT dataset, CAST(min(window_id) AS BIGINT) AS lo, CAST(max(window_id) AS BIGINT) AS hi, count(DISTINCT window_id) AS n FROM (SELECT 'old' AS dataset, event_id AS window_id FROM ev WHERE event_id < 100 UNION ALL SELECT 'field', 100 + row_number() OVER (ORDER BY recording, pos) - 1 FROM ev) GROUP BY dataset"))
def register_windows(spark, d):
    e = ev(spark, d)
    have = e.filter("event_id < 100").select(F.col("event_id").alias("window_id"), F.lit("old").alias("dataset"), "recording", "pos")
    r = sinks.register_windows(have, e.select("recording", "pos"), "field", ["recording", "pos"])
    return r.groupBy("dataset").agg(F.min("window_id").alias("lo"), F.max("window_id").alias("hi"), F.countDistinct("window_id").alias("n"))


@query("partitioned_round_trip", "SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_linestatus")
def partitioned_round_trip(spark, d):
    """Written in folders by a predicate's column; reading one value opens one folder."""
    path = scratch(spark, "by-status")
    sinks.write_parquet(read(spark, d, "lineitem").select("l_linestatus", "l_quantity", "l_orderkey"), path, ["l_linestatus"], ["l_orderkey"])
    return spark.read.parquet(path).filter("l_linestatus = 'O'").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("csv_round_trip", "SELECT n_nationkey, n_name FROM nation")
def csv_round_trip(spark, d):
    path = scratch(spark, "csv")
    sinks.write_csv(read(spark, d, "nation").select("n_nationkey", "n_name"), path, ["n_nationkey"])
    return spark.read.option("header", "true").schema("n_nationkey int, n_name string").csv(path)


@query("csv_positions", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, CAST(n_nationkey AS DOUBLE) AS value FROM nation")
def csv_positions(spark, d):
    """Line order as a column."""
    path = scratch(spark, "csv-pos")
    sinks.write_csv(read(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("amplitude")), path, ["amplitude"])
    return readers.csv_positions(spark, path).select(F.col("pos").cast("long").alias("pos"), "value")


@query("blob_decode", "SELECT vec_id AS scene_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last, len(embedding) AS n FROM embeddings")
def blob_decode(spark, d):
    """Little-endian 32-bit floats in a blob, decoded by bit arithmetic inside the JVM."""
    import struct

    import pyarrow as pa

    from ..functions.arrays import decode_f32

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([struct.pack(f"<{len(x)}f", *x) for x in b.column(1).to_pylist()], pa.binary())], names=["scene_id", "blob"])

    blobs = read(spark, d, "embeddings").select(F.col("vec_id").alias("scene_id"), "embedding").mapInArrow(pack, "scene_id long, blob binary")
    x = blobs.select("scene_id", decode_f32(F.col("blob")).alias("x"))
    return x.select("scene_id", F.round(F.col("x")[0].cast("double"), 6).alias("first"), F.round(F.element_at("x", -1).cast("double"), 6).alias("last"), F.size("x").cast("long").alias("n"))


@query("activity_json", sql("a AS (SELECT scene_id, cls, unnest(iv) AS iv FROM (SELECT event_id AS scene_id, event_type AS cls, [[value, value + 5], [value + 3, value + 9]] AS iv FROM events))", "SELECT scene_id, cls, round(sum(greatest(0, least(iv[2], CAST(300 AS DOUBLE)) - greatest(iv[1], CAST(100 AS DOUBLE)))), 6) AS covered FROM a GROUP BY ALL"))
def activity_json(spark, d):
    """Nested activity written as JSON text, parsed with a schema, summed per class."""
    from ..operators.joins import overlap_of_list

    t = read(spark, d, "events").select(F.col("event_id").alias("scene_id"), F.to_json(F.struct(F.create_map("event_type", F.lit(1)).alias("counts"), F.create_map("event_type", F.array(F.array("value", F.col("value") + 5), F.array(F.col("value") + 3, F.col("value") + 9))).alias("activity"))).alias("activity_json"))
    p = t.select("scene_id", F.from_json("activity_json", "counts map<string,int>, activity map<string,array<array<double>>>").alias("a"))
    return p.select("scene_id", F.explode("a.activity").alias("cls", "iv")).select("scene_id", "cls", F.round(overlap_of_list(F.col("iv"), F.lit(100.0), F.lit(300.0)), 6).alias("covered"))


@query("delete_where", "SELECT n_nationkey FROM nation WHERE NOT (n_regionkey = 2)")
def delete_where(spark, d):
    return sinks.delete_where(read(spark, d, "nation"), F.col("n_regionkey") == 2).select("n_nationkey")


@query("recording_keys", "SELECT split_part(p_name, ' ', 1) AS head, count(*) AS n FROM part GROUP BY 1")
def recording_keys(spark, d):
    """Parts of composite names."""
    return read(spark, d, "part").groupBy(F.split("p_name", " ")[0].alias("head")).agg(F.count("*").alias("n"))


@query("shard_scan", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag")
def shard_scan(spark, d):
    """Twelve shards, read in the order of their numbers, two columns of them."""
    return _shards(spark, d, None).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("first_shards", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_orderkey % 12 < 3 GROUP BY l_returnflag")
def first_shards(spark, d):
    """Only the first three shards are opened: shard 10 isn't among them, though its name sorts before shard 2's."""
    return _shards(spark, d, 3).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


#: Rows that a task which writes shards is meant to hold.
SHARD_ROWS = 1_000_000


def _shards(spark, d, first):
    path = scratch(spark, "shards")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag").withColumn("shard", F.concat(F.lit("shard_"), F.col("l_orderkey") % 12))
    tasks = max(4, -(-rows.count() // SHARD_ROWS))  # each sorts its rows by shard: a shard is a file a task
    rows.repartition(tasks, "l_orderkey").write.partitionBy("shard").parquet(path)
    return readers.shards(spark, path, r"shard=shard_\d+", ["l_quantity", "l_returnflag", "no such column"], first)


@query("json_lines", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_acctbal < 0 AS owes FROM customer")
def json_lines(spark, d):
    """Objects written one a line and read by a stated schema."""
    path = scratch(spark, "json")
    c = read(spark, d, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), (F.col("c_acctbal") < 0).alias("owes"))
    c.select(F.to_json(F.struct(*c.columns))).write.text(path)
    return spark.read.schema("c_custkey bigint, c_name string, c_acctbal double, owes boolean").json(path)


@query("optional_files", "SELECT count(*) AS n, CAST(2 AS BIGINT) AS rejected FROM nation")
def optional_files(spark, d):
    """A table beside two that aren't there: what loads is united, the others are named with the reason."""
    good, bad = readers.with_rejects(spark, [f"{d}/nation.parquet", f"{d}/no-such-table.parquet", f"{d}/neither.parquet"], lambda s, path: s.read.parquet(path))
    return good.agg(F.count("*").alias("n")).withColumn("rejected", F.lit(len([b for b in bad if b[1] == "missing"])).cast("long"))


@query("cached_table", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def cached_table(spark, d):
    """Built once; the second call reads what is there."""
    path = scratch(spark, "cached")
    build = lambda: read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    readers.cached(spark, path, build)

    def again():
        raise AssertionError("built twice")

    return readers.cached(spark, path, again)


@query("registered_dataset", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def registered_dataset(spark, d):
    return readers.load(spark, "parquet", f"{d}/nation.parquet").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("content_hashes", "SELECT c_custkey, sha256(c_name) AS sha256, md5(c_name || '|' || CAST(c_custkey AS VARCHAR)) AS md5 FROM customer")
def content_hashes(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("sha256"), F.md5(F.concat_ws("|", "c_name", F.col("c_custkey").cast("string"))).alias("md5"))


@query("manifest_append", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 < 2 OR o_orderkey % 2 = 0")
def manifest_append(spark, d):
    """Two overlapping batches, the second one sent twice: each key is there once."""
    path = scratch(spark, "manifest")
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for part in ("o_orderkey % 3 < 2", "o_orderkey % 2 = 0", "o_orderkey % 2 = 0"):
        sinks.append_new(o.filter(part), path, ["o_orderkey"])
    return spark.read.parquet(path)


@query("netcdf_variables", sql(SG, "SELECT scene_id, CAST(len(x) AS BIGINT) AS n, round(x[1], 6) AS first, round(list_sum(x), 6) + 0 AS total FROM sg"))
def netcdf_variables(spark, d):
    """Every scene as the bytes of a NetCDF file with two variables, and one of them read from the bytes again."""
    import pyarrow as pa

    def encode(batches):
        for b in batches:
            data = [formats.netcdf_bytes({"index": range(len(x)), "amplitude": x}) for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("scene_id").cast(pa.string()), pa.array(data, pa.binary())], names=["path", "content"])

    files = sg(spark, d).select("scene_id", "x").mapInArrow(encode, "path string, content binary")
    x = readers.decoded(files, formats.netcdf_decoder("amplitude"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return x.select(F.col("path").cast("long").alias("scene_id"), F.size("x").cast("long").alias("n"), F.round(F.col("x")[0], 6).alias("first"), (F.round(total, 6) + 0.0).alias("total"))
