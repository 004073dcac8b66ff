"""Readers, sinks and streaming twins on small files."""
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewin.sources import readers, sinks
from tidewin.streaming import operators as T


def test_shards_in_numeric_order(spark, tmp_path):
    for i in (10, 2, 1):
        spark.range(i, i + 1).withColumn("extra", F.lit(i)).coalesce(1).write.parquet(str(tmp_path / f"features_shard_{i}.parquet"))
    names = [n.rsplit("_", 1)[1] for n in readers.list_files(spark, str(tmp_path), r"features_shard_\d+\.parquet")]
    assert names == ["1.parquet", "2.parquet", "10.parquet"]
    df = readers.shards(spark, str(tmp_path), r"features_shard_\d+\.parquet", ["id", "absent"], first=2)
    assert df.columns == ["id"] and sorted(r["id"] for r in df.collect()) == [1, 2]


def test_csv_positions_and_fallback_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time_s,counts\n" + "".join(f"{i / 10},{(i * 7) % 50}\n" for i in range(500)))
    rows = readers.csv_positions(spark, str(tmp_path / "a.csv")).orderBy("pos").collect()
    assert [r["value"] for r in rows] == [float((i * 7) % 50) for i in range(500)] and rows[-1]["pos"] == 499


def test_rejects_are_counted(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "good.json").write_text('{"a": 1}')
    df, bad = readers.with_rejects(spark, [str(tmp_path / n) for n in ("good.json", "empty.json", "none.json")], readers.json_objects)
    assert [r["a"] for r in df.collect()] == [1] and [reason for _, reason in bad] == ["empty", "missing"]


def test_npz_and_sqlite(spark, tmp_path):
    readers.register(spark)
    np.savez(tmp_path / "b.npz", x=np.arange(3.0), y=np.array([[1, 2], [3, 4]]))
    rows = spark.read.format("npz").option("path", str(tmp_path / "b.npz")).load().orderBy("array", "i").collect()
    assert [(r["array"], r["i"], r["value"]) for r in rows] == [("x", 0, 0.0), ("x", 1, 1.0), ("x", 2, 2.0), ("y", 0, 1.0), ("y", 1, 2.0), ("y", 2, 3.0), ("y", 3, 4.0)]
    with sqlite3.connect(tmp_path / "c.sqlite") as c:
        c.execute("CREATE TABLE scenes (scene_id INTEGER, name TEXT, v REAL, b BLOB)")
        c.executemany("INSERT INTO scenes VALUES (?, ?, ?, ?)", [(i, f"n{i}", i / 2, bytes([i])) for i in range(20)])
    df = spark.read.format("sqlite").option("path", str(tmp_path / "c.sqlite")).option("table", "scenes").load()
    assert dict(df.dtypes) == {"scene_id": "bigint", "name": "string", "v": "double", "b": "binary"}
    assert sorted((r["scene_id"], r["v"], bytes(r["b"])) for r in df.collect()) == [(i, i / 2, bytes([i])) for i in range(20)]


def test_decoders(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(4))
    assert readers.decode_files(spark, str(tmp_path / "*.npy"), readers.npy_decoder).first()["x"] == [0.0, 1.0, 2.0, 3.0]
    import io
    import wave

    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(1000)
        w.writeframes(np.array([0, 16384, -32768], "<i2").tobytes())
    assert readers.wav_decoder(buf.getvalue()) == [0.0, 0.5, -1.0]


def test_cached_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.cached(spark, str(tmp_path / "c"), build).count() == 3
    assert built == [1]
    with pytest.raises(KeyError):
        readers.load(spark, "unknown", "x")


def test_upsert_and_append(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, s string, v double")
    new = spark.createDataFrame([(2, 9.0, 5), (2, 8.0, 5), (3, 3.0, 5)], "k long, v double, unknown int")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()) == [(1, "a", 1.0), (2, None, 9.0), (3, None, 3.0)]
    path = str(tmp_path / "t")
    assert sinks.append_new(spark.range(5), path, ["id"]) == 5
    assert sinks.append_new(spark.range(7), path, ["id"]) == 2
    assert sinks.append_new(spark.range(7), path, ["id"]) == 0


def test_register_is_idempotent(spark):
    have = spark.createDataFrame([(0, "x", 1, 0)], "window_id long, dataset string, recording long, pos long")
    new = spark.createDataFrame([(5, 1), (5, 0), (3, 0)], "recording long, pos long")
    one = sinks.register_windows(have, new, "y", ["recording", "pos"]).cache()
    got = sorted((r["window_id"], r["dataset"], r["recording"], r["pos"]) for r in one.collect())
    assert got == [(0, "x", 1, 0), (1, "y", 3, 0), (2, "y", 5, 0), (3, "y", 5, 1)]
    assert sinks.register_windows(one, new, "y", ["recording", "pos"]) is one


def test_stream_state_crosses_batches(spark, tmp_path):
    """The same rows in one batch and in three give the same flags."""
    rows = [(k, i, v) for k in (1, 2) for i, v in enumerate([.9, .6, .6, .3, .6, .9, .6])]
    results = []
    for tag, cuts in (("one", [rows]), ("three", [[r for r in rows if r[1] < 2], [r for r in rows if 2 <= r[1] < 5], [r for r in rows if r[1] >= 5]])):
        src, out, state = (str(tmp_path / f"{tag}-{x}") for x in ("in", "out", "state"))
        for part in cuts:
            spark.createDataFrame(part, "k long, t long, v double").coalesce(1).write.mode("append").parquet(src)
            s = spark.readStream.schema("k long, t long, v double").parquet(src)
            got = T.run_available(T.hysteresis_stream(s, "k", "t", "v", .8, .5), out, state)
        results.append(sorted((r["k"], r["t"], r["is_on"]) for r in got.collect()))
    assert results[0] == results[1] and [x[2] for x in results[0][:7]] == [True, True, True, False, False, True, True]


def test_sqlite_balances_sparse_ids_and_filters_inside(spark, tmp_path):
    """Partitions hold like numbers of rows though most ids lie together; a condition is decided before rows are read."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "s.sqlite")
    rows = [(i if i < 900 else 10**9 + i * 10**6, ["Ab", "aB", None][i % 3], i / 7 if i % 11 else None) for i in range(1000)]
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, v REAL)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
        c.execute("CREATE TABLE none (id INTEGER)")
    readers.register(spark)
    load = lambda **o: spark.read.format("sqlite").options(path=path, table="t", partitions="8", **o).load()
    df = load()
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 8 and max(sizes) == 125
    for cond in ("id > 500 AND v < 100", "v >= 3.5 OR name = 'aB'", "v IS NULL", "name IN ('aB', 'x')"):
        want = sorted(map(repr, spark.createDataFrame(rows, df.schema).filter(cond).collect()))
        assert sorted(map(repr, df.filter(cond).collect())) == want == sorted(map(repr, load(where=cond).collect())), cond
    reader = readers.SqliteReader(path, "t", ["id"], 4, "id > 990")
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 100
    assert spark.read.format("sqlite").options(path=path, table="none").load().count() == 0
