"""Readers: shards in numeric order, projected scans, row positions, arrays, SQLite, optional files."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The schema of a field recording.
AMPLITUDE = "time_s double, amplitude double"


def list_files(spark: SparkSession, folder: str, pattern: str = r".*") -> list[str]:
    """Files of a folder on any file system that Spark reads, in the order of the numbers in their names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(path)] if fs.exists(path) else []
    own = [n for n, _ in names if re.fullmatch(pattern, n.rsplit("/", 1)[-1])]
    return sorted(own, key=lambda n: ([int(x) for x in re.findall(r"\d+", n.rsplit("/", 1)[-1])], n))


def shards(spark: SparkSession, folder: str, pattern: str, columns: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Parquet shards (the ``first`` few, if given), only the named columns that exist."""
    files = list_files(spark, folder, pattern)[:first]
    df = spark.read.option("mergeSchema", "true").parquet(*files)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def csv_positions(spark: SparkSession, path: str, column: str = "amplitude", schema: str | None = None) -> DataFrame:
    """file, pos, value of one CSV column, the last one if it isn't there; pos counts a file's rows from 0.

    Positions come from the scan's own row order in a file: ids grow inside a partition and partitions of a
    file follow its offsets, so ranking by id inside the file restores the lines' order.
    """
    from pyspark.sql.window import Window

    r = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", "true").csv(path)
    name = column if column in df.columns else df.columns[-1]
    t = df.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_id"), F.col(name).cast("double").alias("value"))
    return t.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("_id")) - 1).drop("_id")


def json_objects(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", "true")
    return (r.schema(schema) if schema else r).json(path)


def with_rejects(spark: SparkSession, files: list[str], load: Callable[[SparkSession, str], DataFrame]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Union of the files that load, and (file, reason) of those that are missing, empty or broken."""
    good, bad = None, []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in files:
        p = jvm.org.apache.hadoop.fs.Path(f)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            bad.append((f, "missing"))
        elif fs.getFileStatus(p).isFile() and fs.getFileStatus(p).getLen() == 0:
            bad.append((f, "empty"))
        else:
            try:
                df = load(spark, f)
                good = df if good is None else good.unionByName(df, allowMissingColumns=True)
            except Exception as e:  # the reason is reported, not hidden
                bad.append((f, type(e).__name__))
    return good, bad


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Parquet at ``path`` if a finished write is there, else built, written and read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def labelled_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files of any kind."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def decode_files(spark: SparkSession, path: str, decoder: Callable[[bytes], list[float]]) -> DataFrame:
    """path and x: each file's bytes through ``decoder``, in Arrow batches."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"), decoder)


def decoded(files: DataFrame, decoder: Callable[[bytes], list[float]]) -> DataFrame:
    """path and x of a table of files (path, content)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column("path").slice(i, 1), pa.array([list(map(float, decoder(b.column("content")[i].as_py())))], pa.list_(pa.float64()))], names=["path", "x"])

    return files.mapInArrow(run, "path string, x array<double>")


def npy_decoder(data: bytes) -> list[float]:
    import io

    import numpy as np

    return np.load(io.BytesIO(data), allow_pickle=False).astype(float).ravel().tolist()


def wav_decoder(data: bytes) -> list[float]:
    """16-bit PCM, first channel, in [-1, 1)."""
    import io
    import wave

    import numpy as np

    with wave.open(io.BytesIO(data)) as w:
        return (np.frombuffer(w.readframes(w.getnframes()), "<i2")[:: w.getnchannels()] / 32768.0).tolist()


class NpzSource(DataSource):
    """``spark.read.format("npz").option("path", ...)``: array, i, value of every array of an .npz file.

    Each array is an input partition, so they load in parallel and never on the driver. The path must be
    readable where the executors run.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "array string, i bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options["path"])


class NpzReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import zipfile

        with zipfile.ZipFile(self.path) as z:
            return [InputPartition(n) for n in sorted(z.namelist())]

    def read(self, partition):
        import zipfile

        import numpy as np

        with zipfile.ZipFile(self.path) as z, z.open(partition.value) as f:
            values = np.load(f, allow_pickle=False).ravel()
        name = partition.value.removesuffix(".npy")
        for i, v in enumerate(values.tolist()):
            yield name, i, float(v)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")`` with options path, table, partitions, where (a condition in SQLite's terms), and schema; ranges of rowid are the partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        import sqlite3

        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
        with sqlite3.connect(self.options["path"]) as c:
            return ", ".join(f"`{r[1]}` {kinds.get((r[2] or 'TEXT').upper(), 'string')}" for r in c.execute(f'PRAGMA table_info("{self.options["table"]}")'))

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], [f.name for f in schema.fields], int(self.options.get("partitions", "4")), self.options.get("where", ""))


class SqliteReader(DataSourceReader):
    """Partitions hold like numbers of rows, however sparse their ids are; ``where`` is decided by SQLite, before rows leave it.

    Spark's own filters aren't pushed: its Python sources keep what one query has pushed for the next one on the same
    DataFrame (seen with 4.1.2), which then lacks rows.
    """

    def __init__(self, path: str, table: str, columns: list[str], parts: int, where: str = ""):
        self.path, self.table, self.columns, self.parts, self.where = path, table, columns, parts, where

    def partitions(self) -> list[InputPartition]:
        """Ranges of rowid between its own quantiles, found on the table's key."""
        import sqlite3

        with sqlite3.connect(self.path) as c:
            n = c.execute(f'SELECT count(*) FROM "{self.table}"').fetchone()[0]
            parts = min(self.parts, n)
            starts = [c.execute(f'SELECT rowid FROM "{self.table}" ORDER BY rowid LIMIT 1 OFFSET ?', (k * n // parts,)).fetchone()[0] for k in range(parts)]
            last = c.execute(f'SELECT max(rowid) FROM "{self.table}"').fetchone()[0]
        return [InputPartition((a, b - 1)) for a, b in zip(starts, [*starts[1:], last + 1], strict=True)] if n else []

    def read(self, partition):
        import sqlite3

        if partition is None:  # what Spark gives when there are no partitions
            return
        cols = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        where = "rowid BETWEEN ? AND ?" + (f" AND ({self.where})" if self.where else "")
        with sqlite3.connect(self.path) as c:
            yield from c.execute(f'SELECT {cols} FROM "{self.table}" WHERE {where}', partition.value)


def register(spark: SparkSession) -> None:
    """Makes the npz and sqlite formats known to the session."""
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(SqliteSource)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def dataset(name: str):
    """Registers a loader under a name: ``load(spark, name, path)`` finds it."""
    def add(f):
        REGISTRY[name] = f
        return f

    return add


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in REGISTRY:
        raise KeyError(f"no data set named {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](spark, path)


dataset("parquet")(lambda spark, path: spark.read.parquet(path))
dataset("csv")(csv_positions)
dataset("json")(json_objects)
