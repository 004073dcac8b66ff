"""Sinks: compressed Parquet, one CSV file, upserts, contiguous registration, resumable appends."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """zstd Parquet, optionally in folders by column and sorted inside files, so that statistics prune scans."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header; for reports, whose rows fit one task."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with ``new``'s rows in place of those with the same keys. Columns that ``old`` hasn't are ignored, missing ones are NULL.

    Of several new rows with one key, one stays, the one with the largest values.
    """
    cols = [c for c in old.columns if c in new.columns]
    rest = [c for c in cols if c not in keys]
    one = new.select(*cols).groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else new.select(*keys).distinct()
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one, allowMissingColumns=True).select(*old.columns)


def register_windows(have: DataFrame, new: DataFrame, dataset: str, order: list[str]) -> DataFrame:
    """``have`` plus ``new`` as windows of ``dataset`` with ids after the largest; the same number of rows already there: unchanged.

    Ids are dense: row numbers inside cells of a fixed split of the order, plus the rows before each cell.
    """
    there = have.filter(F.col("dataset") == dataset)
    if there.count() == new.count() and there.count():
        return have
    rest = have.filter(F.col("dataset") != dataset)
    top = rest.agg(F.coalesce(F.max("window_id"), F.lit(-1)).alias("_top"))
    series = Window.partitionBy(order[0])
    rows = new.withColumn("_i", F.row_number().over(series.orderBy(*order[1:])) - 1)
    from ..operators.ordering import sums_before

    size = sums_before(new.groupBy(order[0]).agg(F.count("*").alias("_n")), [], order[0], ["_n"]) if dict(new.dtypes)[order[0]] != "string" else new.groupBy(order[0]).agg(F.count("*").alias("_n")).withColumn("_n_before", F.coalesce(F.sum("_n").over(Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = rows.join(size.select(order[0], F.col("_n_before")), order[0]).crossJoin(F.broadcast(top))
    out = out.withColumns({"window_id": F.col("_top") + 1 + F.col("_n_before") + F.col("_i"), "dataset": F.lit(dataset)}).drop("_i", "_n_before", "_top")
    return rest.unionByName(out, allowMissingColumns=True)


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows for which the condition isn't true (NULL keeps the row)."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def unfinished(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return plan.join(done.select(*keys), keys, "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys ``path`` hasn't; their number. A run that is repeated adds nothing."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df = unfinished(df, spark.read.parquet(path), keys)
    before = spark.read.parquet(path).count() if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else 0
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before
