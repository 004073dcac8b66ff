"""Helpers that every operator of this folder shares."""
from __future__ import annotations

import ctypes
import gc
import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import staged as stage  # noqa: F401  the other modules take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no other column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted at ``most_rows`` rows or fewer; otherwise as it is."""
    return F.broadcast(df) if df.count() <= most_rows else df


def release(spark: SparkSession) -> None:
    """Gives the driver's free memory back: Arrow's pool, Python's heap, and what the JVM no longer refers to.

    For steps that end after having held counts or plans of some 10 MB on the driver; results don't depend on it.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    spark.sparkContext._jvm.System.gc()


def process_store(name: str) -> dict:
    """A dictionary of this Python process. Functions travel by value, so their own globals are new in every task."""
    place = sys.modules.setdefault("_tidewin_process", types.ModuleType("_tidewin_process"))
    return place.__dict__.setdefault(name, {})


def look_up(rows: DataFrame, few: DataFrame, keys: list[str], copies: str, most_rows: int, hot_parts: int = 1_000) -> DataFrame:
    """``rows`` left-joined with ``few``, which has one row per key and in ``copies`` how many rows have that key.

    ``few`` is broadcast if it is counted at ``most_rows`` or fewer; beyond that only its hot keys are (those of at
    least 1/hot_parts of all rows, so at most ``hot_parts``), and their rows never meet in one task.
    """
    if few.count() <= most_rows:
        return rows.join(F.broadcast(few), keys, "left")
    least = max(2, -(-rows.count() // hot_parts))
    hot = few.filter(F.col(copies) >= least)
    keyed = rows.dropna(subset=keys)
    rest = keyed.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(few.filter(F.col(copies) < least), keys, "left")
    keyless = rows.filter(~F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))).join(F.broadcast(few.limit(0)), keys, "left")
    return keyed.join(F.broadcast(hot), keys).unionByName(rest).unionByName(keyless)


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str, most_rows: int = 10_000, places: int = 64, small: bool | None = None) -> DataFrame:
    """``rows`` joined with ``few`` (few rows per key), though one key may hold any share of ``rows``.

    ``few`` is broadcast up to ``most_rows`` (or if the caller, who knows its size, says that it is ``small``); beyond
    that each of its rows goes to ``places`` places, over which a key's rows are dealt by a hash of ``by``.
    """
    if few.count() <= most_rows if small is None else small:
        return rows.join(F.broadcast(few), keys)
    copies = few.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    return rows.withColumn("_place", F.pmod(F.xxhash64(by), F.lit(places)).cast("int")).join(copies, [*keys, "_place"]).drop("_place")
