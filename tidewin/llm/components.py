"""Connected components by alternating large-star and small-star, on DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage


#: A node with more edges than this, and than 1/500 of all edge ends, is hot; so at most 500 nodes are.
HOT_EDGES = 1_000


def _hot(edges: DataFrame, n: int) -> DataFrame | None:
    """The hot nodes of the ``n`` edges: a table of 500 rows at most, or None."""
    ends = edges.select("u").unionByName(edges.select(F.col("v").alias("u")))
    hot = stage(ends.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > max(HOT_EDGES, 2 * n // 500)).select("u"), "hot-nodes")
    return hot if hot.count() else None


def _with_least(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``edges`` plus m, the least v of their u. A node's edges meet in one place, but those of hot nodes: their m is broadcast."""
    m = F.min("v").over(Window.partitionBy("u"))
    if hot is None:
        return edges.withColumn("m", m)
    own = edges.join(F.broadcast(hot), "u")
    few = own.groupBy("u").agg(F.min("v").alias("m"))  # one row a hot node
    return own.join(F.broadcast(few), "u").unionByName(edges.join(F.broadcast(hot), "u", "left_anti").withColumn("m", m))


def _large_star(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, hot).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The larger neighbours move to the least one; the edge to that one says that the node itself does."""
    return _with_least(edges, hot).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (the smallest node that it reaches) for every node of an edge; loops and nulls are ignored.

    Each step is two windows over nodes and two distincts, four shuffles in all; the edge set never grows beyond its first size, and
    every step's edges are staged in the shared folder, so a lost executor costs one step at most. Only a
    count and a checksum come to the driver.
    """
    now = stage(_clean(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    was, state = None, _state(now)
    while state != was and state[0]:
        hot = _hot(now, state[0])
        now = stage(_clean(_small_star(_clean(_large_star(now, hot)), hot)), "edges")
        was, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
