"""Exact deduplication: a 128-bit content hash finds groups, a comparison of bytes confirms them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, ids_and_text, stage

#: Up to so many groups the group table is broadcast (about 120 bytes a row); beyond it, it is joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: A group with at least 1/HOT_PARTS of all rows is hot; there can be HOT_PARTS of them at most.
HOT_PARTS = 1_000


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = md5_128,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as the empty text, so empty and null rows form one
    group. The largest id of a group stays (nulls lose to any id; in a group without ids all rows stay).
    Rows that repeat both id and text can't be told apart: each counts in group_size, each is marked kept
    if its id is the one that stays. An empty table gives no rows; other columns are ignored.

    Plan: (1) hash and count, combined before the shuffle, so a hot group costs one row per task; (2) the
    texts whose hash repeats are grouped by hash and bytes, again combined map-side; (3) every row looks
    its group up, by broadcast while the group table is below ``broadcast_groups`` rows, else by a join
    in which the few hot groups are still broadcast and so never meet in one task.
    """
    rows = ids_and_text(docs, id_col, text_col).withColumn("h", content_hash(F.col("text")))
    repeated = stage(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "dup-hash")
    n_rep = repeated.count()
    small = n_rep <= broadcast_groups
    copies = rows.join(F.broadcast(repeated) if small else repeated, "h", "left_semi")
    groups = stage(
        copies.groupBy("h", "text").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n"))
        .select("h", F.sha2("text", 256).alias("sha"), "keep", "n"), "dup-groups")
    slim = rows.select("doc_id", "h", F.sha2("text", 256).alias("sha"))
    if small and groups.count() <= broadcast_groups:
        joined = slim.join(F.broadcast(groups), ["h", "sha"], "left")
    else:
        least = max(2, -(-docs.count() // HOT_PARTS))
        hot = groups.filter(F.col("n") >= least)
        joined = slim.join(F.broadcast(hot), ["h", "sha"], "inner").unionByName(
            slim.join(F.broadcast(hot.select("h", "sha")), ["h", "sha"], "left_anti").join(groups.filter(F.col("n") < least), ["h", "sha"], "left"))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows whose text another row with a larger id has.

    Dropped ids are looked up by an anti join on the id; rows that repeat id and text all stay or all go.
    """
    gone = exact_groups(docs, id_col, text_col).filter(~F.col("kept"))
    key = free_name(docs, "gone_id")
    sha = free_name(docs, "gone_sha")
    gone = gone.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct()
    gone = broadcast_if_small(stage(gone, "dup-gone"), BROADCAST_GROUPS)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == F.col(sha)), "left_anti")


def op4_exact_dedup(spark, sf_dir):
    """``exact_groups`` of all documents; null texts are empty texts, repeated rows come again."""
    from .common import table

    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))
"""
