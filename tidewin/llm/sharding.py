"""Sharding by histogram sort: byte counts below candidate boundaries, refined until splitters meet a tolerance."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ids_and_text, stage, table

#: Candidate boundaries of one refined interval in one round.
PROBES = 2_048
#: Keys are non-negative 63-bit integers.
TOP = 1 << 63


@dataclass(frozen=True)
class Splitter:
    """Rows with (k1, k2) < (hi, lo) lie below it."""
    hi: int
    lo: int


def sort_keys(text, doc_id):
    """(k1, k2): a hash of the text, so that equal texts are neighbours, then a hash of the id, so that even a hot group can be cut anywhere."""
    return F.shiftrightunsigned(F.xxhash64(text), 1), F.shiftrightunsigned(F.xxhash64(doc_id), 1)


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.002, probes: int = PROBES) -> list[Splitter]:
    """Splitters that cut ``keys`` (k1, k2, size) into ``shards`` parts of near equal bytes.

    Each round counts exact bytes per candidate interval around every splitter that isn't settled: one
    aggregate that is combined map-side and returns ``shards * probes`` rows at most. A splitter is settled
    when its bytes are within ``tolerance`` of a shard's share, or when its interval holds one key. If one
    k1 (a group of equal texts) is all that is left and is too large for the tolerance, k2 is refined too,
    so a group with a third of all bytes is cut; smaller groups stay whole.
    """
    total, most = keys.agg(F.sum("size"), F.max("size")).first()
    if not total:
        return [Splitter(0, 0)] * (shards - 1)
    share = total / shards
    allowed = max(tolerance * share, 1.0)
    settled: dict[int, Splitter] = {}
    # splitter -> (level, fixed k1, low, high, bytes below low)
    active = {i: (1, 0, 0, TOP, 0) for i in range(1, shards)}
    while active:
        spans = sorted({v[:4] for v in active.values()})
        number = {s: n for n, s in enumerate(spans)}
        cut = None
        for n, (level, fixed, low, high) in enumerate(spans):
            key = F.col("k1") if level == 1 else F.col("k2")
            inside = (key >= low) & (key <= high - 1) if level == 1 else (F.col("k1") == fixed) & (key >= low) & (key <= high - 1)
            width = -(-(high - low) // probes)
            value = F.lit(n).cast("long") * probes + F.expr(f"({'k1' if level == 1 else 'k2'} - {low}L) div {width}L")
            cut = F.when(inside, value) if cut is None else cut.when(inside, value)
        found = (keys.select(cut.alias("c"), "size").filter("c IS NOT NULL").groupBy("c").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
        cells: dict[int, list[tuple[int, int, int]]] = {}
        for r in found:
            cells.setdefault(r["c"] // probes, []).append((r["c"] % probes, r["b"], r["n"]))
        again = {}
        for i, (level, fixed, low, high, below) in active.items():
            want, at = i * share, below
            width = -(-(high - low) // probes)
            for cell, b, n in sorted(cells.get(number[level, fixed, low, high], [])):
                if at + b < want:
                    at += b
                    continue
                left, right = low + cell * width, min(high, low + (cell + 1) * width)
                make = (lambda x: Splitter(x, 0)) if level == 1 else (lambda x, f=fixed: Splitter(f, x))
                near = make(left) if want - at <= at + b - want else make(right)
                off = min(want - at, at + b - want)
                if off <= allowed or n == 1:
                    settled[i] = near
                elif right - left > 1:
                    again[i] = (level, fixed, left, right, at)
                elif level == 1 and off > most:
                    again[i] = (2, left, 0, TOP, at)
                else:
                    settled[i] = near
                break
            else:
                settled[i] = Splitter(high if level == 1 else fixed, 0 if level == 1 else high)
        active = again
    out = [settled[i] for i in range(1, shards)]
    return sorted(out, key=lambda s: (s.hi, s.lo))


def shard_of(splitters: list[Splitter]):
    """The number of splitters at or below a row's key."""
    n = F.lit(0)
    for s in splitters:
        hi = F.lit(min(s.hi, TOP - 1))
        above = (F.col("k1") > hi) | ((F.col("k1") == hi) & (F.col("k2") >= F.lit(min(s.lo, TOP - 1))))
        n = n + F.when(above if s.hi < TOP else F.lit(False), 1).otherwise(0)
    return n.cast("int")


def histogram_shards(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text", cells: int = 16_384) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the UTF-8 bytes of the text plus 1 (null text: 1). A splitter is off by the tolerance or by the
    largest row, whichever is more, and a shard, which lies between two, by twice that at most; equal texts share a shard unless their group alone
    would break that. slot counts from 0 without gaps in key order; rows that repeat id and text follow one
    another. Null ids are ordinary values. Empty input gives no rows; other columns are ignored.

    The keys (about 30 bytes a row) are staged once for the rounds of counting. The rows move in one
    exchange, by cells that are bounded ranges of a shard's keys: no shard ever has to fit a task. A hot
    text gets cells of its own by the second key; the tables of cells and of hot texts are bounded by
    ``cells + 256 * 1,024`` and by 1,024 rows.
    """
    rows = ids_and_text(docs, id_col, text_col)
    k1, k2 = sort_keys(F.col("text"), F.col("doc_id"))
    keyed = rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"), k1.alias("k1"), k2.alias("k2"))
    keys = stage(keyed, "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)
    n = keys.count()
    bits = max(0, min(cells, n // 64).bit_length() - 1)
    placed = keys.withColumn("shard", shard_of(splitters)).withColumn("c1", F.expr(f"shiftrightunsigned(k1, {63 - bits})") if bits else F.lit(0).cast("long"))
    hot = placed.groupBy("k1").agg(F.count("*").alias("n")).filter(F.col("n") >= max(64, n // 1_024)).select("k1", F.lit(True).alias("is_hot"))
    hot_bits = max(0, min(256, n // 64).bit_length() - 1)
    spread = F.expr(f"shiftrightunsigned(k2, {63 - hot_bits})") if hot_bits else F.lit(0).cast("long")
    # within c1, rows below, in and above a hot text must not interleave: c2 is that text's key, or the hot key just below
    placed = placed.join(F.broadcast(hot), "k1", "left").withColumn("c2", F.when(F.col("is_hot"), F.col("k1")).otherwise(F.lit(-1))).withColumn("c3", F.when(F.col("is_hot"), spread).otherwise(F.lit(0)))
    cell = ["shard", "c1", "c2", "c3"]
    counts = placed.groupBy(*cell).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("c1", "c2", "c3").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.select(*cell, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")), "shard-cells")
    slot = F.row_number().over(Window.partitionBy(*cell).orderBy("k1", "k2", "doc_id", "text_crc32")) - 1
    out = placed.select("doc_id", "size", "text_crc32", *cell, slot.alias("local")).join(F.broadcast(counts), cell)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("local")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark, sf_dir):
    """``histogram_shards`` of all documents into 16 shards; a null text has size 1, repeated rows come again."""
    return histogram_shards(table(spark, sf_dir, "documents"))
