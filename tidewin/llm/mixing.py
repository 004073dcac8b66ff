"""Mixing sources to target weights: exact quotas, split over output shards by a hypergeometric tree."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, stage, table

#: No source is taken more often than this.
MOST = 3
#: Blocks of all sources together; each block is a range of a source's permuted documents.
BLOCKS = 32_768
#: Documents of a block, at least (about).
BLOCK_DOCS = 16
#: Documents around a source's cut of which those are taken that come nearest to its target.
CHOICE = 24
BITS = 40


def water_fill(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Targets that sum to all sizes, in proportion to ``weights``, none above ``most`` times its size; the excess is shared anew by weight."""
    targets = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            open_.discard(i)
        left = float(sum(sizes)) - sum(targets[i] for i in range(len(sizes)) if i not in open_)
    return targets


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many of each source's block draws go to each shard.

    A node holds exact counts of every source and splits them between its halves by a multivariate
    hypergeometric draw, so the counts of all shards add up to the quotas, whatever the draws.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        mid = (first + last) // 2
        take = int(round(int(have.sum()) * (mid - first) / (last - first)))
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)
        split(first, mid, left)
        split(mid, last, have - left)

    split(0, shards, quotas.astype(np.int64))
    return out


def nearest_subset(sizes: list[int], want: float) -> list[int]:
    """Places of the ``sizes`` whose sum comes nearest to ``want``: the exact best, by sums of halves.

    Of equally near ones the first in a fixed order, so that reruns agree. 2 ** (len(sizes) / 2) sums a half.
    """
    half = len(sizes) // 2

    def sums(part: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for x in part:
            out = np.concatenate([out, out + x])
        return out

    left, right = sums(sizes[:half]), sums(sizes[half:])
    order = np.argsort(right, kind="stable")
    at = np.searchsorted(right[order], want - left)
    best = (float("inf"), 0, 0)
    for shift in (-1, 0):
        k = np.clip(at + shift, 0, len(order) - 1)
        off = np.abs(left + right[order[k]] - want)
        i = int(off.argmin())
        best = min(best, (float(off[i]), i, int(order[k[i]])))
    return [j for j in range(half) if best[1] >> j & 1] + [half + j for j in range(len(sizes) - half) if best[2] >> j & 1]


@dataclass
class Plan:
    """What the driver decides: one entry a source, and one row a block draw."""
    names: list
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    #: Block draws of each source, the last of them in part.
    quotas: list[int]
    #: (shards, sources) block draws.
    tree: np.ndarray
    #: source: its blocks in the order in which they are drawn, pass after pass, and the shard and slot of each draw.
    draws: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: source: the last draws, of which a part of the documents is taken; by their places in the draws.
    tails: list[list[int]]
    #: source: place of the draw and key up to which the tail's documents are taken, and further keys.
    upto: list[tuple[int, int]]
    chosen: list[list[int]]


def permutation_key(doc_id, text, seed: int):
    """A 40-bit place of a document in its source's permutation; rows that repeat id and text share it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 64 - BITS)


def block_of(key, blocks):
    return F.shiftrightunsigned(key * blocks, BITS)


def keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), permutation_key(F.col(id_col), text, seed).alias("key"))


def make_plan(rows: DataFrame, shards: int, seed: int) -> Plan:
    """Quotas, tree and draws, from aggregates of ``rows`` (doc_id, source, size, key).

    A source's documents stand in blocks by a seeded hash, and its blocks in one random order a pass. Its quota is
    the number of blocks that this sequence needs to reach the target. The tree splits the quotas among the shards;
    each shard draws its number of the source's next blocks, so draws are disjoint, and what is drawn is what is
    taken: all of a block but in the last two draws, where whole documents are taken up to the cut and CHOICE of
    them around it are chosen so that the source comes nearest to its target. To the driver come one row a source,
    one a block and CHOICE documents a source: the number of sources and BLOCKS bound them, not the documents.
    """
    found = sorted(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes, counts = [r["source"] for r in found], [r["size"] for r in found], [r["n"] for r in found]
    targets = water_fill(sizes, [i % 3 + 1 for i in range(len(names))])
    each = max(BLOCK_DOCS, -(-sum(counts) // BLOCKS)) if counts else 1
    blocks = [max(1, n // each) for n in counts]
    passes = [int(t // s) if s else 0 for t, s in zip(targets, sizes)]
    part = [t - p * s for t, s, p in zip(targets, sizes, passes)]
    spark = rows.sparkSession
    if not names:
        return Plan([], [], [], [], [], np.zeros((shards, 0), np.int64), [], [], [], [])
    info = spark.createDataFrame(list(zip(names, range(len(names)), blocks)), "source string, s int, blocks long")
    numbered = rows.join(F.broadcast(info), rows["source"].eqNullSafe(info["source"])).select("s", "size", "key", block_of(F.col("key"), F.col("blocks")).alias("block"))
    words = [np.zeros(b, np.int64) for b in blocks]
    for r in numbered.groupBy("s", "block").agg(F.sum("size").alias("w")).collect():
        words[r["s"]][r["block"]] = r["w"]
    sequence, quotas, tails, upto, chosen, cuts = [], [], [], [], [], []
    for i, b in enumerate(blocks):
        order = np.concatenate([np.random.default_rng([seed, 7, i, p]).permutation(b) for p in range(passes[i] + 1)])
        last = passes[i] * b
        ends = np.cumsum(words[i][order[last:]])
        # full passes only: not even documents without words come once more
        whole = int(np.searchsorted(ends, part[i], "right")) if part[i] >= 1 else 0
        quota = last + (min(whole + 1, b) if part[i] >= 1 else 0)
        tail = list(range(max(last, quota - 2), quota))
        if tail:
            before = tail[0] - last
            room = part[i] - (ends[before - 1] if before else 0)
            cuts += [(i, int(order[j]), j, float(room)) for j in tail]
        sequence.append(order[:quota])
        quotas.append(quota)
        tails.append(tail)
        upto.append((-1, -1))
        chosen.append([])
    if cuts:
        inside = numbered.join(F.broadcast(spark.createDataFrame(cuts, "s int, block long, draw int, room double")), ["s", "block"])
        # rows that share a key (equal ids and texts) are taken together
        inside = inside.groupBy("s", "draw", "key").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
        in_order, all_ = Window.partitionBy("s").orderBy("draw", "key"), Window.partitionBy("s")
        inside = inside.withColumn("sum", F.sum("size").over(in_order)).withColumn("place", F.row_number().over(in_order))
        inside = inside.withColumn("docs", F.count("*").over(all_)).withColumn("cut", F.sum((F.col("sum") <= F.col("room")).cast("int")).over(all_))
        first = F.greatest(F.least(F.col("cut") - CHOICE // 2, F.col("docs") - CHOICE), F.lit(0))
        near = inside.withColumn("first", first).filter(f"place >= first AND place <= first + {CHOICE}")
        by_source: dict[int, list] = {}
        for r in near.collect():
            by_source.setdefault(r["s"], []).append(r)
        for i, found_ in by_source.items():
            found_.sort(key=lambda r: r["place"])
            room = found_[0]["room"]
            if found_[0]["place"] == found_[0]["first"]:
                head = found_.pop(0)
                upto[i] = (head["draw"], head["key"])
                room -= head["sum"]
            chosen[i] = [found_[j]["key"] for j in nearest_subset([r["size"] for r in found_], room)]
    tree = splitting_tree(np.array(quotas, np.int64), shards, seed)
    slots = [np.random.default_rng([seed, 8, k]).permutation(int(tree[k].sum())) for k in range(shards)]
    draws, used = [], [0] * shards
    for i, order in enumerate(sequence):
        owner = np.repeat(np.arange(shards), tree[:, i])
        place = np.empty(len(order), np.int64)
        for k in range(shards):
            n = int(tree[k, i])
            place[owner == k] = slots[k][used[k] : used[k] + n]
            used[k] += n
        draws.append((order, owner, place))
    return Plan(names, sizes, targets, blocks, quotas, tree, draws, tails, upto, chosen)


def _decided(spark, rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` (with source, size, key and any further columns) plus s, takes, shards and slots (one entry a take)."""
    sources = [(n, i, int(plan.blocks[i]), int(plan.sizes[i]), float(plan.targets[i]), *plan.upto[i], plan.chosen[i]) for i, n in enumerate(plan.names)]
    info = spark.createDataFrame(sources, "m_source string, s int, m_blocks long, source_size long, target double, m_upto int, m_upto_key long, m_chosen array<long>")
    drawn: dict[tuple[int, int], tuple[list, list, list]] = {(i, k): ([], [], []) for i, b in enumerate(plan.blocks) for k in range(b)}
    for i, (order, owner, place) in enumerate(plan.draws):
        for j, (block, shard, slot) in enumerate(zip(order.tolist(), owner.tolist(), place.tolist())):
            whole_shards, whole_slots, tail = drawn[i, block]
            if j in plan.tails[i]:
                tail.extend((j, shard, slot))
            else:
                whole_shards.append(shard)
                whole_slots.append(slot)
    spots = spark.createDataFrame([(i, k, a, b, *(t or (None, None, None))) for (i, k), (a, b, t) in drawn.items()], "s int, m_block long, m_shards array<int>, m_slots array<int>, m_draw int, m_shard int, m_slot int")
    out = rows.join(F.broadcast(info), rows["source"].eqNullSafe(info["m_source"]))
    out = out.withColumn("m_block", block_of(F.col("key"), F.col("m_blocks"))).join(F.broadcast(spots), ["s", "m_block"])
    before = (F.col("m_draw") < F.col("m_upto")) | ((F.col("m_draw") == F.col("m_upto")) & (F.col("key") <= F.col("m_upto_key")))
    extra = F.col("m_draw").isNotNull() & (before | F.array_contains("m_chosen", F.col("key")))
    plus = lambda all_, one: F.when(extra, F.concat(all_, F.array(one))).otherwise(F.col(all_))
    out = out.withColumn("shards", plus("m_shards", "m_shard")).withColumn("slots", plus("m_slots", "m_slot")).withColumn("takes", F.size("shards"))
    return out.drop(*(c for c in info.columns + spots.columns if c.startswith("m_")))


def mixture(docs: DataFrame, shards: int = 16, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, takes, shards, slots, taken.

    ``shards`` and ``slots`` have one entry a take: the shard, and the place in it of the block draw that took the document.

    size counts words (runs outside ASCII white space; null text: 0). Sources are ordered by code point, a
    null source last and a source like any other; their weights are 1, 2, 3, repeating; targets share the
    sum of all sizes and stop at 3 times their source's size. Whole documents are taken, as the tree's block draws
    say: floor(target/size) times all of a source, and once more the blocks that fill the rest. The same input
    and seed give the same rows. Rows that repeat id and text are taken together. Empty tables give no rows; a
    source without words is taken no time.
    """
    rows = stage(keyed(docs, seed, id_col, text_col, source_col), "mix-keys")
    plan = make_plan(rows, shards, seed)
    return _decided(docs.sparkSession, rows, plan).select("doc_id", "source", "size", "source_size", "target", "takes", "shards", "slots", (F.col("size") * F.col("takes")).alias("taken"))


def mix_documents(docs: DataFrame, shards: int = 16, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, dealt to its shards and shuffled inside them.

    Has the columns of ``docs``. A shard's rows are split over several partitions by their random place, so
    neither a shard nor a source has to fit a task; inside a partition rows stand in random order. Null texts have
    no words and come only in full passes, a null source is a source like any other, an empty table gives no rows.
    """
    plan = make_plan(stage(keyed(docs, seed, id_col, text_col, source_col), "mix-keys"), shards, seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # input columns travel inside one struct, so none of their names can clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m_row"), F.col(source_col).alias("source"), permutation_key(F.col(id_col), text, seed).alias("key"))
    out = _decided(docs.sparkSession, packed, plan).select("m_row", F.posexplode("shards").alias("m_take", "m_shard"), "key")
    place = F.xxhash64(F.lit(seed + 1), "key", "m_take")
    n = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = out.withColumn("m_place", place).repartition(n, "m_shard", F.pmod("m_place", F.lit(max(1, 64 * n // shards)))).sortWithinPartitions("m_shard", "m_place")
    return out.select("m_row.*")


def op3_mixing(spark, sf_dir):
    """``mixture`` of all documents; a null text has no words, a null source is the last source, repeated rows come again."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "takes", "shards", "slots")
