"""Near-duplicates: minima of many universal hashes, banding, verification on signatures and on full sets, components."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, ids_and_text, release, spread_join, stage, table
from .components import components
from .exact_dedup import BROADCAST_GROUPS, HOT_PARTS
from .textkernel import ORDER, U, chunks, lean, mix, shingle_sets, splitmix

ROWS = 5
#: A pair at the threshold is in no common band with at most this chance.
MISS = 1e-7
#: Standard errors by which a signature's estimate may fall short of the threshold.
SLACK = 5.0
#: Rows of a bucket compared in one task; a larger bucket is compared block by block.
BUCKET_ROWS = 4_096
#: Shingles, and rows, of a candidate group verified in one task; a larger group meets pivots first, and what no pivot
#: settles is verified block by block.
GROUP_SHINGLES = 2_000_000
GROUP_ROWS = 256
#: Documents of a large group with which all others are compared first.
PIVOTS = 4
#: Shingles of all pivots together up to which they are broadcast.
PIVOT_SHINGLES = 4_000_000
#: Groups up to this size are compared in one vectorised step.
SMALL = 24


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def signatures(data: np.ndarray, offsets: np.ndarray, k: int, bands: int, rows: int = ROWS):
    """Set sizes, 128-bit set hashes (2 columns), one byte of each minimum, and the bands' 64-bit keys."""
    sets, at = shingle_sets(data, offsets, k)
    n = np.diff(at)
    full = np.flatnonzero(n)
    h = np.zeros((2, len(n)), U)
    low = np.zeros((len(n), bands * rows), np.uint8)
    keys = np.zeros((len(n), bands), U)
    if len(full):
        first = at[:-1][full]
        factors = splitmix(bands * rows, 1234) | U(1)
        minima = np.empty((bands * rows, len(full)), U)
        with np.errstate(over="ignore"):
            for j, salt in enumerate((U(0), U(0x5851F42D4C957F2D))):
                h[j, full] = np.add.reduceat(mix(sets ^ salt), first)
            for i, a in enumerate(factors):
                minima[i] = np.minimum.reduceat((sets * a) >> U(32), first)
            for b in range(bands):
                part = np.full(len(full), b + 1, U)
                for r in range(rows):
                    part = mix(part * ORDER[r] + minima[b * rows + r])
                keys[full, b] = part
        low[full] = (minima & U(255)).astype(np.uint8).T
    return n, h, low, keys, sets, at


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _describe(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                n, h, low, keys, _, _ = signatures(data, offsets, k, bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), _binary(low), _lists(keys.reshape(-1), np.arange(b - a + 1) * bands)],
                    names=["doc_id", "n", "h1", "h2", "sig", "bands"])

    return lean(run)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                sets, at = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("comp").slice(a, b - a), _lists(sets, at)], names=["doc_id", "comp", "items"])

    return lean(run)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' borders, from rows sorted by ``keys``; no more is held than a batch and one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        cols = [t.column(c).to_numpy() for c in keys]
        new = np.zeros(t.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        if len(at):
            yield t.slice(0, at[-1]), np.concatenate([[0], at])
            held = t.slice(at[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        cols = [t.column(c).to_numpy() for c in keys]
        new = np.zeros(t.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        yield t, np.concatenate([[0], np.flatnonzero(new), [t.num_rows]])


def spanning(n: int, near, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links connect. ``near(i)``: mask of the rows linked with row i.

    ``label``: components that are known before (equal numbers); each row is one of its own if it's left out.
    A row is asked only while the rows that haven't been asked yet are in more than one component; rows
    outside the largest component are asked first, so a tight group costs a few steps and any group is
    exact: in the end no two rows that were never asked lie in different components.
    """
    label = np.arange(n) if label is None else label.copy()
    asked = np.zeros(n, bool)
    out = []
    while True:
        rest = np.flatnonzero(~asked)
        if len(rest) < 2:
            return out
        names, counts = np.unique(label[rest], return_counts=True)
        if len(names) < 2:
            return out
        big = names[np.argmax(counts)]
        i = rest[np.argmax(label[rest] != big)]
        asked[i] = True
        hit = near(i)
        hit[i] = False
        others = np.unique(label[hit])
        others = others[others != label[i]]
        if len(others):
            for other in others:
                out.append((int(i), int(np.flatnonzero(hit & (label == other))[0])))
            label[np.isin(label, others)] = label[i]


def _pairs(a: list, b: list) -> pa.RecordBatch:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _bucket_links(least: int):
    """Links (a, b) that span what the signatures of each bucket connect: ``least`` equal bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, ["key", "bi", "bj"]):
            ids = t.column("rep").to_numpy()
            column = t.column("sig").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            width = len(column[0].as_py())
            sig = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(ids), width)
            size = np.diff(at)
            a_out, b_out = [], []
            group = np.repeat(np.arange(len(size)), size)
            small = size[group] <= SMALL
            for d in range(1, min(SMALL, int(size.max()))):
                i = np.flatnonzero((group[d:] == group[:-d]) & small[:-d])
                for part in np.array_split(i, max(1, len(i) // 20_000)):
                    hit = part[(sig[part] == sig[part + d]).sum(1) >= least]
                    a_out.append(ids[hit])
                    b_out.append(ids[hit + d])
            for g in np.flatnonzero(size > SMALL):
                own = sig[at[g] : at[g + 1]]
                for i, j in spanning(len(own), lambda i, own=own: (own == own[i]).sum(1) >= least):
                    a_out.append([ids[at[g] + i]])
                    b_out.append([ids[at[g] + j]])
            if a_out:
                a, b = np.concatenate(a_out), np.concatenate(b_out)
                keep = a != b
                if keep.any():
                    pair = np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]]), axis=1)
                    yield _pairs(pair[0], pair[1])

    return lean(run)


def _verified(percent: int):
    """Links that span the pairs of a candidate group with 100 * intersection >= percent * union, on full sets.

    Rows marked ``main`` are known to be connected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, ["comp", "bi", "bj"]):
            ids = t.column("doc_id").to_numpy()
            main = t.column("main").to_numpy()
            items = t.column("items").combine_chunks()
            items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
            offsets = np.asarray(items.offsets)
            values = np.asarray(items.values)
            a_out, b_out = [], []
            for g in range(len(at) - 1):
                lo, hi = at[g], at[g + 1]
                if hi - lo < 2:
                    continue
                own = values[offsets[lo] : offsets[hi]]
                off = offsets[lo : hi + 1] - offsets[lo]
                n = np.diff(off)
                if hi - lo == 2:
                    both = len(np.intersect1d(own[: off[1]], own[off[1] :], assume_unique=True))
                    found = [(0, 1)] if 100 * both >= percent * (n[0] + n[1] - both) else []
                else:
                    names, code = np.unique(own, return_inverse=True)

                    def near(i, n=n, off=off, names=names, code=code):
                        mark = np.zeros(len(names), np.int64)
                        mark[code[off[i] : off[i + 1]]] = 1
                        both = np.add.reduceat(mark[code], off[:-1])
                        return 100 * both >= percent * (n + n[i] - both)

                    label = np.arange(hi - lo)
                    label[main[lo:hi]] = int(main[lo:hi].argmax())
                    found = spanning(hi - lo, near, label)
                a_out += [ids[lo + i] for i, _ in found]
                b_out += [ids[lo + j] for _, j in found]
            if a_out:
                yield _pairs(a_out, b_out)

    return lean(run)


def _blocks(df: DataFrame, node: str, parts: str) -> DataFrame:
    """(bi, bj): the pair of blocks in which each row is compared; every two rows of a key meet in at least one."""
    own = F.pmod(F.xxhash64(node), F.col(parts))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1), lambda o: F.struct(F.least(own, o).alias("bi"), F.greatest(own, o).alias("bj")))
    return df.withColumn("pair", F.explode(pair)).select("*", "pair.bi", "pair.bj").drop("pair")


def _linked(n, other_n, both, percent: int):
    return 100 * both >= percent * (n + other_n - both)


def _by_pivots(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to pivots, and what they leave over, from the full sets (comp, doc_id, items) of large groups.

    All documents of a group are compared with PIVOTS of it, where they lie: only pivots move. Of the components that
    this gives the largest is the main one; its documents needn't be compared with one another any more. The second
    table has (comp, bi, bj, doc_id, items, main) of the blocks in which every other document meets all documents of
    its group; groups that the pivots connect whole aren't in it. Blocks of either kind have a bounded number of rows
    and shingles.
    """
    # rows that repeat an id and its set count once; an id with several sets has a row for each
    own = stage(sets.withColumn("set", F.xxhash64("items")).dropDuplicates(["comp", "doc_id", "set"]).withColumn("n", F.size("items").cast("long")), "minhash-large")
    chosen = own.groupBy("comp").agg(*[F.min(F.struct(F.xxhash64(F.lit(p), "doc_id").alias("h"), "doc_id"))["doc_id"].alias(f"p{p}") for p in range(PIVOTS)])
    # a document chosen twice is one pivot: comparisons repeat, links don't
    long = chosen.select("comp", F.posexplode(F.array(*[f"p{p}" for p in range(PIVOTS)])).alias("p", "doc_id"))
    pivots = own.join(long, ["comp", "doc_id"]).groupBy("comp").agg(*[F.max(F.when(F.col("p") == p, F.struct("doc_id", "n", "items"))).alias(f"p{p}") for p in range(PIVOTS)])
    pivots = stage(pivots, "minhash-pivots")
    size = pivots.agg(F.sum(sum((F.col(f"p{p}.n") for p in range(PIVOTS)), F.lit(0)))).first()[0] or 0
    met = spread_join(own, pivots, ["comp"], "set", small=size <= PIVOT_SHINGLES)  # a group's sets stay apart either way
    mask = F.lit(0)
    for p in range(PIVOTS):
        both = F.size(F.array_intersect("items", f"p{p}.items"))
        mask = mask + F.when(_linked(F.col("n"), F.col(f"p{p}.n"), both, percent), 1 << p).otherwise(0)
    met = stage(met.select("comp", "doc_id", "set", "n", mask.alias("mask"), F.array(*[f"p{p}.doc_id" for p in range(PIVOTS)]).alias("to")), "minhash-met")
    hits = F.filter(F.transform("to", lambda d, p: F.when(F.call_function("shiftright", F.col("mask"), p).bitwiseAND(F.lit(1)) == 1, d)), lambda d: d.isNotNull() & (d != F.col("doc_id")))
    links = met.select("doc_id", F.explode(F.array_distinct(hits)).alias("to")).select(F.least("doc_id", "to").alias("a"), F.greatest("doc_id", "to").alias("b"))

    # pivots connected by documents that are linked with both; masks are few, so a group's fit one row
    kinds = met.groupBy("comp", "mask").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).groupBy("comp").agg(F.collect_list(F.struct("mask", "rows", "n")).alias("kinds"))

    def closure(p: int):
        rounds = F.sequence(F.lit(1), F.lit(PIVOTS))
        grow = lambda m, k: F.when(m.bitwiseAND(k["mask"]) != 0, m.bitwiseOR(k["mask"])).otherwise(m)
        return F.aggregate(rounds, F.lit(1 << p), lambda m, _: F.aggregate("kinds", m, grow))

    def total(m, name: str, inside: bool):
        return F.aggregate("kinds", F.lit(0).cast("long"), lambda acc, k: acc + F.when((k["mask"].bitwiseAND(m) != 0) == inside, k[name]).otherwise(0))

    best = F.array_max(F.array(*[F.struct(total(closure(p), "rows", True).alias("rows"), closure(p).alias("m")) for p in range(PIVOTS)]))["m"]
    kinds = kinds.withColumn("m", best)
    blocks = lambda inside: F.greatest(F.ceil(total(F.col("m"), "rows", inside) / GROUP_ROWS), F.ceil(total(F.col("m"), "n", inside) / GROUP_SHINGLES)).cast("long")
    open_ = kinds.select("comp", "m", blocks(True).alias("mains"), blocks(False).alias("rests")).filter("rests > 0")
    left = spread_join(met, stage(open_, "minhash-open"), ["comp"], "set").select("comp", "doc_id", "set", "mains", "rests", (F.col("mask").bitwiseAND(F.col("m")) != 0).alias("main"))
    # blocks of the rest are 0 .. rests - 1, those of the main component follow; one of a pair is of the rest
    at = F.pmod(F.xxhash64("doc_id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))) + F.when(F.col("main"), F.col("rests")).otherwise(F.lit(0))
    left = left.withColumn("at", at)
    others = F.when(F.col("main"), F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("rests") + F.col("mains") - 1))
    left = left.select("comp", "doc_id", "set", "main", "at", F.explode(others).alias("o"))
    left = left.select("comp", "doc_id", "set", "main", F.least("at", "o").alias("bi"), F.greatest("at", "o").alias("bj"))
    return links, own.join(left, ["comp", "doc_id", "set"]).select("comp", "bi", "bj", "doc_id", "items", "main")


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct ``words``-word
    shingles (A-Z lower-cased; words are runs outside ASCII white space; fewer words than that form one
    shingle). Texts without words, null texts included, have the empty set and are linked with nothing.
    component_id is the smallest doc_id that is reachable over links, itself included; kept marks the rows
    that have it. A row without id keeps to itself unless its set equals another's. Rows that share an id
    count as one document. Other columns are ignored; an empty table gives no rows.

    Steps: equal sets collapse to one representative; band keys with two members or more bring their
    signatures together; in each bucket the signatures' estimates (threshold less 5 standard errors) give
    spanning links; their components are the candidate groups, to which the full sets travel once; in each
    group spanning links are confirmed on full sets; their components are the result. In groups beyond a task's
    size all documents meet a few pivots where they lie, and only those that pivots don't connect are compared
    with all, block by block, so nothing is capped. A pair at the threshold is missed with a chance of about 1e-7.
    """
    threshold = percent / 100
    bands = bands_for(threshold)
    hashes = bands * ROWS
    estimate = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / hashes)
    least = math.ceil(hashes * (estimate + (1 - estimate) / 256))
    rows = ids_and_text(docs, id_col, text_col)
    made = stage(rows.mapInArrow(_describe(words, bands), "doc_id long, n long, h1 long, h2 long, sig binary, bands array<long>"), "minhash")
    reps = stage(made.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "minhash-reps")
    known = reps.filter("rep IS NOT NULL")
    keys = stage(known.select("rep", F.explode("bands").alias("key")), "minhash-keys")
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "minhash-shared")
    buckets = keys.join(broadcast_if_small(shared, BROADCAST_GROUPS), "key").join(known.select("rep", "sig"), "rep")
    buckets = _blocks(buckets.withColumn("parts", F.ceil(F.col("m") / BUCKET_ROWS)), "rep", "parts")
    at = ["key", "bi", "bj"]
    links = buckets.select(*at, "rep", "sig").repartition(*at).sortWithinPartitions(*at).mapInArrow(_bucket_links(least), "a long, b long")
    groups = components(links)
    release(docs.sparkSession)
    groups = groups.join(known.select(F.col("rep").alias("node"), "n"), "node")
    sizes = groups.groupBy("comp").agg(F.sum("n").alias("all_n"), F.count("*").alias("all_rows"))
    large = (F.col("all_n") > GROUP_SHINGLES) | (F.col("all_rows") > GROUP_ROWS)
    groups = stage(groups.select("node", "comp").distinct().join(sizes.select("comp", large.alias("large")), "comp"), "minhash-groups")

    def sets(of: DataFrame) -> DataFrame:
        own = rows.join(broadcast_if_small(of.select(F.col("node").alias("doc_id"), "comp"), BROADCAST_GROUPS), "doc_id")
        return own.select("doc_id", "comp", "text").mapInArrow(_sets(words), "doc_id long, comp long, items array<long>").filter(F.size("items") > 0)

    at = ["comp", "bi", "bj"]
    full = sets(groups.filter("NOT large")).select("comp", F.lit(0).cast("long").alias("bi"), F.lit(0).cast("long").alias("bj"), "doc_id", "items", F.lit(False).alias("main"))
    sure = full.repartition(*at).sortWithinPartitions(*at).mapInArrow(_verified(percent), "a long, b long")
    if not groups.filter("large").isEmpty():
        to_pivots, rest = _by_pivots(sets(groups.filter("large")), percent)
        sure = sure.unionByName(to_pivots).unionByName(rest.repartition(*at).sortWithinPartitions(*at).mapInArrow(_verified(percent), "a long, b long"))
    sure = components(sure)
    label = reps.join(sure, reps["rep"] == sure["node"], "left").select("h1", "h2", "copies", F.coalesce("comp", "rep").alias("comp"), F.col("comp").isNotNull().alias("linked"))
    label = stage(label.filter("copies > 1 OR linked"), "minhash-labels")
    thin = made.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("h1")).alias("h1"), F.when(F.col("n") > 0, F.col("h2")).alias("h2"))
    if label.count() <= BROADCAST_GROUPS:
        out = thin.join(F.broadcast(label), ["h1", "h2"], "left")
    else:
        floor = max(2, -(-made.count() // HOT_PARTS))
        hot = label.filter(F.col("copies") >= floor)
        out = thin.join(F.broadcast(hot), ["h1", "h2"], "inner").unionByName(thin.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(label.filter(F.col("copies") < floor), ["h1", "h2"], "left"))
    own = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one document of each near-duplicate group: the one with the smallest id."""
    key = free_name(docs, "gone_id")
    gone = near_components(docs, words, percent, id_col, text_col).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(key)).distinct()
    gone = broadcast_if_small(stage(gone, "minhash-gone"), 1_000_000)
    release(docs.sparkSession)
    return docs.join(gone, F.col(id_col) == F.col(key), "left_anti")


def op8_minhash(spark, sf_dir):
    """``near_components`` of all documents on three-word shingles at 85 %; null texts are linked with nothing, repeated rows come again."""
    return near_components(table(spark, sf_dir, "documents"), words=3, percent=85)
