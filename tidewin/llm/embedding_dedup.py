"""Near-duplicate vectors: random projections decoded to points of the E8 lattice, neighbouring cells, cosines, components."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, look_up, spread_join, stage, table
from .components import components
from .exact_dedup import BROADCAST_GROUPS
from .minhash import _groups, _pairs, spanning
from .textkernel import U, lean, mix, splitmix

#: Lattice points in a key: a cell is a pair of points of E8, so 16 projections.
BLOCKS = 2
#: A vector enters so many cells of each table: its own and the nearest neighbours.
PROBES = 6
#: Scale of the lattice, in distances that two unit vectors at the threshold have. In simulations a pair at the
#: threshold then shares a cell of a table with a chance of 0.927, and unrelated vectors with one of 1.7e-5.
WIDTH = 8.0
#: Tables. A pair at the threshold shares no cell of any with a chance of about 1e-8; closer pairs with less.
TABLES = 7
#: Vectors of a cell, or of a component, compared in one task; more are compared block by block.
ROWS = 2_048
#: Groups up to this size are compared in one vectorised step.
SMALL = 24
#: Vectors projected at once.
CHUNK = 2_048


def least_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or eight halves with an even number of minus signs."""
    ones = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [h for h in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0]
    return np.array(ones + [list(h) for h in halves])


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where rounding gives an odd one, the worst coordinate goes the other way."""
    near = np.rint(x)
    gap = x - near
    worst, row = np.abs(gap).argmax(1), np.arange(len(x))
    turned = near.copy()
    turned[row, worst] += np.where(gap[row, worst] >= 0, 1, -1)
    return np.where((near.sum(1) % 2 != 0)[:, None], turned, near)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: E8 is the points with an even sum, and those moved by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def nearest_points(x: np.ndarray, n: int, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` nearest of the decoded point and its 240 neighbours (rows, n, 8), and their squared distances."""
    home = decode(x)
    rest = x - home
    d = (rest**2).sum(1)[:, None] - 2 * rest @ steps.T + (steps**2).sum(1)
    near = np.argpartition(d, n - 1, axis=1)[:, :n]
    return home[:, None, :] + steps[near], np.take_along_axis(d, near, 1)


def cell_keys(unit: np.ndarray, seed: np.ndarray, threshold: float, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES) -> np.ndarray:
    """(rows, tables * probes) keys of the cells that each unit vector enters; ``seed``: a hash of what must be equal."""
    dim = unit.shape[1]
    rng = np.random.Generator(np.random.PCG64(20_240 + dim))
    scale = WIDTH * math.sqrt(2 - 2 * threshold)
    turn = rng.standard_normal((tables * blocks, dim, 8)) / scale
    move = rng.random((tables * blocks, 8))
    factors = splitmix(8 * blocks + 1, 8_008) | U(1)
    steps = np.concatenate([np.zeros((1, 8)), least_vectors()])
    out = np.zeros((len(unit), tables * probes), U)
    with np.errstate(over="ignore"):
        for t in range(tables):
            keys, far = np.zeros((len(unit), 1), U), np.zeros((len(unit), 1))
            for b in range(blocks):
                points, d = nearest_points(unit @ turn[t * blocks + b] + move[t * blocks + b], probes, steps)
                code = (np.rint(points * 2).astype(np.int64).view(U) * factors[8 * b : 8 * b + 8]).sum(2, dtype=U)
                keys = (keys[:, :, None] + code[:, None, :]).reshape(len(unit), -1)
                far = (far[:, :, None] + d[:, None, :]).reshape(len(unit), -1)
            best = np.argpartition(far, probes - 1, axis=1)[:, :probes]
            out[:, t * probes : (t + 1) * probes] = mix(np.take_along_axis(keys, best, 1) + seed[:, None] + U(t) * factors[-1])
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of packed vectors of one length."""
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, np.float64 if len(raw) == 8 * dim * len(column) else np.float32).reshape(len(column), dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square leaves the range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, with a 128-bit hash of them."""
    for batch in batches:
        lists = batch.column("v")
        wide = lists.type.value_type == pa.float64()
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64 if wide else np.float32)
        values = values + values.dtype.type(0)  # no negative zeros
        sizes = lists.value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
        raw = values.tobytes()
        vecs = [raw[ends[i] : ends[i + 1]] for i in range(len(sizes))]
        hashes = [hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(hashes, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "label", "dim", "h", "vec"])


def _cells(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    one = batch.filter(pa.array(dims == dim))
                    seed = one.column("lab").to_numpy().view(U) + U(dim)
                    keys = cell_keys(_matrix(one.column("vec"), int(dim)), seed, threshold)
                    offsets = pa.array((np.arange(len(keys) + 1) * keys.shape[1]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([one.column("node"), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))], names=["node", "keys"])

    return lean(run)


class _Held:
    """The vectors of some whole groups, and which rows are linked. Rows meet if label and length agree."""

    def __init__(self, t: pa.Table, threshold: float) -> None:
        self.threshold = threshold
        self.dim = t.column("dim").to_numpy()
        label = t.column("label").combine_chunks().dictionary_encode()
        self.kind = np.asarray((label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices).astype(np.int64) * (int(self.dim.max()) + 1) + self.dim
        self.vec = np.zeros((t.num_rows, int(self.dim.max())))
        packed = t.column("vec").combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        for d in np.unique(self.dim):
            rows = np.flatnonzero(self.dim == d)
            self.vec[rows, :d] = _matrix(packed.take(pa.array(rows)), int(d))
        self.place = t.column("at").to_numpy()

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (np.einsum("ij,ij->i", self.vec[i], self.vec[j]) >= self.threshold) & (self.kind[i] == self.kind[j])

    def block(self, rows: slice, others: slice, across: bool) -> np.ndarray:
        """Linked (rows x others), no row with itself; ``across``: only rows of different blocks."""
        hit = (self.vec[rows] @ self.vec[others].T >= self.threshold) & (self.kind[rows, None] == self.kind[None, others])
        if across:
            return hit & (self.place[rows, None] != self.place[None, others])
        i = np.arange(rows.start, rows.stop)
        inside = (i >= others.start) & (i < others.stop)
        hit[np.flatnonzero(inside), i[inside] - others.start] = False
        return hit


def _small_pairs(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs inside groups of 2 to SMALL rows, in runs."""
    group = np.repeat(np.arange(len(size)), size)
    small = size[group] <= SMALL
    for d in range(1, min(SMALL, int(size.max()))):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[:-d])
        for part in np.array_split(i, max(1, len(i) // 50_000)):
            yield part, part + d


def _links(threshold: float):
    """Links (a, b) that span what the cosines of each cell, or pair of its blocks, connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, ["key", "bi", "bj"]):
            held, ids = _Held(t, threshold), t.column("node").to_numpy()
            across = t.column("bi").to_numpy() != t.column("bj").to_numpy()
            main = t.column("main").to_numpy()
            size = np.diff(at)
            a, b = [], []
            for i, j in _small_pairs(size):
                hit = held.pairs(i, j) & ~(across[i] & (held.place[i] == held.place[j]))
                a.append(ids[i[hit]])
                b.append(ids[j[hit]])
            for g in np.flatnonzero(size > SMALL):
                lo, hi = int(at[g]), int(at[g + 1])
                label = np.arange(hi - lo)
                if main[lo:hi].any():
                    label[main[lo:hi]] = int(main[lo:hi].argmax())
                for i, j in spanning(hi - lo, lambda i, lo=lo, hi=hi: held.block(slice(lo + i, lo + i + 1), slice(lo, hi), bool(across[lo]))[0], label):
                    a.append([ids[lo + i]])
                    b.append([ids[lo + j]])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield _pairs(pair[0], pair[1])

    return lean(run)


def _counts(threshold: float):
    """(node, n): rows that each vector is linked with in its component, or pair of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, ["comp", "bi", "bj"]):
            held, copies = _Held(t, threshold), t.column("copies").to_numpy()
            across = t.column("bi").to_numpy() != t.column("bj").to_numpy()
            size = np.diff(at)
            n = np.zeros(t.num_rows, np.int64)
            for i, j in _small_pairs(size):
                hit = held.pairs(i, j) & ~(across[i] & (held.place[i] == held.place[j]))
                np.add.at(n, i[hit], copies[j[hit]])
                np.add.at(n, j[hit], copies[i[hit]])
            for g in np.flatnonzero(size > SMALL):
                lo, hi = int(at[g]), int(at[g + 1])
                for s in range(lo, hi, 512):
                    rows = slice(s, min(hi, s + 512))
                    n[rows] += held.block(rows, slice(lo, hi), bool(across[lo])) @ copies[lo:hi]
            yield pa.RecordBatch.from_arrays([t.column("node").combine_chunks(), pa.array(n)], names=["node", "n"])

    return lean(run)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the cosine to their group's pivot; null if label or length differ."""
    for batch in batches:
        cos = np.full(batch.num_rows, np.nan)
        dims = batch.column("dim").to_numpy()
        same = np.array([a == b for a, b in zip(batch.column("label").to_pylist(), batch.column("p_label").to_pylist(), strict=True)], bool) & (dims == batch.column("p_dim").to_numpy())
        for d in np.unique(dims[same]):
            rows = pa.array(np.flatnonzero(same & (dims == d)))
            cos[rows.to_numpy()] = (_matrix(batch.column("vec").take(rows), int(d)) * _matrix(batch.column("p_vec").take(rows), int(d))).sum(1)
        keep = [c for c in batch.schema.names if c not in ("p_label", "p_dim", "p_vec")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(cos)], names=[*keep, "cos"])


def _to_pivots(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` of large groups plus p_node and cos: one vector of each group is met by all others where they lie."""
    pivot = F.min(F.struct(F.xxhash64("node").alias("_h"), "node", "label", "dim", "vec")).alias("p")
    pivots = stage(rows.groupBy(by).agg(pivot).select(by, *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("node", "label", "dim", "vec")]), "vectors-pivots")
    met = spread_join(rows, pivots, [by], "node")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema if f.name not in ("p_label", "p_dim", "p_vec"))
    return stage(met.mapInArrow(_cosines, f"{schema}, cos double"), "vectors-met")


def _in_blocks(rows: DataFrame, by: str, most: int) -> DataFrame:
    """``rows`` (with ``main``) plus at, bi, bj: pairs of blocks in which all pairs of rows meet but those of two main rows.

    Groups with main rows alone aren't in it. A pair of rows counts once: inside (bi, bi), or across (bi, bj).
    """
    size = rows.groupBy(by).agg(F.ceil(F.sum(F.when(~F.col("main"), 1).otherwise(0)) / most).cast("long").alias("rests"), F.ceil(F.sum(F.when(F.col("main"), 1).otherwise(0)) / most).cast("long").alias("mains"))
    left = spread_join(rows, stage(size.filter("rests > 0"), "vectors-blocks"), [by], "node")
    at = F.when(F.col("main"), F.col("rests") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rests")))
    first = F.lit(0).cast("long")
    others = F.when(F.col("main"), F.sequence(first, F.col("rests") - 1)).otherwise(F.sequence(first, F.col("rests") + F.col("mains") - 1))
    left = left.withColumn("at", at).withColumn("o", F.explode(others))
    return left.withColumns({"bi": F.least("at", "o"), "bj": F.greatest("at", "o")}).drop("o", "rests", "mains")


def _alone(rows: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return rows.withColumns({"main": F.lit(False), "at": zero, "bi": zero, "bj": zero})


def vector_components(
    rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", most: int = ROWS, broadcast_groups: int = BROADCAST_GROUPS
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels (``label_col`` None: all) and equal length are linked when their cosine, in
    double precision, is ``threshold`` or more. n_links counts the other rows linked directly, copies included;
    component_id is the smallest id reachable over links, its own included; kept marks the rows that have it. Null, empty and
    zero vectors, vectors with null or non-finite components and those with a null label are linked with nothing. A
    row without an id is linked like any other, but its component is named by another row's id (null if there is
    none). Rows that share an id are rows of their own. Other columns are ignored; an empty table gives no rows.

    Steps: equal vectors collapse to one with a number of copies; each enters PROBES cells in TABLES tables; vectors
    that share a cell are compared, and links that span what is connected there are kept; their components are then
    compared whole, which counts every link inside. Large cells and components first meet one of their vectors: what
    that links with is connected already, and what lies within half the threshold's angle of it is linked with
    all others of that kind by the triangle inequality, so neither is compared again; the rest meets all, block by
    block. No pair is ever a row. A pair at the threshold is in no common cell with a chance of about 1e-8, and is still
    counted if both are connected otherwise.
    """
    x = F.col(vec_col)
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    fine = label.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    kind = "double" if "double" in rows.schema[vec_col].dataType.simpleString() else "float"
    slim = rows.select(F.col(id_col).alias("vec_id"), label.alias("label"), x.cast(f"array<{kind}>").alias("v"), fine.alias("fine"))
    id_type = slim.schema["vec_id"].dataType.simpleString()
    made = stage(slim.filter("fine").select("vec_id", "label", "v").mapInArrow(_pack, f"vec_id {id_type}, label string, dim int, h binary, vec binary"), "vectors")
    own = ["label", "dim", "h"]
    reps = made.groupBy(*own).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    reps = stage(reps.withColumn("node", F.monotonically_increasing_id()), "vectors-reps")

    keys = reps.select("node", "dim", F.xxhash64("label").alias("lab"), "vec").mapInArrow(_cells(threshold), "node long, keys array<long>")
    keys = stage(keys.select("node", F.explode("keys").alias("key")), "vectors-keys")
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "vectors-shared")
    cells = keys.join(broadcast_if_small(shared, broadcast_groups), "key").join(reps.select("node", "label", "dim", "vec"), "node")
    columns = ["key", "bi", "bj", "at", "main", "node", "label", "dim", "vec"]
    met = _alone(cells.filter(F.col("m") <= most)).select(*columns)
    direct = None
    if not shared.filter(F.col("m") > most).isEmpty():
        large = _to_pivots(cells.filter(F.col("m") > most).drop("m"), "key").withColumn("main", F.coalesce(F.col("cos") >= threshold, F.lit(False)) & ~F.isnan("cos"))
        direct = large.filter("main AND node <> p_node").select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b"))
        met = met.unionByName(_in_blocks(large, "key", most).select(*columns))
    by = ["key", "bi", "bj"]
    links = met.repartition(*by).sortWithinPartitions(*by).mapInArrow(_links(threshold), "a long, b long")
    links = links if direct is None else links.unionByName(direct)
    comps = stage(components(links), "vectors-comps")

    sizes = stage(comps.groupBy("comp").agg(F.count("*").alias("m")), "vectors-sizes")
    members = comps.join(reps.select("node", "label", "dim", "vec", "copies"), "node")
    columns = ["comp", "bi", "bj", "at", "main", "node", "label", "dim", "vec", "copies"]
    big = stage(sizes.filter(F.col("m") > most).select("comp"), "vectors-large")
    met, core = _alone(members).select(*columns), None
    if not big.isEmpty():
        met = _alone(members.join(broadcast_if_small(big, broadcast_groups), "comp", "left_anti")).select(*columns)
        inner = math.cos(math.acos(threshold) / 2) + 1e-9  # within half the angle, with room for rounding
        large = _to_pivots(spread_join(members, big, ["comp"], "node"), "comp").withColumn("main", F.coalesce(F.col("cos") >= inner, F.lit(False)) & ~F.isnan("cos"))
        total = stage(large.filter("main").groupBy("comp").agg(F.sum("copies").alias("core")), "vectors-core")
        core = spread_join(large.filter("main"), total, ["comp"], "node").select("node", (F.col("core") - F.col("copies")).alias("n"))
        met = met.unionByName(_in_blocks(large, "comp", most).select(*columns))
    by = ["comp", "bi", "bj"]
    n = met.repartition(*by).sortWithinPartitions(*by).mapInArrow(_counts(threshold), "node long, n long")
    n = (n if core is None else n.unionByName(core)).groupBy("node").agg(F.sum("n").alias("n"))

    named = comps.join(reps.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = spread_join(comps, stage(named, "vectors-named"), ["comp"], "node").select("node", "component_id")
    found = reps.join(named, "node", "left").join(n, "node", "left").filter("copies > 1 OR n > 0")
    found = stage(found.select(*own, "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "rep").alias("comp")), "vectors-found")
    out = look_up(made.select("vec_id", *own), found, own, "copies", broadcast_groups)
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("comp")).alias("component_id"))
    lone = slim.filter("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def drop_near_vectors(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """``rows`` with all their columns, one vector of each component: those with the smallest id. Rows without an id stay."""
    key = free_name(rows, "gone_id")
    gone = vector_components(rows, threshold, id_col, vec_col, label_col).filter("NOT kept AND vec_id IS NOT NULL").select(F.col("vec_id").alias(key)).distinct()
    return rows.join(broadcast_if_small(stage(gone, "vectors-gone"), 1_000_000), F.col(id_col) == F.col(key), "left_anti")


def op13_embedding_dedup(spark, sf_dir):
    """``vector_components`` of all embeddings at a cosine of 0.98; vectors without a label or with odd components are linked with nothing."""
    return vector_components(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS to_id FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.to_id = l.a),
least AS (SELECT node, min(to_id) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = a LEFT JOIN least ON vec_id = node
"""
