"""How sources of a language differ: terms counted in radix tries, merged by ranges of prefixes, read in UTF-8 order."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread_join, stage, table
from .minhash import _groups
from .textkernel import LOWER, chunks, lean, per_text, runs

#: Bytes of text that one trie is built from before it is merged into the task's.
CHUNK = 1 << 22
#: Tries held before they are merged, and leaf counters at which a task writes its trie out and begins another.
HELD = 8
COUNTERS = 2_000_000
#: Pairs of sources of a term worked on at once; sums held before they are written out.
PAIRS = 1 << 21
SUMS = 2_000_000
LEAST_DOCUMENTS = 3
TOP = 200
#: Probabilities are whole numbers of 1/SCALE.
SCALE = 1_000_000_000
#: Bytes that terms are made of: ASCII letters, and all of other characters.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True


def _sums(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys in order, sums of the values, and each row's place among the keys."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return tuple(k[order][at] for k in keys), tuple(np.add.reduceat(v[order], at) if n else v for v in values), place


class Trie:
    """A radix trie with edges of eight bytes, in arrays; leaves count occurrences and documents by group.

    ``levels[k]``: the parents and edges of the nodes at depth k, ordered by both, so that nodes are numbered in the
    order of their paths. Edges are big-endian numbers, so their order is that of UTF-8; a shorter last edge ends in zero
    bytes, which terms don't have. ``leaves[k]``: node, group, occurrences, documents of the terms that end there.
    """

    def __init__(self, levels: list, leaves: list) -> None:
        self.levels, self.leaves = levels, leaves

    @property
    def size(self) -> int:
        return sum(len(x[0]) for x in self.leaves)

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, group: np.ndarray) -> Trie:
        """The trie of data[start:end] of each term; ``doc`` numbers its document, ``group`` has each document's group."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), ">u8", padded.tobytes(), strides=(1,))
        levels, leaves = [], []
        parent = np.zeros(len(starts), np.int64)
        n_docs = len(group)
        while len(starts):
            edge = eight[starts].astype(np.uint64)
            left = ends - starts
            short = np.flatnonzero(left < 8)
            edge[short] &= ~np.uint64(0) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))
            if levels:
                (p, e), _, node = _sums((parent, edge), ())
            else:
                (e,), _, node = _sums((edge,), ())
                p = np.zeros(len(e), np.int64)
            levels.append((p, e))
            end = left <= 8
            (code,), (times,), _ = _sums((node[end] * n_docs + doc[end],), (np.ones(int(end.sum()), np.int64),))
            leaves.append(_counted(code // n_docs, group[code % n_docs], times, np.ones(len(code), np.int64)))
            starts, ends, doc, parent = starts[~end] + 8, ends[~end], doc[~end], node[~end]
        return cls(levels, leaves)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """One trie with the sums of all counters."""
        levels, leaves = [], []
        places = [np.zeros(1, np.int64)] * len(tries)
        for depth in range(max((len(t.levels) for t in tries), default=0)):
            there = [(i, t) for i, t in enumerate(tries) if depth < len(t.levels)]
            parents = [places[i][t.levels[depth][0]] for i, t in there]
            (p, e), _, place = _sums((np.concatenate(parents), np.concatenate([t.levels[depth][1] for _, t in there])), ())
            levels.append((p, e))
            cuts = np.cumsum([len(x) for x in parents])[:-1]
            for (i, _), own in zip(there, np.split(place, cuts), strict=True):
                places[i] = own
            node = np.concatenate([places[i][t.leaves[depth][0]] for i, t in there])
            leaves.append(_counted(node, *[np.concatenate([t.leaves[depth][c] for _, t in there]) for c in (1, 2, 3)]))
        return cls(levels, leaves)

    def terms(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """Terms with group, occurrences and documents, in runs of one depth."""
        for depth, (node, group, n, docs) in enumerate(self.leaves):
            if not len(node):
                continue
            own, place = np.unique(node, return_inverse=True)
            path = np.zeros((len(own), depth + 1), ">u8")
            at = own
            for k in range(depth, -1, -1):
                path[:, k] = self.levels[k][1][at]
                at = self.levels[k][0][at]
            text = path.view(f"S{8 * (depth + 1)}").reshape(-1)  # numpy leaves trailing zero bytes out
            yield pa.array(text.tolist(), pa.binary()).cast(pa.string()).take(pa.array(place)), group, n, docs


def _counted(node, group, n, docs):
    (node, group), (n, docs), _ = _sums((node, group), (n, docs))
    return node, group, n, docs


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: a task's counts; a row without term for each group that occurs."""
    number: dict[tuple[str, str], int] = {}
    held: list[Trie] = []

    def rows(trie: Trie) -> Iterator[pa.RecordBatch]:
        lang, source = (pa.array([g[i] for g in number], pa.string()) for i in (0, 1))
        for term, group, n, docs in trie.terms():
            at = pa.array(group)
            yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), term, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        group = np.array([number.setdefault(p, len(number)) for p in pairs], np.int64)
        for a, b, data, offsets in chunks(batch.column("text"), CHUNK):
            low = LOWER[data]
            starts, ends = runs(TERM[low], offsets)
            doc = np.repeat(np.arange(b - a), np.diff(per_text(starts, offsets)))
            held.append(Trie.of(low, starts, ends, doc, group[a:b]))
            if len(held) == HELD:
                held = [Trie.merged(held)]
                if held[0].size > COUNTERS:
                    yield from rows(held.pop())
    if held:
        yield from rows(Trie.merged(held))
    if number:
        zero = pa.array(np.zeros(len(number), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in number], pa.string()), pa.array([g[1] for g in number], pa.string()), pa.nulls(len(number), pa.string()), zero, zero], names=["lang", "source", "term", "n", "docs"])


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _PairSums:
    """Sums by ordered pair of groups: what terms of both add beyond what each adds alone, and their number."""

    def __init__(self) -> None:
        self.keys, self.values, self.both = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, at: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        """Rows of whole terms: term g has rows at[g] to at[g + 1]."""
        size = np.diff(at)
        partners = np.repeat(size, size)
        first = np.repeat(at[:-1], size)
        upto = np.cumsum(partners)
        row = 0
        while row < len(partners):
            end = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + PAIRS, "right")))
            n = partners[row:end]
            i = np.repeat(np.arange(row, end), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[row:end], n)
            keep = i != j
            i, j = i[keep], j[keep]
            value = gap(p[i], p[j]) - gap(p[i], p0[j]) - gap(p0[i], p[j]) + gap(p0[i], p0[j])
            keys = np.concatenate([self.keys, group[i] << 32 | group[j]])
            (self.keys,), (self.values, self.both), _ = _sums((keys,), (np.concatenate([self.values, value]), np.concatenate([self.both, np.ones(len(i), np.int64)])))
            row = end


class _Best:
    """The TOP candidates of each group by value; of equal values those met first, which is the order of the terms."""

    def __init__(self, top: int) -> None:
        self.top, self.group, self.value, self.term = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, group: np.ndarray, value: np.ndarray, term: np.ndarray) -> None:
        group, value, term = (np.concatenate(x) for x in ((self.group, group), (self.value, value), (self.term, term)))
        order = np.lexsort((np.arange(len(group)), -value, group))
        g = group[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        rank = np.arange(len(g)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(g) else order
        keep = np.sort(order[rank < self.top])  # back to the order of meeting
        self.group, self.value, self.term = group[keep], value[keep], term[keep]


def _traverse(top: int):
    """Rows in the order of language and term: sums for pairs of groups, and each group's leading terms."""
    names = ["part", "lang", "source", "item", "value", "both"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        pairs, best = _PairSums(), _Best(top)

        def rows() -> Iterator[pa.RecordBatch]:
            lang, source = (np.array([g[i] for g in number], object) for i in (0, 1))
            for part, group, item, value, both in (("pair", pairs.keys >> 32, source[pairs.keys & 0xFFFFFFFF], pairs.values, pairs.both), ("term", best.group, best.term, best.value, np.zeros(len(best.group), np.int64))):
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(group), pa.string()), pa.array(lang[group], pa.string()), pa.array(source[group], pa.string()), pa.array(item, pa.string()), pa.array(value), pa.array(both)], names=names)

        for t, at in _groups(batches, ["lang", "term"]):
            own = list(zip(t.column("lang").to_pylist(), t.column("source").to_pylist(), strict=True))
            group = np.array([number.setdefault(g, len(number)) for g in own], np.int64)
            p, p0, q = (t.column(c).to_numpy() for c in ("p", "p0", "q"))
            pairs.add(at, group, p, p0)
            lead = np.flatnonzero(p > q)
            best.add(group[lead], gap(p[lead], q[lead]), t.column("term").to_numpy()[lead])
            if len(pairs.keys) + len(best.group) > SUMS:
                yield from rows()
                pairs, best = _PairSums(), _Best(top)
        if number:
            yield from rows()

    return lean(run)


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), in decimals, so that no product overflows."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), total.cast("decimal(19,0)"))).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, docs from each task's trie, a row without term per group: to be summed over tasks."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    return rows.mapInArrow(lean(_count_terms), "lang string, source string, term string, n long, docs long")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language differ in their terms.

    Terms are runs of ASCII letters and other characters beyond ASCII, A-Z lower-cased. A language keeps the V terms
    that ``least`` of its rows have. A group (language, source) or a language gives a term
    p = 1 + floor(10^9 * (count + 1) / (N + V)), N the group's count of kept terms. Part ``pair``: for each other source of the
    language, the sum over all kept terms of floor((p - q)^2 / q), q being the other's p. Part ``term``: the ``top`` terms
    that a group has and gives more than its language does, by the same measure. Ranks go by value, then by item in UTF-8.

    Null text, language and source are empty ones; a row is a document, so repeated rows count again; a group without
    terms gives all terms the same p (value 0 if nothing is kept); a language with one source has no pairs; an empty
    table gives no rows; other columns are ignored. All arithmetic is exact while counts stay below 10^18.

    Steps: tasks count terms in tries; the tries' leaves are merged in ranges of (language, term); a second pass reads
    the kept leaves in that order. A term that neither of two sources has adds the same to all such pairs, one that only
    one has adds what its count alone decides, so only sources that share a term meet in it. Sums and leading terms
    leave a task when they are many; nothing is held whole anywhere.
    """
    tries = stage(term_counts(docs, text_col, lang_col, source_col), "terms-tries")
    term = Window.partitionBy("lang", "term")
    leaves = tries.filter("term IS NOT NULL").repartitionByRange("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    leaves = leaves.select("lang", "term", "source", "n", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("lang_n"), F.min("source").over(term).alias("first"))
    leaves = stage(leaves.filter(F.col("df") >= least).select("lang", "term", "source", "n", "lang_n", (F.col("first") == F.col("source")).alias("once")), "terms-leaves")

    totals = stage(leaves.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"), F.sum(F.col("once").cast("long")).alias("once")), "terms-totals")
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("once").alias("v"))
    groups = tries.filter("term IS NULL").select("lang", "source").distinct().join(totals.drop("once"), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "own", "lang_total", "v")])
    some = F.col("total") + F.col("v")
    groups = stage(groups.withColumn("p0", F.when(some > 0, _share(F.lit(0), F.greatest(some, F.lit(1))))), "terms-groups")

    known = spread_join(leaves.drop("once"), groups.drop("own"), ["lang", "source"], "term")
    known = known.select("lang", "term", "source", _share(F.col("n"), F.col("total") + F.col("v")).alias("p"), "p0", _share(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("q"))
    known = stage(known, "terms-shares")
    found = known.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    found = stage(found.mapInArrow(_traverse(top), "part string, lang string, source string, item string, value long, both long"), "terms-found")

    # what one source's terms add whatever the other has: by distinct shares, not by terms
    kinds = known.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    met = spread_join(kinds, other, ["lang"], "p").filter(F.col("other") != F.col("source"))
    alone = met.select("lang", F.inline(F.array(
        F.struct(F.col("source"), F.col("other").alias("item"), (F.col("times") * _gap(F.col("p"), F.col("o0"))).alias("value")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (F.col("times") * _gap(F.col("o0"), F.col("p"))).alias("value")))))
    shared = found.filter("part = 'pair'").select("lang", "source", "item", "value", "both")
    sums = alone.withColumn("both", F.lit(0).cast("long")).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ends = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("item_own"), F.col("p0").alias("q0"))
    every = groups.select("lang", "source", "own", "v", "p0").join(ends, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
    absent = (F.col("v") - F.col("own") - F.col("item_own")) * _gap(F.col("p0"), F.col("q0"))
    pair = every.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + absent).otherwise(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    lead = found.filter("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(lead)


def op11_source_divergence(spark, sf_dir):
    """``source_divergence`` of all documents: terms of at least 3 documents, 200 leading terms a group."""
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + v))::HUGEINT AS p, (1 + (1000000000::HUGEINT * (kept.n + 1)) // (langs.total + v))::HUGEINT AS q
  FROM g JOIN kept ON g.lang = kept.lang JOIN langs ON g.lang = langs.lang JOIN s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.item = b.source),
lead AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM lead)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""
