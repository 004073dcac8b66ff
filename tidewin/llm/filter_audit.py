"""What filters do to one another: a packed bitmap index, AND-NOT and popcount for every set of filters applied before."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import look_up, stage, table
from .exact_dedup import BROADCAST_GROUPS
from .textkernel import SPACE, U, chunks, lean, mix, per_text, prefix, runs, slices

#: Rows of a task that are ordered by part and packed at once.
BLOCK = 1 << 16
#: Distinct ids with a label up to which the labels are broadcast.
LABELS_BROADCAST = 200_000
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
SYMBOLS = b"#$%&*|"


def _text_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, the four failures that a text alone decides, and the text's SHA-256."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column("text")):
            starts, ends = runs(~SPACE[data], offsets)
            first = per_text(starts, offsets)
            words = np.diff(first)
            text = np.repeat(np.arange(b - a), words)
            with np.errstate(over="ignore"):
                key = mix(slices(prefix(data), starts, ends) + mix(text.astype(U) + U(1)))
            order = np.argsort(key)
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            distinct = np.bincount(text[order][new], minlength=b - a)

            def count(mask: np.ndarray, offsets=offsets) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

            points = count((data & 0xC0) != 0x80)
            raw = data.tobytes()
            sha = [hashlib.sha256(raw[offsets[i] : offsets[i + 1]]).digest() for i in range(b - a)]
            flags = [words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * count((data >= 65) & (data <= 90)) > CAPITAL_PERCENT * points, count(symbol[data]) > 0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("part").slice(a, b - a), *[pa.array(f) for f in flags], pa.array(sha, pa.binary())], names=["doc_id", "part", "A", "B", "C", "D", "sha"])


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, part and A to E, true where a document fails: one row per input row.

    A: under 200 words; B: distinct words below 50 % of all; C: capitals A-Z above 2 % of the code points; D: any
    of ``#$%&*|``; E: the text of a row with a smaller id is the same. Words are runs outside ASCII white space,
    as they stand. A null text is empty (it fails A, and E if an empty text has a smaller id); a null part is the
    empty string. A row without an id is never smaller or larger than another; repeats of one row don't fail E
    for one another. Long texts are read whole. Other columns are ignored; an empty table gives no rows.

    One scan of the texts; equal texts are found by their SHA-256, counted before the shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    made = stage(rows.mapInArrow(lean(_text_flags), f"doc_id {id_type}, part string, A boolean, B boolean, C boolean, D boolean, sha binary"), "filter-flags")
    copies = stage(made.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1"), "filter-copies")
    found = look_up(made, copies, ["sha"], "copies", broadcast_groups)
    return found.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame, marks: dict[str, Column], id_col: str = "doc_id", most_rows: int = LABELS_BROADCAST) -> DataFrame:
    """``rows`` plus a boolean per mark: whether any row of ``labels`` with that id has it. Null ids have none."""
    own = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(m) for m, c in marks.items()])
    own = stage(own.filter(" OR ".join(marks)), "filter-labels")
    if own.count() <= most_rows:
        found = rows.join(F.broadcast(own), id_col, "left")
    else:
        own = own.join(rows.groupBy(id_col).agg(F.count("*").alias("_copies")), id_col)
        found = look_up(rows, stage(own, "filter-labels"), [id_col], "_copies", most_rows)
    return found.select(*rows.columns, *[F.coalesce(m, F.lit(False)).alias(m) for m in marks])


def _pack(names: list[str]):
    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        part = t.column("part").chunk(0).dictionary_encode()
        code = np.asarray(part.indices)
        order = np.argsort(code, kind="stable")
        n = np.bincount(code, minlength=len(part.dictionary))
        width = -(-n // 8)
        ends = np.cumsum(width)
        # each part begins at a byte of its own
        slot = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n) + 8 * np.repeat(ends - width, n)
        columns = []
        for name in names:
            bits = np.zeros(8 * int(ends[-1]), bool)
            bits[slot] = t.column(name).to_numpy()[order]
            raw = np.packbits(bits).tobytes()
            columns.append([raw[e - w : e] for e, w in zip(ends.tolist(), width.tolist(), strict=True)])
        bitmaps = pa.array([list(x) for x in zip(*columns, strict=True)], pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([part.dictionary, pa.array(n.astype(np.int64)), bitmaps], names=["part", "n", "bitmaps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                n += held[-1].num_rows
                if n >= BLOCK:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return lean(run)


def bitmap_index(rows: DataFrame, names: list[str], part: str = "part") -> DataFrame:
    """part, n, bitmaps: the boolean columns ``names`` of ``rows``, packed eight rows to a byte (null: false).

    A row of the index has some rows of one part, from one task; the order of rows is the same in all its bitmaps.
    Rows are never moved: a task orders a block of them by part, whatever the number of parts.
    """
    flags = rows.select(F.col(part).alias("part"), *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in names])
    return flags.mapInArrow(_pack(names), "part string, n long, bitmaps array<binary>")


def _popcounts(filters: int, labels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            width = -(-n // 8)
            starts = np.cumsum(width) - width
            flat = batch.column("bitmaps").flatten().to_pylist()
            bits = [np.frombuffer(b"".join(flat[k :: filters + labels]), np.uint8) for k in range(filters + labels)]
            there = np.full(int(width.sum()), 255, np.uint8)
            there[starts + width - 1] = (0xFF00 >> (n - 8 * (width - 1))) & 0xFF  # the last byte's bits that are rows
            for subset in range(1 << filters):
                gone = np.zeros(len(there), np.uint8)
                for k in range(filters):
                    if subset >> k & 1:
                        gone |= bits[k]
                alive = there & ~gone
                counts = [np.add.reduceat(np.bitwise_count(alive & m).astype(np.int64), starts) for m in (there, *bits[filters:])]
                yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(np.full(len(n), subset, np.int32)), *[pa.array(c) for c in counts]], names=["part", "gone", *[f"c{k}" for k in range(labels + 1)]])

    return lean(run)


def kept_by_subset(index: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """part, gone, rows and a count per label: what is left of each part after the set ``gone`` of filters.

    ``index``: bitmaps of the filters, then of the labels. Bit k of ``gone`` stands for filter k. One AND-NOT and a
    popcount per set and bitmap, then a sum over partitions: 2**filters rows a part, whatever the rows.
    """
    schema = "part string, gone int, " + ", ".join(f"c{k} long" for k in range(len(labels) + 1))
    counted = index.mapInArrow(_popcounts(len(filters), len(labels)), schema)
    return counted.groupBy("part", "gone").agg(*[F.sum(f"c{k}").alias(name) for k, name in enumerate(["rows", *labels])])


def interactions(kept: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """A row per part, order of the filters (joined names) and step, from ``kept_by_subset``.

    kept and removed after and by the step's filter; redundant: rows that fail it but went before; unique_fails: rows
    that fail it alone; <label>_lost: removed rows with the label; shapley: its removed rows, summed over all orders.
    """
    every = (1 << len(filters)) - 1
    steps = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(filters[k] for k in order)).alias("filter_order"), F.lit(step + 1).alias("step"), F.lit(f).alias("f"), F.lit(before).alias("before"), F.lit(before | 1 << f).alias("after")))
            before |= 1 << f
    at = lambda key, name="rows": F.col("kept_by")[key][name]
    parts = kept.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("gone", F.struct("rows", *labels)))).alias("kept_by"))
    weights = []
    for f in range(len(filters)):
        sets = [s for s in range(every + 1) if not s >> f & 1]
        ways = [math.factorial(s.bit_count()) * math.factorial(len(filters) - 1 - s.bit_count()) for s in sets]
        weights.append(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(s | 1 << f).alias("after"), F.lit(w).cast("long").alias("w")) for s, w in zip(sets, ways, strict=True)]))
    shapley = F.array(*[F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + x["w"] * (at(x["before"]) - at(x["after"]))) for w in weights])
    alone = F.array(*[at(every & ~(1 << f)) - at(every) for f in range(len(filters))])
    fails = F.array(*[at(0) - at(1 << f) for f in range(len(filters))])
    rows = parts.select("part", "kept_by", shapley.alias("shapley"), alone.alias("alone"), fails.alias("fails"), F.explode(F.array(*steps)).alias("o"))
    removed = at(F.col("o.before")) - at(F.col("o.after"))
    return rows.select(
        "part", "o.filter_order", "o.step", at(F.col("o.after")).alias("kept"), removed.alias("removed"), (F.col("fails")[F.col("o.f")] - removed).alias("redundant"), F.col("alone")[F.col("o.f")].alias("unique_fails"),
        *[(at(F.col("o.before"), x) - at(F.col("o.after"), x)).alias(f"{x}_lost") for x in labels], F.col("shapley")[F.col("o.f")].alias("shapley"))


FILTERS = ["A", "B", "C", "D", "E"]
LABELS = ["good", "toxic"]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the five filters of ``document_flags`` over all documents, by source.

    A document is good or toxic if any of its rows in ``labels`` says 1; null labels say nothing. What documents with
    odd values fail is told there. An empty table gives no rows.
    """
    rows = with_labels(document_flags(docs), labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    index = stage(bitmap_index(rows, [*FILTERS, *LABELS]), "filter-bitmaps")
    return interactions(stage(kept_by_subset(index, FILTERS, LABELS), "filter-kept"), FILTERS, LABELS)


def op12_filter_audit(spark, sf_dir):
    """``filter_audit`` of all documents and labels."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > first_id THEN 16 ELSE 0 END AS m
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, m, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM x p JOIN x q ON q.c <> p.c JOIN x r ON r.c NOT IN (p.c, q.c) JOIN x s ON s.c NOT IN (p.c, q.c, r.c) JOIN x t ON t.c NOT IN (p.c, q.c, r.c, s.c)),
steps AS (SELECT filter_order, step, bits[step] AS b, list_sum(bits[1:step])::BIGINT AS upto FROM o, range(1, 6) AS i(step)),
k AS (SELECT part, filter_order, step, b,
    sum(CASE WHEN m & upto = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & (upto - b) = 0 AND m & b > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & (upto - b) > 0 AND m & b > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = b THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & (upto - b) = 0 AND m & b > 0 THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & (upto - b) = 0 AND m & b > 0 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM g, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM k
"""
