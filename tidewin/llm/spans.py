"""Spans of regular-expression matches, with DataFrame functions only.

A span is struct(kind, rank, start, stop, ...), in code points, stop exclusive. ``regexp_extract_all`` gives the
matches and ``split`` the text between them; running lengths of both give the places. What a lambda needs again
is bound to a lambda variable (``let``), as the optimiser doesn't lift it out; running sums are built block by
block and texts are cut from fixed pieces, so that a text with many thousand matches costs time in proportion to
its length. (Appending is quadratic inside a block of BLOCK and over blocks of blocks, which counts from some ten
million matches a text on.)
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches in one block of a running sum.
BLOCK = 256
#: Code points in one piece of a text.
PIECE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and however deep inside lambdas it's used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, state: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """array<out_type>: ``step(state, item)`` gives the next state and the item's output."""

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{out_type}>").alias("out")), one)
        return F.struct(inner["state"].alias("state"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    def run(all_: Column) -> Column:
        # by elements, as ``slice`` copies the whole array
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.transform(F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, F.size(all_)) - 1), lambda i: F.get(all_, i)))
        return F.flatten(F.aggregate(parts, F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out")), block)["out"])

    return let(items, lambda all_: F.when(F.size(all_) > 0, run(all_)).otherwise(F.array().cast(f"array<{out_type}>")))


def located(text: Column, found: Column, pattern: str) -> Column:
    """array<struct(m, start)>: each string of ``found`` (all matches of ``pattern`` in order) with its first code point's place."""
    none = F.array().cast("array<struct<m:string,gap:int>>")
    gaps = F.transform(F.split(text, F.lit(pattern), -1), lambda g: F.length(g))
    pairs = F.slice(F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap"))), F.lit(1), F.size(found))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        return start + F.length(x["m"]), F.struct(x["m"].alias("m"), start.alias("start"))

    return scan(F.when(F.size(found) > 0, pairs).otherwise(none), F.lit(0), "struct<m:string,start:int>", step)


def pieces(text: Column) -> Column:
    """The text in an array of strings of PIECE code points (the last has the rest)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` to ``stop`` (exclusive) of the text that ``pieces`` took apart; costs no more than these and two pieces."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((stop - 1) / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(parts, first), F.lit("")), F.coalesce(F.get(parts, first + 1), F.lit("")))
    near = F.when(last - first <= 1, two).otherwise(F.array_join(F.slice(parts, first + 1, last - first + 1), ""))
    return F.when(stop > start, F.substring(near, start - first * PIECE + 1, stop - start)).otherwise(F.lit(""))


def joined(spans: Column) -> Column:
    """'kind:start:stop,...' by start, then by the kinds' order."""
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s["stop"].alias("c"), s["kind"].alias("d"))))
    return F.array_join(F.transform(in_order, lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")
