"""Secret scan: fixed forms, and strings whose sliding-window entropy is high for their character class."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, table
from .pii import digest
from .spans import let, located

# The guards and possessive repetition only keep the search linear; the matches are those of the plain forms.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{24,}+"
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE))
BASE = ("assign", "access", "hex")

WINDOW = 20
#: The characters of candidates. Counts of up to 31 of them stand in 5 bits each, PACK of them in a long.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PACK, COUNT_BITS = 12, 5
#: Bits per character that the best window of a candidate needs, by its character class.
LEAST_BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Candidates of these forms are no secrets: words without a digit, UUIDs, dates and numbers, paths, repeated placeholders.
ALLOW = r"^[^0-9]*$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9_+/=-]*$|^/|(?i:example|placeholder|changeme|dummy|xxxx)|^(.)\1*$"


def char_class(s: Column) -> Column:
    return F.when(s.rlike("^[0-9a-fA-F]+$"), "hex").when(s.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")


def best_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits a character) of any ``window`` consecutive characters of ``s``.

    ``s`` has SYMBOLS only and no fewer than ``window``, which is 31 at most. The counts of all symbols go along
    with the window. With S = sum c*log2(c) over them, the entropy is log2(window) - S/window. A step takes one
    character in and lets one go, which changes two counts and two terms of S, so it costs the same everywhere.
    """
    grow = F.array(*[F.lit((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)) for c in range(window + 1)])
    # where a symbol's count stands: long number, and bit
    code = lambda c: F.instr(F.lit(SYMBOLS), c) - 1
    places = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.struct(F.floor(code(c) / PACK).cast("int").alias("at"), (F.pmod(code(c), F.lit(PACK)) * COUNT_BITS).alias("bit")))
    count = lambda counts, p: F.call_function("shiftright", F.get(counts, p["at"]), p["bit"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    empty = F.array(*[F.lit(0).cast("long")] * -(-len(SYMBOLS) // PACK))

    def put(counts: Column, p: Column, sign: int) -> Column:
        return F.transform(counts, lambda v, j: F.when(j == p["at"], v + F.call_function("shiftleft", F.lit(sign).cast("long"), p["bit"])).otherwise(v))

    def run(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            into, out = F.element_at(places, i), F.element_at(places, F.greatest(i - window, F.lit(1)))
            same = (i > window) & (into == out)
            added = F.when(same, acc["s"]).otherwise(acc["s"] + F.get(grow, count(acc["counts"], into).cast("int")))
            counts = F.when(same, acc["counts"]).otherwise(put(acc["counts"], into, 1))
            loses = (i > window) & ~same
            s = F.when(loses, added - F.get(grow, count(acc["counts"], out).cast("int") - 1)).otherwise(added)
            counts = F.when(loses, put(counts, out, -1)).otherwise(counts)
            return F.struct(counts.alias("counts"), s.alias("s"), F.when(i >= window, F.least(acc["low"], s)).otherwise(acc["low"]).alias("low"))

        most = window * math.log2(window)
        return F.aggregate(F.sequence(F.lit(1), F.size(places)), F.struct(empty.alias("counts"), F.lit(0.0).alias("s"), F.lit(most).alias("low")), step)["low"]

    return F.lit(math.log2(window)) - let(places, run) / window


def _spanner(kind: str, rank: int):
    def span(x: Column) -> Column:
        score = best_entropy(x["m"]) if kind == "entropy" else F.lit(1.0)
        return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("stop"), score.alias("score"), char_class(x["m"]).alias("cls"))

    return span


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans: array<struct(kind, rank, start, stop, score)>, one row per input row.

    assign (an assignment whose value has 6 characters or more), access (20 or more) and hex (24 or more) are the
    base kinds with score 1; entropy spans are further candidates of 20 or more characters whose best window
    reaches the bits of its character class, unless the allow list names their form or they equal a hex or
    access span. Matches are leftmost and don't overlap within a kind. Null text is empty text and has no spans;
    null ids, row order, repeated rows and further columns don't matter; an empty table gives no rows. Whole texts
    are read, in time proportional to their length, however long a candidate is.
    """
    df = ids_and_text(docs, id_col, text_col)
    for kind, pattern in KINDS:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        if kind == "access":
            found = F.when(F.contains("text", F.lit("AKIA")), found).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(f"m_{kind}", found)
    every = []
    for rank, (kind, pattern) in enumerate(KINDS):
        at = located(F.col("text"), F.col(f"m_{kind}"), pattern)
        if kind == "assign":
            at = F.filter(at, lambda x: F.length(F.regexp_extract(x["m"], ASSIGN_VALUE, 1)) >= 6)
        if kind == "entropy":
            at = F.filter(at, lambda x: ~x["m"].rlike(ALLOW) & ~x["m"].rlike(r"^[0-9a-f]{24,}$|^AKIA[A-Z0-9]{16,}$"))
        spans = F.transform(at, _spanner(kind, rank))
        if kind == "entropy":
            need = lambda s: F.when(s["cls"] == "hex", LEAST_BITS["hex"]).when(s["cls"] == "alnum", LEAST_BITS["alnum"]).otherwise(LEAST_BITS["base64"])
            spans = F.filter(spans, lambda s: s["score"] >= need(s))
        every.append(spans)
    return df.select("doc_id", "text", F.concat(*every).alias("spans"))


def op6_secrets(spark, sf_dir):
    """The digest of ``find_secrets`` over all documents; null text is empty text, a repeated row comes again."""
    return digest(find_secrets(table(spark, sf_dir, "documents")), BASE)
