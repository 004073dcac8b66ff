"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust a score."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, table
from .spans import cut, joined, let, located, pieces, scan

# Each pattern finds what its plain form finds. Possessive repetition and the guard in front (a match
# starts where the last one ended, or where a run starts) only keep the search linear on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Lengths of the international bank account number (ISO 13616), by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{c.replace(' ', '|')})(?:\\x20?[A-Z0-9]){{{n - 2}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP_OK = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})?+(?:\.(?!$)|$)){4}$"

#: kind, pattern, probability before context, words whose presence within WINDOW code points raises it.
KINDS = (
    ("email", EMAIL, 0.9, "e-?mails?|contacts?|mailto"),
    ("ip", IP, 0.6, "ips?|address(?:es)?|hosts?|servers?"),
    ("card", CARD, 0.8, "cards?|visa|credit|payments?|carte|karte|tarjeta"),
    ("phone", PHONE, 0.7, "(?:tele)?phones?|tel|calls?|mobiles?|fax"),
    ("iban", IBAN, 0.9, "ibans?|accounts?|konto|compte|cuenta"),
    ("ssn", SSN, 0.3, "ssns?|social|security"),
)
BASE = 4
WINDOW = 40
#: A kind that is not a base kind needs this score.
LEAST = 0.5
RAISE = 0.3


def mod97(text: Column) -> Column:
    """ISO 13616: the country and check digits go to the end, letters count 10 to 35; the remainder must be 1."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97))


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return m.rlike(IP_OK)
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(m) == 1
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-|-0000$")
    return F.lit(True)


def _checker(kind: str):
    return lambda x: valid(kind, x["m"])


def _near(words: str, parts: Column, length: Column, start: Column, stop: Column) -> Column:
    """Whether one of ``words`` stands whole in the WINDOW code points before or after the match.

    One code point more is cut on each side (a blank at the text's ends), so that no part of a word counts as one.
    """
    before = F.concat(F.when(start <= WINDOW, " ").otherwise(""), cut(parts, F.greatest(start - WINDOW - 1, F.lit(0)), start))
    after = F.concat(cut(parts, stop, F.least(stop + WINDOW + 1, length)), F.when(length - stop <= WINDOW, " ").otherwise(""))
    whole = rf"(?<![a-z0-9])(?:{words})(?![a-z0-9])"
    return F.lower(before).rlike(f"(?s)(?<=.){whole}") | F.lower(after).rlike(f"(?s){whole}(?=.)")


def _scorer(kind: str, rank: int, prior: float, words: str, parts: Column, length: Column):
    def span(x: Column) -> Column:
        stop = x["start"] + F.length(x["m"])
        score = F.least(F.lit(1.0), F.lit(prior) + F.when(_near(words, parts, length, x["start"], stop), RAISE).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), x["start"].alias("start"), stop.alias("stop"), score.alias("score"))

    return span


def _of_kind(*kinds: str):
    return lambda s: s["kind"].isin(*kinds)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans: array<struct(kind, rank, start, stop, score)>, one row per input row.

    Matches are leftmost and don't overlap within a kind; spans of different kinds may overlap. What fails
    its check (parts of at most 255, Luhn, mod 97, counts of digits) is dropped without another try.
    The score starts at the kind's prior and rises by RAISE, up to 1, if a context word stands whole within
    the WINDOW code points before or after; base kinds are kept at any score, the others from LEAST on. Null
    text is empty text and has no spans; null ids, row order, repeated rows and further columns don't matter;
    an empty table gives no rows. Whole texts are read, in time proportional to their length.
    """
    df = ids_and_text(docs, id_col, text_col)
    hint = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for kind, pattern, _, _ in KINDS:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        df = df.withColumn(f"m_{kind}", F.when(hint[kind], found).otherwise(F.array().cast("array<string>")) if kind in hint else found)
    good = []
    for kind, pattern, _, _ in KINDS:
        good.append(F.filter(located(F.col("text"), F.col(f"m_{kind}"), pattern), _checker(kind)).alias(f"g_{kind}"))
    df = df.select("doc_id", "text", *good)

    def scored(whole: Column) -> Column:
        every = []
        for rank, (kind, _, prior, words) in enumerate(KINDS):
            out = F.transform(f"g_{kind}", _scorer(kind, rank, prior, words, whole["parts"], whole["n"]))
            every.append(out if rank < BASE else F.filter(out, lambda s: s["score"] >= LEAST))
        return F.concat(*every)

    some = sum((F.size(f"g_{kind}") for kind, *_ in KINDS), F.lit(0)) > 0
    return df.select("doc_id", "text", let(F.when(some, F.struct(pieces(F.col("text")).alias("parts"), F.length("text").alias("n"))), scored).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text with every span replaced by ``[KIND]``; of overlapping spans the earlier wins, then the longer.

    Null text becomes empty text; null ids, repeated rows and further columns don't matter; an empty table gives no rows.
    """
    found = find_pii(docs, id_col, text_col)
    in_order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("neg"), F.upper(s["kind"]).alias("kind"))))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        skip = s["start"] < at
        return F.when(skip, at).otherwise(-s["neg"]), F.struct(at.alias("from"), s["start"].alias("start"), (-s["neg"]).alias("stop"), s["kind"].alias("kind"), skip.alias("skip"))

    kept = F.filter(scan(in_order, F.lit(0), "struct<from:int,start:int,stop:int,kind:string,skip:boolean>", step), lambda s: ~s["skip"])
    found = found.select("doc_id", "text", kept.alias("kept"))

    def changed(parts: Column) -> Column:
        heads = F.array_join(F.transform("kept", lambda s: F.concat(cut(parts, s["from"], s["start"]), F.lit("["), s["kind"], F.lit("]"))), "")
        return F.concat(heads, cut(parts, F.element_at("kept", -1)["stop"], F.length("text")))

    return found.select("doc_id", F.when(F.size("kept") > 0, let(pieces(F.col("text")), changed)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame, kinds: tuple[str, ...], hashed: str = "base_sha256") -> DataFrame:
    """doc_id, one count a kind of ``kinds``, the hash of their spans, and all spans; one row per row of ``found``.

    A text without spans has counts of 0, the hash of the empty string and no spans.
    """
    base = F.filter("spans", _of_kind(*kinds))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias(hashed), joined(F.col("spans")).alias("spans"))


def op2_pii(spark, sf_dir):
    """The digest of ``find_pii`` over all documents; null text is empty text, a repeated row comes again."""
    return digest(find_pii(table(spark, sf_dir, "documents")), ("email", "ip", "card", "phone"))
