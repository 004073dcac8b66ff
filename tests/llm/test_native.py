"""PII, secrets, exact dedup and sharding against brute force, and on odd input."""
import hashlib
import random
import re
import time
import zlib
from collections import Counter
from math import log2

import oracle
import pytest
from pyspark.sql import functions as F

from tidewin.llm import exact_dedup, pii, secrets, sharding


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15),
]
SECRETS = [
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
]


def base(text, kinds):
    spans = sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))
    return [sum(s[3] == k for s in spans) for k, _, _ in kinds], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


TRICKY = [
    "a@b.c_d@e.f x..y@z-.q.r. @@a@b@c.d", "a" * 3000 + "@", "a.b" * 500 + "@x" + ".y" * 4000, "1.2.3.4.5.6.7.8.9 256.1.1.1 0255.000.1.00001 1.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111-4111111111111111 12 3", "+1 (555) 123-4567 +1 555 +49.30.901820. +1" + " " * 3000 + "2", "é😀a@b.co 😀+1 555 123 4567 ß1.2.3.4",
    "password: secret: token: abcdefgh api_key=\"ABCDEF\" APIKEY:x passwd = 'a.b-c/d=' token=token=abcdef ſecret=abcdefg toKen=abcdefg", "AKIA" + "A" * 15 + " AKIAAKIA" + "Z9" * 8 + " AKIAAKIA" + "B" * 11,
    "deadbeef" * 3 + " " + "0" * 23 + "g" + "f" * 24 + "A" + "1" * 5000, None, "", "x" * 200_000,
]


@pytest.mark.parametrize("run, kinds", [(lambda d: pii.digest(pii.find_pii(d), ("email", "ip", "card", "phone")), PII), (lambda d: pii.digest(secrets.find_secrets(d), secrets.BASE), SECRETS)])
def test_spans_equal_python(make, odd, run, kinds):
    from conftest_rows import rows_of

    for df in (make(rows_of(TRICKY)), odd):
        texts = {}
        for r in df.select("doc_id", "text").collect():
            texts.setdefault(r[0], []).append(base(r[1], kinds))
        for r in run(df).collect():
            assert (list(r[1 : 1 + len(kinds)]), r["base_sha256"]) in texts[r["doc_id"]], r["doc_id"]


def test_added_spans(make):
    from conftest_rows import rows_of

    got = [r["spans"] for r in pii.digest(pii.find_pii(make(rows_of(["iban GB82 WEST 1234 5698 7654 32 ok", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "number 123-45-6789"]), 1)), ("email",)).orderBy("doc_id").collect()]
    assert got == ["iban:5:32", "", "ssn:4:15", ""]
    texts = ["key q8Zr2LmX0vB7nT4kWc9YdE1s", "zzzzzzzzzzzzzzzzzzzzzzzzz1", "123e4567-e89b-12d3-a456-426614174000", "thequickbrownfoxjumpsoverthelazydog", "EXAMPLEq8Zr2LmX0vB7nT4kWc9Yd"]
    got = [r["spans"] for r in pii.digest(secrets.find_secrets(make(rows_of(texts), 1)), secrets.BASE).orderBy("doc_id").collect()]
    assert got == ["entropy:4:28", "", "", "", ""]


CONTEXT = {"iban": "ibans?|accounts?|konto|compte|cuenta", "ssn": "ssns?|social|security"}


def added_pii(text):
    """Numbers of accounts by country length and mod 97; social security numbers with a context word nearby."""
    lengths = {c: n for n, cs in pii.IBAN_LENGTHS.items() for c in cs.split()}
    out, at = [], 0
    while m := re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}").search(text, at):
        at = m.start() + 1
        n = lengths.get(m[0][:2])
        if n and (w := re.compile(r"[A-Z0-9](?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 1)).match(text, m.start())):
            plain = w[0].replace(" ", "")
            at = w.end()
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                out.append((w.start(), 4, w.end(), "iban"))
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        if not re.match("000|666|9", m[0]) and not re.search("-00-|-0000$", m[0]):
            word = re.compile(r"(?i)(?<![a-z0-9])(?:%s)(?![a-z0-9])" % CONTEXT["ssn"])
            near = [w for w in word.finditer(text[: m.start()]) if w.start() >= m.start() - 40] + [w for w in word.finditer(text[m.end() :]) if w.end() <= 40]
            if near:
                out.append((m.start(), 5, m.end(), "ssn"))
    return out


def test_added_pii_equals_python(make):
    from conftest_rows import rows_of

    es = "ES91 2100 0418 4502 0005 1332"
    texts = [f"{es}", f"{es} OK", f"pay {es} TO ME", "NO9386011117947 DE89370400440532013000", "GB82 WEST 1234 5698 7654 32A", "XX82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00, DE89 3704 0044 0532 0130 01"]
    for gap in (0, 30, 31, 38, 39, 40, 41, 60):
        texts += ["123-45-6789" + " " * gap + "ssn", "ssn" + " " * gap + "123-45-6789", "x" * 900 + " 123-45-6789" + " " * gap + "SSN. " + "y" * 700, "é😀 " * 150 + "social" + " " * gap + "123-45-6789", "lessns" + " " * gap + "123-45-6789", "x" * 500 + " ssn" + " " * gap + "123-45-6789, 234-56-7890"]
    rng = random.Random(9)
    texts += [" ".join(rng.choice(["ssn", "123-45-6789", es, "word", "é" * 30, "security:", "000-12-3456", "tel", "\n"]) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    for r in pii.find_pii(make(rows_of(texts))).collect():
        got = sorted((s["start"], s["rank"], s["stop"], s["kind"]) for s in r["spans"] if s["rank"] >= pii.BASE)
        assert got == sorted(added_pii(r["text"])), r["text"]


def test_context_words_are_whole(make):
    from conftest_rows import rows_of

    texts = ["my tel +1 555 123 4567", "my hotel +1 555 123 4567", "+1 555 123 4567 (fax)", "+1 555 123 4567 faxes"]
    got = {r["doc_id"]: [round(s["score"], 2) for s in r["spans"]] for r in pii.find_pii(make(rows_of(texts))).collect()}
    assert got == {0: [1.0], 1: [0.7], 2: [1.0], 3: [0.7]}


def entropies(s, w=20):
    return [-sum(c / w * log2(c / w) for c in Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1)]


def test_sliding_entropy(spark):
    rng = random.Random(2)
    texts = ["aab1Zq9aab1Zq9zzYX08aab1", "a" * 20, "a" * 50 + "bcd", secrets.SYMBOLS, secrets.SYMBOLS[::-1] * 3]
    texts += ["".join(rng.choice(secrets.SYMBOLS[: rng.randint(1, 67)]) for _ in range(rng.randint(20, 120))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.best_entropy(F.col("t")).alias("e")).collect()
    for r in got:
        assert r["e"] == pytest.approx(max(entropies(r["t"])), abs=1e-9), r["t"]


def test_added_secrets_equal_python(make):
    """Candidates by the plain expression, the allow list, and entropy counted anew in every window."""
    from conftest_rows import rows_of

    rng = random.Random(4)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", secrets.SYMBOLS[:62], secrets.SYMBOLS, "0123", "abcdefgh"]
    texts = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(10, 60))) for a in rng.choices(alphabets, k=rng.randint(1, 8))) for _ in range(150)] + ["x" * 30_000 + "1"]

    def want(text):
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            s = m[0]
            if re.search(secrets.ALLOW.replace("(?i:example", "(?:example"), s) or re.fullmatch("[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", s):
                continue
            need = 3.0 if re.fullmatch("[0-9a-fA-F]+", s) else 3.6 if s.isalnum() else 3.8
            if max(entropies(s)) >= need:
                yield m.start(), m.end()

    for r in secrets.find_secrets(make(rows_of(texts))).collect():
        assert sorted((s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "entropy") == sorted(want(r["text"])), r["text"]


@pytest.mark.parametrize("run, text", [
    (lambda d: pii.digest(pii.find_pii(d), ("email", "ip", "card", "phone")), lambda n: " ".join(f"user{i}@example{i % 7}.com" for i in range(n))),
    (lambda d: pii.digest(pii.find_pii(d), ("email", "ip", "card", "phone")), lambda n: "ssn 123-45-6789, " * n),
    (pii.redact, lambda n: "mail a@b.co now, " * n),
    (lambda d: pii.digest(secrets.find_secrets(d), secrets.BASE), lambda n: " ".join(f"token=abcdef{i}" for i in range(n))),
    (lambda d: pii.digest(secrets.find_secrets(d), secrets.BASE), lambda n: "".join(random.Random(1).choices(secrets.SYMBOLS, k=20 * n)))])
def test_dense_texts_in_linear_time(spark, run, text):
    """One text of 50,000 matches, or one candidate of 1 MB: at ten times the length no more than about ten times the time."""
    took = []
    for n in (5_000, 5_000, 50_000):
        df = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        begin = time.perf_counter()
        assert len(run(df).collect()) == 1
        took.append(time.perf_counter() - begin)
    assert took[2] < 12 * max(took[1], .5) + 5


def test_redact(make):
    from conftest_rows import rows_of

    long = "é" * 1500
    texts = ["mail a@b.co or 1.2.3.4!", None, "", "none", f"{long} a@b.co{long}", "1.2.3.4a@b.co", "a@b.co"]
    got = {r["doc_id"]: r["text"] for r in pii.redact(make(rows_of(texts), 1)).collect()}
    assert got == {0: "mail [EMAIL] or [IP]!", 1: "", 2: "", 3: "none", 4: f"{long} [EMAIL]{long}", 5: "[EMAIL]", 6: "[EMAIL]"}


@pytest.mark.parametrize("kw", [{}, {"broadcast_groups": 0}, {"content_hash": lambda t: F.lit(b"same")}, {"content_hash": lambda t: F.lit(b"same"), "broadcast_groups": 0}])
def test_exact_groups(odd, kw):
    """Also with a hash under which all texts collide, and by the path without broadcasts."""
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = sorted(map(repr, (tuple(r) for r in exact_dedup.exact_groups(odd, **kw).collect())))
    want = []
    for i, t in rows:
        own = [a for a, b in rows if (b or "") == (t or "")]
        keep = max((a for a in own if a is not None), default=None)
        want.append(repr((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest())))
    assert got == sorted(want)


def test_exact_dedup_oracle(spark, small):
    assert oracle.differences(spark, oracle.connect(small), small, exact_dedup.op4_exact_dedup, exact_dedup.OP4_SQL) == ""


def test_drop_exact_copies(odd):
    out = exact_dedup.drop_exact_copies(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["2", "3", "4", "5", "7", "8", "9", "10", "11"])


def check_shards(rows, texts, shards):
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= 2 * max(most, .002 * total / shards) + 1


@pytest.mark.parametrize("copies", [0, 400])
def test_shards(make, copies):
    from conftest_rows import rows_of

    texts = [f"text number {i} " + "pad " * (i % 50) for i in range(600)] + ["the hot text " * 20] * copies
    df = make(rows_of(texts))
    rows = sharding.histogram_shards(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    check_shards(rows, texts, 16)
    again = sharding.histogram_shards(df.repartition(7)).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == {r["doc_id"]: (r["shard"], r["slot"]) for r in again}


def test_shards_odd(odd, empty):
    rows = sharding.histogram_shards(odd, 3).collect()
    assert len(rows) == odd.count()
    for s in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


@pytest.mark.parametrize("run", [exact_dedup.exact_groups, exact_dedup.drop_exact_copies, sharding.histogram_shards, pii.find_pii, secrets.find_secrets])
def test_empty(empty, run):
    assert run(empty).count() == 0
