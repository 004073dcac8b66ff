"""Divergence of sources, filter interactions and near-duplicate vectors, against brute force and on odd input."""
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewin.llm import common, divergence, embedding_dedup, filter_audit, queries

AUDITS = ["op11_source_divergence", "op12_filter_audit", "op13_embedding_dedup"]


@pytest.mark.parametrize("name", AUDITS)
def test_same_as_oracle(name, spark, small):
    assert oracle.differences(spark, oracle.connect(small), small, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


# ---- divergence

def plain_divergence(rows, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = term.findall((text or "").translate(low))
        df[lang].update(set(own))
        counts[lang, source].update(own)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (value, item) in enumerate(items[:most])]
    return sorted(out)


def divergence_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("x"), "p": F.lit(None).cast("int"), "value": F.lit(2)})
    got = divergence.source_divergence(df.repartition(4), **more)
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["a", "ab", "abcdefgh", "abcdefghi", "ABCDEFGHabcdefgh", "é", "日本語" * 7, "ß" * 4, "Zz", "x" * 40, "İ", "s", "ſ", "mot", "Mot"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", "é", "", None, "z"])) for _ in range(150)]
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("one two", "xx", None), (" \n1234 _", None, None), ("lonely " * 3, "yy", "only")] * 2 + [("same " * 5, "zz", "a")] * 3 + [("long" * 3000 + " " + "word " * 4000, "en", "s1")] * 3
    want = plain_divergence(rows)
    assert divergence_of(spark, rows) == want
    # many small tries, pair sums and candidate lists, written out early
    monkeypatch.setattr(divergence, "CHUNK", 300)
    monkeypatch.setattr(divergence, "HELD", 2)
    monkeypatch.setattr(divergence, "COUNTERS", 50)
    monkeypatch.setattr(divergence, "PAIRS", 16)
    monkeypatch.setattr(divergence, "SUMS", 20)
    assert divergence_of(spark, rows) == want
    # groups beyond the broadcast
    monkeypatch.setattr(divergence, "spread_join", lambda a, b, keys, by: common.spread_join(a, b, keys, by, most_rows=0, places=3))
    assert divergence_of(spark, rows, top=5) == plain_divergence(rows, top=5)
    assert divergence_of(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="abz\xe9日", min_size=1, max_size=20), max_size=12), min_size=1, max_size=6), st.randoms(use_true_random=False))
def test_trie_equals_counters(docs, rng):
    group = [rng.randint(0, 2) for _ in docs]
    tries, want = [], defaultdict(lambda: [0, 0])
    for words, g in zip(docs, group, strict=True):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1 if words else np.zeros(0, int)
        starts = ends - np.array([len(w.encode()) for w in words], int)
        tries.append(divergence.Trie.of(data, starts, ends, np.zeros(len(words), int), np.array([g])))
        for w, n in Counter(words).items():
            want[w, g][0] += n
            want[w, g][1] += 1
    trie = divergence.Trie.merged([divergence.Trie.merged(tries[::2]), *tries[1::2]])
    got = {(t, int(g)): [int(n), int(d)] for terms, gs, ns, ds in trie.terms() for t, g, n, d in zip(terms.to_pylist(), gs, ns, ds, strict=True)}
    assert got == dict(want)
    for depth in range(len(trie.levels)):  # nodes are numbered in the order of their paths
        parent, edge = trie.levels[depth]
        assert list(zip(parent, edge)) == sorted(set(zip(parent, edge)))


def test_shares_are_exact_beyond_64_bits(spark):
    n, total = 4 * 10**17, 9 * 10**17
    assert spark.range(1).select(divergence._share(F.lit(n), F.lit(total))).first()[0] == 1 + 10**9 * (n + 1) // total


# ---- filter interactions

def plain_flags(rows):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append((i, source or "", len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and i > first[text]))
    return out


def plain_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    flags = plain_flags(rows)
    parts = sorted({f[1] for f in flags})
    out, sums = [], Counter()
    for order in itertools.permutations("ABCDE"):
        for part in parts:
            mine = [f for f in flags if f[1] == part]
            alive = mine
            for step, letter in enumerate(order):
                k = 2 + "ABCDE".index(letter)
                went = [f for f in alive if f[k]]
                alive = [f for f in alive if not f[k]]
                sums[part, letter] += len(went)
                out.append([part, "".join(order), step + 1, len(alive), len(went), sum(f[k] for f in mine) - len(went), sum(f[k] and sum(f[2:]) == 1 for f in mine), sum(f[0] in good for f in went), sum(f[0] in toxic for f in went), letter])
    return sorted((*r[:-1], sums[r[0], r[-1]]) for r in out)


def audit_rows():
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = [rng.choice(["a", "b", "Cc", "D", "é", "x#y", "w%d" % rng.randint(0, 400)]) for _ in range(rng.choice([3, 150, 199, 200, 201, 400]))]
        rows.append((i, rng.choice([" ", "\n", "\x85"]).join(words), rng.choice(["s0", "s0", "s1", None, "", "日"])))
    rows += [(400 + i, rows[i % 7][1], "s1") for i in range(60)] + [(None, rows[0][1], "s0"), (None, None, None), (500, None, "s0"), (501, "", "s0"), (501, "", "s0"), (7, rows[7][1], "s0"), (502, "A" * 100_000 + " |", "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 600, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (9_999, 1, 1)]
    return rows, labels


def audit_of(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit("q"), "a": F.lit(1), "sha": F.lit("z"), "copies": F.lit(3), "first_id": F.lit(1)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"good": F.lit(7), "_copies": F.lit(1)})
    return filter_audit.filter_audit(docs.repartition(3), marks)


def test_audit_equals_brute_force(spark, monkeypatch):
    rows, labels = audit_rows()
    want = plain_audit(rows, labels)
    assert sorted(map(tuple, audit_of(spark, rows, labels).collect())) == want
    monkeypatch.setattr(filter_audit, "BLOCK", 9)  # many blocks a task, parts that end inside a byte
    monkeypatch.setattr(filter_audit.with_labels, "__defaults__", ("doc_id", 0))  # labels and copies beyond the broadcast
    monkeypatch.setattr(filter_audit.document_flags, "__defaults__", ("doc_id", "text", "source", 0))
    assert sorted(map(tuple, audit_of(spark, rows, labels).collect())) == want
    assert audit_of(spark, [], labels).collect() == []
    assert len(audit_of(spark, rows[:5], []).collect()) == 600 * len({r[2] or "" for r in rows[:5]})


def test_bitmaps_are_packed_rows(spark):
    rows = [("p" if i % 3 else "q", i % 2 == 0, i % 5 == 0) for i in range(1000)]
    index = filter_audit.bitmap_index(spark.createDataFrame(rows, "part string, x boolean, y boolean").coalesce(1), ["x", "y"])
    got = {r["part"]: r for r in index.collect()}
    for part, r in got.items():
        own = [x for x in rows if x[0] == part]
        assert r["n"] == len(own) and [len(b) for b in r["bitmaps"]] == [-(-len(own) // 8)] * 2
        for k in (0, 1):
            assert np.unpackbits(np.frombuffer(r["bitmaps"][k], np.uint8))[: r["n"]].tolist() == [int(x[k + 1]) for x in own]


# ---- vectors

def plain_components(rows, threshold=0.98):
    """(n_links, component_id) by place, by comparing all pairs."""
    units = []
    for _, label, v in rows:
        fine = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v if fine else [], float)
        x = x / np.abs(x).max() if fine else x
        units.append(x / np.linalg.norm(x) if fine else None)
    n = len(rows)
    links = [[] for _ in rows]
    for i, j in itertools.combinations(range(n), 2):
        if units[i] is not None and units[j] is not None and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
            links[i].append(j)
            links[j].append(i)
    comp = list(range(n))
    for i in range(n):
        if comp[i] == i:
            todo = [i]
            while todo:
                for j in links[todo.pop()]:
                    if comp[j] != i:
                        comp[j] = i
                        todo.append(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[comp[i]] = min(least.get(comp[i], rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], len(links[i]), least.get(comp[i])) for i in range(n)), key=repr)


def vector_rows():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        base = rng.standard_normal(20)
        for k in range(rng.choice([1, 1, 1, 2, 5])):
            rows.append((len(rows), int(i % 4), (base + rng.standard_normal(20) * rng.choice([0, 0.05, 0.1, 0.2, 0.25])).astype(np.float32).tolist()))
    core = rng.standard_normal(20)
    rows += [(2000 + i, 1, (core + rng.standard_normal(20) * (0.02 if i % 4 else 0.18)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(3000 + i, 2, rows[0][2]) for i in range(30)] + [(4000, 0, rows[0][2]), (4001, None, rows[0][2]), (None, 0, rows[0][2]), (None, None, None), (4002, 0, None), (4003, 0, []), (4004, 0, [0.0] * 20)]
    rows += [(4005, 0, [1.0, None]), (4006, 0, [float("nan"), 1.0]), (4007, 0, [float("inf")] * 20), (4008, 0, [1.0]), (4009, 0, [2.0]), (4010, 0, [-1.0]), (4011, 0, [-0.0, 1.0]), (4012, 0, [0.0, 1.0]), (4013, 3, [1e-30, 1e-30]), (4014, 3, [3.0, 3.0]), (0, 0, rows[0][2]), (5, 0, rows[9][2])]
    return rows


def vectors_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"node": F.lit(1), "key": F.lit("k"), "copies": F.lit(1), "h": F.lit("h"), "n": F.lit(0)})
    got = embedding_dedup.vector_components(df.repartition(3), **more)
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("more", [{}, {"most": 7}, {"most": 40, "broadcast_groups": 0}])
def test_vectors_equal_all_pairs(spark, more):
    rows = vector_rows()
    got = vectors_of(spark, rows, **more)
    assert sorted((r[:3] for r in got), key=repr) == plain_components(rows)
    assert all(kept == (component == vec) for vec, _, component, kept in got)


def test_vectors_empty_and_dropped(spark):
    assert vectors_of(spark, []) == []
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("gone_id", F.lit(1))
    left = embedding_dedup.drop_near_vectors(df)
    assert left.columns == df.columns
    gone = {i for i, _, c in plain_components(rows) if i is not None and i != c}
    assert sorted((r["vec_id"] for r in left.collect()), key=repr) == sorted((r[0] for r in rows if r[0] is None or r[0] not in gone), key=repr)


def test_decoded_points_are_the_nearest():
    rng = np.random.default_rng(1)
    steps = embedding_dedup.least_vectors()
    assert len({tuple(s) for s in steps}) == 240 and np.allclose((steps**2).sum(1), 2)
    x = rng.normal(0, 3, (3000, 8))
    point = embedding_dedup.decode(x)
    halves = point - 0.5
    whole = (point == np.rint(point)).all(1)
    assert (whole | (halves == np.rint(halves)).all(1)).all() and (np.abs(point.sum(1)) % 2 == 0).all()
    d = ((x - point) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()  # the covering radius
    assert (((x[:, None] - point[:, None] - steps) ** 2).sum(2) >= d[:, None] - 1e-9).all()


def test_a_pair_at_the_threshold_shares_a_cell_of_most_tables():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    seed = np.zeros(1500, np.uint64)
    tables = [embedding_dedup.cell_keys(x, seed, 0.98).reshape(1500, embedding_dedup.TABLES, embedding_dedup.PROBES) for x in (a, b)]
    hit = (tables[0][:, :, :, None] == tables[1][:, :, None, :]).any((2, 3))
    assert hit.mean() > 0.9 and hit.any(1).all()
    other = np.roll(tables[1], 1, axis=0)
    assert (tables[0][:, :, :, None] == other[:, :, None, :]).any((2, 3)).mean() < 0.002
