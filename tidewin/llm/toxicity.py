"""Toxicity: disguised words are restored by a Viterbi search under a character model, then the text is scored."""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, ids_and_text, release, stage, table
from .textkernel import U, chunks, lean, mix, per_text, prefix, runs, slices

#: Buckets of hashed words and word beginnings.
BUCKETS = 1 << 20
#: Pseudo-documents that pull a rare feature's ratio to 1.
KAPPA = 2.0
#: Documents of each label on which the last step, a logistic regression over STATS numbers, is fitted at most.
FIT_ROWS = 20_000
#: Resolution of the rates at which labelled rows are drawn for it.
RATE = 1_000_000_000
STATS = 7
#: Labelled rows (two numbers each) up to which they are broadcast.
LABELS_BROADCAST = 1_000_000
#: Beginnings of words, in bytes, that are features beside the whole word.
HEADS = (5, 6, 8)

#: What a sign may stand for, besides itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "¡": "i"}
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKE = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
A = len(ALPHABET) + 1  # and the word border
#: Cost (natural log) of reading a sign as a letter and of reading a run of one letter as fewer.
SUBSTITUTE, SHORTEN = 1.0, 0.5
#: Cost of reading a letter as the Latin one that it looks like or that it is but for an accent.
FOLD = 0.2
#: Cost of reading a sign at a word's edge as punctuation: these few are letters more often than others.
EDGE = {"@": 4.0, "$": 4.0, "€": 4.0}
PUNCTUATION = 0.5
#: Cost of a word border between letters set apart, and of none where the gap is wider than others of the phrase.
BORDER, JOIN = 1.0, 3.0

_SIGNS = re.escape("".join(LEET))
_SIGN_DIGITS = "".join(c for c in LEET if c.isdigit())
_PUNCT = re.escape("".join(c for c in LEET if not c.isdigit()))
#: What sets letters apart, and a letter or sign set apart, which may be held.
_GAP, _ONE = r"[\s._*-]", rf"[a-z{_SIGNS}]"
#: Disguised words: letters and signs set apart, signs between letters, letters held for three or more places. Possessive, so that each run is read once.
DISGUISED = re.compile(
    rf"(?P<apart>(?:(?<!\w)(?=\w)|(?<![\w{_SIGNS}]))(?:[{_PUNCT}]++(?=[a-z]))?({_ONE})\2*+(?:{_GAP}++({_ONE})\3*+){{3,}}(?!\w))"
    rf"|(?<![\w{_SIGNS}])(?=[\w{_SIGNS}]*?[a-z])[^\W{_SIGN_DIGITS}]*+[{_SIGNS}][\w{_SIGNS}]*+(?!\.\w)"
    r"|(?<![^\W\d_])[a-z]*([a-z])\4\4[a-z]*(?![^\W\d_])")
READABLE = re.compile(rf"[a-z{_SIGNS}]+")
#: Also words that begin in Latin letters and go on in others that look like them, or the other way round.
_LOOKS = "".join(LOOKALIKE)
LOOKS = re.compile(f"[{_LOOKS}]")
MIXED = re.compile(rf"(?<!\w)(?:[a-z]++[{_LOOKS}]|[{_LOOKS}]++[a-z])\w*+|{DISGUISED.pattern}")


def plain_letter(ch: str) -> str:
    """The letter a-z that a letter looks like or is without its accents, or nothing."""
    if ch in ALPHABET:
        return ch
    base = LOOKALIKE.get(ch) or (unicodedata.normalize("NFD", ch)[0] if ch.isalpha() else "")
    return base if len(base) == 1 and base in ALPHABET else ""


def readable(run: str) -> list[str]:
    """The parts of a run of word characters and signs that can be read as letters: no part of a word with others, such as 2 or ж."""
    plain = run if run.isascii() else "".join(ch if ch in LEET else plain_letter(ch) or "_" for ch in run)
    out = []
    for m in READABLE.finditer(plain):
        part = run[m.start() : m.end()]
        if m.start() and run[m.start() - 1] != "_":
            part = re.sub(r"^\w+", "", part)
        if m.end() < len(run) and run[m.end()] != "_":
            part = part[: len(part) - len(re.match(r"\w*", part[::-1])[0])]
        if len(part) > 2 and re.search("[a-z]", part):
            out.append(part)
    return out


def letters_of(ch: str) -> list[tuple[str, float]]:
    """What a letter or sign may stand for, and the cost."""
    if ch in ALPHABET:
        return [(ch, 0.0)]
    return [(x, SUBSTITUTE) for x in LEET[ch]] if ch in LEET else [(x, FOLD) for x in plain_letter(ch)]


def readings(ch: str, n: int) -> list[tuple[str, float]]:
    """Readings of a letter or sign that stands n times in a row, and their costs."""
    return [(x * k, sub + (SHORTEN if k < n else 0.0)) for x, sub in letters_of(ch) for k in ({1, 2} if n > 1 else {1})]


class CharModel:
    """Trigrams of letters within words, with the word border as a letter; from the counts of all documents."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(A, A, A).astype(float) + 0.5
        self.cost = (-np.log(c / c.sum(2, keepdims=True))).reshape(-1).tolist()

    def best(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The cheapest reading; ``lattice``: for each place its readings (possibly empty, a blank is the word border) and their costs. Linear in its length."""
        cost = self.cost
        state: dict[int, tuple] = {0: (0.0, None)}  # by the last two letters: cost, and the readings as a linked list
        for place in lattice:
            new: dict[int, tuple] = {}
            for at, (before, path) in state.items():
                for reading, extra in place:
                    x, now = at, before + extra
                    for ch in reading:
                        z = ord(ch) - 96 if ch != " " else 0
                        now += cost[x * A + z]
                        x = x % A * A + z if z else 0
                    if (old := new.get(x)) is None or now < old[0]:
                        new[x] = (now, (path, reading))
            state = new
        _, path = min(((now + cost[x * A], path) for x, (now, path) in state.items()), key=lambda e: e[0])
        out = []
        while path is not None:
            path, reading = path
            out.append(reading)
        return "".join(reversed(out))

    def restore(self, word: str) -> str:
        """A disguised word's letters: signs and repetitions undone as the model finds most likely."""
        lattice = []
        first, last = len(word) - len(re.sub(r"^\W+", "", word)), len(re.match(r"(?s:.*\w)?", word)[0])
        for m in re.finditer(r"(.)\1*", word):
            if place := readings(m[1], len(m[0])):
                if m.start() < first or m.start() >= last:
                    place.append(("", EDGE.get(m[1], PUNCTUATION)))
                lattice.append(place)
        return self.best(lattice)

    def join(self, phrase: str) -> str:
        """The words of letters set apart, signs and repetitions undone: as one word (parted at wide gaps only), and parted as the model finds most likely.

        Both, as trigrams tell the borders of many phrases wrongly.
        """
        gaps = re.findall(f"{_GAP}+", phrase)
        usual = min(map(len, gaps), default=0)
        blank = sum(g.isspace() for g in gaps) * 2 > len(gaps)
        held: list[list] = []  # sign, times, over how many places, whether after a wide gap
        for m in re.finditer(rf"({_GAP}*)((.)\3*)", phrase):
            wide = len(m[1]) > usual or m[1].isspace() and not blank
            if held and held[-1][0] == m[3] and not wide:
                held[-1][1:3] = held[-1][1] + len(m[2]), held[-1][2] + 1
            else:
                held.append([m[3], len(m[2]), 1, wide])
        out: list[str] = []
        for borders in (False, True):
            lattice = []
            for k, (ch, n, places, wide) in enumerate(held):
                if k and (wide or borders):
                    lattice.append([("", JOIN if wide else 0.0), (" ", 0.0 if wide else BORDER)])
                place = readings(ch, n)
                if places > 1 and borders:  # equal letters may end one word and begin the next
                    place += [(f"{x * i} {x * j}", BORDER + sub + (SHORTEN if i + j < n else 0.0)) for x, sub in letters_of(ch) for i in (1, 2) for j in (1, 2) if i + j <= n]
                if not ch.isalnum():
                    place.append(("", EDGE.get(ch, PUNCTUATION)))
                lattice.append(place)
            out += self.best(lattice).split()
        return " ".join(dict.fromkeys(out))


def restored(text: str, model: CharModel, store: dict[str, str]) -> str:
    """The lower-cased text; each disguised word is followed by its restored form, so nothing is lost."""
    low = text.lower()

    def change(m: re.Match) -> str:
        word = m[0]
        if (found := store.get(word)) is None:
            if m["apart"]:
                found = model.join(word) if re.search("[a-z]", word) else ""
            else:  # what the text says as it stands isn't said twice
                found = " ".join(x for part in readable(word) if (x := model.restore(part)) and x not in re.split("[^a-z]", part))
            if len(word) <= 64:
                if len(store) > 100_000:
                    store.clear()
                store[word] = found
        return f"{word} {found} " if found else word

    return (DISGUISED if low.isascii() or not LOOKS.search(low) else MIXED).sub(change, low)


IN_WORD = np.zeros(256, bool)
IN_WORD[97:123] = True
IN_WORD[48:58] = True
IN_WORD[128:] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 + len(HEADS)) bucket rows per word, and offsets of each text's words. A missing head repeats the word."""
    starts, ends = runs(IN_WORD[data], offsets)
    sums = prefix(data)
    rows = [slices(sums, starts, ends)]
    for k in HEADS:
        cut = np.minimum(starts + k, ends)
        # a head is told from a whole word; cutting inside a multi-byte letter does no harm to a hash
        rows.append(np.where(cut < ends, mix(slices(sums, starts, cut) + U(k)), mix(rows[0] + U(k))))
    return np.stack(rows) & U(BUCKETS - 1), per_text(starts, offsets)


def _letters():
    code = np.zeros(256, np.int64)
    code[97:123] = np.arange(1, 27)
    code[65:91] = np.arange(1, 27)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(A**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                x = np.concatenate([[0, 0], code[data], [0, 0]])
                total += np.bincount((x[:-2] * A + x[1:-1]) * A + x[2:], minlength=A**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    return lean(run)


#: Rows restored at once.
RESTORED = 256


def _text_chunks(batch: pa.RecordBatch, model: CharModel, store: dict):
    for a in range(0, batch.num_rows, RESTORED):
        part = batch.slice(a, RESTORED)
        yield part, pa.array([restored(t or "", model, store) for t in part.column("text").to_pylist()], pa.large_string())


def _restore(counts: np.ndarray):
    """Rows with restored texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, store = CharModel(counts), {}
        for batch in batches:
            for part, texts in _text_chunks(batch, model, store):
                yield part.set_column(part.schema.get_field_index("text"), "text", texts.cast(pa.string()))

    return lean(run)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by fold and label, from restored labelled rows (text, fold, toxic)."""
    total = {}
    for batch in batches:
        fold_, toxic = batch.column("fold").to_numpy(), batch.column("toxic").to_numpy()
        for a, b, data, offsets in chunks(batch.column("text")):
            rows, first = features(data, offsets)
            for i in range(b - a):
                key = int(fold_[a + i]) * 2 + int(toxic[a + i])
                if key not in total:
                    total[key] = np.zeros(BUCKETS, np.int32)
                total[key][np.unique(rows[:, first[i] : first[i + 1]])] += 1
    for key, n in total.items():
        some = np.flatnonzero(n)
        for at in np.array_split(some, max(1, len(some) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key, np.int32)), pa.array(at), pa.array(n[at].astype(np.int64))], names=["class", "bucket", "n"])


def weights_of(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log ratio of the shares of toxic and clean documents that have a feature, pulled to 0 where it is rare."""
    rate = (n_toxic + 1) / (n_clean + 1)
    return np.log((toxic + KAPPA * rate / (1 + rate)) / (clean + KAPPA / (1 + rate)) / rate).astype(np.float32)


def statistics(rows: np.ndarray, first: np.ndarray, weights: np.ndarray, i: int) -> np.ndarray:
    """What a text's feature weights say: strongest words, strong words and their share, the mean."""
    a, b = first[i], first[i + 1]
    if b <= a:
        return np.zeros(STATS)
    w = weights[rows[:, a:b]]
    best = w.max(0)
    n = b - a
    top = np.sort(best)[::-1][:5]
    strong, some = best > 2.0, best > 1.0
    kinds = len(np.unique(rows[0, a:b][strong])) if strong.any() else 0
    return np.array([top[0], top.mean(), np.log1p(strong.sum()), np.log1p(kinds), 10 * strong.sum() / (n + 10), 10 * some.sum() / (n + 10), w.mean()])


def _stats(weights: list[np.ndarray], counts: np.ndarray | None = None):
    """Statistics of rows (doc_id, text, fold, ...): ``weights[fold]`` are those that the row's fold didn't shape.

    Texts are restored with the model of ``counts``, or are so already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, store = CharModel(counts) if counts is not None else None, {}
        for batch in batches:
            for part, texts in _text_chunks(batch, model, store) if model else [(batch, batch.column("text"))]:
                fold_ = part.column("fold").to_numpy()
                for a, b, data, offsets in chunks(texts):
                    rows, first = features(data, offsets)
                    out = np.array([statistics(rows, first, weights[fold_[a + i]], i) for i in range(b - a)])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(a, b - a), part.column("fold").slice(a, b - a), part.column("toxic").slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * STATS), pa.array(out.reshape(-1)))], names=["doc_id", "fold", "toxic", "x"])

    return lean(run)


def fit_shares(clean: int, toxic: int, fit_rows: int) -> tuple[int, int]:
    """Of RATE, how much of the clean and of the toxic rows the last step is fitted on: ``fit_rows`` of each about."""
    return tuple(max(1, min(RATE, fit_rows * RATE // max(1, n))) for n in (clean, toxic))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method on standardised columns, of weighted rows: (means, scales, coefficients with the constant last)."""
    w = np.ones(len(x)) if weight is None else weight
    mean = np.average(x, axis=0, weights=w) if w.sum() else np.zeros(x.shape[1])
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w)) + 1e-9 if w.sum() else np.ones(x.shape[1])
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta))
        move = np.linalg.solve(hess, z.T @ (w * (y - p)) - ridge * beta)
        beta += move
        if np.abs(move).max() < 1e-8:
            break
    return mean, scale, beta


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    The character model counts the letters of all documents. Labels (``toxic``; of several of an id the
    largest) are learnt only from rows whose crc32(id) mod 5 isn't 0: all of them count into the feature
    weights, in two halves, so that each labelled row is described by weights that it didn't shape; the
    last step is fitted on ``fit_rows`` rows of each label at most, the first by a hash of the id. Nothing
    but the text makes a score. Null text is empty text; texts without words get the score of no evidence.
    Without labels of both kinds every score is 0. Rows with a null id are scored, held_out is then null; repeated
    rows are scored each and count each; further columns of both tables are ignored; an empty table gives no rows.
    Whole texts are read, in time proportional to their length, disguised or not.
    """
    rows = ids_and_text(docs, id_col, text_col)
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    grams = rows.mapInArrow(_letters(), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(A**3, np.int64)
    counts[grams.column("gram").to_numpy()] = grams.column("n").to_numpy()
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic")).filter(F.crc32(F.col("label_id").cast("string").cast("binary")) % 5 != 0)
    learn = rows.join(broadcast_if_small(known, LABELS_BROADCAST), rows["doc_id"] == known["label_id"]).select("doc_id", "text", (F.xxhash64("doc_id") % 2 != 0).cast("int").alias("fold"), F.col("toxic").cast("int").alias("toxic"))
    learn = stage(learn.mapInArrow(_restore(counts), learn.schema), "toxic-learn")  # read twice below
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in learn.groupBy("fold", "toxic").count().collect()}
    if not sum(v for (_, t), v in sizes.items() if t) or not sum(v for (_, t), v in sizes.items() if not t):
        return rows.select("doc_id", (rest == 0).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    found = learn.mapInArrow(lean(_weigh), "class int, bucket long, n long").groupBy("class", "bucket").agg(F.sum("n").alias("n")).filter("n > 0").toArrow()
    n = np.zeros((4, BUCKETS))
    n[found.column("class").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    size = [sizes.get((k // 2, k % 2), 0) for k in range(4)]
    crossed = [weights_of(n[3], n[2], size[3], size[2]), weights_of(n[1], n[0], size[1], size[0])]
    total = weights_of(n[1] + n[3], n[0] + n[2], size[1] + size[3], size[0] + size[2])
    schema = "doc_id long, fold int, toxic int, x array<double>"
    shares = fit_shares(size[0] + size[2], size[1] + size[3], fit_rows)
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(RATE))
    part = learn.filter(drawn < F.when(F.col("toxic") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))) if min(shares) < RATE else learn
    sample = part.mapInArrow(_stats(crossed), schema).toArrow()
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, STATS)
    y = sample.column("toxic").to_numpy()
    # a row stands for as many as its label's share leaves out, so the scores are those of all rows
    mean, scale, beta = fit(x, y.astype(float), np.array([RATE / k for k in shares])[y])
    plain = rows.select("doc_id", "text", F.lit(0).alias("fold"), F.lit(None).cast("int").alias("toxic"))
    out = plain.mapInArrow(_stats([total], counts), schema)
    logit = F.lit(float(beta[-1]))
    for i in range(STATS):
        logit = logit + (F.col("x")[i] - float(mean[i])) / float(scale[i]) * float(beta[i])
    score = 1 / (1 + F.exp(-logit))
    return out.select("doc_id", (rest == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the documents whose score is 0.5 or more.

    Rows with a null id stay; rows that share an id go together; an empty table stays empty.
    """
    key = free_name(docs, "bad_id")
    bad = score_toxicity(docs, labels, id_col, text_col).filter("predicted = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(key)).distinct()
    bad = broadcast_if_small(stage(bad, "toxic-ids"), 1_000_000)
    release(docs.sparkSession)
    return docs.join(bad, F.col(id_col) == F.col(key), "left_anti")


def op5_toxicity(spark, sf_dir):
    """``score_toxicity`` of all documents with the labels table; null texts get the score of no evidence."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
