"""Quality rules: counted rules, then a hashed n-gram log-likelihood ratio of trusted against raw text."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, stage, table
from .textkernel import SPACE, U, chunks, lean, mix, per_text, prefix, runs, sequences, slices

#: Buckets of hashed uni- and bigrams: the model's size, whatever the corpus.
BUCKETS = 1 << 18
#: Pseudo-count of a bucket: rare n-grams say little.
KAPPA = 5.0
#: Histogram of labelled scores, from which the threshold is read.
BINS, LOW, HIGH = 4_000, -2.0, 2.0
#: Share of trusted documents that the threshold must keep.
TRUSTED_KEPT = 0.995
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, per_text(starts, offsets)


def _buckets(words: np.ndarray, a: int, b: int) -> np.ndarray:
    return np.concatenate([mix(words[a:b]), sequences(words[a:b], 2)]) & U(BUCKETS - 1)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text; and its word hashes."""
    starts, ends, first = _words(data, offsets)
    sums = prefix(data)
    words = slices(sums, starts, ends)
    inside = ~SPACE[data]
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    n_texts = len(offsets) - 1
    line_a, line_b = runs(data != 10, offsets)
    filled = np.concatenate([[0], np.cumsum(inside)])
    has_word = filled[line_b] > filled[line_a]
    line_a, line_b = line_a[has_word], line_b[has_word]
    lines, line_first = slices(sums, line_a, line_b), per_text(line_a, offsets)
    windows = sequences(words, 8)
    dup, repeat = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    for i in range(n_texts):
        a, b = line_first[i], line_first[i + 1]
        if b - a > 1:
            s = np.sort(lines[a:b])
            dup[i] = np.count_nonzero(s[1:] == s[:-1])
        a, b = first[i], first[i + 1]
        if b - a > 8:
            own = windows[a : b - 7]
            order = np.argsort(own, kind="stable")
            s = own[order]
            same = s[1:] == s[:-1]
            if same.any():
                twice = np.zeros(len(s), bool)
                twice[1:] |= same
                twice[:-1] |= same
                change = np.zeros(b - a + 1, np.int64)
                at = order[twice]
                change[at] += 1
                np.subtract.at(change, at + 8, 1)
                repeat[i] = np.count_nonzero(np.cumsum(change)[:-1] > 0)
    return {"n_words": np.diff(first), "word_chars": total(inside & ((data & 0xC0) != 0x80)), "n_symbols": total(SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": repeat, "first": first, "words": words}


def _count():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in chunks(batch.column("text")):
                starts, ends, first = _words(data, offsets)
                words = slices(prefix(data), starts, ends)
                uni = mix(words) & U(BUCKETS - 1)
                bi = sequences(words, 2) & U(BUCKETS - 1)
                text_of = np.repeat(np.arange(b - a), np.diff(first))
                inner = text_of[1:] == text_of[:-1]
                good = trusted[a:b][text_of] if len(text_of) else np.zeros(0, bool)
                raw += np.bincount(uni.astype(np.int64), minlength=BUCKETS) + np.bincount(bi[inner].astype(np.int64), minlength=BUCKETS)
                target += np.bincount(uni[good].astype(np.int64), minlength=BUCKETS) + np.bincount(bi[inner & good[1:]].astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(raw)
        for part in np.array_split(some, max(1, len(some) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(raw[part]), pa.array(target[part])], names=["bucket", "raw", "target"])

    return lean(run)


def _score(raw: np.ndarray, target: np.ndarray):
    """Base counts, and the mean log ratio as it is for a text outside the trusted ones (llr) and for one of them (llr_trusted).

    The text's own counts are taken out, so labelled and other texts are measured alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, t = raw.astype(float), target.astype(float)
        all_r, all_t = r.sum(), t.sum()
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                c = base_counts(data, offsets)
                first, words = c.pop("first"), c.pop("words")
                score = np.zeros((2, b - a))
                for i in range(b - a):
                    n = first[i + 1] - first[i]
                    if not n or not all_t:
                        continue
                    bucket, own = np.unique(_buckets(words, first[i], first[i + 1]), return_counts=True)
                    grams = own.sum()
                    below = np.log(r[bucket] - own + KAPPA)
                    for trusted in (0, 1):
                        share = max(all_t - grams * trusted, 1.0) / max(all_r - grams, 1.0)
                        rest = np.maximum(t[bucket] - own * trusted, 0.0)  # below 0 only for texts that aren't trusted, whose value isn't used
                        score[trusted, i] = (own * (np.log((rest + KAPPA * share) / share) - below)).sum() / grams
                failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a)] + [pa.array(c[x].astype(np.int64)) for x in COUNTS] + [pa.array(failed), pa.array(score[0]), pa.array(score[1])], names=["doc_id", *COUNTS, "base_failed", "llr", "llr_trusted"])

    return lean(run)


#: Labels up to which they are broadcast.
LABELS_BROADCAST = 1_000_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def threshold_of(good: np.ndarray, bad: np.ndarray, kept: float = TRUSTED_KEPT) -> float:
    """From histograms of labelled scores: the cut with the largest true less false positive rate among those that keep ``kept`` of the trusted.

    Without trusted or without rejected labels there is nothing to tell apart, and everything stays.
    """
    if not good.sum() or not bad.sum():
        return float("-inf")
    above_good = 1 - np.concatenate([[0], np.cumsum(good)[:-1]]) / good.sum()
    above_bad = 1 - np.concatenate([[0], np.cumsum(bad)[:-1]]) / bad.sum()
    gain = np.where(above_good >= kept, above_good - above_bad, -1)
    return LOW + int(np.argmax(gain)) * (HIGH - LOW) / BINS


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    Trusted text is what ``labels`` marks with quality 1 (of several labels of an id the largest counts);
    the raw corpus is all of ``docs``. Every document's n-grams are counted, and every document's mean
    log ratio is compared with one threshold, which is read from a histogram of the labelled documents'
    scores. A document's own counts never speak for it. Null text is empty text: it fails the base rules.
    Without labels only the base rules decide. Rows with a null id are scored as raw text. Repeated rows count
    again and come again; a score at the threshold stays; texts of any length are read whole. Labels beyond
    ``LABELS_BROADCAST`` meet narrow rows, and texts move once, to the trusted ids.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    known = stage(known, "quality-labels")
    few = known.count() <= LABELS_BROADCAST
    rows = ids_and_text(docs, id_col, text_col)
    trusted = F.coalesce(F.col("quality") == 1, F.lit(False)).alias("trusted")
    schema = "bucket long, raw long, target long"
    if few:
        counted = rows.join(F.broadcast(known), rows["doc_id"] == known["label_id"], "left").select("text", trusted).mapInArrow(_count(), schema)
    else:  # the raw counts need no label; texts move once, to the ids of trusted ones
        good = rows.join(known.filter("quality = 1"), rows["doc_id"] == known["label_id"], "left_semi").select("text", F.lit(True).alias("trusted"))
        raw_counts = rows.select("text", F.lit(False).alias("trusted")).mapInArrow(_count(), schema)
        counted = raw_counts.unionByName(good.mapInArrow(_count(), schema).withColumn("raw", F.lit(0).cast("long")))
    counted = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = counted.column("bucket").to_numpy()
    raw[at], target[at] = counted.column("raw").to_numpy(), counted.column("target").to_numpy()
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, llr double, llr_trusted double"
    scored = rows.mapInArrow(_score(raw, target), schema)
    if few:
        scored = scored.join(F.broadcast(known), scored["doc_id"] == known["label_id"], "left").drop("label_id")
    else:  # narrow rows; those without an id find nothing and stay where they are
        scored = stage(scored, "quality-scores")
        keyed = scored.filter("doc_id IS NOT NULL").join(known, scored["doc_id"] == known["label_id"], "left").drop("label_id")
        scored = keyed.unionByName(scored.filter("doc_id IS NULL").withColumn("quality", F.lit(None).cast("int")))
    scored = scored.withColumn("llr", F.when(F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("llr_trusted")).otherwise(F.col("llr"))).drop("llr_trusted")
    scored = stage(scored, "quality")
    cell = F.least(F.greatest(F.floor((F.col("llr") - LOW) / (HIGH - LOW) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    hist = scored.filter("quality IS NOT NULL AND NOT base_failed").groupBy(cell.alias("bin"), (F.col("quality") == 1).alias("good")).count().collect()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in hist:
        (good if r["good"] else bad)[r["bin"]] += r["count"]
    cut = threshold_of(good, bad)
    return scored.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("llr") >= F.lit(cut))).alias("kept"), "llr")


def op10_quality(spark, sf_dir):
    """``quality_verdicts`` of all documents with the labels table; null texts have no words and fail, repeated rows come again."""
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
