"""Byte-level BPE as a monoid: halves are encoded apart, neighbours joined by re-encoding a boundary window.

Two levels. A text is a sequence of matches of the pre-token pattern; a match is a sequence of tokens. At
both, an element is the encoding of a piece, and the product of two elements is the encoding of the joined
piece, found by encoding anew only a window around the seam that grows until what lies outside is proven
unchanged:

* matches: they are found from left to right, and where one ends depends on its own characters and one
  more at most. Matches of the left piece that end two characters or more before its end stand. From the
  first of the others on, the pattern is matched anew, until a match ends where one of the right piece
  ends: from there on both see the same characters and so the same matches.
* tokens: a sequence of tokens is the encoding of its bytes exactly if every two neighbours are the
  encoding of their own bytes. So a re-encoded window is right when the pairs at its two edges are.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_text, process_store, table
from .textkernel import lean

#: Characters of a leaf, whose matches are found at once.
LEAF_CHARS = 1_024
#: Bytes of a leaf of a single match, which is merged pair by pair.
LEAF_BYTES = 32
#: Encodings of matches that a worker keeps: a young and an old generation of so many entries at most.
CACHE = 100_000
#: A rank above all.
NONE = 1 << 60
DECODE_LEAF = 4_096


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Encoder and decoder of one vocabulary. ``rank_file``: lines of base64 bytes and rank.

    Joins take a token that equals a whole match for what merging gives, so every token must be reachable by merges, as
    all 50,000 of the default file are; a vocabulary with others would be encoded differently in long matches.
    """

    def __init__(self, rank_file: str | None = None, pattern: str | None = None, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex

        with open(rank_file or default_ranks(), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.pattern = regex.compile(pattern or default_pattern())
        self.leaf_chars, self.leaf_bytes = max(1, leaf_chars), max(1, leaf_bytes)
        self.packed: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    # ---- tokens of one match

    def merge(self, data: bytes) -> list[int]:
        """The definition: the pair with the lowest rank is merged, the leftmost first, until none is known."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        if len(data) > 96:
            return self.merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        get = ranks.get
        known = [get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while known and (low := min(known)) != NONE:
            at = known.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del known[at]
            if at < len(known):
                known[at] = get(parts[at] + parts[at + 1], NONE)
            if at:
                known[at - 1] = get(parts[at - 1] + parts[at], NONE)
        return [ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs, for windows that had to grow."""
        ranks, n = self.ranks, len(data)
        parts = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := ranks.get(parts[k] + parts[i])) is not None:
                heapq.heappush(heap, (r, k))
        return [ranks[p] for p in parts if p]

    def fit(self, a: int, b: int) -> bool:
        """Whether tokens a, b are what their joined bytes encode to."""
        key = (a, b)
        if (found := self.fits.get(key)) is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            found = self.fits[key] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return found

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.fit(left[-1], right[0]):
            return left + right
        w = 1
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            window = self.merge(b"".join([self.pieces[t] for t in left[a:] + right[:b]]))
            ok_left = a == 0 or self.fit(left[a - 1], window[0])
            ok_right = b == len(right) or self.fit(window[-1], right[b])
            if ok_left and ok_right:
                return left[:a] + window + right[b:]
            w *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        mid = len(data) // 2
        return self.join_tokens(self.encode_bytes(data[:mid]), self.encode_bytes(data[mid:]))

    def pack(self, match: str) -> bytes:
        """The ids of one match as little-endian unsigned 32-bit integers."""
        if (found := self.packed.get(match)) is None:
            if (found := self.aged.get(match)) is None:
                ids = self.encode_bytes(match.encode())
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(match) <= 64:
                if len(self.packed) >= CACHE:
                    self.aged = self.packed
                    self.packed = {}
                self.packed[match] = found
        return found

    # ---- matches of a text

    def matches(self, text: str) -> list[str]:
        """All matches, by halving."""
        if len(text) <= self.leaf_chars:
            return self.pattern.findall(text)
        mid = len(text) // 2
        return self.join_matches(self.matches(text[:mid]), self.matches(text[mid:]))

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        # matches that end less than two characters before the seam may change
        keep, tail = len(left), 0
        while keep and tail < 2:
            keep -= 1
            tail += len(left[keep])
        head = "".join(left[keep:])
        w = 2
        while True:
            b = min(len(right), w)
            window = head + "".join(right[:b])
            found = self.pattern.findall(window)
            if b == len(right):
                return left[:keep] + found
            # matches of the window that end two characters or more before its end stand
            ends, at = {}, len(head)
            for i, m in enumerate(right[:b]):
                at += len(m)
                ends[at] = i + 1
            at = 0
            for j, m in enumerate(found):
                at += len(m)
                if at + 2 > len(window):
                    break
                if at >= len(head) and at in ends:
                    return left[:keep] + found[: j + 1] + right[ends[at] :]
            w *= 2

    # ---- whole texts

    def encode(self, text: str) -> bytes:
        pack, get = self.pack, self.packed.get  # an aged generation still answers here, and pack() moves on
        return b"".join([get(m) or pack(m) for m in self.matches(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; halves are decoded apart and concatenated."""
        if len(ids) <= DECODE_LEAF:
            pieces = self.pieces
            return b"".join([pieces[i] for i in ids.tolist()])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def codec(rank_file: str | None, pattern: str | None) -> Codec:
    """The codec of this process: later tasks of a Python worker find what earlier ones stored."""
    kept = process_store("codecs")
    key = (rank_file, pattern)
    if key not in kept:
        kept[key] = Codec(rank_file, pattern)
    return kept[key]


def _encoded(rank_file: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return lean(run)


def _digested(rank_file: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                n, ids_hash, text_hash = [], [], []
                for t in part.column("text").to_pylist():
                    ids = c.encode(t or "")
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4"))).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return lean(run)


def _decoded(rank_file: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            out = [c.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return lean(run)


def encode(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers), one row per input row.

    Null and empty texts have no ids. Nothing is shuffled, so repeated rows, ties and hot sources don't
    matter; other columns are ignored. ``rank_file`` is read on the executors (default: the public 50k file).
    """
    return ids_and_text(docs, id_col, text_col).mapInArrow(_encoded(rank_file, pattern), "doc_id long, ids binary")


def decode(encoded: DataFrame, rank_file: str | None = None) -> DataFrame:
    """doc_id and text from ``encode``'s rows; null ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(rank_file, None), "doc_id long, text string")


def round_trip(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: its text encoded, and its ids decoded again."""
    return ids_and_text(docs, id_col, text_col).mapInArrow(_digested(rank_file, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark, sf_dir):
    """``round_trip`` of all documents; null texts are empty texts, repeated rows come again, an empty table gives no rows."""
    return round_trip(table(spark, sf_dir, "documents"))
