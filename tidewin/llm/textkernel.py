"""Words, lines and shingles of many texts at once, on the bytes of an Arrow batch.

Hashes are polynomials modulo 2**64 over random byte values, taken from prefix sums, then mixed. Two
different strings share one with a chance of about 2**-64.
"""
from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
U = np.uint64


def lean(run):
    """``run`` over a task's batches; when it ends, memory that Python, Arrow and the C library hold free goes back to the system.

    Workers live on between tasks, beside the heap of their executor, whose next stage may need the room.
    """
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
        x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
        return x ^ (x >> U(33))


R = int(splitmix(1, 77)[0]) | 1
R_INV = pow(R, -1, 1 << 64)
BYTE = splitmix(256, 5) | U(1)
ORDER = splitmix(64, 9) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """r**i and r**-i for positions of a chunk; grows when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            m = 1 << int(n + 1).bit_length()
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([np.ones(1, U), np.cumprod(np.full(m - 1, x, dtype=U), dtype=U)]) for x in (U(R), U(R_INV)))
        return self.up, self.down


POWERS = Powers()


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a text's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def prefix(data: np.ndarray) -> np.ndarray:
    up, _ = POWERS.of(len(data))
    out = np.zeros(len(data) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]."""
    _, down = POWERS.of(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts])


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of each text's runs among all runs."""
    return np.searchsorted(starts, offsets, "left")


def sequences(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbours: element i stands for words[i:i+k]; len - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += words[j : j + n] * ORDER[j]
        return mix(out + U(k))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles (fewer words: the whole sequence is one), and offsets.

    A-Z are lower-cased; words are runs of bytes outside the six ASCII white-space characters.
    """
    low = LOWER[data]
    starts, ends = runs(~SPACE[low], offsets)
    words = slices(prefix(low), starts, ends)
    first = per_text(starts, offsets)
    every = sequences(words, k)
    parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(sizes)):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = sequences(words[a:b], int(b - a))
        else:
            continue
        parts.append(s)
        sizes[i] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)])
