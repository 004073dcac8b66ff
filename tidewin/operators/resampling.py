"""Block resampling: confidence bounds of sums over blocks that are drawn again and again inside their groups."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws worked out at once.
DRAWS = 1 << 20


def arithmetic_draw(rep: np.ndarray, slot: np.ndarray, group: int) -> np.ndarray:
    """A whole number for a replicate, a slot and a group; from arithmetic alone, so any engine repeats it."""
    return np.fmod(rep * 7919 + slot * 104729 + group * 1299709 + rep * slot * 15485863, 1000003)


def block_resamples(blocks: DataFrame, group: str, order: str, counts: list[str], replicates: int = 1000, draw: Callable = arithmetic_draw) -> DataFrame:
    """rep (from 0) and the sum of each count over the blocks that the replicate draws.

    ``blocks`` has one row a block. A group (whole numbers) of m blocks fills m slots in each replicate; a slot takes the block whose
    place in ``order`` is ``draw`` modulo m. A task adds what its groups draw to one row of counters per
    replicate, so ``replicates`` rows leave it, whatever it read; nothing is copied per replicate. Rows with a null
    group are left out; null counts are 0.
    """
    names = ["rep", *counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(counts), replicates), np.int64)
        rep = np.arange(replicates, dtype=np.int64)[:, None]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def add() -> None:
            values = np.concatenate([v for _, v in held], axis=1)
            m = values.shape[1]
            for first in range(0, m, max(1, DRAWS // replicates)):
                slot = np.arange(first, min(m, first + max(1, DRAWS // replicates)), dtype=np.int64)[None, :]
                pick = draw(rep, slot, int(now)) % m
                for k in range(len(counts)):
                    total[k] += values[k][pick].sum(1)

        for batch in batches:
            g = batch.column("_g").to_numpy()
            values = np.stack([batch.column(c).to_numpy() for c in counts]) if batch.num_rows else None
            for lo, hi in zip(*_ranges(g), strict=True):
                if held and g[lo] != now:
                    add()
                    held = []
                now = g[lo]
                held.append((g[lo:hi], values[:, lo:hi]))
        if held:
            add()
            yield pa.RecordBatch.from_arrays([pa.array(rep[:, 0]), *[pa.array(t) for t in total]], names=names)

    rows = blocks.filter(F.col(group).isNotNull()).select(F.col(group).cast("long").alias("_g"), order, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])
    part = rows.repartition("_g").sortWithinPartitions("_g", order).select("_g", *counts).mapInArrow(run, ", ".join(f"`{n}` long" for n in names))
    return part.groupBy("rep").agg(*[F.sum(c).alias(c) for c in counts])


def _ranges(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(g[1:] != g[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(g)]])
