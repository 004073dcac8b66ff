"""Signal operators that need a transform of a whole scene: Arrow batches in, rows out."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions import features as X


def _array(value) -> np.ndarray:
    return np.nan_to_num(np.asarray(value, float), nan=0.0, posinf=0.0, neginf=0.0) if value is not None else np.zeros(0)


def scene_features(df: DataFrame, scene_id: str, x: str, groups: tuple[str, ...] = tuple(X.GROUPS), hop: int = X.SIZE // 2) -> DataFrame:
    """scene_id, start and one float column per feature, for every window that fits; scenes are one row each.

    A scene travels alone: memory holds one scene and its band signals. Scenes without a whole window, and
    null signals, give no rows. Chunks of 30 s are the usual scene length; the picks' medians depend on it.
    """
    names = X.feature_names(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _array(batch.column("x")[i].as_py())
                if len(x) < X.SIZE:
                    continue
                with np.errstate(all="ignore"):
                    scene = X.Scene(x)
                    rows = [(s, X.window_features(scene, s, groups)) for s in scene.starts(hop)]
                ids = batch.column("scene_id").take(pa.array([i] * len(rows)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([s for s, _ in rows], pa.int32())] + [pa.array([np.float32(r[n]) for _, r in rows], pa.float32()) for n in names], names=["scene_id", "start", *names])

    kind = df.schema[scene_id].dataType.simpleString()
    return df.select(F.col(scene_id).alias("scene_id"), F.col(x).cast("array<double>").alias("x")).mapInArrow(run, f"scene_id {kind}, start int, " + ", ".join(f"`{n}` float" for n in names))


def per_scene(df: DataFrame, scene_id: str, x: str, fields: str, work) -> DataFrame:
    """scene_id plus the rows (tuples) that ``work(x)`` yields for each scene."""
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    kind = df.schema[scene_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(work(_array(batch.column("x")[i].as_py())))
                if rows:
                    ids = batch.column("scene_id").take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[k] for r in rows]) for k in range(len(names))]], names=["scene_id", *names])

    return df.select(F.col(scene_id).alias("scene_id"), F.col(x).cast("array<double>").alias("x")).mapInArrow(run, f"scene_id {kind}, {fields}")


def welch_psd(df: DataFrame, scene_id: str, x: str, fs: float, n: int) -> DataFrame:
    """scene_id, f, p."""

    def work(v: np.ndarray):
        if len(v):
            f, p = dsp.welch(v, fs, n)
            yield from zip(f.tolist(), p.tolist())

    return per_scene(df, scene_id, x, "f double, p double", work)


def resampled(df: DataFrame, scene_id: str, x: str, up: int, down: int) -> DataFrame:
    """scene_id, y: the signal at up/down times its rate."""
    return per_scene(df, scene_id, x, "y array<double>", lambda v: [(dsp.resample(v, up, down).tolist(),)] if len(v) else [])


def spectral_lines(df: DataFrame, scene_id: str, x: str, fs: float, n: int, width: int = 31, least_db: float = 6.0, apart_hz: float = 1.0) -> DataFrame:
    """scene_id, f, prominence_db: peaks of the spectrum in dB above its running median."""

    def work(v: np.ndarray):
        if len(v):
            f, p = dsp.welch(v, fs, n)
            over = 10 * np.log10(p + 1e-12)
            over = over - dsp.running_median(over, width)
            for k in dsp.peaks(over, least_db, max(1, round(apart_hz / (f[1] - f[0])) if len(f) > 1 else 1)):
                yield float(f[k]), float(over[k])

    return per_scene(df, scene_id, x, "f double, prominence_db double", work)


def residual_bumps(df: DataFrame, scene_id: str, x: str, fs: float, n: int, degree: int = 4) -> DataFrame:
    """scene_id, f, height_db: the largest excess of the log spectrum over a polynomial in log frequency."""

    def work(v: np.ndarray):
        if len(v) > 2 * degree:
            f, p = dsp.welch(v, fs, n)
            u, y = np.log10(f[1:]), 10 * np.log10(p[1:] + 1e-12)
            rest = y - np.polyval(np.polyfit(u, y, degree), u)
            k = int(rest.argmax())
            yield float(f[1:][k]), float(rest[k])

    return per_scene(df, scene_id, x, "f double, height_db double", work)


def band_levels(df: DataFrame, scene_id: str, x: str, fs: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """scene_id and the brick-wall RMS of each band."""
    return per_scene(df, scene_id, x, ", ".join(f"{b} double" for b in bands), lambda v: [tuple(dsp.band_rms(v, lo, hi, fs) for lo, hi in bands.values())] if len(v) else [])


def sensor_response(df: DataFrame, scene_id: str, x: str, fs: float, f0: float = 10.0, damping: float = 0.6, gain: float = 1.0, rail: float = float("inf"), lsb: float = 0.0) -> DataFrame:
    """scene_id, y: a geophone's second-order response, then gain, rail and quantising, half to even."""

    def work(v: np.ndarray):
        if len(v):
            f = np.fft.rfftfreq(len(v), 1 / fs)
            s, w0 = 2j * np.pi * f, 2 * np.pi * f0
            y = np.clip(np.fft.irfft(np.fft.rfft(v) * s**2 / (s**2 + 2 * damping * w0 * s + w0**2), len(v)) * gain, -rail, rail)
            yield ((np.round(y / lsb) * lsb if lsb > 0 else y).tolist(),)

    return per_scene(df, scene_id, x, "y array<double>", work)
