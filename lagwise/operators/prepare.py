"""Crop, centre, normalise, peaks at zero crossings, top peaks, support.

Crop is a column expression. The rest is one Arrow kernel per batch: its parts feed each other, and as
expressions the optimizer would inline each series' mean into every sample's lambda.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.config import Config


def crop(series: DataFrame, cfg: Config) -> DataFrame:
    """The window about the first largest absolute sample of the range; an error where it does not fit."""
    if not cfg.crop:
        return series
    part = F.slice("d", cfg.crop_min + 1, max(0, cfg.crop_max - cfg.crop_min))
    size = F.transform(part, F.abs)
    peak: Column = F.when(F.size(part) == 0, F.lit(0)).otherwise(cfg.crop_min + F.array_position(size, F.array_max(size)) - 1).cast("int")
    fits = (peak - cfg.crop_before >= 0) & (peak + cfg.crop_after <= F.size("d")) & (F.lit(cfg.crop_max) <= F.size("d"))
    return series.withColumn("_peak", peak).select(
        "event_id",
        F.when(fits, F.slice("d", F.greatest(F.col("_peak") - cfg.crop_before + 1, F.lit(1)), F.lit(cfg.samples))).alias("d"),
        F.coalesce("error", F.when(~fits, F.lit("array out of bounds while cropping"))).alias("error"),
    )


def crossing_peaks(c: np.ndarray) -> np.ndarray:
    """Positions of the peaks of one series, one for each sign crossing, in order.

    A sample is positive if > 0. The search begins at position 1; what follows the last crossing gives
    no peak; a run without any nonzero sample repeats the peak before it (at first: position 0).
    """
    sign = c > 0
    at = np.flatnonzero(sign[1:] != sign[:-1]) + 1
    size, out, last, start = np.abs(c), np.empty(len(at), np.int64), 0, 1
    for k, end in enumerate(at):
        if end > start:
            best = start + int(size[start:end].argmax())
            if size[best] > 0:
                last = best
        out[k], start = last, end
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def unit(x: np.ndarray, centre: bool) -> tuple[np.ndarray, np.ndarray]:
    """(centred and divided by the root of the sum of squares, that root); NaN for zero vectors."""
    c = x - (x.sum(axis=1) / x.shape[1])[:, None] if centre else x
    norm = np.sqrt((c * c).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return c / norm[:, None], norm


def _event_type(df: DataFrame) -> tuple[str, pa.DataType]:
    kind = dict(df.dtypes)["event_id"]
    return (kind, {"bigint": pa.int64(), "int": pa.int32()}[kind]) if kind in ("bigint", "int") else ("string", pa.string())


def prepare(series: DataFrame, cfg: Config) -> DataFrame:
    """``event_id, d`` (unit), ``peak_amp, max_peaks, min_peaks, support, error`` of each series, errors kept."""
    name, kind = _event_type(series)
    k, m = cfg.top_k, cfg.samples

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for event, d, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error is not None or d is None:
                    out.append((event, None, None, None, None, None, error or "no samples"))
                    continue
                u, norm = (x[0] for x in unit(np.array([d], float).reshape(1, m), cfg.centre))
                pos = crossing_peaks(u) if norm > 0 else np.empty(0, np.int64)
                if len(pos) < k:
                    out.append((event, None, None, None, None, None, f"only {len(pos)} peaks, {k} needed"))
                    continue
                order = pos[np.argsort(-u[pos], kind="stable")]
                top, low = order[:k], order[::-1][:k]
                support = np.flatnonzero((u > u[top[0]] * cfg.amplitude) | (u < u[low[0]] * cfg.amplitude)) if k else np.empty(0, np.int64)
                out.append((event, u, float(np.abs(u[1:]).max() * norm), top, low, support, None))
            cols = list(zip(*out, strict=True)) or [()] * 7
            ints = pa.list_(pa.int32())
            kinds = (kind, pa.list_(pa.float64()), pa.float64(), ints, ints, ints, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["event_id", "d", "peak_amp", "max_peaks", "min_peaks", "support", "error"])

    rows = crop(series, cfg).select("event_id", "d", "error")
    return rows.mapInArrow(run, f"event_id {name}, d array<double>, peak_amp double, max_peaks array<int>, min_peaks array<int>, support array<int>, error string")


def zero_crossings(series: DataFrame, cfg: Config) -> DataFrame:
    """P6 in rows: ``event_id, ord, pos, amp`` (amplitude of the unit series), for every series."""
    name, kind = _event_type(series)

    def run(batches):
        for batch in batches:
            ids, ords, places, amps = [], [], [], []
            for event, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, norm = (x[0] for x in unit(np.array([d], float), cfg.centre))
                for n, p in enumerate(crossing_peaks(u) if norm > 0 else ()):
                    ids.append(event)
                    ords.append(n)
                    places.append(int(p))
                    amps.append(float(u[p]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(ords, pa.int32()), pa.array(places, pa.int32()), pa.array(amps, pa.float64())], ["event_id", "ord", "pos", "amp"])

    return crop(series, cfg).where("error IS NULL").select("event_id", "d").mapInArrow(run, f"event_id {name}, ord int, pos int, amp double")


def diagnostics(series: DataFrame, cfg: Config) -> DataFrame:
    """What preparation does to each series: ``event_id, samples, trailing_zeros, peak_at, mean, norm, error``.

    ``trailing_zeros`` counts those at the end, padding included; ``peak_at`` is the first largest absolute
    sample of the whole series; mean and norm are those of the series as cropped.
    """
    size = F.transform("d", F.abs)
    seen = series.select("event_id", F.size("d").alias("samples"), F.aggregate("d", F.lit(0), lambda n, x: F.when(x == 0, n + 1).otherwise(0)).alias("trailing_zeros"), (F.array_position(size, F.array_max(size)) - 1).alias("peak_at"))
    sums = crop(series, cfg).select("event_id", "error", F.aggregate("d", F.lit(0.0), lambda s, x: s + x).alias("_s"), F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x).alias("_q"))
    mean = F.col("_s") / cfg.samples
    norm = F.sqrt(F.greatest(F.col("_q") - cfg.samples * mean * mean, F.lit(0.0))) if cfg.centre else F.sqrt("_q")
    return seen.join(sums, "event_id").select("event_id", "samples", "trailing_zeros", "peak_at", mean.alias("mean"), norm.alias("norm"), "error")
