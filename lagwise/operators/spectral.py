"""Magnitude spectra and what derives from them. Only the transform itself is an Arrow kernel."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.config import Config, next_power_of_two
from lagwise.operators.prepare import matrix


def passband(p: int, cfg: Config) -> tuple[int, int]:
    """First bin and end of the band; the padded length is divided by the rate in whole numbers first."""
    return int(p // cfg.rate * cfg.below_hz), min(p // 2, int(p // cfg.rate * cfg.above_hz))


def magnitudes(frames: DataFrame, length: int, p: int, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """``keys, mags``: magnitudes of bins 0 .. p/2-1 of each frame ``d`` of ``length`` samples, zero-padded to p."""
    kinds = dict(frames.dtypes)

    def run(batches):
        for batch in batches:
            mags = np.abs(np.fft.rfft(matrix(batch.column(len(keys)), length), p))[:, : p // 2]
            offsets = pa.array(np.arange(len(mags) + 1, dtype=np.int32) * (p // 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(mags).ravel()))], [*keys, "mags"])

    return frames.select(*keys, "d").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", mags array<double>")


def spectrum(prepared: DataFrame, cfg: Config) -> DataFrame:
    """``event_id, k, freq, mag`` within the band."""
    return _bins(magnitudes(prepared.where("error IS NULL"), cfg.samples, cfg.padded), cfg, cfg.padded, ("event_id",))


def _bins(mags: DataFrame, cfg: Config, p: int, keys: tuple[str, ...]) -> DataFrame:
    low, end = passband(p, cfg)
    part = F.slice("mags", low + 1, max(0, end - low))
    rows = mags.select(*keys, F.posexplode(part).alias("_k", "mag")).withColumn("k", F.col("_k") + low)
    return rows.select(*keys, "k", (F.col("k").cast("double") * cfg.rate / p).alias("freq"), "mag")


def band_start(freq: Column, cfg: Config) -> Column:
    return F.lit(cfg.band_hz) * (freq / F.lit(cfg.band_hz)).cast("int")


def band_means(bins: DataFrame, cfg: Config, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """``keys, band, mean`` of nonempty bands."""
    return bins.groupBy(*keys, band_start(F.col("freq"), cfg).alias("band")).agg(F.avg("mag").alias("mean"))


def band_vectors(means: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """X8 in one row for each key: ``bands`` and unit ``vec``, by ascending band; null where all means are 0.

    The norm is summed by ascending band too, so equal series have equal vectors.
    """
    grouped = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("band", "mean"))).alias("b"))
    grouped = grouped.withColumn("norm", F.sqrt(F.aggregate("b", F.lit(0.0), lambda s, x: s + x["mean"] * x["mean"])))
    return grouped.select(*keys, F.transform("b", lambda x: x["band"]).alias("bands"), F.transform("b", lambda x: F.try_divide(x["mean"], F.col("norm"))).alias("vec"))


def spread(bins: DataFrame) -> DataFrame:
    """Sample deviation of the band's magnitudes; 0 for one bin."""
    return bins.groupBy("event_id").agg(F.coalesce(F.stddev_samp("mag"), F.lit(0.0)).alias("sd"))


def parse_bands(text: str | None) -> list[tuple[float, float]]:
    """X11: ``[lo-hi] [lo-hi]``."""
    if text is None:
        return []
    out = []
    for band in re.sub(r"[\[\]()]", "", text).split(" "):
        try:
            low, high = map(float, band.split("-"))
        except ValueError:
            raise ValueError(f"cannot read band {band!r} of {text!r}; write low-high in Hz, bands parted by one blank") from None
        out.append((low, high))
    return out


def configured_means(cfg: Config) -> Column:
    """X11: mean magnitude (column ``mags``) of each configured range of bins; NaN where it is empty."""
    p, means = cfg.padded, []
    for low, high in parse_bands(cfg.mean_bands):
        a, b = int(p // cfg.rate * low), min(p // 2, int(p // cfg.rate * high))
        part = F.slice("mags", a + 1, max(0, b - a))
        means.append(F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.lit(float(b - a)) if b > a else F.lit(float("nan")))
    return F.array(*means).cast("array<double>")


def pick_dominant(peaks: Column, cfg: Config) -> Column:
    """Greedy choice from an array of (mag, freq, k): by falling magnitude, none within the width of one chosen."""
    order = F.array_sort(peaks, lambda x, y: F.when(x["mag"] > y["mag"], -1).when(x["mag"] < y["mag"], 1).otherwise(x["k"] - y["k"]))
    free = lambda acc, x: ~F.exists(acc, lambda f: F.abs(x["freq"] - f) < cfg.band_width)
    room = lambda acc: F.lit(True) if cfg.top_freqs == 0 else F.size(acc) < cfg.top_freqs
    return F.aggregate(order, F.array().cast("array<double>"), lambda acc, x: F.when(room(acc) & free(acc, x), F.concat(acc, F.array(x["freq"]))).otherwise(acc))


def dominant(prepared: DataFrame, cfg: Config) -> DataFrame:
    """M6: ``event_id, freqs, peak_amp, sd, band_means``, without a shuffle."""
    rows = prepared.where("error IS NULL").select(F.struct("event_id", "peak_amp").alias("key"), "d")
    mags = magnitudes(rows, cfg.samples, cfg.padded, ("key",))
    low, end = passband(cfg.padded, cfg)
    part = F.slice("mags", low + 1, max(0, end - low))
    peaks = F.transform(part, lambda x, i: F.struct(x.alias("mag"), ((i + low).cast("double") * cfg.rate / cfg.padded).alias("freq"), (i + low).alias("k")))
    n = float(max(0, end - low))
    mags = mags.withColumn("_mean", F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.lit(n or float("nan")))
    square = F.aggregate(F.transform(F.arrays_zip(part.alias("x"), F.array_repeat("_mean", int(n)).alias("m")), lambda z: (z["x"] - z["m"]) * (z["x"] - z["m"])), F.lit(0.0), lambda s, x: s + x)
    sd = F.lit(float("nan")) if n == 0 else F.lit(0.0) if n == 1 else F.sqrt(square / (n - 1))
    own = mags.select(F.col("key.event_id").alias("event_id"), "mags", "_mean", F.col("key.peak_amp").alias("peak_amp"))
    return own.select("event_id", pick_dominant(peaks, cfg).alias("freqs"), "peak_amp", sd.alias("sd"), configured_means(cfg).alias("band_means"))


def sliced_bands(prepared: DataFrame, cfg: Config) -> DataFrame:
    """``event_id, slice, band, mean`` (unit within a slice) of time slices, the last zero-padded."""
    size = int(cfg.slice_sec * cfg.rate)
    if size < 1:
        raise ValueError("a slice has no samples")
    p = next_power_of_two(2 * size)
    starts = F.sequence(F.lit(0), F.lit(cfg.samples - 1), F.lit(size))
    frames = prepared.where("error IS NULL").select("event_id", "d", F.posexplode(starts).alias("slice", "at"))
    frames = frames.select("event_id", "slice", F.slice(F.concat(F.slice("d", F.col("at") + 1, F.lit(size)), F.array_repeat(F.lit(0.0), size)), 1, size).alias("d"))
    keys = ("event_id", "slice")
    vectors = band_vectors(band_means(_bins(magnitudes(frames, size, p, keys), cfg, p, keys), cfg, keys), keys)
    return vectors.select(*keys, F.explode(F.arrays_zip("bands", "vec")).alias("z")).select(*keys, F.col("z.bands").alias("band"), F.col("z.vec").alias("mean"))
