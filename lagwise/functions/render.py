"""Text plots and formats."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.config import RAMPS, Config

ROWS, SPACING, TOP = 20, 10, 0.3
_BAR = "▊"


def number(x: float) -> str:
    """Three decimals at most, half to even, no grouping."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else ("-" if x < 0 else "") + "∞"
    text = f"{Decimal(repr(float(x))).quantize(Decimal('0.001'), ROUND_HALF_EVEN):f}".rstrip("0").rstrip(".")
    return ("-0" if math.copysign(1, x) < 0 else "0") if text in ("0", "-0", "") else text


def duration(ms: int) -> str:
    """R6."""
    parts = []
    for unit, size in (("days", 86_400_000), ("hr", 3_600_000), ("min", 60_000), ("sec", 1000)):
        n, ms = divmod(ms, size)
        if n:
            parts.append(f"{n} {unit}")
    return ", ".join(parts) or f"{ms} ms"


def tiny_plots(vectors: DataFrame) -> DataFrame:
    """R2: ``event_id, plot``: a glyph for each band of (bands, means), then ``#``. In column expressions."""
    ramp = F.array(*[F.lit(c) for c in RAMPS["VERTICAL"]])
    top = F.array_max("means")
    glyph = F.transform("means", lambda x: F.element_at(ramp, F.coalesce(F.try_divide(8 * x, top), F.lit(0.0)).cast("int") + 1))
    return vectors.select("event_id", F.concat(F.array_join(glyph, ""), F.lit("#")).alias("plot"))


def plot_1d(name: str, means: list[tuple[float, float]], cfg: Config) -> str:
    """Bars over bands. Heights add up in floating point, so there are 20 or 21 rows."""
    top, heights, h = max((m for _, m in means), default=0.0), [], 0.0
    while h < top:
        heights.append(h)
        h += top / ROWS
    lines = [f"{number(h) + ' ':>10}" + "".join(_BAR if h <= m else " " for _, m in means) for h in reversed(heights)]
    width = len(means) if heights else 0
    axis = f"{'hz ':>10}" + "".join(f"{'|' + number(cfg.band_hz * k + cfg.below_hz):<{SPACING}}" for k in range(0, width, SPACING))
    return "\n".join([name, *lines, axis, ""])


def plot_2d(name: str, slices: list[list[tuple[float, float]]], cfg: Config) -> str:
    """A grid of glyphs, a row for each band from high to low, a column for each time slice of unit band means."""
    ramp, bands = RAMPS[cfg.ramp], sorted({band for means in slices for band, _ in means}, reverse=True)
    level = np.zeros((len(bands), len(slices)), int)
    for column, means in enumerate(slices):
        for band, v in means:
            if v is not None and not math.isnan(v):
                level[bands.index(band), column] = min(len(ramp) - 1, int(len(ramp) * v / TOP))
    grid = ["".join(row) for row in np.array(list(ramp))[level]]
    ticks = "".join(f"{'|' + number(cfg.slice_sec * k):<{SPACING}}" for k in range(0, len(slices) if bands else 0, SPACING))
    return "\n".join([name, *(f"{number(band) + ' hz ':>10}{row}" for band, row in zip(bands, grid, strict=True)), f"{'sec ':>10}{ticks}", "", ""])
