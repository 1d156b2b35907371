"""Run settings, from keywords or a properties file."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from pathlib import Path

MODES = ("ANALYSE", "PEAKMATCH", "FFTPRECACHE", "POSTPROCESS", "BRUTEFORCE", "FFTDOMINANTFREQ", "PLOT2D", "PLOT1D", "CLUSTER")
#: fixed values: the glyph ramps of plots
RAMPS = {"VERTICAL": " ▁▂▃▄▅▆▇█", "HORIZONTAL": " ▏▎▍▌▋▊▉█", "SHADED": " ░▒▓█"}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    length: int = 4000
    mode: str = "PLOT1D"
    verbose: bool = False
    dataset: str = ""
    sample_dataset: str = ""
    crop: bool = False
    crop_min: int = 250
    crop_max: int = 2000
    crop_before: int = 250
    crop_after: int = 1000
    top_k: int = 2
    stride: int = 5
    amplitude: float = 0.3
    candidate: float = 0.55
    final: float = 0.7
    band_width: float = 0.25
    below_hz: float = 1.0
    above_hz: float = 10.0
    rate: int = 50
    top_freqs: int = 5
    mean_bands: str | None = "[1-5] [5-8.5] [8.5-10]"
    centre: bool = True
    tiny: bool = False
    slice_sec: float = 1.0
    ramp: str = "HORIZONTAL"
    band_hz: float = 0.25
    cluster_k: int = 10
    cluster_eta: float = 0.15
    centres: str = ""
    centre_threshold: float = 0.0
    continue_on_error: bool = False
    truncate: bool = True  # samples lose their fraction when loaded

    @property
    def samples(self) -> int:
        """Samples of each prepared series."""
        return self.crop_before + self.crop_after if self.crop else self.length

    @property
    def padded(self) -> int:
        return next_power_of_two(2 * self.samples)


#: property name, field and whether it must be there
KEYS = {
    "expected-file-line-count": ("length", True), "mode": ("mode", True), "verbose": ("verbose", False), "dataset.full": ("dataset", True), "dataset.sample": ("sample_dataset", True), "crop": ("crop", False),
    "crop.min-peak-range": ("crop_min", True), "crop.max-peak-range": ("crop_max", True), "crop.window-before-peak": ("crop_before", True), "crop.window-after-peak": ("crop_after", True),
    "top-k-peaks": ("top_k", True), "sampling-stride": ("stride", True), "top-amplitude-threshold": ("amplitude", True), "candidate-threshold": ("candidate", True), "final-threshold": ("final", True),
    "dominantfreq.band-width": ("band_width", True), "dominantfreq.filter-below-hz": ("below_hz", True), "dominantfreq.filter-above-hz": ("above_hz", True), "dominantfreq.sample-rate": ("rate", True),
    "dominantfreq.top-freq-count": ("top_freqs", True), "dominantfreq.mean-frequency-amplitude-bands": ("mean_bands", False), "normalise-events": ("centre", False), "plot.1d.tiny": ("tiny", False),
    "plot.2d.bucket-duration-sec": ("slice_sec", True), "plot.2d.gradient": ("ramp", True), "frequency.band-hz": ("band_hz", True), "cluster.k": ("cluster_k", True), "cluster.eta": ("cluster_eta", True),
    "cluster.centres": ("centres", False), "cluster.centre-threshold": ("centre_threshold", False), "continue-on-error": ("continue_on_error", False),
}


def next_power_of_two(x: int) -> int:
    """P10."""
    return 1 << max(0, x - 1).bit_length()


def properties(text: str) -> dict[str, str]:
    """Lines ``key = value`` (or ``:``); ``#`` and ``!`` begin comments; a trailing backslash joins the next line."""
    out = {}
    for line in re.sub(r"\\\r?\n[ \t]*", "", text).splitlines():
        line = line.lstrip()
        if line and line[0] not in "#!":
            key, _, value = re.sub(r"^([^=:\s]+)\s*[=:]?\s*", "\\1\0", line, count=1).partition("\0")
            out[key] = value
    return out


def read_config(path: str) -> Config:
    props, got = properties(Path(path).read_text(encoding="utf-8")), {}
    kinds = {f.name: f.type for f in fields(Config)}
    for key, (name, needed) in KEYS.items():
        value = props.get(key)
        if value is None:
            if needed:
                raise ConfigError(f"missing conf value: {key}")
            got[name] = {"bool": False, "str | None": None, "str": "", "float": 0.0}[kinds[name]]
            continue
        try:
            got[name] = {"int": int, "float": float, "bool": lambda v: v.lower() == "true"}.get(kinds[name], str)(value)
            if kinds[name] == "int" and value != value.strip():
                raise ValueError
        except ValueError:
            if needed:
                raise ConfigError(f"invalid {kinds[name]} value for key {key}: {value}") from None
            got[name] = 0.0
    if got["mode"] not in MODES:
        raise ConfigError(f"invalid mode value '{got['mode']}'")
    if got["ramp"] not in RAMPS:
        raise ConfigError(f"invalid gradient value '{got['ramp']}'")
    return Config(**got)
