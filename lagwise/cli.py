"""C1-C4 and the modes from a properties file: ``python -m lagwise.cli [-plot [1d|2d] | -xcorr | -fftdom] -events f...``."""

from __future__ import annotations

import sys
from dataclasses import replace

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lagwise.config import Config, ConfigError, read_config
from lagwise.functions.render import duration, number
from lagwise.operators import pairs
from lagwise.operators.prepare import diagnostics
from lagwise.plans import modes
from lagwise.plans.progress import Progress
from lagwise.plans.scratch import materialize
from lagwise.plans.ship import ship
from lagwise.sources import sinks
from lagwise.sources.series import failures, present, read_candidates, read_scores, read_series, read_spectra, resolve

USAGE = """usage: lagwise [-conf file]                    run the configured mode
       lagwise -plot [1d|2d] -events f...      plot (tiny without 1d or 2d)
       lagwise -xcorr -events a b              exact score of two series
       lagwise -fftdom -events f...            dominant frequencies"""
CANDIDATES, POSTPROCESS, BRUTEFORCE, DOMINANT, CACHE, SAVED = ("xcorr.candidates", "xcorr.postprocess", "xcorr.bruteforce", "xcorr.dominantfreq", "xcorr.fftcache", "xcorr.saved")


def _option(args: list[str], name: str) -> list[str] | None:
    """Values after an option, up to the next one."""
    if name not in args:
        return None
    rest = args[args.index(name) + 1 :]
    return rest[: next((k for k, x in enumerate(rest) if x.startswith("-")), len(rest))]


def _warn(text: str) -> None:
    print(text, file=sys.stderr)


def _projected(events, cfg: Config, total: int, candidates: int) -> list[str]:
    """A7 as lines; times of a pair in microseconds, of the whole dataset in words."""
    found = modes.throughput(events, cfg, total, candidates)
    lines = [f"full dataset: {total} series"]
    for name, x in found.items():
        shown = "not known" if x is None else f"{x * 1e6:.1f} us" if name.endswith("a pair") else f"{x:.0f}" if name == "candidates" else f"{x:.1f} x" if name == "gain" else duration(int(1000 * x))
        lines.append(f"{name}: {shown}")
    return lines


def run_mode(spark: SparkSession, cfg: Config, out: str = ".") -> list[str]:
    """Run ``cfg.mode``; files go below ``out``, the lines of reports are returned.

    POSTPROCESS and BRUTEFORCE use the transforms that FFTPRECACHE left (J12); ANALYSE uses the scores of
    earlier runs and appends only what it had to compute.
    """
    series = read_series(spark, cfg.sample_dataset if cfg.mode == "ANALYSE" else cfg.dataset, cfg)
    per_event = cfg.mode in ("FFTDOMINANTFREQ", "PLOT1D", "PLOT2D", "CLUSTER", "FFTPRECACHE")
    if cfg.verbose:
        for r in diagnostics(series, cfg).toLocalIterator():
            _warn(", ".join(f"{k} {v}" for k, v in r.asDict().items() if v is not None))
    if per_event:
        series = materialize(series, "series")
    events = modes.prepared(series, cfg, strict=not per_event)
    if per_event:
        for text in failures(series):
            _warn(text)
    if cfg.mode in ("POSTPROCESS", "BRUTEFORCE") and present(spark, f"{out}/{CACHE}"):
        events = pairs.with_spectra(events, read_spectra(spark, f"{out}/{CACHE}"), cfg)
    if cfg.mode == "PEAKMATCH":
        sinks.write_pairs(modes.peakmatch(events, cfg), f"{out}/{CANDIDATES}")
    elif cfg.mode == "POSTPROCESS":
        listed = read_candidates(spark, f"{out}/{CANDIDATES}")
        sinks.write_pairs(modes.postprocess(listed, events, cfg), f"{out}/{POSTPROCESS}")
        return [f"unresolved: {r['e1']} {r['e2']}" for r in pairs.unresolved(listed, events).toLocalIterator()]
    elif cfg.mode == "BRUTEFORCE":
        sinks.write_pairs(modes.bruteforce(events, cfg), f"{out}/{BRUTEFORCE}")
    elif cfg.mode == "FFTPRECACHE":
        sinks.write_spectra(modes.precache(events, cfg), f"{out}/{CACHE}")
    elif cfg.mode == "FFTDOMINANTFREQ":
        sinks.write_dominant(modes.dominant_freqs(events, cfg), f"{out}/{DOMINANT}")
    elif cfg.mode == "ANALYSE":
        saved = read_scores(spark, f"{out}/{SAVED}") if present(spark, f"{out}/{SAVED}") else None
        found = modes.analyse(events, cfg, saved)
        report = found["report"].first().asDict()
        sinks.save_scores(found["fresh"], f"{out}/{SAVED}")
        total = read_series(spark, cfg.dataset, cfg).count()
        return [f"{k}: {v}" for k, v in report.items()] + _projected(events, cfg, total, report["candidates"])
    elif cfg.mode == "CLUSTER":
        return [f"{r['head']}\t{r['event_id']}\t{number(r['distance'])}" for r in modes.clustering(events, cfg).toLocalIterator()]
    else:
        draw = modes.plots_1d if cfg.mode == "PLOT1D" else modes.plots_2d
        return [r["plot"] if not (cfg.mode == "PLOT1D" and cfg.tiny) else f"{r['event_id']}\t{r['plot']}" for r in draw(events, cfg).orderBy("event_id").toLocalIterator()]
    return []


def run_files(spark: SparkSession, cfg: Config, args: list[str]) -> list[str]:
    """Modes on named files. Precedence: plot, xcorr, fftdom; anything else gives the usage."""
    names = _option(args, "-events") or []
    kind = next((k for k in ("-plot", "-xcorr", "-fftdom") if k in args), None)
    if kind is None or not names:
        return [USAGE]
    series = None
    for path in names:
        one = read_series(spark, resolve(path, cfg), cfg)
        series = one if series is None else series.unionByName(one)
    events = modes.prepared(series, cfg)
    if kind == "-plot":
        how = (_option(args, "-plot") or [""])[0]
        if how == "2d":
            return [r["plot"] for r in modes.plots_2d(events, cfg).collect()]
        plots = modes.plots_1d(events, replace(cfg, tiny=how != "1d")).collect()
        return [r["plot"] if how == "1d" else f"{r['event_id']}\t{r['plot']}" for r in plots]
    if kind == "-xcorr":
        if len(names) < 2:
            raise ConfigError("two series are needed")
        wanted = [resolve(x, cfg).rpartition("/")[2] for x in names[:2]]
        rows = {r["event_id"]: r["d"] for r in events.where(F.col("event_id").isin(wanted)).collect()}
        a, b = (np.array([rows[x]]) for x in wanted)
        forward, reverse = pairs.transforms(a, cfg.padded)[0], pairs.transforms(b, cfg.padded)[1]
        return [number(float(pairs.exact_scores(forward, reverse, cfg.padded)[0]))]
    return [r["value"] for r in sinks.dominant_lines(modes.dominant_freqs(events, cfg)).collect()]


def main(args: list[str]) -> int:
    if "-help" in args:
        print(USAGE)
        return 0
    try:
        cfg = read_config((_option(args, "-conf") or ["xcorr.conf"])[0])
        spark = ship(SparkSession.builder.getOrCreate())
        chosen = [a for a in args if a.startswith("-") and a != "-conf"]
        with Progress(spark):
            lines = run_files(spark, cfg, args) if chosen else run_mode(spark, cfg)
        print("\n".join(lines))
    except (ConfigError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
