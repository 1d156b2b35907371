"""All pairs of series, scored in tiles.

Series are dealt to B blocks; a tile is a pair of blocks, so each series goes to B tiles and not into
n pairs: the shuffle is n * B rows for n * n / 2 scores. Blocks are as large as ``TILE_BYTES`` allows a
tile, or smaller where there would be too few tiles for the cores. In a tile each series is padded and
transformed once, and equal series are scored once: their pairs repeat the scores. Thresholds apply within
the kernel, before pairs are listed, and pairs leave a tile in batches: no table of all scores, and no list of a tile's pairs.
Short series are scored by products of matrices (``Narrow``), for several targets at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.config import Config
from lagwise.operators.prepare import matrix

TILE_BYTES = 192 << 20  # of both blocks of a tile: samples, padded samples and two half spectra
LEAST_SCORE = 5e-324  # the smallest positive double: a search for the largest score begins here
_CHUNK = 1 << 16  # numbers in one batch of inverse transforms, so that they stay near the core
_BATCH = 1 << 16  # pairs that leave a tile at once
FEW = 2_000_000  # ids that may be broadcast
_LISTED = 1 << 20  # listed pairs of a tile
_DEALT = 1024  # buckets that are dealt to blocks
PAIRED = 8192  # series of a block where more would only make tiles that are few and long
_GATHER = 1 << 16  # samples gathered at once, so that they stay near the core
NARROW = 96  # samples up to which products of matrices beat transforms
_AHEAD = 64  # targets scored at once
_WIDE = 1024  # series of one product of matrices, so that it stays near the core
_LAGS, _TOGETHER = 32, 4  # lags and targets of one product of matrices


def transforms(x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Half spectra of the padded series and of its reverse."""
    return np.fft.rfft(x, p), np.fft.rfft(x[:, ::-1], p)


def exact_scores(forward: np.ndarray, reverse: np.ndarray, p: int, rows: np.ndarray | None = None) -> np.ndarray:
    """The largest correlation over all lags, row by row (of ``rows`` of ``forward`` against one of ``reverse``, if given); never below the smallest positive number."""
    out = np.empty(len(forward) if rows is None else len(rows))
    step = max(1, _CHUNK // p)
    for a in range(0, len(out), step):
        z = forward[a : a + step] * reverse[a : a + step] if rows is None else forward[rows[a : a + step]] * reverse
        out[a : a + step] = np.fft.irfft(z, p).max(axis=1)
    return np.maximum(out, LEAST_SCORE)


def padded(x: np.ndarray) -> np.ndarray:
    """Series between zeros of their own length: samples beyond an end count nothing."""
    m = x.shape[1]
    wide = np.zeros((len(x), 3 * m))
    wide[:, m : 2 * m] = x
    return wide


def approximate_scores(wide: np.ndarray, rows: np.ndarray, peaks: tuple[np.ndarray, np.ndarray], j: int, support: np.ndarray, stride: int) -> np.ndarray:
    """Scores of the series ``rows`` of ``wide`` (padded) against series ``j`` of it, over alignments of top with top and low with low peaks.

    Short supports are gathered by place; long ones go by dot products with the target, zero outside its support.
    """
    m = wide.shape[1] // 3
    use, b = support[::stride], wide[j, m : 2 * m]
    offsets = np.concatenate([(x[rows][:, :, None] - x[j][None, None, :]).reshape(len(rows), -1) for x in peaks], axis=1)
    best = np.full(len(rows), -1.0)
    if not offsets.shape[1]:
        return best
    if not len(use):
        return np.maximum(best, 0.0)
    first, span = int(use[0]), int(use[-1] - use[0]) + 1
    if len(use) > 256 + span // 8:
        target = np.zeros(span)
        target[use - first] = b[use]
        places = (offsets + (m + first)).tolist()
        best = np.array([max([target.dot(row[o : o + span]) for o in own]) for row, own in zip(map(wide.__getitem__, rows.tolist()), places, strict=True)])
    else:
        flat, weights, begin = wide.ravel(), b[use], rows[:, None] * (3 * m) + m + offsets
        step = max(1, _GATHER // (offsets.shape[1] * len(use)))
        for a in range(0, len(rows), step):
            best[a : a + step] = (flat.take(begin[a : a + step, :, None] + use) @ weights).max(axis=1)
    return np.maximum(stride * best, -1.0)


class Narrow:
    """J2, X3, X4 for short series ``d``: both scores as products of matrices, many pairs at once.

    Approximate: the samples about each peak of a series, times those about each peak of a target that is zero outside its
    support, are the sum at the alignment of the two peaks. Exact: a series times the target at each lag. ``kind`` is the type that approximate scores are computed in.
    """

    def __init__(self, d: np.ndarray, peaks: tuple[np.ndarray, ...], support: pa.Array | None, stride: int, kind: type = np.float64):
        self.d, self.m, self.stride, self.kind, self.peaks, self.support = d, d.shape[1], stride, kind, peaks, support
        self.at = [self._about(d, x) for x in peaks if x.shape[1]]
        self.rows = {t: d.astype(t) for t in (np.float32, np.float64)}
        self.most = float((d * d).sum(axis=1).max(initial=0.0))
        self.buffers = {t: np.empty(_LAGS * _TOGETHER * _WIDE, t) for t in (np.float32, np.float64)}

    def guard(self, kind: type) -> float:
        """More than a sum in ``kind`` may be wrong by: the magnitudes of its terms add up to ``most`` at most (1 for unit vectors)."""
        return (self.m + 8) * float(np.finfo(kind).eps) * self.most

    def _about(self, x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
        """(peaks, series, 2 m - 1): the samples of each series about each of its peaks, between zeros."""
        windows = np.lib.stride_tricks.sliding_window_view(padded(x.astype(self.kind)), 2 * self.m - 1, axis=1)
        return np.stack([windows[np.arange(len(x)), own + 1] for own in peaks.T])

    def approximate(self, i: np.ndarray, js: np.ndarray) -> np.ndarray:
        """A row for each of ``js``: the scores of series ``i`` against it."""
        best = np.full((len(js), len(i)), -1.0, self.kind)
        target = np.zeros((len(js), self.m))
        for row, j in zip(target, js.tolist(), strict=True):
            use = self.support[j].values.to_numpy(zero_copy_only=False)[:: self.stride]
            row[use] = self.d[j, use]
        for own, peaks in zip(self.at, (x for x in self.peaks if x.shape[1]), strict=True):
            about = self._about(target, peaks[js])
            for a in range(0, len(i), _WIDE):
                part = best[:, a : a + _WIDE]
                for x in own:
                    rows = x[i[a : a + _WIDE]].T
                    for y in about:
                        np.maximum(part, y @ rows, out=part)
        return np.maximum(self.stride * best, -1.0)

    def exact(self, i: np.ndarray, js: np.ndarray, kind: type = np.float64) -> np.ndarray:
        """A row for each of ``js``: the largest correlation with series ``i`` over all lags."""
        m, own = self.m, self.rows[kind]
        best = np.empty((len(js), len(i)), kind)
        wide = np.zeros((len(js), 3 * m - 2), kind)
        wide[:, m - 1 : 2 * m - 1] = self.d[js]
        lags = np.lib.stride_tricks.sliding_window_view(wide, m, axis=1)[:, ::-1].swapaxes(0, 1)  # lag, target, sample
        for a in range(0, len(i), _WIDE):
            x = own[i[a : a + _WIDE]].T
            for t in range(0, len(js), _TOGETHER):
                part = best[t : t + _TOGETHER, a : a + _WIDE]
                for b in range(0, 2 * m - 1, _LAGS):
                    e = min(b + _LAGS, 2 * m - 1)
                    lo, hi = max(0, b - m + 1), min(m, e)  # samples that have a partner at one of the lags
                    y = np.ascontiguousarray(lags[b:e, t : t + _TOGETHER, lo:hi]).reshape(-1, hi - lo)
                    z = np.matmul(y, x[lo:hi], out=self.buffers[kind][: len(y) * x.shape[1]].reshape(len(y), -1)).reshape(e - b, *part.shape)
                    np.maximum(part, z.max(axis=0), out=part) if b else z.max(axis=0, out=part)
        return np.maximum(best, LEAST_SCORE if kind == np.float64 else 0)


def block_count(rows: int, samples: int, p: int, cores: int, block: int | None = None) -> int:
    """Blocks of at most the series that half of ``TILE_BYTES`` holds (or ``block``), and four tiles a core where blocks of 64 allow it."""
    held = 8 * 4 * samples + 16 * p
    least = -(-rows // (block or max(2, TILE_BYTES // 2 // held)))
    return max(1, least, min(-(-rows // 64), int(np.ceil(np.sqrt(8 * cores)))) if block is None else 1)


def deal(counts: dict[int, int], blocks: int) -> tuple[list[int], list[int]]:
    """For each of ``_DEALT`` buckets of so many rows the first block and the number of blocks it goes to: about ``blocks`` in all, of like sizes."""
    most, first, pieces, block, held = max(1, -(-sum(counts.values()) // blocks)), [], [], 0, 0
    for k in range(_DEALT):
        rows = counts.get(k, 0)
        if held and held + rows > most + most // 8:
            block, held = block + 1, 0
        first.append(block)
        pieces.append(max(1, -(-rows // most)))
        held += rows
        if pieces[-1] > 1:
            block, held = block + pieces[-1], 0
    return first, pieces


def blocked(rows: DataFrame, content: str, count: Callable[[int, int], int]) -> tuple[DataFrame, int, int]:
    """(rows with their ``_block``, blocks, rows); ``count`` gives the number of blocks for rows and cores.

    Series of equal ``content`` go to the same block, or to few where they are more than a block holds.
    """
    cores, bucket = rows.sparkSession.sparkContext.defaultParallelism, F.pmod(F.xxhash64(content), F.lit(_DEALT)).cast("int")
    counts = {r["k"]: r["count"] for r in rows.groupBy(bucket.alias("k")).count().collect()}  # at most _DEALT rows
    total = sum(counts.values())
    first, pieces = deal(counts, count(total, cores))
    at = lambda xs: F.element_at(F.lit(xs), bucket + 1)
    return rows.withColumn("_block", (at(first) + F.pmod(F.xxhash64("event_id"), at(pieces))).cast("int")), max(a + b for a, b in zip(first, pieces, strict=True)), total


def tiles(rows: DataFrame, fields: list[str], content: str, count: Callable[[int, int], int]) -> DataFrame:
    """``fields`` of each series once for every tile of its block (``blocked``), dealt out by tile.

    The number of tasks follows the tiles, not the bytes: small tiles are much work all the same, and
    adaptive execution would put them in a few tasks.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    own, blocks, _ = blocked(rows, content, count)
    own = own.select(*fields, "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")).withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other")).drop("_other")
    return own.repartition(min(blocks * (blocks + 1) // 2, 32 * cores), "_low", "_high")


def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each class of equal rows, class of each row); classes by their first rows."""
    seen: dict[bytes, int] = {}
    own = np.array([seen.setdefault(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), len(seen)) for x in rows], np.int64)
    first = np.full(len(seen), len(rows), np.int64)
    np.minimum.at(first, own, np.arange(len(rows)))
    return first, own


Scored = tuple[np.ndarray, list[np.ndarray]]


def walk(table: pa.Table, own: np.ndarray, score: Callable[[np.ndarray, int], Scored], ahead: Callable[[np.ndarray, np.ndarray], None] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The pairs of a tile sorted by id, whose rows are of classes ``own``: (rows i, rows j, values at i), of which those with i < j are pairs.

    All of j are of one class, so ``score`` (classes, class -> those of them that stay, their values) is asked once for a pair of classes.
    ``ahead`` is told before the classes, and at least those that they will be scored against.
    """
    count, block_of = int(own.max()) + 1 if len(own) else 0, table["_block"].to_numpy()
    low, high = table["_low"][0].as_py(), table["_high"][0].as_py()
    sides = [np.flatnonzero(block_of == b) for b in ((low,) if low == high else (low, high))]
    for rows, targets in zip(sides, sides[::-1], strict=True):
        first = np.full(count, len(own))
        np.minimum.at(first, own[rows], rows)
        targets = targets[np.argsort(own[targets], kind="stable")]
        groups = np.split(targets, np.flatnonzero(np.diff(own[targets])) + 1) if len(targets) else []
        for n, js in enumerate(groups):
            if ahead is not None and n % _AHEAD == 0:
                some = groups[n : n + _AHEAD]
                ahead(np.flatnonzero(first < max(x[-1] for x in some)), own[[x[0] for x in some]])
            near = rows[: np.searchsorted(rows, js[-1])]
            wanted = np.flatnonzero(first < js[-1])
            if not len(wanted):
                continue
            stay, values = score(wanted, int(own[js[0]]))
            if not len(stay):
                continue
            place = np.full(count, -1)
            place[stay] = np.arange(len(stay))
            at = place[own[near]]
            near, at = near[at >= 0], at[at >= 0]
            yield near, js, [x[at] for x in values]


def listed(table: pa.Table, names: list[str], found: Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]], null: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs of ``walk`` in batches; with ``null`` NaN becomes null."""
    ids = table["event_id"].combine_chunks()
    keys = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else None
    take = (lambda at: pa.array(keys[at], ids.type)) if keys is not None else (lambda at: ids.take(pa.array(at)))

    def batch() -> pa.RecordBatch:
        second = np.repeat(np.array([j for j, _ in ends]), [n for _, n in ends])
        return pa.RecordBatch.from_arrays([take(np.concatenate(parts[0])), take(second), *[pa.array(np.concatenate(x), from_pandas=null) for x in parts[1:]]], names)

    parts: list[list[np.ndarray]] = [[] for _ in names[1:]]
    ends, held = [], 0
    for rows, js, values in found:
        for j, n in zip(js.tolist(), np.searchsorted(rows, js).tolist(), strict=True):
            for a in range(0, n, _BATCH):
                b = min(n, a + _BATCH)
                for own, x in zip(parts, [rows, *values], strict=True):
                    own.append(x[a:b])
                ends.append((j, b - a))
                held += b - a
                if held >= _BATCH:
                    yield batch()
                    parts, ends, held = [[] for _ in names[1:]], [], 0
    if held:
        yield batch()


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Half away from zero, as SQL rounds; never -0."""
    if digits is None:
        return x
    scaled = x * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.copysign(1.0, scaled), 0.0)) / 10.0**digits + 0.0


_KEPT = ("fwd_re", "fwd_im", "rev_re", "rev_im")


def with_spectra(prepared: DataFrame, spectra: DataFrame, cfg: Config) -> DataFrame:
    """Kept transforms beside their series (null where there are none); a real series needs half of each."""
    half = spectra.select("event_id", *[F.slice(c, 1, cfg.padded // 2 + 1).alias(c) for c in _KEPT]).dropDuplicates(["event_id"])
    return prepared.join(half, "event_id", "left")


def _transforms_of(d: np.ndarray, kept: list[pa.Array], p: int, which: str = "both") -> list[np.ndarray]:
    """Half spectra of the rows of ``d`` and of their reverses; those in ``kept`` (arrays of parts, or none) are not computed anew."""
    out = []
    for k, x in enumerate((d, d[:, ::-1])):
        if which != "both" and k != ("forward", "reverse").index(which):
            continue
        if not kept:
            out.append(np.fft.rfft(x, p))
            continue
        re, im = kept[2 * k : 2 * k + 2] if which == "both" else kept
        has = np.flatnonzero(re.is_valid().to_numpy(zero_copy_only=False) & (re.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == p // 2 + 1))
        z = np.empty((len(d), p // 2 + 1), complex)
        z[has] = matrix(re.take(pa.array(has)), p // 2 + 1) + 1j * matrix(im.take(pa.array(has)), p // 2 + 1)
        rest = np.setdiff1d(np.arange(len(d)), has)
        z[rest] = np.fft.rfft(x[rest], p)
        out.append(z)
    return out


def _tile(
    table: pa.Table, cfg: Config, approx: bool, exact: bool, kept_cols: list[str], candidate: float | None, final: float | None, keep: Callable[..., np.ndarray] | None = None, reject: bool = False, counted: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Scores of a tile's pairs, as ``walk`` gives them. Kept transforms may differ where series are equal, so there each series is a class.

    ``counted``: scores are only compared with the two thresholds of ``cfg``, so they may be of single precision where they are
    further from them than its error.
    """
    m, p, stride = cfg.samples, cfg.padded, cfg.stride
    d = matrix(table["d"].combine_chunks(), m)
    first, own = classes(d) if not kept_cols else (np.arange(len(d)), np.arange(len(d)))
    d = d[first]
    one = table.take(pa.array(first))
    peaks = tuple(matrix(one[c].combine_chunks(), cfg.top_k).astype(np.int64) for c in ("max_peaks", "min_peaks")) if approx else ()
    support = one["support"].combine_chunks() if approx else None
    narrow = Narrow(d, peaks, support, stride, np.float32 if counted else np.float64) if m <= NARROW and not kept_cols and (approx or exact) else None
    forward, reverse = _transforms_of(d, [one[c].combine_chunks() for c in kept_cols], p) if exact and narrow is None else (None, None)
    wide = padded(d) if approx else None
    screen = np.float32 if counted or final is not None or reject else np.float64  # of exact scores, most of which go
    together = exact and (candidate is None or reject)  # most pairs get an exact score
    held: dict[str, np.ndarray] = {}

    def ahead(i: np.ndarray, js: np.ndarray) -> None:
        held["column"], held["row"] = np.empty(len(d), np.int64), np.empty(len(d), np.int64)
        held["column"][i], held["row"][js] = np.arange(len(i)), np.arange(len(js))
        if approx:
            held["approx"] = narrow.approximate(i, js)
        if together:
            held["exact"] = narrow.exact(i, js, screen)

    def approximate(i: np.ndarray, j: int) -> np.ndarray:
        one_by_one = lambda i: approximate_scores(wide, i, peaks, j, support[j].values.to_numpy(zero_copy_only=False).astype(np.int64), stride)
        if narrow is None:
            return one_by_one(i)
        s = held["approx"][held["row"][j], held["column"][i]].astype(np.float64)
        if counted and len(near := np.flatnonzero(np.abs(s - cfg.candidate) <= stride * narrow.guard(np.float32))):
            s[near] = one_by_one(i[near])
        return s

    def exactly(i: np.ndarray, j: int) -> np.ndarray:
        if narrow is None:
            return exact_scores(forward, reverse[j], p, i)
        s = (held["exact"][held["row"][j], held["column"][i]] if together else narrow.exact(i, np.array([j]), screen)[0]).astype(np.float64)
        if screen == np.float32 and len(near := np.flatnonzero(np.abs(s - (cfg.final if final is None else final)) <= narrow.guard(screen))):
            s[near] = narrow.exact(i[near], np.array([j]))[0]
        return s

    def score(i: np.ndarray, j: int) -> Scored:
        cols = []
        if approx:
            s = approximate(i, j)
            stay = (s > candidate) != reject if candidate is not None else slice(None)
            i, cols = i[stay], [s[stay]]
        if exact and len(i):
            s = exactly(i, j)
            stay = s > final if final is not None else slice(None)
            i, cols = i[stay], [*(c[stay] for c in cols), s[stay]]
        if keep is not None and len(i):
            stay = keep(*cols)
            i, cols = i[stay], [c[stay] for c in cols]
        if exact and narrow is not None and screen == np.float32 and not counted and len(i):
            cols[-1] = narrow.exact(i, np.array([j]))[0]
        return i, cols

    return walk(table, own, score, ahead if narrow is not None else None)


def sorted_tile(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    """The series of a tile, by id."""
    return pa.Table.from_batches(list(batches)).combine_chunks().sort_by("event_id")


def _scored_tiles(prepared: DataFrame, cfg: Config, approx: bool, kept_cols: list[str], block: int | None) -> DataFrame:
    fields = ["event_id", "d", *["max_peaks", "min_peaks", "support"] * approx, *kept_cols]
    blocks = lambda rows, cores: max(block_count(rows, cfg.samples, cfg.padded, cores, block), 1 if block else -(-rows // PAIRED))
    return tiles(prepared.where("error IS NULL"), fields, "d", blocks)


def score_pairs(
    prepared: DataFrame, cfg: Config, approx: bool = True, exact: bool = True, candidate: float | None = None, final: float | None = None, block: int | None = None, keep: Callable[..., np.ndarray] | None = None, digits: int | None = None, reject: bool = False
) -> DataFrame:
    """``e1, e2[, approx][, score]`` of all pairs with e1 < e2 (numbers by value, texts by code).

    ``candidate``: only pairs with approx above it (F2), or with ``reject`` only the others, go on to the exact score; ``final``: only
    scores above it (F3) are returned; ``keep``: only pairs for whose scores (arrays) it is true; with ``reject`` it compares the exact
    score with the final threshold of ``cfg`` only. What is returned is
    rounded to ``digits``, if given. ``prepared`` is read once for each of the two uses: keep it.
    Kept transforms (``with_spectra``) are used where they are there.
    """
    kept_cols = [c for c in _KEPT if exact and c in prepared.columns]
    kind = dict(prepared.dtypes)["event_id"]
    names = ["e1", "e2", *["approx"] * approx, *["score"] * exact]
    schema = f"e1 {kind}, e2 {kind}" + ", approx double" * approx + ", score double" * exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted_tile(batches)
        found = _tile(table, cfg, approx, exact, kept_cols, candidate, final, keep, reject)
        yield from listed(table, names, ((i, j, [rounded(x, digits) for x in values]) for i, j, values in found))

    return _scored_tiles(prepared, cfg, approx, kept_cols, block).groupBy("_low", "_high").applyInArrow(run, schema)


def count_pairs(prepared: DataFrame, cfg: Config, block: int | None = None, **rules: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """One row: for each rule (approx, score -> true or false) how many pairs it holds for. Tiles count; no pair leaves them.

    Rules compare scores with the two thresholds of ``cfg`` and with nothing else: others may be of single precision.
    """
    kept_cols = [c for c in _KEPT if c in prepared.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = sorted_tile(batches), dict.fromkeys(rules, 0)
        for rows, js, values in _tile(table, cfg, True, True, kept_cols, None, None, counted=True):
            for name, rule in rules.items():
                sums[name] += int(np.searchsorted(rows[rule(*values)], js).sum())
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in sums.items()})

    counts = _scored_tiles(prepared, cfg, True, kept_cols, block).groupBy("_low", "_high").applyInArrow(run, ", ".join(f"{k} long" for k in rules))
    return counts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in rules])


def distinct(codes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes in order, place of each code among them), without a sort where they are from few."""
    if below > max(1 << 24, 4 * len(codes)):
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(below, bool)
    seen[codes] = True
    place = np.cumsum(seen, dtype=np.int32)
    return np.flatnonzero(seen), place[codes] - 1


def score_candidates(candidates: DataFrame, prepared: DataFrame, cfg: Config, final: float | None = None, digits: int | None = None) -> DataFrame:
    """Exact scores of listed pairs (``e1, e2``), each once; pairs with an absent series drop out. Kept transforms are used.

    Pairs go to the tile of their series' blocks: a series is sent once for each tile of its block and not once for each
    pair. Blocks are those of ``blocked``, which the pairs learn by a join on the ids (of few series broadcast), as many as keep a
    tile's series to ``TILE_BYTES`` and its pairs to about ``_LISTED``; those of a tile are at most the product of its
    blocks, however they are spread, unless they are listed repeatedly. ``candidates`` is read twice.
    """
    kept_cols = [c for c in _KEPT if c in prepared.columns]
    kind, cores = dict(prepared.dtypes)["event_id"], prepared.sparkSession.sparkContext.defaultParallelism
    m, p, number = cfg.samples, cfg.padded, candidates.count()
    rows, blocks, total = blocked(prepared.where("error IS NULL"), "d", lambda n, cores: max(block_count(n, m, p, cores), int(np.ceil(np.sqrt(2 * number / _LISTED)))))
    ids = rows.select("event_id", "_block")
    ids = F.broadcast(ids) if total <= FEW else ids
    tile = [F.least("_a", "_b").alias("_low"), F.greatest("_a", "_b").alias("_high")]
    pairs = candidates.select("e1", "e2").join(ids.toDF("e1", "_a"), "e1").join(ids.toDF("e2", "_b"), "e2").select(F.col("e1").cast(kind).alias("e1"), F.col("e2").cast(kind).alias("e2"), *tile)
    own = rows.withColumnRenamed("_block", "_a").select("event_id", "d", *kept_cols, "_a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b")).select("event_id", "d", *kept_cols, *tile)
    tasks = min(blocks * (blocks + 1) // 2, 32 * cores)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, n = ["e1", "e2", "score"], right.num_rows
        ids = right["event_id"].combine_chunks()
        at = [pc.index_in(left[c].combine_chunks(), ids) for c in ("e1", "e2")]
        both = pc.and_(at[0].is_valid(), at[1].is_valid())
        code, _ = distinct(at[0].filter(both).to_numpy().astype(np.int64) * n + at[1].filter(both).to_numpy(), n * n)
        d = matrix(right["d"].combine_chunks(), m)
        first, class_of = classes(d) if not kept_cols else (np.arange(n), np.arange(n))
        forward, reverse = _transforms_of(d[first], [right[c].combine_chunks().take(pa.array(first)) for c in kept_cols], p)
        asked, place = distinct(class_of[code // n] * len(first) + class_of[code % n], len(first) ** 2) if n else (code, code)
        score, step = np.empty(len(asked)), max(1, _CHUNK // p)
        for a in range(0, len(asked), step):
            i, j = np.divmod(asked[a : a + step], len(first))
            score[a : a + step] = exact_scores(forward[i], reverse[j], p)
        stay = score > final if final is not None else np.ones(len(score), bool)
        code, place = code[stay[place]], place[stay[place]]
        return pa.Table.from_arrays([ids.take(pa.array(code // n if n else code)), ids.take(pa.array(code % n if n else code)), pa.array(rounded(score, digits)[place])], names)

    by = ("_low", "_high")
    return pairs.repartition(tasks, *by).groupBy(*by).cogroup(own.repartition(tasks, *by).groupBy(*by)).applyInArrow(run, f"e1 {kind}, e2 {kind}, score double")


def unresolved(candidates: DataFrame, prepared: DataFrame) -> DataFrame:
    """Candidate pairs of which a series is absent."""
    ids = prepared.where("error IS NULL").select("event_id")
    missing = [candidates.join(ids, candidates[c] == ids.event_id, "left_anti") for c in ("e1", "e2")]
    return missing[0].unionByName(missing[1]).select("e1", "e2").dropDuplicates()


def fft_records(prepared: DataFrame, cfg: Config) -> DataFrame:
    """X2 for K6: the full forward and reversed transforms as parallel arrays of real and imaginary parts."""
    kind, p, m = dict(prepared.dtypes)["event_id"], cfg.padded, cfg.samples

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), m)
            parts = [part for z in (np.fft.fft(x, p), np.fft.fft(x[:, ::-1], p)) for part in (z.real, z.imag)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(y), pa.list_(pa.float64())) for y in parts]], ["event_id", "fwd_re", "fwd_im", "rev_re", "rev_im"])

    return prepared.where("error IS NULL").select("event_id", "d").mapInArrow(run, f"event_id {kind}, fwd_re array<double>, fwd_im array<double>, rev_re array<double>, rev_im array<double>")
