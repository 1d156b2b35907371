"""Operator 5: substring deduplication by sliding sentence spans.

Texts are cut into pieces: after a word ending in ``. ! ?``, and inside a sentence after the word of
least hash of every ``CUT`` words in a row, whatever the sentence's length. Such borders depend on at most
``CUT - 1`` words to either side, so copies share all borders but those near their ends, and two neighbours are
at most ``CUT`` words apart. Line ends give a second set of borders beside the first; it adds runs and
takes none away, so that a text with other line ends has the same runs by the first set.
For each border the shortest run of at least two pieces and 20 words that begins with it, and the one
that ends with it, are hashed (96 bits over lower-cased words); where borders agree, these cover whatever
longer runs would. Of a run that occurs again anywhere, the occurrence in the smallest id, and there the first, stays. Pieces covered by any other
occurrence are removed. Every passage of 49 words or more has such a run wherever it is set; of a passage
that begins or ends inside a sentence, at most ``2 * CUT - 1`` words at that end stay.

Each task first combines the runs of ``WINDOW`` spans at a time: all but the first of equal ones are
surely not the first of all, and are dealt out evenly. Only one row a window and hash meets at its
hash, however many documents share a passage; sorted partitions then stream past, holding nothing.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.worker import alone, cache
from lagwise.plans.scratch import materialize

LEAST_PIECES, LEAST_WORDS, CUT = 2, 20, 8
WINDOW = 400_000
BROADCAST_IDS = 2_000_000  # some 50 MB
_KEPT_WORDS = 1 << 18
_GAP = re.compile(r"\s+")


class _Hashes(dict):
    """64-bit hash of a word in lower case; odd if the word ends a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower()) & ~1 | (word[-1] in ".!?")
        return h


_hashes = cache("span_dedup", _Hashes())


def _borders(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Numbers of words before each border; ``last`` is true for words that end a sentence."""
    cut = last.copy()
    if len(hashes) >= CUT:
        least = CUT - 1 - np.lib.stride_tricks.sliding_window_view(hashes, CUT)[:, ::-1].argmin(axis=1)  # the last of equal ones
        before = np.concatenate([[0], np.cumsum(last)])
        whole = np.flatnonzero(before[CUT - 1 : -1] == before[:-CUT])  # no sentence ends before the window does
        cut[whole + least[whole]] = True
    cut[-1] = True
    return np.concatenate([[0], np.flatnonzero(cut) + 1])


def _pieces(text: str) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """(words, their hashes, sets of borders: by words alone, and with line ends)."""
    words = text.split()
    hashes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not words:
        return words, hashes, []
    last = (hashes & np.uint64(1)).astype(bool)
    sets = [_borders(hashes, last)]
    if "\n" in text:
        lines, at = last.copy(), np.cumsum([len(x.split()) for x in text.split("\n")])
        lines[at[at > 0] - 1] = True
        if (lines != last)[:-1].any():
            sets.append(_borders(hashes, lines))
    return words, hashes, sets


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each piece with the white space after it; together they are the whole text."""
    words, _, sets = _pieces(text)
    if not words:
        return [(0, len(text))] if text else []
    n, gaps = len(words), _GAP.findall(text)
    lead = len(gaps.pop(0)) if text[:1].isspace() else 0
    gaps += [""] * (n - len(gaps))
    ends = lead + np.cumsum(np.fromiter(map(len, words), np.int64, n) + np.fromiter(map(len, gaps), np.int64, n))
    return list(pairwise([0, *ends[np.unique(np.concatenate(sets))[1:] - 1].tolist()]))


def runs(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(hashes, 12 bytes each; first pieces; ends) of the runs, those that repeat within the text included."""
    _, hashes, sets = _pieces(text)
    if len(hashes) < LEAST_WORDS:
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    found = []
    for b in sets:
        k = np.arange(len(b))
        end = np.maximum(np.searchsorted(b, b + LEAST_WORDS), k + LEAST_PIECES)
        first = np.minimum(np.searchsorted(b, b - LEAST_WORDS, "right") - 1, k - LEAST_PIECES)
        i, j = np.concatenate([k[end < len(b)], first[first >= 0]]), np.concatenate([end[end < len(b)], k[first >= 0]])
        found.append(b[i] << 32 | b[j])
    found = np.unique(np.concatenate(found))
    i, j = found >> 32, found & 0xFFFFFFFF
    every = np.unique(np.concatenate(sets)) if len(sets) > 1 else sets[0]
    raw, digest = hashes.tobytes(), xxhash.xxh3_128_digest
    marks = b"".join([digest(raw[a:e])[:12] for a, e in zip((8 * i).tolist(), (8 * j).tolist(), strict=True)])
    return marks, np.searchsorted(every, i), np.searchsorted(every, j)


_SPANS = "h1 long, h2 int, id long, place long, spread int"  # place: first piece << 8 | number of pieces, of which a run has under 2 * CUT + LEAST_WORDS


def _first_of_equal(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.empty(0, bool)


def _spans(batches):
    """Runs as ``_SPANS``; ``spread`` is 0 for the first of equal ones of a window, else a number over 0 that deals the row out."""

    def combined(rows: list[tuple[bytes, int, np.ndarray]]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join([r[0] for r in rows]), [("h1", ">i8"), ("h2", ">i4")])
        h1, h2 = h["h1"].astype(np.int64), h["h2"].astype(np.int32)
        ids, places = np.repeat(np.array([r[1] for r in rows], np.int64), [len(r[2]) for r in rows]), np.concatenate([r[2] for r in rows])
        order = np.lexsort((places, ids, h2, h1))
        h1, h2, ids, places = h1[order], h2[order], ids[order], places[order]
        lead = _first_of_equal(h1, h2)
        once = lead | np.concatenate([[True], (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])])  # rows that repeat an id tell the same twice
        h1, h2, ids, places, lead = h1[once], h2[once], ids[once], places[once], lead[once]
        spread = np.where(lead, 0, 1 + np.arange(len(h1)) % 65521).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, ids, places, spread)], ["h1", "h2", "id", "place", "spread"])

    held: list[tuple[bytes, int, np.ndarray]] = []
    n = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            marks, first, end = runs(text)
            if not len(first):
                continue
            held.append((marks, i, first << 8 | (end - first)))
            n += len(first)
            if n >= WINDOW:
                yield combined(held)
                held, n = [], 0
    if held:
        yield combined(held)


def _later(batches):
    """Of rows sorted by hash, id and place: those that are not the first of their hash."""
    last = None  # the hash, id and place of the last row that was first of its hash
    for batch in batches:
        h1, h2, ids, places, spread = (batch.column(k).to_numpy() for k in range(5))
        if not len(h1):
            continue
        lead = _first_of_equal(h1, h2)
        lead[0] = last is None or (h1[0], h2[0]) != last[:2]
        first = np.maximum.accumulate(np.where(lead, np.arange(len(h1)), -1))  # -1: that of the batch before
        same = (ids == np.where(first < 0, last[2] if last else 0, ids[first])) & (places == np.where(first < 0, last[3] if last else 0, places[first]))
        if first[-1] >= 0:
            last = tuple(x[first[-1]] for x in (h1, h2, ids, places))
        gone = ~same | (spread > 0)
        places = places[gone]
        yield pa.RecordBatch.from_arrays([pa.array(ids[gone]), pa.array((places >> 8).astype(np.int32)), pa.array(((places >> 8) + (places & 255)).astype(np.int32))], ["id", "first", "end"])


def _cut(batches):
    for batch in batches:
        texts, removed = [], []
        at, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values
        first, end = (flat.field(k).to_numpy() for k in ("first", "end"))
        for k, text in enumerate(batch.column(1).to_pylist()):
            spans, own = sentences(text), slice(at[k], at[k + 1])
            n = len(spans)
            drop = (np.cumsum(np.bincount(first[own], minlength=n)[:n] - np.bincount(end[own], minlength=n)[:n]) > 0).tolist()
            texts.append("".join([text[a:b] for (a, b), gone in zip(spans, drop, strict=True) if not gone]))
            removed.append([{"start": a, "end": b} for (a, b), gone in zip(spans, drop, strict=True) if gone])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, kind)], ["_row", "_text", "removed"])


def covered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gone): by document, the runs of pieces that are not the first occurrence."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = rows.mapInArrow(alone("span_dedup", _spans), _SPANS).repartition("h1", "h2", "spread").sortWithinPartitions("h1", "h2", "spread", "id", "place")
    gone = spans.mapInArrow(alone("span_dedup", _later), "id long, first int, end int")
    return gone.groupBy("id").agg(F.collect_set(F.struct("first", "end")).alias("gone"))


def drop_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` freed of repeated spans, plus ``removed``: (start, end) in the old text of each piece cut.

    Null texts and rows with a null id stay as they are and do not count as occurrences; a text
    of fewer than 20 words has no run. Rows that repeat an id and a text are one occurrence and keep or lose the same
    pieces. A text may become empty; texts may be of any length. An empty table gives an empty result. A
    column ``removed`` in ``df`` is replaced, all others pass through.
    """
    df = df.drop("removed")
    gone = materialize(covered(df, id_col, text_col), "gone")
    ids = gone.select(F.col("id").alias("_key"))
    hint = F.broadcast if ids.count() <= BROADCAST_IDS else (lambda x: x)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")  # so that no column of df clashes with ours
    keyed = df.select(row, F.col(f"`{id_col}`").cast("long").alias("_key"), F.col(f"`{text_col}`").alias("_old"))
    same = keyed.join(hint(ids), "_key", "left_anti")  # rows without repeats pass straight through
    cut = keyed.join(hint(ids), "_key", "left_semi").join(gone.select(F.col("id").alias("_key"), "gone"), "_key")
    schema = f"_row {keyed.schema['_row'].dataType.simpleString()}, _text string, removed array<struct<start:int,end:int>>"
    changed = cut.select("_row", "_old", "gone").mapInArrow(alone("span_dedup", _cut), schema)
    changed = changed.select(*[(F.col("_text") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in df.columns], "removed")
    same = same.select("_row.*", F.expr("cast(array() AS array<struct<start:int,end:int>>)").alias("removed"))
    return same.unionByName(changed)
