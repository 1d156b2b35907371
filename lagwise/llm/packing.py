"""Operator 1: best-fit packing planned on a length histogram.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at most
``capacity`` counts) reaches the driver, where best-fit decreasing runs over counts: a run of equal
pieces goes into a run of equally filled sequences in one step, so planning costs no more for 10**12
pieces than for 10**6. The plan lists, by length, runs of slots in rank order; each piece takes the
slot of its rank among the pieces of its length. Ranks come from counts by (length, bucket) plus a
local row number, so no task holds all pieces of one length.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Mapping
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.worker import alone, cache
from lagwise.plans.scratch import materialize

_PIECES = "id long, piece int, start long, length long, ids_crc32 long"
PIECES_A_BUCKET = 50_000
_encoders: dict[str, Encoder] = cache("packing", {})


def added_tokens(json_path: str) -> list[str]:
    """The strings that the tokenizer takes out of a text before it splits words."""
    with open(json_path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


class Encoder:
    """Ids of the tokenizer in a JSON file, without added special tokens.

    A text that holds none of the ``added`` tokens has the same ids by the rank file of the same
    vocabulary, whose encoder is three times as fast; the others go to the tokenizer itself, which is loaded
    when the first of them comes.
    """

    def __init__(self, json_path: str, ranks_path: str, added: list[str]):
        self.json_path, self.added = json_path, added
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self) -> tokenizers.Tokenizer:
        return tokenizers.Tokenizer.from_file(self.json_path)

    def ids(self, text: str) -> list[int]:
        if any(token in text for token in self.added):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)


def encoder(json_path: str, ranks_path: str, added: list[str] | None = None) -> Encoder:
    """Kept for each worker."""
    if json_path not in _encoders:
        _encoders[json_path] = Encoder(json_path, ranks_path, added_tokens(json_path) if added is None else added)
    return _encoders[json_path]


def token_pieces(df: DataFrame, id_col: str, text_col: str, json_path: str, ranks_path: str, capacity: int, closing_id: int = 0) -> DataFrame:
    """Pieces of each document's ids plus ``closing_id``: full pieces from the end, so that only the first may be shorter."""
    added = added_tokens(json_path)

    def run(batches):
        for batch in batches:
            encode = encoder(json_path, ranks_path, added).ids
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), closing_id], "<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(alone("packing", run), _PIECES)


def plan(counts: Mapping[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Best-fit decreasing over counts.

    Returns, by length, runs ``(first rank, first sequence, sequences' step, offset)``: the piece of rank
    ``r`` in a run goes to sequence ``first + (r - first rank) // step`` at ``offset + ((r - first rank) % step) * length``;
    and the number of sequences.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # runs (first, number) of sequences by room left
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    made = 0

    def give(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            heapq.heappush(free[room], (first, number))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank, own = counts[length], 0, runs.setdefault(length, [])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, (first, number) = capacity, (made, -(-left // (capacity // length)))
                made += number
            else:
                room = rooms[at]
                first, number = heapq.heappop(free[room])
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
            each = room // length  # the tightest fit of the next equal piece is the same sequence again
            full = min(number, left // each)
            if full:
                own.append((rank, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                give(room - each * length, first, full)
                first, number = first + full, number - full
            if number and left and left < each:
                own.append((rank, first, left, capacity - room))
                give(room - left * length, first, 1)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            give(room, first, number)
    return runs, made


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` (a written table) with ``rank`` from 0 among those of equal length."""
    buckets = max(1, -(-pieces.count() // PIECES_A_BUCKET))
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    # at most `buckets` rows for each length, of which there are at most `capacity`
    base = counts.select("length", "_bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_base"))
    local = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("id", "piece", "ids_crc32")) - 1
    return pieces.withColumn("_local", local).join(base, ["length", "_bucket"]).withColumn("rank", F.col("_base") + F.col("_local")).drop("_bucket", "_local", "_base")


def assign(pieces: DataFrame, runs: dict[int, list[tuple[int, int, int, int]]]) -> DataFrame:
    """Join ranked pieces to the planned slots. The plan is broadcast: a bounded number of runs for each length."""
    tables = pieces.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64).reshape(-1, 4) for k, v in runs.items()})
    fields = pieces.select("id", "piece", "start", "length", "ids_crc32", "rank")

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                mine, table = length == one, tables.value[int(one)]
                r = rank[mine]
                row = table[np.searchsorted(table[:, 0], r, side="right") - 1]
                inside = r - row[:, 0]
                sequence[mine] = row[:, 1] + inside // row[:, 2]
                offset[mine] = row[:, 3] + inside % row[:, 2] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return fields.mapInArrow(alone("packing", run), f"{_PIECES}, sequence_id long, offset long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Ids are those of the tokenizer in ``json_path``; ``ranks_path`` is the rank file of the same vocabulary.
    Null and empty texts give one piece, the closing id. Texts may be of any length. Repeated rows are packed each; a null id
    stays null. An empty table gives an empty result. Other columns are ignored.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = materialize(token_pieces(df, id_col, text_col, json_path, ranks_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    return assign(ranked(pieces), runs).withColumnRenamed("id", id_col)
