"""Operator 9: byte-level BPE encoding and decoding by an automaton and backtracking.

Token bytes map to Latin-1 strings, which pyahocorasick matches. Encoding a piece starts from the
longest token that matches at each place and backtracks to shorter ones until every two adjacent
tokens are compatible: that is, BPE of the two together gives those two again, which a walk down
their merges decides and a memo keeps. Such a sequence is unique and equals what exact merging by rank gives,
in time linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
import re

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the letters, numbers and white space of Unicode below U+02B0
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_LATIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_BEYOND = re.compile("[^\u0000-\u02af]").search
_KEPT_PIECES = 400_000
_KEPT_PAIRS = 1_000_000


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split_any = regex.compile(pattern).findall
        self.split_latin = re.compile(_LATIN_PATTERN).findall if pattern == public_tokenizers.PATTERN else None
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.by_text = {str(b): a for a, b in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.rank_of = {a.decode("latin-1"): b for a, b in ranks.items()}
        self.single = [self.rank_of.get(chr(b), -1) for b in range(256)]
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, str] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self._learn(token.decode("latin-1"), rank)
        self.width = [len(self.bytes_of.get(r, b"")) for r in range(max(ranks.values(), default=-1) + 1)]

    def _learn(self, token: str, rank: int) -> None:
        """The last merge of ``token``: the two parts left when merging goes on by ranks below its own."""
        ids = [self.single[ord(c)] for c in token]
        while len(ids) > 2:
            best = min(((m, k) for k in range(len(ids) - 1) if (m := self.merge.get((ids[k], ids[k + 1]), rank)) < rank), default=None)
            if best is None:
                return  # no merge reaches this token
            ids[best[1] : best[1] + 2] = [best[0]]
        self.parts[rank] = (ids[0], ids[1])
        self.merge[ids[0], ids[1]] = rank

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both together yields exactly ``left, right``."""
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= _KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = 1 << 62
        while True:
            if self.merge.get((left, right), limit) < limit:
                return False
            # undo the later merge: before it, what merges across the border must rank below it, and at
            # equal rank the border wins against the right token, since merging goes from left to right
            if left in self.parts and (left > right or right not in self.parts):
                limit, left = left, self.parts[left][1]
            elif right in self.parts:
                limit, right = right + 1, self.parts[right][0]
            else:
                return True

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1 text of its bytes."""
        if (whole := self.rank_of.get(piece)) is not None:
            return [whole]
        n, width = len(piece), self.width
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, rank in self.automaton.iter(piece):
            starts[end + 1 - width[rank]].append(rank)  # ends ascend, so each list goes from short to long
        out: list[int] = []
        tries: list[int] = []
        at, choice, dead = 0, len(starts[0]) - 1, bytearray(n + 1)
        while at < n:
            own = starts[at]
            while choice >= 0:
                rank = own[choice]
                if not dead[at + width[rank]] and (not out or self.compatible(out[-1], rank)):
                    break
                choice -= 1
            if choice >= 0:
                out.append(rank)
                tries.append(choice)
                at += width[rank]
                choice = len(starts[at]) - 1 if at < n else 0
            else:
                dead[at] = 1  # the sequence up to a place is unique, so nothing will pass here
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                at -= width[out.pop()]
                choice = tries.pop() - 1
        return out

    def split(self, text: str) -> list[str]:
        """The pattern's matches. Texts below U+02B0 take an equal pattern that ``re`` runs faster."""
        return self.split_latin(text) if self.split_latin and not _BEYOND(text) else self.split_any(text)

    def ids_text(self, text: str) -> str:
        """Decimal ids joined by one space."""
        kept, out = self.pieces, []
        for piece in self.split(text):
            if (ids := kept.get(piece)) is None:
                ids = " ".join(map(str, self.encode_piece(piece.encode().decode("latin-1"))))
                if len(piece) <= 64:
                    if len(kept) >= _KEPT_PIECES:
                        kept.clear()
                    kept[piece] = ids
            out.append(ids)
        return " ".join(out)

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split(" "))) if ids else b""


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``id_col, ids``: the token ids of each whole text, null as empty (no ids)."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        for batch in batches:
            ids_text = codec(path).ids_text
            ids = [list(map(int, s.split())) for s in (ids_text(t or "") for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """``id_col, bytes``: what the ids stand for; null ids give no bytes."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        for batch in batches:
            table = codec(path).bytes_of
            out = [b"".join(map(table.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, bytes binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of each whole text, encoded and decoded again.

    Null counts as empty: no ids, and the digests of the empty string. Repeated rows give repeated
    rows, a null id stays null, an empty table gives none; other columns are ignored.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        for batch in batches:
            own, rows = codec(path), ([], [], [])
            for text in batch.column(1).to_pylist():
                ids = own.ids_text(text or "")
                rows[0].append(ids.count(" ") + 1 if ids else 0)
                rows[1].append(hashlib.sha256(ids.encode()).hexdigest())
                rows[2].append(hashlib.sha256(own.decode_text(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
