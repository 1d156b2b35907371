"""Operator 3: language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of one fixed public vocabulary. A word's probability is
the sum over all its segmentations into pieces, which a forward algorithm computes for all languages
at once; a text's is the product over its words (runs of letters, lower-cased). Counts for training
come from every labelled text: each task sums pieces by language and only those counts, at most
pieces x languages, reach the driver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.worker import alone, cache

UNDETERMINED = "und"
SMOOTHING = 0.5
SEGMENT = 16  # after so many characters the forward vector is rescaled and carried on; in between, pieces as rare as 1e-18 do not underflow
_KEPT_WORDS = 300_000  # in a worker's memory at once
_BATCH_KEYS = 20_000
_BATCH_WORDS = 8192
_LETTERS = regex.compile(r"\p{L}+")
_MARK = "▁"
_vocabularies: dict[str, Vocabulary] = cache("langid", {})


class Vocabulary:
    """The pieces of a sentencepiece model and an automaton that finds them. Piece 0 stands for any character without one."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        plain = [i for i in range(self.size) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.normal = np.zeros(self.size, np.int64)
        self.normal[plain] = plain  # bytes and others count as piece 0
        self.finder = ahocorasick.Automaton()
        self.length = np.zeros(self.size, np.int64)
        self.characters = set()
        for i in plain:
            piece = self.model.id_to_piece(i)
            self.length[i] = len(piece)
            self.finder.add_word(piece, i)
            if len(piece) == 1:
                self.characters.add(piece)
        self.finder.make_automaton()


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


@dataclass
class Model:
    languages: list[str]
    probabilities: np.ndarray  # pieces x languages
    path: str


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased, in no particular order: most are whole words between white space."""
    if not text:
        return []
    parts = text.lower().split()
    whole = [w for w in parts if w.isalpha()]
    if len(whole) < len(parts):
        whole += _LETTERS.findall(" ".join([w for w in parts if not w.isalpha()]))
    return whole


def train(rows: DataFrame, path: str | None = None) -> Model:
    """Piece probabilities by language from (text, lang); rows with a null lang teach nothing."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        vocab, seen, sums = vocabulary(path), {}, {}

        def flush():
            for lang, words in seen.items():
                total = sums.setdefault(lang, np.zeros(vocab.size, np.int64))
                keys = list(words)
                for a in range(0, len(keys), _BATCH_KEYS):
                    part = keys[a : a + _BATCH_KEYS]
                    encoded = vocab.model.encode(part, num_threads=1)
                    times = np.repeat(np.fromiter(map(words.__getitem__, part), np.int64, len(part)), [len(x) for x in encoded])
                    pieces = np.fromiter((i for x in encoded for i in x), np.int64, len(times))
                    np.add.at(total, vocab.normal[pieces], times)
            seen.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, seen.values())) > _KEPT_WORDS:
                    flush()
        flush()
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["lang", "piece", "n"])

    counts = rows.where("lang IS NOT NULL").select("text", "lang").mapInArrow(alone("langid", run), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    total = np.zeros((vocabulary(path).size, len(languages)))
    total[counts["piece"].to_numpy(np.int64), np.searchsorted(languages, counts["lang"].to_numpy(str)) if len(counts) else []] = counts["n"].to_numpy(float)
    total += SMOOTHING
    return Model(languages, total / total.sum(axis=0), path)


class Scorer:
    """Log-probabilities of words by language, kept for words met before."""

    def __init__(self, model: Model):
        self.model, self.vocab = model, vocabulary(model.path)
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def forward(self, words: list[str]) -> np.ndarray:
        """Words by languages: the log of the sum over all segmentations."""
        wholes = [_MARK + word for word in words]
        length, known = self.vocab.length, self.vocab.characters
        hits, strange = [], []
        for k, s in enumerate(wholes):
            hits.append(list(self.vocab.finder.iter(s)))
            if not known.issuperset(s):
                strange += [(at + 1, k, at, 0) for at, c in enumerate(s) if c not in known]
        counts = np.fromiter(map(len, hits), np.int64, len(hits))
        pairs = np.fromiter(chain.from_iterable(chain.from_iterable(hits)), np.int64, 2 * int(counts.sum())).reshape(-1, 2)
        ends, pieces = pairs[:, 0] + 1, pairs[:, 1]
        edges = np.stack([ends, np.repeat(np.arange(len(hits)), counts), ends - length[pieces], pieces], axis=1)
        if strange:
            edges = np.concatenate([edges, np.array(strange, np.int64)])
            edges = edges[np.argsort(edges[:, 1], kind="stable")]
        sizes = np.fromiter(map(len, wholes), np.int64, len(wholes))
        longest = int(sizes.max(initial=1))
        edges = edges[np.argsort(edges[:, 0].astype(np.int16 if longest < 1 << 15 else np.int64), kind="stable")]  # by end, then word
        borders = np.searchsorted(edges[:, 0], np.arange(1, longest + 2))
        p, back = self.model.probabilities, int(length.max(initial=1))
        out, scale = np.zeros((len(words), p.shape[1])), np.zeros((len(words), p.shape[1]))
        left, row = np.arange(len(words)), np.arange(len(words))  # words not at their end yet, and where they are in alpha
        alpha = np.zeros((len(words), back + SEGMENT + 1, p.shape[1]))  # places base - back to base + SEGMENT
        alpha[:, back] = 1
        for base in range(0, longest, SEGMENT):
            shift = back - base
            for end in range(base + 1, min(base + SEGMENT, longest) + 1):
                own = edges[borders[end - 1] : borders[end]]
                if len(own):
                    first, at = np.flatnonzero(np.diff(own[:, 1], prepend=-1)), row[own[:, 1]]
                    alpha[at[first], end + shift] = np.add.reduceat(alpha[at, own[:, 2] + shift] * p[own[:, 3]], first, axis=0)
            over = sizes[left] <= base + SEGMENT
            done = left[over]
            out[done] = np.log(alpha[row[done], sizes[done] + shift]) + scale[done]
            left, carried = left[~over], alpha[~over, SEGMENT:]
            row[left] = np.arange(len(left))
            alpha = np.zeros((len(left), *alpha.shape[1:]))
            alpha[:, : back + 1] = carried / carried[:, -1:]
            scale[left] += np.log(carried[:, -1])
        return out

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """Texts by languages: the sum of their words' logs."""
        if len(self.row) > _KEPT_WORDS:
            self.row.clear()
        new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in self.row]
        for a in range(0, len(new), _BATCH_WORDS):
            part = new[a : a + _BATCH_WORDS]
            at = len(self.row)
            while at + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(part)] = self.forward(part)
            self.row.update(zip(part, range(at, at + len(part)), strict=True))
        return np.array([self.table[[self.row[w] for w in t]].sum(axis=0) if t else np.zeros(self.table.shape[1]) for t in texts])


def posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _answered(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``_row`` (the row of ``df``), ``lang_pred`` and ``score``. The text is read from the row, so it goes to Python once."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    place = df.columns.index(text_col)

    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            names, found, scores = shared.value.languages, [], []
            texts = batch.column(0).field(place)
            for a in range(0, len(texts), 256):
                words = [words_of(t) for t in texts[a : a + 256].to_pylist()]
                p = posterior(scorer.texts(words)) if names else None
                for k, w in enumerate(words):
                    best = int(p[k].argmax()) if names and w else -1
                    found.append(names[best] if best >= 0 else UNDETERMINED)
                    scores.append(float(p[k, best]) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["_row", "lang_pred", "score"])

    return rows.mapInArrow(alone("langid", run), f"_row {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` plus ``lang_pred`` and ``score``, the posterior under equal priors; ``und`` and 0 for texts without a letter.

    Equally likely languages: the first in order of name. A model of no language answers ``und``.
    Columns named lang_pred or score are replaced; all others pass through unchanged.
    """
    return _answered(df.drop(*{"lang_pred", "score"} - {text_col}), model, text_col).select("_row.*", "lang_pred", "score")


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows of ``df`` that are not held out, then predict every row: ``id_col, held_out, lang_pred, score``.

    A null id is not held out. A null text, or one without a letter, is ``und`` with score 0 and teaches nothing; a
    null lang teaches nothing. Repeated rows teach and are answered each. Texts and words of any length
    count whole. An empty table gives an empty result; other columns are ignored.
    """
    taught = df.where(~held_out(F.col(id_col))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))
    return _answered(rows, train(taught), "_text").select(f"_row.`{id_col}`", "_row.held_out", "lang_pred", "score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows whose language is determined with at least ``least``; columns as in ``df``.

    Rows whose text is null or has no letter go. Repeated rows stay or go together, a null id makes no
    difference, and an empty table stays empty.
    """
    taught = df.where(~held_out(F.col(id_col))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = _answered(df, train(taught), text_col)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("_row.*")
