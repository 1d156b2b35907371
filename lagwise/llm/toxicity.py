"""Operator 7: toxicity by multiple-instance learning.

Only documents have labels. A sentence's probability is logistic in its hashed words and their
beginnings (so that unseen words of a known stem count); a document's is their noisy-or with a leak:
1 - (1 - leak) * prod(1 - p). The weights come from gradient steps on the documents' likelihood, whose gradient
shares each label out among the sentences that explain it, and the trained sentence scores then locate
the offending ones. Only features that occur more often in toxic documents than chance would have it
(G statistic) get a weight, so a stem of a small language counts as soon as its evidence is sound.

Training takes a bounded sample of the labelled rows (``SAMPLE`` documents in the order of a hash of
the id, and of these the first that together have ``SAMPLE_BYTES``); scoring covers every whole text.
The constants below were chosen on a split of rows that are not held out; held-out rows were never read for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.llm.shingles import word_starts

BITS = 20
PREFIXES = (3, 4, 5, 6, 7, 8)  # bytes
LEAST_POSITIVE, LEAST_EVIDENCE = 3, 10.0  # toxic documents of the sample in which a feature must occur to get a weight, and its G statistic
SAMPLE = 8_000
SAMPLE_BYTES = 48 << 20  # of text on the driver; its features take some seven times as much there
THRESHOLD = 0.7
EPOCHS = 10
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float


def sentence_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of each word and its beginnings, number of its sentence, place of its first byte); sentences without words have no number."""
    hashes, places = word_starts(text, _BETWEEN, PREFIXES)
    ends = np.flatnonzero(_ENDS[np.frombuffer(text, np.uint8)])
    raw = np.searchsorted(ends, places)
    number = np.cumsum(np.diff(raw, prepend=raw[:1]) != 0)
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32), number.astype(np.int32), places


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def evidence(k: np.ndarray, j: np.ndarray, toxic: int, other: int) -> np.ndarray:
    """G statistic of features in ``k`` of the toxic and ``j`` of the other documents; 0 where they are no likelier in toxic ones."""
    total = max(1, toxic + other)

    def part(seen: np.ndarray, of: int, rows: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1) / np.maximum(rows * of / total, 1e-300))

    g = 2 * (part(k, toxic, k + j) + part(j, other, k + j) + part(toxic - k, toxic, total - k - j) + part(other - j, other, total - k - j))
    return np.where(k * other > j * toxic, g, 0.0)


def gradient(x: np.ndarray, doc: np.ndarray, labels: np.ndarray, leak: float) -> tuple[np.ndarray, float]:
    """Of the log-likelihood of ``labels``, by the logits ``x`` of sentences in documents ``doc`` and by the logit ``leak``."""
    p, p0 = _sigmoid(x), _sigmoid(np.array([leak]))[0]
    log_none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(labels)) + np.log1p(-p0)
    some = np.maximum(-np.expm1(log_none), 1e-9)
    share = np.where(labels == 1, np.exp(log_none) / some, -1.0)  # of each sentence's own probability
    return share[doc] * p, float((share * p0).sum())


def fit(words: list[np.ndarray], sentences: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Adagrad over batches of documents. ``words``: words x features cells; ``sentences``: ascending sentence numbers from 0; by document."""
    seen_in = np.zeros((2, 1 << BITS), np.int32)
    for own, label in zip(words, labels, strict=True):
        seen_in[int(label == 1), np.unique(own)] += 1
    toxic = np.count_nonzero(labels == 1)
    active = (seen_in[1] >= LEAST_POSITIVE) & (evidence(seen_in[1].astype(float), seen_in[0].astype(float), toxic, len(labels) - toxic) >= LEAST_EVIDENCE)
    kept = [active[own] for own in words]
    cells_of = [own[k] for own, k in zip(words, kept, strict=True)]
    sentence_of = [np.broadcast_to(n[:, None], k.shape)[k] for n, k in zip(sentences, kept, strict=True)]
    counts_of = np.array([n[-1] + 1 if len(n) else 0 for n in sentences], np.int64)
    w, seen, bias, leak = np.zeros(1 << BITS), np.full(1 << BITS, 1.0), -4.0, -4.0
    seen_bias = seen_leak = 1.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), 64):
            batch = order[a : a + 64]
            counts = counts_of[batch]
            base = np.concatenate([[0], np.cumsum(counts)])
            cells = np.concatenate([cells_of[d] for d in batch])
            inst = np.concatenate([sentence_of[d] + b for d, b in zip(batch, base, strict=False)])
            x = bias + np.bincount(inst, w[cells], minlength=base[-1])
            g, g_leak = gradient(x, np.repeat(np.arange(len(batch)), counts), labels[batch], leak)
            used, place = np.unique(cells, return_inverse=True)
            step = np.bincount(place, g[inst], minlength=len(used)) - decay * w[used] * len(batch)
            seen[used] += step * step
            w[used] += rate * step / np.sqrt(seen[used])
            seen_bias += g.sum() ** 2
            bias = min(-2.0, bias + rate * g.sum() / np.sqrt(seen_bias))
            seen_leak += g_leak**2
            leak = min(-1.0, leak + rate * g_leak / np.sqrt(seen_leak))
    return Model(w.astype(np.float32), float(bias), float(leak))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled rows that are not held out. Without any the model scores its priors.

    An id labelled twice has the larger label; rows that repeat an id are each used. Null texts count as empty.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    share = max(1, -(-marked.count() // sample))
    # an even share by hash, bounded again by a limit in case the hash falls unevenly
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    few = marked.where(place < (1 << 30) // share).orderBy(place, "id").limit(sample + sample // 10)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = texts.join(F.broadcast(few), "id").select("id", "label", F.octet_length("text").alias("bytes"), place.alias("place"))
    total, wanted = 0, []
    for r in sizes.orderBy("place", "id", "bytes").limit(2 * sample).collect():
        total += r["bytes"]
        if total > sample_bytes:
            break
        wanted.append((r["id"], r["label"]))
    schema = "id long, label int"
    got = texts.join(F.broadcast(df.sparkSession.createDataFrame(sorted(set(wanted)), schema)), "id").select("id", "text", "label").collect()
    got = sorted(got, key=lambda r: (r["id"], r["text"]))  # rows arrive in any order
    features = [sentence_words(r["text"].encode())[:2] for r in got]
    return fit([c for c, _ in features], [n for _, n in features], np.array([r["label"] for r in got], np.int64))


def document_score(text: bytes, model: Model) -> tuple[float, np.ndarray, np.ndarray]:
    """(document's score, sentences' probabilities, places where the sentences begin)."""
    cells, numbers, places = sentence_words(text)
    leak = 1 / (1 + np.exp(-model.leak))
    if not len(cells):
        return float(leak), np.empty(0), places
    x = model.bias + np.bincount(numbers, model.weights[cells].sum(axis=1))
    p = _sigmoid(x)
    first = np.flatnonzero(np.diff(numbers, prepend=-1))
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum() + np.log1p(-leak))), p, places[first]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, held_out, score, predicted, offending``: ``offending`` has (byte where it starts, score) of sentences at 0.5 or more.

    Null and empty texts get the leak. Repeated rows get equal rows; a null id stays null and is not held out.
    Texts of any length are scored whole; an empty table gives an empty result; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            scores, where = [], []
            for text in batch.column(2).to_pylist():
                s, p, starts = document_score((text or "").encode(), shared.value)
                scores.append(s)
                where.append([{"start": int(starts[k]), "score": float(p[k])} for k in np.flatnonzero(p >= 0.5)])
            predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted, pa.array(where, kind)], ["id", "held_out", "score", "predicted", "offending"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int, offending array<struct<start:long,score:double>>").withColumnRenamed("id", id_col)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on ``labels.toxic`` and score every whole text of ``df``."""
    return score(df, train(df, labels, id_col, text_col), id_col, text_col)
