"""Operator 10: N-gram Jaccard join, exact, by inverted lists and a T-occurrence search (DivideSkip).

1. *Sets.* Each text gives its set size, a 128-bit signature of the set and a 256-bit parity sketch.
   Equal sets become one representative before anything is compared.
2. *Inverted lists of part signatures.* A hash deals a set's tokens into parts and signs each part with
   tokens in it. Two linked sets differ in at most d = (1-t)/t n tokens, n being the size of either, so of P
   parts at least P - d are equal in both. Sizes fall into bands of ratio 1/t; a set signs the parts
   for its own band and the one below, so any two sets that can link share a scheme. With e empty parts a
   set shares at least T = P - d - e signatures with each set it links to; where that is under 1, it
   signs its empty parts too and T is 1. A signature stands for some 1/(1-t) tokens at once,
   so frequent words make no long lists.
3. *Short and long lists.* Each task combines ``WINDOW`` entries at a time: all but the first of equal
   signatures link to it and are dealt out evenly, so one entry a window and signature meets at the
   signature, in sorted partitions that stream past. Lists of one entry drop out. Of T shared lists the
   shortest is, for both sets, not among their own T - 1 longest: a set is taken out of its T - 1
   longest lists, so that passages which many documents share lead nowhere unless they make up enough of
   both. Lists with the same members count once. Each list first links its members to its most central
   member (a star), the one whose lists are longest altogether: of a family of near copies mostly the text they come from. Verified
   stars give provisional components, so a group of thousands of near copies costs a star and not all its pairs.
4. *T-occurrence search.* Sets in lists that still hold different components, and only they, get
   inverted lists of their shingles, again without each set's T - 1 longest, T being the overlap a link
   needs. Near copies that share a template but too little for a link meet in no short list. Pairs of
   different components that do meet, within bounds on set size and on the parity sketch
   (popcount(a xor b) <= |A xor B|), get wide sketches, two to four bits a shingle, which tell sets of hundreds of
   shingles apart by the same bound. No link between components is lost. Candidates gather by their query (hubs with many are cut into bounded
   blocks). In a block the candidates' shingles form inverted lists; the query's lists are divided
   into long and short: short ones are heap-merged, long ones probed by binary search, and the
   candidates that reach the overlap ``ceil(t (|A|+|B|) / (1+t))`` are kept.
5. *Components* over verified links, in rounds of joins (never on the driver).
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.shingles import mix, shingle_set
from lagwise.llm.worker import alone
from lagwise.operators.graph import attach_group, connected_components
from lagwise.plans.scratch import materialize

BROADCAST_ROWS = 2_000_000  # ids; beyond it, a shuffled join
WINDOW = 500_000  # entries combined in a task before the shuffle
BLOCK_SHINGLES = 100_000  # of candidates that meet in one verification block
WIDE_BITS = 1 << 15  # of a wide sketch at most; of larger sets it tells less, and their texts decide
_ROWS = 256  # turned into Python objects at once
_PART = np.uint64(0x5851F42D4C957F2D)
_SETS = "id long, n int, s1 long, s2 long, b0 long, b1 long, b2 long, b3 long, t0 int, t1 int"


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for a in range(0, batch.num_rows, _ROWS):
        part = batch.slice(a, _ROWS)
        for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            yield i, t or b""


def _needed(t: Fraction, total):
    """Smallest overlap of two sets of ``total`` members together whose Jaccard similarity reaches ``t``."""
    p, q = t.numerator, t.denominator + t.numerator
    return -(-(p * total) // q)


class Bands:
    """Size bands and the number of parts of each one's scheme, extended as larger sets come."""

    def __init__(self, t: Fraction):
        self.t, self.lower = t, [0, 1]

    def of(self, n: int) -> int:
        while self.lower[-1] <= n:
            self.lower.append(self.lower[-1] * self.t.denominator // self.t.numerator + 1)
        return bisect_right(self.lower, n) - 1

    def differ(self, n: int) -> int:
        """Tokens in which a set of size ``n`` and one it links to may differ."""
        return (self.t.denominator - self.t.numerator) * n // self.t.numerator

    def parts(self, scheme: int) -> tuple[int, int]:
        """(parts, tokens that may differ) for pairs of which the smaller set is in band ``scheme``; no parts where only equal sets can link."""
        self.of(self.lower[min(scheme, len(self.lower) - 1)])
        differ = self.differ(self.lower[scheme + 1] - 1) if scheme > 0 else 0
        return (differ + 2 + differ // 5, differ) if differ else (0, 0)


def schemes_of(tokens: np.ndarray, bands: Bands) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(scheme, parts, part of each token, least number of shared signatures) under the set's own band and the one below."""
    band, spread = bands.of(len(tokens)), tokens >> np.uint64(32)
    for scheme in (band, band - 1):
        parts, differ = bands.parts(scheme)
        if parts:
            part = (spread * np.uint64(parts)) >> np.uint64(32)  # ascending, as the tokens are
            used = 1 + int(np.count_nonzero(part[1:] != part[:-1]))
            yield scheme, parts, part, used - min(differ, bands.differ(len(tokens)))


def least_shared(tokens: np.ndarray, bands: Bands) -> list[int]:
    """Signatures shared with any set it links to: at least so many of even schemes, and of odd ones."""
    found = [1, 1]
    for scheme, _, _, least in schemes_of(tokens, bands):
        found[scheme & 1] = max(1, least)
    return found


def part_signatures(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of the parts of one set under its own band's scheme and the one below; odd where the scheme's number is."""
    out, value = [], mix(tokens + _PART)
    for scheme, parts, part, least in schemes_of(tokens, bands):
        first = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
        named = [mix(part[first] + np.uint64(scheme << 32)) ^ np.add.reduceat(value, first)]
        if least < 1:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
            named.append(mix(empty + np.uint64(scheme << 32)))
        out.append(mix(np.concatenate(named)) & ~np.uint64(1) | np.uint64(scheme & 1))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_sets(rows: DataFrame, width: int, t: Fraction) -> DataFrame:
    """(id, text) to one row of ``_SETS`` each: size, signature and parity sketch of the shingle set, and its least numbers of shared part signatures."""

    def run(batches):
        bands = Bands(t)
        for batch in batches:
            ids, nums, sketch = [], [], []
            for i, text in _texts(batch):
                tokens = shingle_set(text, width)
                other = mix(tokens ^ _PART)
                ids.append(i)
                nums.append((len(tokens), int(tokens.sum(dtype=np.uint64).astype(np.int64)), int(other.sum(dtype=np.uint64).astype(np.int64)), *least_shared(tokens, bands)))
                parity = np.bincount((other >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                sketch.append(np.packbits(parity.astype(np.uint8)).view(np.int64))
            num, sk = np.array(nums, np.int64).reshape(-1, 5), np.array(sketch, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(num[:, 0].astype(np.int32)), pa.array(num[:, 1]), pa.array(num[:, 2]), *[pa.array(np.ascontiguousarray(sk[:, k])) for k in range(4)], *[pa.array(num[:, k].astype(np.int32)) for k in (3, 4)]],
                ["id", "n", "s1", "s2", "b0", "b1", "b2", "b3", "t0", "t1"],
            )

    return rows.mapInArrow(alone("ngram_join", run), _SETS)


def _changes(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.empty(0, bool)


def _entries(width: int, t: Fraction):
    """(id, text) to (sign, id, hub): of equal signatures in a window, the first has its own id as hub and the others that id; single ones null."""

    def combined(signs: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        sign, own = np.concatenate(signs), np.repeat(np.array(ids, np.int64), [len(x) for x in signs])
        order = np.lexsort((own, sign))
        sign, own = sign[order], own[order]
        lead = _changes(sign)
        first = np.flatnonzero(lead)
        counts = np.diff(np.append(first, len(sign)))
        return pa.RecordBatch.from_arrays([pa.array(sign), pa.array(own), pa.array(np.repeat(own[first], counts), mask=np.repeat(counts == 1, counts))], ["sign", "id", "hub"])

    def run(batches):
        bands, signs, ids, held = Bands(t), [], [], 0
        for batch in batches:
            for i, text in _texts(batch):
                signs.append(part_signatures(shingle_set(text, width), bands).view(np.int64))
                ids.append(i)
                held += len(signs[-1])
                if held >= WINDOW:
                    yield combined(signs, ids)
                    signs, ids, held = [], [], 0
        if held:
            yield combined(signs, ids)

    return run


def _shared(batches):
    """From entries sorted by signature and id, those of lists of two or more, with the smallest id of the list (or window) as hub."""
    last: tuple[int, int, bool] | None = None  # signature, hub and whether its last entry went out
    for batch in batches:
        sign, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        alone = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        given = batch.column(2).fill_null(0).to_numpy()
        follows = ~alone & (given != own)
        out = [(sign[follows], own[follows], given[follows])]
        sign, own, alone = sign[~follows], own[~follows], alone[~follows]
        if len(sign):
            first = np.flatnonzero(_changes(sign))
            counts = np.diff(np.append(first, len(sign)))
            hub, send = own[first].copy(), (counts > 1) | ~alone[first]
            if last is not None and last[0] == sign[0]:
                hub[0], send[0] = last[1], True
                if not last[2]:
                    out.append((sign[:1], np.array([last[1]]), np.array([last[1]])))
            out.append(tuple(np.repeat(x, counts)[np.repeat(send, counts)] if x is not own else own[np.repeat(send, counts)] for x in (sign[first], own, hub)))
            last = (int(sign[-1]), int(hub[-1]), bool(send[-1]))
        cols = [np.concatenate([o[k] for o in out]) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["sign", "id", "hub"])


def shared_signatures(rows: DataFrame, width: int, t: Fraction) -> DataFrame:
    """(sign, id, hub) of the signatures that two or more of the texts share; one shuffle."""
    schema = "sign long, id long, hub long"
    entries = rows.mapInArrow(alone("ngram_join", _entries(width, t)), schema)
    place = F.when(F.col("hub").isNull() | (F.col("hub") == F.col("id")), F.col("sign")).otherwise(F.xxhash64("sign", "id"))
    return entries.repartition(place).sortWithinPartitions("sign", "id").mapInArrow(alone("ngram_join", _shared), schema)


def t_occurrence(query: np.ndarray, lists: dict[int, list[int]], needed: dict[int, int]) -> dict[int, int]:
    """DivideSkip: overlap of ``query`` with each candidate that reaches its own ``needed`` overlap.

    ``lists``: ascending candidate numbers by token. The lists of the query's tokens are sorted by
    length; the L longest (L < the least overlap asked) are only probed. A candidate must occur in at
    least ``needed - L`` short lists, which one heap merge finds.
    """
    mine = [own for own in map(lists.get, query.tolist()) if own]
    least = min(needed.values(), default=0)
    if len(mine) < least or not mine:
        return {}
    mine.sort(key=len)
    longest = len(mine[-1])
    count = min(max(0, least - 1), int(least / (0.02 * np.log2(max(2, longest)) + 1)))
    short, long = mine[: len(mine) - count], mine[len(mine) - count :]
    found: dict[int, int] = {}
    heap = [(own[0], k, 0) for k, own in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        top, times = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, k, at = heap[0]
            times += 1
            if at + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        if times + len(long) >= needed[top]:
            left = len(long)
            for own in long:
                spot = bisect_left(own, top)
                times += spot < len(own) and own[spot] == top
                left -= 1
                if times + left < needed[top]:
                    break
            if times >= needed[top]:
                found[top] = times
    return found


def _verify_block(width: int, t: Fraction):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        asks = block["asks"].to_numpy(bool)
        query = shingle_set(block.loc[asks, "text"].iloc[0].encode(), width)
        others = block[~asks]
        wanted = set(query.tolist())
        lists: dict[int, list[int]] = {}
        needed: dict[int, int] = {}
        for k, text in enumerate(others["text"]):
            tokens = shingle_set(text.encode(), width)
            needed[k] = int(_needed(t, len(query) + len(tokens)))
            for token in wanted.intersection(tokens.tolist()):
                lists.setdefault(token, []).append(k)
        links = sorted(t_occurrence(query, lists, needed))
        return pd.DataFrame({"src": np.full(len(links), block["hub"].iloc[0]), "dst": others["id"].to_numpy()[links]}, columns=["src", "dst"]).astype("int64")

    return run


def _with_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose id is in the small-or-large table ``ids``; broadcast only when counted to be small."""
    few = ids.count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def wide_sketches(rows: DataFrame, width: int) -> DataFrame:
    """(id, text) to (id, n, wide): set size and a parity sketch of a power of two of bits, at least 64."""

    def run(batches):
        for batch in batches:
            ids, nums, sketch = [], [], []
            for i, text in _texts(batch):
                tokens = mix(shingle_set(text, width) ^ _PART)
                power = min(WIDE_BITS.bit_length() - 1, max(6, (2 * len(tokens)).bit_length()))
                parity = np.bincount((tokens >> np.uint64(64 - power)).astype(np.int64), minlength=1 << power) & 1
                ids.append(i)
                nums.append(len(tokens))
                sketch.append(np.packbits(parity.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nums, pa.int32()), pa.array(sketch, pa.binary())], ["id", "n", "wide"])

    return rows.mapInArrow(alone("ngram_join", run), "id long, n int, wide binary")


def sketch_difference(a: bytes, b: bytes) -> int:
    """Places where two wide sketches differ, at most the size of the sets' difference; the longer is folded."""
    bits = min(len(a), len(b)) * 8
    x, y = (np.unpackbits(np.frombuffer(w, np.uint8)).reshape(bits, -1).sum(axis=1) for w in (a, b))
    return int(np.count_nonzero((x ^ y) & 1))


def told_apart(pairs: DataFrame, texts: DataFrame, width: int, t: Fraction) -> DataFrame:
    """(hub, id, n) of the candidate ``pairs`` whose set sizes and wide sketches allow a link; ``n`` is the set size of ``id``."""
    p, q = t.numerator, t.denominator

    def near(n: int, m: int, a: bytes, b: bytes) -> bool:
        return q * min(n, m) >= p * max(n, m) and (q + p) * sketch_difference(a, b) <= (q - p) * (n + m)

    def run(batches):
        for batch in batches:
            parts = (batch.slice(a, _ROWS) for a in range(0, batch.num_rows, _ROWS))
            left = pa.array([near(*row) for part in parts for row in zip(*(part.column(k).to_pylist() for k in range(2, 6)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(left) for k in range(3)], ["hub", "id", "n"])

    ids = materialize(pairs.select("id").unionByName(pairs.select(F.col("hub").alias("id"))).distinct(), "ids")
    wide = materialize(wide_sketches(_with_ids(texts, ids), width), "wide")
    both = pairs.join(wide, "id").join(wide.select(F.col("id").alias("hub"), F.col("n").alias("m"), F.col("wide").alias("other")), "hub")
    return both.select("hub", "id", "n", "m", "wide", "other").mapInArrow(alone("ngram_join", run), "hub long, id long, n int").distinct()


def verify(pairs: DataFrame, texts: DataFrame, width: int, t: Fraction) -> DataFrame:
    """The linked ones of candidate ``pairs`` (hub, id), by T-occurrence search in bounded blocks."""
    pairs = materialize(told_apart(pairs, texts, width, t), "near")
    weight = pairs.groupBy("hub").agg(F.sum("n").alias("weight"))
    cut = pairs.join(weight, "hub").select("hub", "id", F.expr(f"cast(pmod(xxhash64(id), ceil(weight / {BLOCK_SHINGLES})) AS int)").alias("block"))
    members = cut.select("hub", "block", "id", F.lit(False).alias("asks")).unionByName(cut.select("hub", "block", F.col("hub").alias("id"), F.lit(True).alias("asks")).distinct())
    members = materialize(members, "members")
    needed = _with_ids(texts, members.select("id").distinct())
    return members.join(needed, "id").groupBy("hub", "block").applyInPandas(_verify_block(width, t), "src long, dst long")


def near(a: str, b: str, t: Fraction) -> str:
    """SQL: the sizes and parity sketches of rows ``a`` and ``b`` allow a link."""
    p, q = t.numerator, t.denominator
    differ = " + ".join(f"bit_count({a}.b{k} ^ {b}.b{k})" for k in range(4))
    return f"{q} * least({a}.n, {b}.n) >= {p} * greatest({a}.n, {b}.n) AND {q + p} * ({differ}) <= {q - p} * ({a}.n + {b}.n)"


def short_lists(posting: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sign, id, weight) of (sign, id) without each set's longest lists, T - 1 of a scheme; lists of one and those with the members of another go. ``weight``: lengths of all lists of the id."""
    listed = posting.join(posting.groupBy("sign").agg(F.count("*").alias("len")), "sign").join(sizes.select("id", "t0", "t1"), "id")
    longest_first = Window.partitionBy("id", F.col("sign") % 2 == 0).orderBy(F.desc("len"), "sign")
    ranked = listed.withColumn("weight", F.sum("len").over(Window.partitionBy("id"))).withColumn("rank", F.row_number().over(longest_first))
    short = materialize(ranked.where("rank >= if(sign % 2 = 0, t0, t1)").select("sign", "id", "weight"), "short")
    lists = short.groupBy("sign").agg(F.count("*").alias("len"), F.expr("bit_xor(xxhash64(id))").alias("m1"), F.expr("bit_xor(xxhash64(id, 1))").alias("m2")).where("len > 1")
    return short.join(lists.groupBy("len", "m1", "m2").agg(F.min("sign").alias("sign")).select("sign"), "sign")


def occurring_together(sets: DataFrame, texts: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Candidate pairs (hub, id) of ``sets`` (rows of ``_SETS`` and ``label``) with different labels, by inverted lists of their shingles.

    Of a set of n shingles whose overlap with another must reach T, the T - 1 longest lists are left to
    be probed by ``verify`` and the others merged: the shortest list that two linked sets share is among
    the n - T + 1 shortest of both. T is at least 2t/(1+t) n for the smaller set, t n for the larger.
    """

    def run(batches):
        for batch in batches:
            for i, text in _texts(batch):
                tokens = shingle_set(text, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.full(len(tokens), i))], ["token", "id"])

    p, q = t.numerator, t.denominator
    entries = _with_ids(texts, sets.select("id")).mapInArrow(alone("ngram_join", run), "token long, id long")
    shared = entries.withColumn("len", F.count("*").over(Window.partitionBy("token"))).where("len > 1").join(sets.select("id", "n"), "id")
    own = Window.partitionBy("id")
    placed = shared.withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("len", "token")))
    short = placed.where(f"place <= n - ({p} * n + {q - 1}) DIV {q} + 1").drop("len").join(sets.drop("n", "s1", "s2", "t0", "t1"), "id")
    short = materialize(short, "short")
    a, b = short.where(f"place <= n - ({2 * p} * n + {q + p - 1}) DIV {q + p} + 1").alias("a"), short.alias("b")
    # where the first shared list stands, enough of both sets must be left
    left = f"{q + p} * (1 + least(a.n - a.place, b.n - b.place)) >= {p} * (a.n + b.n)"
    both = a.join(b, (F.col("a.token") == F.col("b.token")) & F.expr(f"(a.n < b.n OR (a.n = b.n AND a.id < b.id)) AND a.label <> b.label AND {left} AND {near('a', 'b', t)}"))
    return both.select(F.col("a.id").alias("hub"), F.col("b.id").alias("id")).distinct()


def jaccard_links(sizes: DataFrame, texts: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Components of linked texts with distinct sets; ``sizes`` has their rows of ``_SETS``."""
    posting = materialize(shared_signatures(texts, width, t), "shared").drop("hub")
    posting = materialize(short_lists(posting, sizes), "lists")
    posting = materialize(posting.join(posting.groupBy("sign").agg(F.expr("max_by(id, struct(weight, -id))").alias("hub")), "sign"), "posting")

    star = posting.where("id <> hub").select("hub", "id").distinct()
    star = star.alias("p").join(sizes.alias("a"), F.col("a.id") == F.col("p.id")).join(sizes.alias("b"), F.col("b.id") == F.col("p.hub")).where(near("a", "b", t)).select("p.hub", "p.id")
    links = materialize(verify(materialize(star, "pairs"), texts, width, t), "links")
    label = materialize(connected_components(links), "label")

    named = posting.join(label, posting.id == label.node, "left").select("sign", "id", F.coalesce("component", "id").alias("label"))
    named = materialize(named, "named")
    mixed = named.groupBy("sign").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("sign")
    open_ = materialize(named.join(mixed, "sign").select("id", "label").distinct().join(sizes, "id"), "open")
    rest = materialize(verify(materialize(occurring_together(open_, texts, width, t), "pairs"), texts, width, t), "links")
    return materialize(connected_components(links.unionByName(rest)), "label")


def ngram_jaccard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: str = "0.8") -> DataFrame:
    """One row per row of ``df``: ``id_col, n_shingles, component_id`` (smallest id reachable by links).

    Null text counts as empty; a text without words has no shingles and links with nothing. Equal
    sets (so also repeated rows) link. A row with a null id cannot be linked: its component is null.
    The threshold is inclusive and exact. An empty table gives an empty result; other columns are ignored.
    """
    t = Fraction(threshold)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = materialize(shingle_sets(texts, width, t), "sets")
    keys = sets.where("n > 0 AND id IS NOT NULL").select("id", "n", "s1", "s2")
    whole = materialize(attach_group(keys, ["n", "s1", "s2"], F.col("id"), {"rep": F.min("id")}, {"rep": F.min("rep")}).select("id", "n", "rep"), "whole")
    others = whole.where("id <> rep").select("id").distinct()
    hint = F.broadcast if others.count() <= BROADCAST_ROWS else (lambda x: x)
    sizes = sets.where("n > 0 AND id IS NOT NULL").join(hint(others), "id", "left_anti").select("id", "n", "b0", "b1", "b2", "b3", "t0", "t1").dropDuplicates(["id"])
    single = texts.where("id IS NOT NULL").join(hint(others), "id", "left_anti")
    label = jaccard_links(materialize(sizes, "sizes"), single, width, t)
    linked = whole.join(label, whole.rep == label.node, "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    loose = sets.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(loose).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: str = "0.8") -> DataFrame:
    """``df`` with one row of each linked group, that of the smallest id; columns as in ``df``.

    Rows without id or words stay. Rows that repeat an id and text count as one group too: repeats of
    the kept id all stay, since the verdict is by id.
    """
    found = materialize(ngram_jaccard(df, id_col, text_col, width, threshold), "verdicts")
    gone = found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col)).distinct()
    few = gone.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(gone) if few else gone, id_col, "left_anti")
