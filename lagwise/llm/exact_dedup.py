"""Operator 6: exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes each row to ``HASHES`` cells of a filter and counts the rows of every cell, combined before
the shuffle; the cells that two or more rows hit form the filter, as 4 KB bitmaps. Pass 2 tests each row:
unless all its cells are set its text occurs once, and the row passes straight through. Only the others
shuffle and are compared by SHA-256 (with 16 bits a row and one hash, some 6 % of rows that have no copy do so).

What pass 1 sends is 8 bytes a row and hash, never texts or digests. A second hash would cost those 8 bytes
again and save some 2 of the others. Bitmaps of each task, merged, would send the whole filter once a task: with
T tasks 2 T bytes a row, which is less for 4 tasks or fewer only.

The filter has 16 bits a row. Up to ``MAX_BITS`` (128 MB to broadcast) there is one; beyond some 67
million rows the digests are dealt into slices by other digits, each slice's digests lie in a folder of their own,
and each gets a filter of its own, one after the other. So the share of rows that shuffle and the size
of a broadcast stay the same whatever the number of rows, and no row is read for a slice that is not its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.operators.graph import attach_group
from lagwise.plans.scratch import materialize

MAX_BITS = 1 << 30
HASHES = 1
BROADCAST_ROWS = 1_000_000  # digests; beyond it, a shuffled join
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null as empty. Pure ASCII takes the faster ``lower``."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def filter_size(rows: int) -> tuple[int, int]:
    """(slices, bits of each slice's filter): some 16 bits a row, between one bitmap and ``MAX_BITS``."""
    slices = max(1, -(-16 * rows // MAX_BITS))
    return slices, min(MAX_BITS, max(1 << 15, 1 << max(0, -(-16 * rows // slices) - 1).bit_length()))


def _cell(k: int, bits: int) -> str:
    """SQL: the row's ``k``-th cell, from 1 on, as bitmap functions count positions."""
    return f"1 + pmod(conv(substring(sha, {1 + 15 * k}, 15), 16, 10)::bigint, {bits}L)"


def repeated_cells(hashed: DataFrame, bits: int) -> DataFrame:
    """Pass 1: (bucket, bitmap) of the cells that more than one row hits, at most ``bits`` / 32768 rows of 4 KB."""
    cells = hashed.select(F.expr(f"explode(array({', '.join(_cell(k, bits) for k in range(HASHES))}))").alias("cell"))
    twice = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.expr("bitmap_bucket_number(cell)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bitmap"))


def maybe_repeated(hashed: DataFrame, filter_: DataFrame, bits: int) -> DataFrame:
    """Pass 2: ``hashed`` with ``again``: false where the text surely occurs once. Only the filter is broadcast."""
    out, every = hashed, F.lit(True)
    for k in range(HASHES):
        side = F.broadcast(filter_.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")))
        out = out.withColumn("_cell", F.expr(_cell(k, bits))).join(side, F.expr("bitmap_bucket_number(_cell)") == F.col("_bucket"), "left")
        byte = "conv(hex(substring(_bitmap, cast(bitmap_bit_position(_cell) DIV 8 AS int) + 1, 1)), 16, 10)::int"
        out = out.withColumn(f"_set{k}", F.expr(f"coalesce(getbit({byte}, cast(bitmap_bit_position(_cell) % 8 AS int)), 0) = 1")).drop("_bucket", "_bitmap", "_cell")
        every = every & F.col(f"_set{k}")
    return out.withColumn("again", every).drop(*[f"_set{k}" for k in range(HASHES)])


def tested(hashed: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Both passes over a table with ``sha``: (that table with ``again``, the filter if there is but one, its bits)."""
    hashed = materialize(hashed, "hashed")
    slices, bits = filter_size(hashed.count())
    if slices == 1:
        filter_ = materialize(repeated_cells(hashed, bits), "filter")
        return maybe_repeated(hashed, filter_, bits), filter_, bits
    hashed = materialize(hashed.withColumn("_slice", F.expr(f"cast(pmod(conv(substring(sha, 46, 15), 16, 10)::bigint, {slices}) AS int)")), "slices", "_slice")
    parts = []
    for k in range(slices):
        own = hashed.where(F.col("_slice") == k).drop("_slice")
        parts.append(materialize(maybe_repeated(own, materialize(repeated_cells(own, bits), "filter"), bits), "tested"))
    return reduce(DataFrame.unionByName, parts), None, bits


def exact_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col, keep_id, group_size, kept, text_sha256``; of equal texts the largest id stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. A row with a null id
    never wins over one with an id; a group that has only null ids keeps them all (keep_id null).
    Repeated rows count in group_size and share their id's verdict. Other columns are ignored.
    """
    hashed = df.select(F.col(id_col).cast("long").alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"))
    flagged = materialize(tested(hashed)[0], "tested")
    once = flagged.where("NOT again").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    again = attach_group(
        flagged.where("again").select("id", "sha"), ["sha"], F.col("id"),
        {"keep_id": F.max("id"), "group_size": F.count("*")}, {"keep_id": F.max("keep_id"), "group_size": F.sum("group_size")},
    )
    both = once.unionByName(again.select("id", "sha", "keep_id", "group_size"))
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, that of the largest id; columns as in ``df``.

    Rows whose text surely occurs once pass straight through; the rest shuffle, combined before the
    shuffle so that a huge group sends one row a task. Of rows that also share the id, one stays, and a row with an id goes
    before one without; of a group without ids one stays. An empty table stays empty.
    """
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    rows = named.select("_row", F.sha2(normalised(F.col(f"_row.`{text_col}`")), 256).alias("sha"), F.col(f"_row.`{id_col}`").alias("_id"))
    flagged, filter_, bits = tested(rows.select("sha"))
    if filter_ is not None:
        rows = maybe_repeated(rows, filter_, bits)
    else:  # one pass over the texts all the same: by the digests that do repeat
        repeated = materialize(flagged.where("again").groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha", F.lit(True).alias("again")), "repeated")
        rows = rows.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated, "sha", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    once = rows.where("NOT again").select("_row.*")
    again = rows.where("again").groupBy("sha").agg(F.max_by("_row", F.struct(F.col("_id").isNotNull(), "_id")).alias("_row"))
    return once.unionByName(again.select("_row.*"))
