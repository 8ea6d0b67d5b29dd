"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.session import new_path, stored

#: 64-bit words in the bitmap of :func:`maybe_among`: 2**17 rows of two longs are broadcast at most, whatever the input.
BITMAP_WORDS = 1 << 17

__all__ = ["fold", "in_sieve", "maybe_among", "new_path", "pieces_of", "row_key", "sieve_of", "stored", "text_batches"]


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key is in fold -1."""
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(-1)).cast("int")


def text_batches(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices whose ``text`` column holds about ``chars`` bytes each, so that what a task builds per slice is bounded by
    that and by the longest text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for row, size in enumerate(sizes):
            if total and total + size > chars:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch, column  # before the next one is read


def maybe_among(df: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """Add a boolean: false where the row's key is certainly not in ``ids`` (one column of the key's type).

    A bitmap of fixed size, as a table of at most ``BITMAP_WORDS`` rows, is broadcast. Rows with true may still be
    absent from ``ids``; joins on them decide. So a join on few keys need not shuffle a table of whole texts.
    """
    def spot(column: Column) -> Column:
        return F.xxhash64(column.cast("string"))

    words = (
        ids.select(spot(F.col(ids.columns[0])).alias("_h"))
        .select(
            F.pmod(F.shiftright("_h", 6), F.lit(BITMAP_WORDS)).alias("_word"),
            F.expr("shiftleft(1L, cast(_h & 63 as int))").alias("_bit"),
        )
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_bits"))
    )
    marked = df.withColumn("_h", spot(F.col(key))).withColumn(
        "_word", F.pmod(F.shiftright("_h", 6), F.lit(BITMAP_WORDS))
    )
    hit = F.expr("coalesce((shiftrightunsigned(_bits, cast(_h & 63 as int)) & 1L) = 1L, false)")
    return marked.join(F.broadcast(words), "_word", "left").withColumn(flag, hit).drop("_h", "_word", "_bits")


def row_key() -> Column:
    """Id and hash of the text of a paper as one string: rows that agree in it are repeated rows."""
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    return F.concat_ws(":", F.coalesce(F.col("paper_id").cast("string"), F.lit("")), text_key.cast("string"))


def sieve_of(places: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``bits`` bits with those of all ``place`` (0 up to ``bits``) set; its size is that, whatever the rows."""
    parts = places.groupBy(F.shiftright("place", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(2**15 - 1))).alias("bits")
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():  # bits / 2**15 rows of 4 kB at most
        out[row.part << 12 : (row.part + 1) << 12] = np.frombuffer(row.bits, np.uint8)
    return out


def in_sieve(sieve: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bits at ``places`` (unsigned) are set."""
    return ((sieve[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def pieces_of(total: int, size: int) -> int:
    """How many pieces of ``size`` hold ``total`` things."""
    return max(1, -(-int(total) // size))
