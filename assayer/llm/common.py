"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.common import give_back

#: Bits per key of the filter that :func:`maybe_among` sends to every task, and its size at most (4 MB of bits).
FILTER_BITS_EACH, MOST_FILTER_BITS = 64, 1 << 25
#: Text that a task holds at once, in bytes; a longer single text is held whole.
BATCH_BYTES = 4 << 20


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as empty: further columns never meet an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the ``text`` column of each piece has about ``limit`` bytes; at the end freed memory is returned."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_lengths(batch.column("text")))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def text_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(text_offsets(column)).astype(np.int64)


def text_offsets(column: pa.Array) -> np.ndarray:
    """The byte offsets of a string column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int64)
    return offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each text starts and the last ends."""
    offsets = text_offsets(column)
    data = column.buffers()[2] if len(column) else None
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def maybe_among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``df`` with flag ``_maybe``: false only where ``column`` (a long) is certainly not in ``keys``' one column.

    The filter has a bounded size, whatever the number of keys: when it fills up, more rows are flagged, never fewer.
    A null is never among the keys.  ``keys`` is read twice.
    """
    key = keys.columns[0]
    bits = min(MOST_FILTER_BITS, 1 << max(16, (FILTER_BITS_EACH * keys.count()).bit_length()))
    words = (
        keys.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("_bit"))
        .select(F.expr("_bit div 64").alias("_word"), F.expr("shiftleft(1L, cast(_bit % 64 AS INT))").alias("_flag"))
        .groupBy("_word").agg(F.bit_or("_flag").alias("_flags"))  # at most MOST_FILTER_BITS / 64 rows
    )
    marked = df.withColumn("_bit", F.pmod(F.xxhash64(column), F.lit(bits))).withColumn("_word", F.expr("_bit div 64"))
    joined = marked.join(F.broadcast(words), "_word", "left")
    there = F.col("_flags").bitwiseAND(F.expr("shiftleft(1L, cast(_bit % 64 AS INT))")) != 0
    return joined.withColumn("_maybe", F.col(column).isNotNull() & F.coalesce(there, F.lit(False))).drop("_bit", "_word", "_flags")


def rows_aside(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one column ``_row`` beside computed ``keys``, so no column of theirs can be mistaken; ``_row.*`` brings them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in keys.items()])
