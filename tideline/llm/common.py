"""What the operators share: folds, small Arrow slices, tables written between steps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tideline.sources.stages import materialise

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

__all__ = ["fold", "kth_largest", "materialise", "narrow", "one_text", "only", "slices", "text_bytes"]


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names, so that further columns of any name cannot clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def text_bytes(name: str = "text") -> Column:
    """A text as UTF-8 bytes; NULL is the empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def one_text(df: DataFrame, *keys: str) -> DataFrame:
    """The keys, and as UTF-8 bytes the text with the smallest hash of each; tasks send one text a key."""
    text = text_bytes()
    return df.groupBy(*keys).agg(F.min_by(text, F.xxhash64(text)).alias("text"))


def narrow(df: DataFrame) -> DataFrame:
    """``df``, after the session was given smaller Arrow batches than the default, unless it has a size of its own.

    A batch of ten thousand long texts would be larger than a worker's memory, or than Arrow allows.
    """
    conf = df.sparkSession.conf
    if BATCH not in conf.getAll:
        conf.set(BATCH, "500")
    return df


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20, field: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` (or a field of it) holds at most ``limit`` bytes in each, or one row.

    Memory that Arrow keeps for later is given back after each batch, as workers outlive their tasks.
    """
    for batch in batches:
        texts = batch.column(column)
        start = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(pc.struct_field(texts, field) if field else texts), 0).to_pylist()):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
        del batch, texts
        pa.default_memory_pool().release_unused()


def kth_largest(df: DataFrame, column: str, k: int, buckets: int = 4096, gather: int = 4096) -> float | None:
    """The k-th largest value of a double column (1 is the largest), found exactly by narrowing histograms.

    Each pass counts at most ``buckets`` intervals; values come to the driver only when at most ``gather``
    distinct ones are left. ``df`` should be a written table. NULL and NaN take no part; None if fewer than k.
    """
    value = F.col(column)
    df = df.where(value.isNotNull() & ~F.isnan(value)).select(value.alias("v"))
    low, high, total = df.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k < 1 or total < k:
        return None
    above = 0
    while low < high:
        inside = df.where((F.col("v") >= low) & (F.col("v") <= high))
        width = (high - low) / buckets
        if width <= 0 or low + width == low or high - width == high or math.isinf(width):
            break
        slot = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(buckets - 1))
        counts = inside.groupBy(slot.alias("slot")).agg(
            F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        for row in sorted(counts.collect(), key=lambda r: -r.slot):
            if above + row.n >= k:
                break
            above += row.n
        low, high = row.low, row.high
        if row.n <= gather:
            break
    if low == high:
        return low
    left = df.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy("v").count()
    for row in left.orderBy(F.desc("v")).toLocalIterator():
        above += row["count"]
        if above >= k:
            return row.v
    return low
