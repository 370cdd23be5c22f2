"""SimHash near-duplicates: fingerprints linked through the bit counts of their segments."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import materialise, narrow, only, slices, text_bytes
from tideline.llm.components import components

BITS = 64
SEED = 42

#: Shingles whose hashes are counted together.
BLOCK = 1 << 14


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a text: bit i is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(width))))
    ones, total = np.zeros(BITS, np.int64), 0
    while block := list(itertools.islice(shingles, BLOCK)):
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in block), "<u8", len(block))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``bits`` (the 64-bit fingerprint as a signed long) of every whole text; NULL text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bits = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    rows = narrow(only(docs, doc_id=doc_id, text=text))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", text_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, bits long")


def _cell(bits: Column, segments: int, distance: int) -> Column:
    """Bit counts of the segments as the digits of one number; a digit leaves room for steps either way."""
    size, digit = BITS // segments, 63 // segments
    if size + 2 * distance >= 1 << digit:
        raise ValueError("too many segments for this distance")
    counts = (F.bit_count(F.shiftrightunsigned(bits, size * i).bitwiseAND(F.lit((1 << size) - 1))) for i in range(segments))
    places = [F.shiftleft((n + distance).cast("long"), digit * i) for i, n in enumerate(counts)]
    return sum(places[1:], places[0])


def _steps(segments: int, distance: int) -> list[int]:
    """Cells within Manhattan distance ``distance``, one of each opposite pair, as differences of cell numbers."""
    zero = (0,) * segments
    found = {zero}
    for _ in range(distance):
        found |= {s[:i] + (s[i] + d,) + s[i + 1 :] for s in found for i in range(segments) for d in (1, -1)}
    return sorted(sum(n << (63 // segments * i) for i, n in enumerate(s)) for s in found if s >= zero)


def near_pairs(prints: DataFrame, distance: int = 2, segments: int = 8) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in at most ``distance`` bits, each pair once.

    ``prints`` has distinct ``bits``. A differing bit changes the count of one segment by one, so the Manhattan
    distance of the counts never exceeds the bit distance. Equal counts make a grid cell; a fingerprint is
    sent to half of the cells in reach, and the bits themselves are compared where two meet. Cells with very many
    fingerprints are split by the adaptive join; only verified pairs leave it. The join is always by merge: Spark
    takes the size of the guests from the file before they are sent out, and would broadcast all of them.
    """
    home = prints.select(F.col("bits").alias("a"), _cell(F.col("bits"), segments, distance).alias("cell"))
    reach = F.explode(F.array(*(F.lit(s) for s in _steps(segments, distance))))
    guest = home.select(F.col("a").alias("b"), "cell", reach.alias("step")).select(
        "b", (F.col("cell") + F.col("step")).alias("cell"), (F.col("step") == 0).alias("same")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return home.hint("merge").join(guest, (home.cell == guest.cell) & near & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b")


def groups(
    docs: DataFrame, width: int = 3, distance: int = 2, segments: int = 8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Near-duplicate groups: doc_id, fingerprint (16 hexadecimal digits), component_id, group, one row per document.

    Documents are linked if their fingerprints differ in at most ``distance`` bits; component_id is the smallest
    id that links reach, ``group`` a fingerprint that stands for the component. Equal fingerprints are linked by
    grouping, so thousands of copies cost one row in the search. Words are runs without ASCII white space after
    lower-casing A-Z, shingles ``width`` words, repeats included; fewer words are one shingle, and a text
    without words (NULL too) has fingerprint zero, linked like any other. Repeated rows give a row each; a NULL
    id gets a row and the component of its fingerprint. Written tables are joined by merge, as the size of a
    compressed file does not tell how much a broadcast of it would take on the driver.
    """
    prints = materialise(fingerprints(docs, width, doc_id, text), "fingerprints")
    distinct = materialise(prints.groupBy("bits").agg(F.min("doc_id").alias("smallest")), "distinct-fingerprints")
    linked = components(near_pairs(distinct, distance, segments))
    rooted = distinct.hint("merge").join(linked, distinct.bits == linked.node, "left").select(
        "bits", "smallest", F.coalesce("root", "bits").alias("group")
    )
    smallest = rooted.groupBy("group").agg(F.min("smallest").alias("component_id"))
    named = rooted.select("bits", "group").hint("merge").join(smallest, "group")
    return prints.hint("merge").join(named, "bits").select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.lower(F.lpad(F.hex("group"), 16, "0")).alias("group"),
    )


def keep_one(docs: DataFrame, width: int = 3, distance: int = 2, segments: int = 8) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id (columns unchanged).

    A document without id stays only where its group has no id; a hash of the row decides between several, and of
    equal rows one stays. Documents are joined by merge, never broadcast: a file of many copies is small.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    key = F.struct(
        F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"),
        F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("hash"),
    )
    found = groups(docs.select(key.alias("key"), "text"), width, distance, segments, doc_id="key")
    chosen = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    kept = docs.select(key.alias("key"), row).hint("merge").join(chosen, "key").dropDuplicates(["key"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
