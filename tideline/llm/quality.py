"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import fold, kth_largest, materialise, narrow, one_text, only, slices, text_bytes

#: Buckets that n-grams are hashed into.
BUCKETS = 10_000

#: Labelled documents that the target model is fitted on, at most; every so many of them only help to choose k.
SAMPLE, CALIBRATE = 8_000, 4

#: A text weighs as much as if it had this many n-grams, so that its length says nothing about its quality.
GRAMS = 100

#: Documents with crc32(id) modulo this equal to 0 are not learned from.
LEARN_FOLDS = 5

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")

#: Tokens that stand for how a word is written, not which one it is.
AGAIN, LOUD = "<again>", "<loud>"


def tokens_of(text: str) -> list[str]:
    """Words in lower case and runs of signs, a word in capitals after a mark, a repeat of the last word as a mark."""
    out, last = [], ""
    for token in TOKEN.findall(text):
        word = token.lower()
        if word[0].isalnum():
            if word == last:
                out.append(AGAIN)
                continue
            if len(token) > 1 and token.isupper():
                out.append(LOUD)
            last = word
        out.append(word)
    return out


def buckets_of(text: str) -> np.ndarray:
    """Buckets of all unigrams and bigrams, with repeats."""
    tokens = tokens_of(text)
    ids = np.fromiter((zlib.crc32(t.encode("utf-8", "replace")) for t in tokens), np.uint64, len(tokens))
    pairs = (ids[:-1] * np.uint64(0x9E3779B1) + ids[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33) if len(ids) > 1 else ids[:0]
    return (np.concatenate([ids, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a partition."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            counts += np.bincount(buckets_of(text.decode("utf-8", "replace")), minlength=BUCKETS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["bucket", "n"])


def model_of(texts: DataFrame) -> np.ndarray:
    """log probability of each bucket in the texts, with one added to every count."""
    sums = texts.select("text").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.ones(BUCKETS)
    for row in sums.collect():  # BUCKETS rows at most
        counts[row.bucket] += row.n
    return np.log(counts / counts.sum())


def log_weight(text: str, ratio: np.ndarray) -> float:
    """Log of target over raw probability, per ``GRAMS`` n-grams; 0 without any."""
    buckets = buckets_of(text)
    return float(GRAMS * ratio[buckets].mean()) if len(buckets) else 0.0


def log_weights(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Rows (row: struct with a text) as (row, log_weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "row", field="text"):
            row = batch.column("row")
            found = [log_weight(t or "", ratio) for t in pc.struct_field(row, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([row, pa.array(found, pa.float64())], ["row", "log_weight"])

    return rows.select("row").mapInArrow(run, rows.select("row").schema.add("log_weight", "double"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of a bounded sample of labelled documents: quality (0 if any label says so), part (0 calibrates), text.

    An id is one document; of several texts the one with the smallest hash stands for it.
    """
    marked = (
        only(labels, doc_id="doc_id", quality="quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold("doc_id", LEARN_FOLDS) != 0))
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .withColumn("order", F.xxhash64(F.col("doc_id").cast("string")))
    )
    texts = only(docs, doc_id="doc_id", text="text").where(F.col("doc_id").isNotNull())
    ids = marked.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy("order", "doc_id").limit(SAMPLE)
    chosen = materialise(ids.select("doc_id", "quality", F.pmod("order", F.lit(CALIBRATE)).alias("part")), "quality-labels")
    return materialise(one_text(texts.join(F.broadcast(chosen), "doc_id"), "doc_id", "quality", "part").drop("doc_id"), "quality-sample")


def best_cut(low: np.ndarray, high: np.ndarray) -> float:
    """The value that leaves the fewest on the wrong side; the middle of the range of such values."""
    values = np.unique(np.concatenate([low, high]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    wrong = len(low) - np.searchsorted(np.sort(low), cuts, "right") + np.searchsorted(np.sort(high), cuts, "left")
    best = np.flatnonzero(wrong == wrong.min())
    return float(cuts[best[0]] + cuts[best[-1]]) / 2


def perturbed(log_weight: Column, doc_id: Column, seed: int) -> Column:
    """The log weight plus standard Gumbel noise from a hash of the id and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return log_weight - F.log(-F.log(u))


def _fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """log ratio of each bucket, and the log weight from which documents are like the target (0 and no limit without labels)."""
    sample = labelled(docs, labels)
    good = sample.where((F.col("quality") == 1) & (F.col("part") != 0))
    if not good.limit(1).count():
        return np.zeros(BUCKETS), -np.inf
    ratio = model_of(good) - model_of(docs.select(text_bytes().alias("text")))
    rest = sample.where("part = 0").select(F.struct("quality", F.col("text").cast("string").alias("text")).alias("row"))
    rows = log_weights(rest, ratio).select("row.quality", "log_weight").collect()  # of the sample
    low, high = (np.array([r.log_weight for r in rows if r.quality == q]) for q in (0, 1))
    return ratio, best_cut(low, high) if len(low) and len(high) else 0.0


def resampled(docs: DataFrame, labels: DataFrame, k: int | None, seed: int) -> tuple[DataFrame, float | None]:
    """All rows as (row: struct of the columns, log_weight, key), written to the shared folder, and the k-th largest key."""
    ratio, cut = _fitted(narrow(docs), labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    scored = log_weights(rows, ratio)
    stage = materialise(scored.withColumn("key", perturbed(F.col("log_weight"), F.col("row.doc_id"), seed)), "resampling")
    if k is None:
        k = stage.where(F.col("log_weight") >= cut).count()
    return stage, kth_largest(stage, "key", k) if k > 0 else float("inf")


def kept(least: float | None) -> Column:
    return F.lit(True) if least is None else F.col("key") >= F.lit(least)


def decisions(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7) -> DataFrame:
    """Importance resampling of whole texts: doc_id, log_weight, key and ``kept``, one row per input row.

    The kept rows are a sample of ``k`` without replacement in proportion to their weights (Gumbel top-k). Without
    ``k`` it is the number of rows on the target's side of the cut that tells a bounded labelled sample apart
    best. The target model comes from such a sample, the raw model from all rows. If ``k`` is beyond the rows or no
    good document is labelled, all rows are kept. NULL and empty texts have weight one (log 0). Rows with the same id
    and text share a key, NULL ids their noise; rows that tie with the k-th key are all kept, so there can be more than
    ``k``. Columns beside doc_id and text are not read.
    """
    stage, least = resampled(only(docs, doc_id="doc_id", text="text").select("doc_id", "text"), labels, k, seed)
    return stage.select(F.col("row.doc_id").alias("doc_id"), "log_weight", "key", kept(least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` without the rows that importance resampling leaves out; columns as they are."""
    stage, least = resampled(docs, labels, None, seed)
    return stage.where(kept(least)).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
