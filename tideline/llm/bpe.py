"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import narrow, only, slices, text_bytes

#: Texts above this many characters are encoded in parts.
PART = 1 << 16

#: Places between two characters that no match of the split pattern can span: before a blank or line end that
#: follows something else, and where a run of letters or of digits ends.
SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")


@functools.lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at safe places only; without one it stays whole."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str, coder: tiktoken.Encoding, size: int = PART) -> np.ndarray:
    if len(text) <= size:
        return coder.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([coder.encode_to_numpy(p, disallowed_special=()) for p in parts(text, size)])


def decode_ids(ids: np.ndarray, coder: tiktoken.Encoding) -> bytes:
    """Raw bytes, which need not be valid UTF-8 when ids are cut anywhere."""
    return coder.decode_bytes(ids.tolist())


def _ids_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int32), *rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text, and the bytes that these ids decode to.

    Returns doc_id, ``ids`` (array of int) and ``decoded`` (binary), one row per input row in any order. The ids
    are those of the tiktoken library without special tokens, whose strings are ordinary text. Texts are split by
    ``pattern``; long ones are first cut at places no match can span (for the pattern of the byte-level family:
    optional blank and a run of letters, digits or other characters, contractions, white space), so memory
    follows one part and one text's ids. A NULL text is the empty text: no ids, no bytes. NULL or repeated ids and
    repeated rows give a row each; further columns are not read. The rank file must be at ``ranks_path`` on every
    executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks_path, pattern)
        for batch in slices(batches, "text"):
            ids = [encode_text(t.decode("utf-8", "replace"), coder) for t in batch.column("text").to_pylist()]
            decoded = pa.array([decode_ids(i, coder) for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _ids_array(ids), decoded], ["doc_id", "ids", "decoded"])

    rows = narrow(only(docs, doc_id=doc_id, text=text))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", text_bytes().alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded binary"
    )


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, number of ids, SHA-256 of the decimal ids joined by one blank, SHA-256 of the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
