"""Best-fit packing of tokenized documents into sequences of one length.

Only piece lengths matter to the packing, and there are at most ``capacity`` of them, so the packing itself works
on the histogram of lengths: its result is a short list of patterns (which lengths share a sequence, and how many
sequences look like that). Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from tideline.llm.bpe import SAFE
from tideline.llm.common import materialise, narrow, only, slices, text_bytes

#: Words whose ids a worker remembers in each of two generations, and characters of such a word at most.
MEMO, SHORT = 400_000, 64

#: Pieces of one length that are ranked together, on average.
RANKED = 50_000


#: White space followed by a blank: there the blank is no cut.
RUN = re.compile(r"\s ")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps the cores busy
    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True  # their strings in a text are ordinary text
    return loaded


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


LETTERS = byte_letters()


@functools.lru_cache(maxsize=2)
def merges(path: str):
    return tokenizer(path).model


def part_ids(part: str, path: str) -> bytes:
    """Ids of a short text; letters after at most one blank are one pre-token, which its merges take directly."""
    if not part.removeprefix(" ").isalpha():
        ids = tokenizer(path).encode(part, add_special_tokens=False).ids
    elif part.isascii():
        ids = [t.id for t in merges(path).tokenize(part.replace(" ", LETTERS[32]))]
    else:
        ids = [t.id for t in merges(path).tokenize("".join([LETTERS[b] for b in part.encode()]))]
    return struct.pack(f"<{len(ids)}I", *ids)


#: Letters at the start of a word (and a few signs that ``isalpha`` tells apart).
RUN_OF_LETTERS = re.compile(r"[^\W\d_]+")


class Memo(dict):
    """Ids of words as little-endian unsigned 32-bit numbers, each word after ``prefix``.

    Byte-level pre-tokens never hold white space after another character, and end where a run of letters or digits
    ends; merges never cross such places. So words are looked up apart from each other, new ones in such
    parts, and only parts not seen lately go through the tokenizer. When it is full, the younger generation takes
    the place of the older one.
    """

    def __init__(self, path: str, prefix: str):
        super().__init__()
        self.path, self.prefix, self.old = path, prefix, {}

    def cut(self, word: str) -> int:
        """A safe place in the word; 0 for none."""
        if word.isalpha():
            return 0
        start = RUN_OF_LETTERS.match(word)
        if start and start.group().isalpha():
            return start.end()
        found = SAFE.search(self.prefix + word, len(self.prefix) + 1)
        return found.start() - len(self.prefix) if found else 0

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            cut = self.cut(word) if len(word) <= SHORT else 0
            if cut:
                ids = self[word[:cut]] + memo_of(self.path, "")[word[cut:]]
            else:
                ids = part_ids(self.prefix + word, self.path)
        if len(word) <= SHORT:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(maxsize=4)
def memo_of(path: str, prefix: str) -> Memo:
    return Memo(path, prefix)


#: White space followed by a blank: there the blank is no cut.
RUN = re.compile(r"\s ")


def encode_text(text: str, path: str) -> bytes:
    """Ids of a text, equal to encoding it as a whole."""
    first, *rest = text.split(" ")
    plain, after_blank = memo_of(path, ""), memo_of(path, " ")
    if first and not RUN.search(text):
        return plain[first] + b"".join(map(after_blank.__getitem__, rest))
    words, glued = [first], not first or first[-1].isspace()
    for word in rest:
        if glued:
            words[-1] += " " + word
        else:
            words.append(" " + word)
        glued = not word or word[-1].isspace()
    return b"".join(map(plain.__getitem__, words))


def cut(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokenizes whole texts, ends each with ``end_id`` and cuts those above ``capacity`` tokens into pieces.

    Returns doc_id, piece (from 0), start (tokens of the document before it), length, ids (binary: little-endian
    unsigned 32-bit). Later pieces are full; the first one may be shorter. A NULL or empty text is the end token
    alone. Repeated rows give their pieces again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in slices(batches, "text"):
            texts = [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            source, piece, start, ids = [], [], [], []
            for row, found in enumerate(encode_text(t, tokenizer_path) for t in texts):
                found += end
                first = len(found) % width or width
                edges = [0, *range(first, len(found) + 1, width)]
                source += [row] * (len(edges) - 1)
                piece += range(len(edges) - 1)
                start += [e // 4 for e in edges[:-1]]
                ids += [found[a:b] for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(source, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    rows = narrow(only(docs, doc_id=doc_id, text=text))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", text_bytes().alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids binary"
    )


Pattern = tuple[tuple[int, ...], int]  # lengths in a sequence, sequences like that


def dominating(counts: Counter, capacity: int) -> list[Pattern]:
    """Martello-Toth reduction: fixes sets that are part of some optimal packing; lowers ``counts``.

    From the longest item down, the set that holds item j is fixed if it dominates every other set with j:
    j alone if nothing fits beside it; j and the longest item that fits, if they fill the sequence or if no two
    items fit beside j together; or if two fit at most and the best pair is no longer than that single item.
    """
    fixed: list[Pattern] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        counts.subtract({length: n * times for length, n in Counter(lengths).items()})
        for length in lengths:
            if not counts[length]:
                counts.pop(length, None)

    def smallest(n: int, without: int) -> int:
        """Sum of the n smallest items when one item of length ``without`` is set apart; capacity + 1 if too few."""
        total = 0
        for length in sorted(counts):
            m = min(n, counts[length] - (length == without))
            total, n = total + m * length, n - m
            if not n:
                return total
        return capacity + 1

    def best_pair(room: int, without: int) -> int:
        """The largest sum of two items up to ``room``, one item of length ``without`` set apart."""
        lengths = sorted(x for x in counts if counts[x] > (x == without))
        low, high, best = 0, len(lengths) - 1, 0
        while low <= high:
            a, b = lengths[low], lengths[high]
            if a + b > room or low == high and counts[a] - (a == without) < 2:
                high -= 1
            else:
                best = max(best, a + b)
                low += 1
        return best

    for j in sorted(counts, reverse=True):
        while counts.get(j):
            room = capacity - j
            beside = max((x for x in counts if x <= room and (x != j or counts[j] > 1)), default=0)
            if not beside:
                take((j,), counts[j])
                continue
            if not (
                beside == room
                or smallest(2, j) > room
                or smallest(3, j) > room and best_pair(room, j) <= beside
            ):
                break
            # It goes on holding as items leave, until one of the two lengths is used up.
            times = counts[j] // 2 if beside == j else min(counts[j], counts[beside])
            take((j,) * 2 if beside == j else (j, beside), times)
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: a length goes to the fullest sequences that have room for it.

    Sequences that look the same are one entry with their number; each length splits at most one entry for
    each pass, so entries are bounded by the number of lengths, not by the number of items.
    """
    open_: dict[int, list[Pattern]] = {}  # by room left

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if times:
            open_.setdefault(room, []).append((lengths, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, entries in open_.items() if r >= length and entries), default=capacity)
            lengths, times = open_[room].pop() if open_.get(room) else ((), left)
            each = room // length
            full = min(times, left // each)
            put(room - each * length, lengths + (length,) * each, full)
            left -= full * each
            if left and full < times:  # what remains goes into one more
                put(room - left * length, lengths + (length,) * left, 1)
                left, full = 0, full + 1
            if lengths:
                put(room, lengths, times - full)
    return [entry for entries in open_.values() for entry in entries]


def patterns(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Reduction, then best fit for what it leaves."""
    rest = Counter({length: n for length, n in counts.items() if n})
    return dominating(rest, capacity) + best_fit(rest, capacity)


def _places(found: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """Per length, which ranks go where: (length, first rank, last rank + 1, copies a sequence, first sequence, offset)."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in found:
        offset = 0
        for length, copies in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, used[length], used[length] + copies * times, copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Places pieces (any columns, among them ``length``, 1 to ``capacity``) in as few sequences as it can.

    Adds sequence_id and offset (gapless from 0 in each sequence). Full pieces have a sequence of their own. The
    histogram of the other lengths is all that reaches the driver, the table of places (bounded by
    ``capacity``, not by the data) all that is broadcast. Pieces of one length are ranked in hash buckets, so a
    length that most pieces have is ranked by many tasks. Equal rows take different places. ``pieces`` is written
    to the shared folder, so give it the columns that the result needs. No rows give no rows.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    keyed = pieces.select(*names, F.xxhash64(*names).alias("_hash"))
    stage = materialise(keyed, "pieces")
    histogram = {r.length: r.n for r in stage.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    buckets = max(1, -(-max([full, *histogram.values()]) // RANKED)) if histogram or full else 1

    bucketed = stage.withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
        .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("length", "_bucket").orderBy("_hash", *(c for c in names if c not in ("length", "ids")))
    ranked = (
        bucketed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_row"))
    )
    found = patterns(histogram, capacity)
    rows = _places([((capacity,), full)] * bool(full) + found)
    places = spark.createDataFrame(rows, "_length long, _from long, _to long, _copies long, _first long, _base long")
    rank = F.col("_rank") - F.col("_from")
    return (
        ranked.join(
            F.broadcast(places),
            (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
        )
        .select(
            *(F.col(f"`{c}`") for c in names),
            (F.col("_first") + F.floor(rank / F.col("_copies"))).cast("long").alias("sequence_id"),
            (F.col("_base") + F.pmod(rank, F.col("_copies")) * F.col("length")).cast("long").alias("offset"),
        )
    )


def packed_digests(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with the CRC-32 of their ids, their sequence and their place in it."""
    pieces = cut(docs, tokenizer_path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, capacity)
