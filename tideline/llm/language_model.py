"""Language-model scores of whole texts by a weighted backoff automaton.

The automaton has a state for each context word and an empty state. A state has an arc for each word seen after its
word, weighted with the smoothed probability, and a failure arc to the empty state, which has an arc for every word.
The model grows with the corpus, so no task holds all of it: documents are gathered into blocks of bounded size, a
block sends its distinct words and word pairs (64-bit hashes, with counts in training texts) to hash ranges, and a
range answers each block with the totals of what it asked for. Each block then builds the part of the
automaton that its own texts can visit. A word or pair is one entry from each block, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.llm.common import fold, materialise, narrow, slices, text_bytes

#: Bytes of text in a block at most (one longer text is a block), and entries in a hash range on average.
BLOCK, RANGE = 8 << 20, 1 << 20

#: Steps an octave in which counts and probabilities travel where only the smoothing weights depend on them.
STEPS = 4

START, END = b" start", b" end"  # no word holds a blank
START_HASH = xxhash.xxh64_intdigest(START)


def words_of(text: bytes) -> list[bytes]:
    """Words without ASCII white space, A-Z in lower case (both as the methods of bytes define them)."""
    return text.lower().split()


def planes(numbers: np.ndarray, kind: str = "<u8") -> bytes:
    """Unsigned numbers as runs of their first, second, ... bytes, compressed: small numbers take little."""
    width = np.dtype(kind).itemsize
    runs = np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(runs.tobytes())


def unplanes(data: bytes, kind: str = "<u8") -> np.ndarray:
    runs = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(runs.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def octaves(values: np.ndarray) -> np.ndarray:
    """Logarithms of counts (at least 1) in whole steps."""
    return np.rint(STEPS * np.log2(np.maximum(values, 1))).astype(np.uint8)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# --- blocks -------------------------------------------------------------------------------------------------------


class Block:
    """Texts of a block as numbers: ``tokens`` index ``hashes`` (the last entry is the start mark)."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, learn: np.ndarray, hashes: np.ndarray):
        self.tokens, self.lengths, self.learn, self.hashes = tokens, lengths, learn, hashes
        self.starts = np.cumsum(lengths) - lengths
        self.learns = np.repeat(learn, lengths)

    @classmethod
    def of_texts(cls, texts: list[bytes], learn: list[bool]) -> "Block":
        index: dict[bytes, int] = {END: 0}
        runs, lengths = [], []
        for text in texts:
            words = words_of(text)
            for word in words:
                if word not in index:
                    index[word] = len(index)
            runs.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
            runs.append(np.zeros(1, np.uint32))
            lengths.append(len(words) + 1)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
        tokens = np.concatenate(runs)
        return cls(tokens, np.array(lengths, np.int64), np.array(learn, bool), np.append(hashes, np.uint64(START_HASH)))

    def before(self) -> np.ndarray:
        """Index of the word before each token."""
        out = np.empty_like(self.tokens)
        out[1:] = self.tokens[:-1]
        out[self.starts] = len(self.hashes) - 1
        return out

    def word_counts(self) -> np.ndarray:
        """Counts in training texts; of the start mark, the number of these texts."""
        counts = np.bincount(self.tokens[self.learns], minlength=len(self.hashes))
        counts[-1] = self.learn.sum()
        return counts

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs in the order of their hashes: hash, first word, second word; and each token's pair."""
        size = np.uint64(len(self.hashes))
        both, which = np.unique(self.before().astype(np.uint64) * size + self.tokens, return_inverse=True)
        first, second = (both // size).astype(np.int64), (both % size).astype(np.int64)
        hashes = pair_hash(self.hashes[first], self.hashes[second])
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return hashes[order], first[order], second[order], place[which]


BLOCKS = "block string, n long, doc_ids {ids}, tokens binary, lengths binary, learn binary, hashes binary"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition gathered into blocks."""
    task, made = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        made_of = Block.of_texts(rows.column("text").to_pylist(), rows.column("learn").to_pylist())
        ids = rows.column("doc_id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{task}-{made}"]), pa.array([len(made_of.tokens)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.array([planes(made_of.tokens, "<u4")], pa.binary()), pa.array([made_of.lengths.tobytes()], pa.binary()),
             pa.array([made_of.learn.tobytes()], pa.binary()), pa.array([made_of.hashes.tobytes()], pa.binary())],
            ["block", "n", "doc_ids", "tokens", "lengths", "learn", "hashes"],
        )

    size = 0
    for part in slices(batches, "text", BLOCK // 4):
        n = part.column("text").nbytes
        if held and size + n > BLOCK:
            yield block()
            held, size, made = [], 0, made + 1
        held.append(part)
        size += n
    if held:
        yield block()


def unpack(row: dict) -> Block:
    return Block(unplanes(row["tokens"], "<u4"), np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["learn"], bool), np.frombuffer(row["hashes"], np.uint64))


# --- exchange with hash ranges ------------------------------------------------------------------------------------


def _cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in sorted hashes, and the end."""
    which = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(which, np.arange(ranges + 1, dtype=np.uint64))


ASKED = "block string, part int, hashes binary, counts binary, context binary, rarity binary"


def _asked(block: str, hashes: np.ndarray, counts: np.ndarray, ranges: int, context=None, rarity=None) -> pa.RecordBatch:
    """What a block asks each range: its sorted hashes (as differences) with its own counts."""
    cuts = _cuts(hashes, ranges)
    rows: dict[str, list] = {n: [] for n in ("block", "part", "hashes", "counts", "context", "rarity")}
    for part in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[part], cuts[part + 1]
        step = np.diff(hashes[a:b], prepend=np.uint64(0))
        own = None if context is None else (context[a:b].tobytes(), rarity[a:b].tobytes())
        for name, value in zip(rows, (block, int(part), planes(step), planes(counts[a:b]), *(own or (None, None)))):
            rows[name].append(value)
    return pa.RecordBatch.from_pydict(rows, schema=ASKED_ARROW)


ASKED_ARROW = pa.schema([("block", pa.string()), ("part", pa.int32()), *((n, pa.binary()) for n in ("hashes", "counts", "context", "rarity"))])

#: Rows with a block answer it; the others carry sums: of the words, and of how well pairs tell the next word.
ANSWERS = "block string, part int, totals binary, name string, slot long, value double"
ANSWERS_ARROW = pa.schema([("block", pa.string()), ("part", pa.int32()), ("totals", pa.binary()), ("name", pa.string()), ("slot", pa.int64()), ("value", pa.float64())])


def _answer(words: bool):
    """For one range: totals back to the blocks, and sums over its distinct entries."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = [np.cumsum(unplanes(r["hashes"]), dtype=np.uint64) for r in rows]
        counts = np.concatenate([unplanes(r["counts"]) for r in rows]).astype(np.float64)
        distinct, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        totals = np.bincount(which, weights=counts, minlength=len(distinct))
        edges = np.cumsum([0, *map(len, hashes)])
        out = [
            {"block": r["block"], "part": r["part"], "totals": planes(totals[which[a:b]]), "name": None, "slot": None, "value": None}
            for r, a, b in zip(rows, edges, edges[1:])
        ]
        seen = totals > 0
        if words:
            seen &= distinct != np.uint64(START_HASH)
            sums = {("distinct", 0): float(seen.sum()), ("tokens", 0): float(totals[seen].sum())}
        else:
            context = np.frombuffer(b"".join(r["context"] for r in rows), np.uint8)[first][seen].astype(np.int64)
            rarity = np.frombuffer(b"".join(r["rarity"] for r in rows), np.uint8)[first][seen].astype(np.int64)
            slots = gain_slots(totals[seen], context, rarity)
            kinds, place = np.unique(slots, return_inverse=True)
            sums = {("gain", int(s)): v for s, v in zip(kinds, np.bincount(place, weights=totals[seen]))}
        part = rows[0]["part"]
        out += [{"block": None, "part": part, "totals": None, "name": n, "slot": s, "value": v} for (n, s), v in sums.items()]
        return pa.Table.from_pylist(out, schema=ANSWERS_ARROW)

    return run


# --- smoothing ----------------------------------------------------------------------------------------------------

#: Ratios from 2 ** -FARTHEST to 2 ** FARTHEST are told apart; the first of a context's slots is for ratio zero.
FARTHEST = 64
RATIOS = 2 * FARTHEST * STEPS + 2


def gain_slots(totals: np.ndarray, context: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Slot of each pair: octave of its context's count, and by which factor the pair, one occurrence left
    out, makes its second word likelier than the word alone."""
    with np.errstate(divide="ignore"):
        left_out = np.log2(np.maximum(totals - 1, 0)) - np.log2(np.maximum(2.0 ** (context / STEPS) - 1, 1))
    ratio = np.where(totals > 1, np.clip(np.rint(STEPS * left_out + rarity), -STEPS * FARTHEST, STEPS * FARTHEST) + STEPS * FARTHEST + 1, 0)
    return (context // STEPS) * RATIOS + ratio.astype(np.int64)


def escapes(gains: dict[int, float]) -> np.ndarray:
    """Per octave of a context's count, the weight of the empty state that makes left-out pairs likeliest."""
    weights = np.full(FARTHEST, 0.5)
    grid = 1 - np.logspace(-6, np.log10(0.999), 400)
    for octave in range(FARTHEST):
        own = {s % RATIOS: n for s, n in gains.items() if s // RATIOS == octave}
        if own:
            slot, n = np.array(list(own)), np.array(list(own.values()))
            ratio = np.where(slot > 0, 2.0 ** ((slot - 1 - STEPS * FARTHEST) / STEPS), 0)
            weights[octave] = grid[np.argmax([(n * np.log((1 - e) * ratio + e)).sum() for e in grid])]
    return weights


class Automaton:
    """States (words before), their arcs (pairs) and failure arcs, with log10 weights, as far as a block needs them."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, first: np.ndarray, second: np.ndarray, tokens: float, distinct: float, escape: np.ndarray):
        rate = (words + 0.5) / (tokens + 0.5 * (distinct + 1))
        self.word = np.log10(rate)  # arcs of the empty state
        self.is_state = words > 0
        weight = escape[np.minimum(octaves(words) // STEPS, FARTHEST - 1)]
        self.fail = np.log10(weight)  # failure arcs
        self.is_arc = pairs > 0
        share = pairs / np.maximum(words[first], 1)
        self.arc = np.log10(np.where(self.is_arc, (1 - weight[first]) * share + weight[first] * rate[second], 1))

    def steps(self, before: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Weight of each step from the state that the word before leads to: its arc, or failure and then the word.

        A state is known by the last word, so all steps of a block are taken at once.
        """
        arc = self.is_arc[pair]
        out = np.where(arc, self.arc[pair], self.word[word])
        failing = ~arc & self.is_state[before]
        out[failing] += self.fail[before[failing]]
        return out


SCORES = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(tokens: float, distinct: float, escape: np.ndarray):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out, totals = [], {}
        for pairs in (False, True):
            own = answers.filter(pc.equal(answers.column("pairs"), pairs)).sort_by("part").column("totals").to_pylist()
            totals[pairs] = np.concatenate([np.empty(0), *map(unplanes, own)]).astype(np.float64)
        for row in blocks.select(["tokens", "lengths", "learn", "hashes"]).to_pylist():  # one
            block = unpack(row)
            counts = np.empty(len(block.hashes))
            counts[np.argsort(block.hashes)] = totals[False]
            _, first, second, pair = block.pairs()
            machine = Automaton(counts, totals[True], first, second, tokens, distinct, escape)
            each = lambda values: np.add.reduceat(values, block.starts)
            known = counts[block.tokens] > 0
            step = machine.steps(block.before(), block.tokens, pair)
            n = np.full(len(block.learn), int(tokens))
            out.append([~block.learn, block.lengths, each(known.astype(np.int64)), n, each(machine.word[block.tokens]), each(step)])
        ids = blocks.column("doc_ids").combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        return pa.Table.from_arrays([ids, *map(pa.array, map(np.concatenate, zip(*out)))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _ask_words(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = unpack(row)
                order = np.argsort(block.hashes)
                yield _asked(row["block"], block.hashes[order], block.word_counts()[order], ranges)

    return run


def _ask_pairs(ranges: int, tokens: float, distinct: float):
    """Pairs of a block, with what the smoothing weights need to know of their words."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        totals = np.concatenate(list(map(unplanes, answers.sort_by("part").column("totals").to_pylist()))).astype(np.float64)
        row = blocks.select(["block", "tokens", "lengths", "learn", "hashes"]).to_pylist()[0]
        block = unpack(row)
        counts = np.empty(len(block.hashes))
        counts[np.argsort(block.hashes)] = totals
        hashes, first, second, pair = block.pairs()
        own = np.bincount(pair[block.learns], minlength=len(hashes))
        rate = (counts + 0.5) / (tokens + 0.5 * (distinct + 1))
        rarity = np.clip(np.rint(-STEPS * np.log2(rate)), 0, 255).astype(np.uint8)
        return pa.Table.from_batches([_asked(row["block"], hashes, own, ranges, octaves(counts)[first], rarity[second])])

    return run


def _totals(spark: SparkSession, answers: DataFrame) -> dict[str, dict[int, float]]:
    out: dict[str, dict[int, float]] = {}
    sums = answers.where(F.col("block").isNull()).groupBy("name", "slot").agg(F.sum("value").alias("value"))
    for row in sums.collect():  # bounded by the number of slots
        out.setdefault(row.name, {})[row.slot] = row.value
    return out


def scores(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """log10 probability of every whole text by a bigram automaton learned from the rows where ``learn`` is true.

    Returns doc_id, held_out (not ``learn``), n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (words alone, additive smoothing by a half) and score. Words have no ASCII white space, with A-Z in lower case; each text ends
    in an end token and is preceded by a start state. A step takes the arc of the state if the pair was seen, with
    (1 - e) * count of pair / count of state + e * rate of the word, else the failure arc (e) and the word's arc.
    The weight e follows the octave of the state's count; it is the value that makes all training pairs likeliest,
    each with one occurrence left out. A NULL text is the empty text. NULL and repeated ids and repeated rows are
    scored row by row; no training rows give rate 1 to every token. Columns other than these and those in ``learn``
    are not read.
    """
    spark = docs.sparkSession
    rows = narrow(docs).select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = materialise(rows.mapInArrow(_gather, BLOCKS.format(ids=f"array<{kind}>")), "text-blocks")
    size = blocks.agg(F.sum("n"), F.sum(F.octet_length("hashes") / 8)).first()
    ranges = [max(1, round((n or 0) / RANGE)) for n in size]

    light = blocks.select("block", "tokens", "lengths", "learn", "hashes")
    answered = light.mapInArrow(_ask_words(ranges[1]), ASKED).groupBy("part").applyInArrow(_answer(True), ANSWERS)
    words = materialise(answered, "word-answers")
    found = _totals(spark, words)
    tokens, distinct = (found.get(n, {}).get(0, 0.0) for n in ("tokens", "distinct"))

    word_answers = words.where(F.col("block").isNotNull()).select("block", "part", "totals", F.lit(False).alias("pairs"))
    asked = light.groupBy("block").cogroup(word_answers.drop("pairs").groupBy("block")).applyInArrow(
        _ask_pairs(ranges[0], tokens, distinct), ASKED
    )
    pairs = materialise(asked.groupBy("part").applyInArrow(_answer(False), ANSWERS), "pair-answers")
    escape = escapes(_totals(spark, pairs).get("gain", {}))

    answers = word_answers.unionByName(
        pairs.where(F.col("block").isNotNull()).select("block", "part", "totals", F.lit(True).alias("pairs"))
    )
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(tokens, distinct, escape), SCORES.format(id=kind)
    )


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores with every fifth document (by the crc32 of its id) held out of the training."""
    return scores(docs, fold("doc_id", 5) != 1)
