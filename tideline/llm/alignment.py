"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens are linked in a corpus.

Tokens are intervals of bytes. All intervals of a batch of texts are sorted by start, a running maximum of their
ends shows where both tokenizers begin anew, and that cuts the tokens into groups. Within a group, tokens that
overlap are paired; two that end together are linked, which happens once in each group.

Links are counted over the corpus in blocks: the texts of a block name their different pairs once, the pairs are
summed up by hash, and each block is told the sums of its own pairs.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import materialise, narrow, only, slices, text_bytes
from tideline.llm.packing import LETTERS, merges, part_ids, tokenizer

#: Bytes of text in a block, whose texts ask for the counts of their pairs together; one text may be longer.
BLOCK = 8 << 20

#: Units whose alignment a worker remembers, and characters of such a unit at most.
MEMO, SHORT = 300_000, 64

SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

MARK = "▁"  # stands for a blank in pieces

#: Texts are cut into units before blanks and line ends that follow something else than white space. Byte-level
#: pre-tokens hold no white space after another character, and no piece holds a blank or line end there.
UNIT = re.compile(r"\s*+(?:\S++(?:[^\S \n]\s*+)?+)+|\s+")
#: White space before a blank or line end: there is no cut between the two.
TOGETHER = re.compile(r"\s[ \n]")


@functools.lru_cache(maxsize=2)
def pieces_model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    coder = tokenizer(path)
    value = {letter: byte for byte, letter in enumerate(LETTERS)}
    names = [coder.id_to_token(i) or "" for i in range(coder.get_vocab_size())]
    return [bytes(value[c] for c in name) if all(c in value for c in name) else name.encode() for name in names]


def piece_tokens(path: str) -> list[bytes]:
    """Bytes of each piece; a byte piece is its byte, control pieces have none."""
    model = pieces_model(path)
    out = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(name[3:5], 16)]))
        else:
            out.append(b"" if model.is_control(i) else name.replace(MARK, " ").encode())
    return out


def check_pieces(path: str) -> None:
    """Raises if a piece holds a blank or line end after another character, so that units cannot be encoded apart."""
    model = pieces_model(path)
    if any(re.search(f"[^\\s{MARK}][\n{MARK}]", model.id_to_piece(i)) for i in range(model.get_piece_size())):
        raise ValueError(f"{path} has pieces that go on after a blank")


def keys_of(text: str) -> list[str | bytes]:
    """The units of a blank and the text, as keys: what follows a blank, or NUL and what follows a line end.

    Where white space stands together, or a text holds NUL, a key is the whole unit in UTF-8.
    """
    if TOGETHER.search(" " + text) or "\0" in text:
        return [unit.encode() for unit in UNIT.findall(" " + text)]
    return text.replace("\n", " \0").split(" ")


def unit_of(key: str | bytes) -> str:
    if isinstance(key, bytes):
        return key.decode()
    return "\n" + key[1:] if key.startswith("\0") else " " + key


@functools.lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    a, b = byte_level_tokens(a_path), piece_tokens(b_path)
    return a, b, np.array([len(t) for t in a]), np.array([len(t) for t in b])


def ids_a(unit: str, path: str) -> bytes:
    """Ids of the byte-level tokenizer for a unit; letters and then signs (no apostrophe) are a pre-token each."""
    word = unit.rstrip(SIGNS)
    if len(word) == len(unit) or not word.removeprefix(" ").isalpha():
        return part_ids(unit, path)
    ids = [t.id for t in merges(path).tokenize(unit[len(word) :])]
    return part_ids(word, path) + struct.pack(f"<{len(ids)}I", *ids)


def ids_b(units: list[str], path: str) -> list[list[int]]:
    """Ids of the piece tokenizer for units, which puts a blank before each text but not before nothing."""
    model = pieces_model(path)
    out = model.encode([unit[1:] if unit[0] == " " else unit for unit in units], num_threads=1)
    for i, unit in enumerate(units):
        if unit == " ":
            out[i] = [model.piece_to_id(MARK)]
        elif unit[0] != " ":
            out[i] = out[i][1:]
    return out


class Tokens:
    """Ids of both tokenizers for units, one after the other; a unit that its ids do not spell has none and is ``bad``."""

    def __init__(self, units: list[str], a_path: str, b_path: str):
        names_a, names_b, width_a, width_b = vocabularies(a_path, b_path)
        a, b, raw = [ids_a(unit, a_path) for unit in units], ids_b(units, b_path), [unit.encode() for unit in units]
        self.bad = np.zeros(len(units), bool)
        self.pack(a, b)
        spells = True
        for ids, sizes, names, width in ((self.a, self.sizes_a, names_a, width_a), (self.b, self.sizes_b, names_b, width_b)):
            ends = np.concatenate([[0], np.cumsum(width[ids])])[np.cumsum(sizes)]
            spells &= np.array_equal(ends, np.cumsum([len(r) for r in raw]))
            spells = spells and b"".join(map(names.__getitem__, ids.tolist())) == b"".join(raw)
        if not spells:
            for i, whole in enumerate(raw):
                found_a, found_b = np.frombuffer(a[i], "<u4").tolist(), b[i]
                if b"".join(names_a[x] for x in found_a) != whole or b"".join(names_b[x] for x in found_b) != whole:
                    a[i], b[i], self.bad[i] = b"", [], True
            self.pack(a, b)

    def pack(self, a: list[bytes], b: list[list[int]]) -> None:
        self.a, self.sizes_a = np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.array([len(x) // 4 for x in a], np.int64)
        self.b, self.sizes_b = np.fromiter(chain.from_iterable(b), np.int64), np.array([len(x) for x in b], np.int64)


def readable(raw: bytes | None) -> str:
    """A text; '' if it is NULL or broken UTF-8."""
    try:
        return (raw or b"").decode()
    except UnicodeDecodeError:
        return ""


def text_tokens(texts: list[bytes | None], a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids A, how many each text has, ids B, how many; none for texts whose ids do not spell a blank and the text."""
    a, n_a, b, n_b = [], [], [], []
    for text in map(readable, texts):
        found = Tokens([unit_of(key) for key in keys_of(text)] if text else [], a_path, b_path)
        whole = not found.bad.any()
        a.append(found.a[: len(found.a) * whole])
        b.append(found.b[: len(found.b) * whole])
        n_a.append(len(a[-1]))
        n_b.append(len(b[-1]))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *a]), np.array(n_a, np.int64), np.concatenate([empty, *b]), np.array(n_b, np.int64)


def groups_of(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number (from 0, in byte order) of each A and of each B token."""
    starts, ends = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    side = np.repeat([0, 1], [len(start_a), len(start_b)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(start_a)], group[len(start_a) :]


def overlaps_of(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of tokens that share a byte, as places among A and B, and whether they end together.

    Both cover the same bytes without gaps, so each stretch between neighbouring ends of either is one pair;
    there are fewer pairs than tokens.
    """
    ends = np.union1d(end_a, end_b)
    a, b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    return a, b, end_a[a] == end_b[b]


class Aligned:
    """Tokens, groups and overlaps of some texts (or units of texts), over one line of bytes."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, a_path: str, b_path: str):
        _, _, width_a, width_b = vocabularies(a_path, b_path)
        self.a, self.b = a, b
        self.edges_a, self.edges_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        end_a, end_b = np.cumsum(width_a[self.a]), np.cumsum(width_b[self.b])
        self.group_a, self.group_b = groups_of(end_a - width_a[self.a], end_a, end_b - width_b[self.b], end_b)
        self.over_a, self.over_b, self.together = overlaps_of(end_a, end_b)
        last = np.flatnonzero(self.together)
        self.link_a, self.link_b = self.over_a[last], self.over_b[last]
        #: Links and groups before each text; a text's last tokens end together, so no link leaves it.
        self.edges_link = np.searchsorted(self.link_a, self.edges_a)
        count = np.append(self.group_a, self.group_a[-1] + 1 if len(self.group_a) else 0)
        self.edges_group = count[self.edges_a]

    def spelled(self) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3;``."""
        size_a, size_b = len(self.a), len(self.b)
        end_a = np.append(self.group_a[1:] != self.group_a[:-1], True)[:size_a]
        end_b = np.append(self.group_b[1:] != self.group_b[:-1], True)[:size_b]
        order = np.lexsort((np.repeat([0, 1], [size_a, size_b]), np.concatenate([self.group_a, self.group_b])))
        ids = np.concatenate([self.a, self.b])[order].tolist()
        signs = np.concatenate([np.where(end_a, ord("|"), ord(",")), np.where(end_b, ord(";"), ord(","))])[order]
        words = [f"{i}{s}" for i, s in zip(ids, signs.astype(np.uint8).tobytes().decode())]
        edges = (self.edges_a + self.edges_b).tolist()
        return ["".join(words[start:end]).encode() for start, end in zip(edges, edges[1:])]


#: A unit's alignment: its groups spelled, numbers of A and B tokens and of groups, its linked pairs (64 bit each).
Unit = tuple[bytes, int, int, int, bytes]
NOTHING: Unit = (b"", 0, 0, 0, b"")


def aligned_units(keys: list[str | bytes], a_path: str, b_path: str) -> list[Unit | None]:
    """The alignment of each unit; None where ids do not spell it. Both tokenizers begin anew at every unit."""
    tokens = Tokens([unit_of(key) for key in keys], a_path, b_path)
    found = Aligned(tokens.a, tokens.sizes_a, tokens.b, tokens.sizes_b, a_path, b_path)
    pairs = (found.a[found.link_a] * PAIR + found.b[found.link_b]).tobytes()
    links = (8 * found.edges_link).tolist()
    out = list(zip(
        found.spelled(), tokens.sizes_a.tolist(), tokens.sizes_b.tolist(), np.diff(found.edges_group).tolist(),
        [pairs[start:end] for start, end in zip(links, links[1:])],
    ))
    for i in np.flatnonzero(tokens.bad).tolist():
        out[i] = None
    return out


class Units(dict):
    """Alignments of units that a worker has met lately; when it is full, the younger half takes the older one's place."""

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        check_pieces(b_path)
        self.paths, self.old = (a_path, b_path), {}

    def of(self, keys: list[str | bytes]) -> list[Unit | None]:
        """The alignments of different units, those not remembered made together."""
        out = [self.get(key, self) for key in keys]
        out = [self.old.get(key, self) if unit is self else unit for key, unit in zip(keys, out)]
        missing = [i for i, unit in enumerate(out) if unit is self]
        for start in range(0, len(missing), 50_000):
            places = missing[start : start + 50_000]
            for i, unit in zip(places, aligned_units([keys[i] for i in places], *self.paths)):
                out[i] = unit
        for key, unit in zip(keys, out):
            if len(key) <= SHORT:
                if len(self) >= MEMO:
                    self.old = dict(self)
                    self.clear()
                self[key] = unit
        return out


@functools.lru_cache(maxsize=2)
def units_of(a_path: str, b_path: str) -> Units:
    return Units(a_path, b_path)


def _lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, kind))


def alignments(
    docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Both tokenizers' ids of every whole text, and how they are aligned.

    Returns doc_id, ``a`` and ``b`` (ids), ``group_a`` and ``group_b`` (group of each token, from 0 in each text),
    ``over_a``, ``over_b`` and ``together`` (places of tokens that share a byte, and whether they end together: a
    link), one row per input row. ``a_path`` is a byte-level vocabulary, which sees a blank before the text;
    ``b_path`` a piece vocabulary, which puts one there. Special tokens are not added, and their strings in a text
    are ordinary text. Texts that are NULL or empty, or whose ids do not spell a blank and the text (one that
    holds the mark for blanks, or broken UTF-8), have no tokens: empty arrays. Repeated rows give equal rows;
    further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = Aligned(*text_tokens(batch.column("text").to_pylist(), a_path, b_path), a_path, b_path)
            sizes_a, sizes_b = np.diff(found.edges_a), np.diff(found.edges_b)
            edges = np.searchsorted(found.over_a, found.edges_a)
            over = np.diff(edges)
            columns = {
                "doc_id": batch.column("doc_id"),
                "a": _lists(found.a, found.edges_a, pa.int32()),
                "b": _lists(found.b, found.edges_b, pa.int32()),
                "group_a": _lists(found.group_a - np.repeat(found.edges_group[:-1], sizes_a), found.edges_a, pa.int32()),
                "group_b": _lists(found.group_b - np.repeat(found.edges_group[:-1], sizes_b), found.edges_b, pa.int32()),
                "over_a": _lists(found.over_a - np.repeat(found.edges_a[:-1], over), edges, pa.int32()),
                "over_b": _lists(found.over_b - np.repeat(found.edges_b[:-1], over), edges, pa.int32()),
                "together": _lists(found.together, edges, pa.bool_()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows = narrow(only(docs, doc_id=doc_id, text=text))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", text_bytes().alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, a array<int>, b array<int>, group_a array<int>, group_b array<int>, over_a array<int>, "
        "over_b array<int>, together array<boolean>",
    )


PAIR = 1 << 32  # a pair of ids is one number, the A id times this and the B id


class Block:
    """Texts, their different units, and the different pairs of these."""

    def __init__(self, texts: list[bytes | None], a_path: str, b_path: str):
        index: dict[str | bytes, int] = {}
        words = []
        for raw in texts:
            text = readable(raw)
            words.append(np.array([index.setdefault(key, len(index)) for key in keys_of(text)] if text else [], np.int32))
        units = units_of(a_path, b_path).of(list(index))
        bad = np.array([unit is None for unit in units], bool)
        #: Places of each text's units; none where one of them has no tokens.
        self.words = [np.empty(0, np.int32) if bad[w].any() else w for w in words] if bad.any() else words
        spelled, n_a, n_b, n_groups, pairs = zip(NOTHING, *(unit or NOTHING for unit in units))  # the first is nobody's
        self.digests = [
            hashlib.sha256(b"".join([spelled[i + 1] for i in w.tolist()])[:-1]).hexdigest() if len(w) else "" for w in self.words
        ]
        n_links = [len(p) // 8 for p in pairs]
        sizes = np.array([n_a, n_b, n_groups, n_links], np.int64)[:, 1:]
        every = np.concatenate([np.empty(0, np.int32), *self.words])
        ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(sizes[:, every], axis=1)], axis=1)[:, ends]
        self.figures = np.diff(sums, axis=1, prepend=0)  # n_a, n_b, n_groups and n_links of each text
        times = np.bincount(every, minlength=len(units))
        self.pairs, self.places = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_inverse=True)
        self.links = sizes[3]  # of each unit, in the order of places
        self.counts = np.zeros(len(self.pairs), np.int64)
        np.add.at(self.counts, self.places, np.repeat(times, self.links))


@functools.lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte by byte of all of them, compressed: most of the higher bytes are zero."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return _codec()[0].compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_codec()[1].decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of texts (with the places of their units) and one row per block: its pairs with counts, where its units have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BLOCK):
            made = Block(batch.column("text").to_pylist(), a_path, b_path)
            rows, doc_id = batch.num_rows, batch.column("doc_id")
            figures = {
                name: pa.concat_arrays([pa.array(made.figures[i]), pa.nulls(1, pa.int64())])
                for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))
            }
            columns = {
                "block": pa.array(np.full(rows + 1, number)),
                "doc_id": pa.concat_arrays([doc_id, pa.nulls(1, doc_id.type)]),
                **figures,
                "groups_sha256": pa.array([*made.digests, None], pa.string()),
                "words": pa.array([*map(packed, made.words), None], pa.binary()),
                "places": pa.array([None] * rows + [packed(made.places)], pa.binary()),
                "links": pa.array([None] * rows + [packed(made.links)], pa.binary()),
                "pairs": pa.concat_arrays([pa.nulls(rows, pa.list_(pa.int64())), _lists(made.pairs, np.array([0, len(made.pairs)]), pa.int64())]),
                "counts": pa.concat_arrays([pa.nulls(rows, pa.list_(pa.int64())), _lists(made.counts, np.array([0, len(made.pairs)]), pa.int64())]),
            }
            yield pa.RecordBatch.from_pydict(columns)
            number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, "
        "places binary, links binary, pairs array<long>, counts array<long>",
    )


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count (links corpus-wide) and best (whether no A id is linked more often to its B id)."""
    asked = blocks.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counts = asked.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    b_id = F.col("pair").bitwiseAND(PAIR - 1)
    highest = counts.groupBy(b_id.alias("_b")).agg(F.max("count").alias("_highest"))
    joined = counts.withColumn("_b", b_id).join(F.broadcast(highest), "_b")  # at most the piece vocabulary
    return joined.select("pair", "count", (F.col("count") == F.col("_highest")).alias("best"))


def link_statistics(
    docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Alignment of every whole text in figures, measured by how often its links occur in the corpus.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair of ids is as frequent as any of its B id,
    ties included), count_sum (corpus-wide counts of its links, added up), groups_sha256 (of the groups spelled
    as ``a1,a2|b1;a3|b2,b3``; '' without tokens), one row per input row. What gives no tokens is said at
    ``alignments``: its figures are 0. Links and pairs are written to the shared folder; a block of texts sends each
    of its pairs once, so a pair that every text holds is no hot key. No rows give no rows.
    """
    rows = narrow(only(docs, doc_id=doc_id, text=text)).select("doc_id", text_bytes().alias("text"))
    blocks = materialise(_blocks(rows, a_path, b_path), "alignment")
    counts = materialise(pair_counts(blocks), "pair-counts")
    asked = blocks.where(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").select(F.col("block").alias("asking"), "place", "count", "best")
    texts_and_blocks = blocks.drop("pairs", "counts")

    def add_up(key, asked: pa.Table, told: pa.Table) -> pa.Table:
        block = asked.filter(pc.is_null(asked.column("words")))
        texts = asked.filter(pc.is_valid(asked.column("words")))
        place = told.column("place").to_numpy()
        places, links = (unpacked(block.column(c)[0].as_py()) for c in ("places", "links"))
        owners, words, sums = np.repeat(np.arange(len(links)), links), [unpacked(w) for w in texts.column("words").to_pylist()], []
        for name in ("best", "count"):
            of_pair = np.zeros(len(place), np.int64)
            of_pair[place] = told.column(name).to_numpy()
            of_unit = np.zeros(len(links), np.int64)
            np.add.at(of_unit, owners, of_pair[places])
            sums.append([int(of_unit[w].sum()) for w in words])
        return pa.table(
            {
                **{c: texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                "n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64()),
                "groups_sha256": texts.column("groups_sha256"),
            }
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return texts_and_blocks.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(
        add_up,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
