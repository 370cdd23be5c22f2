"""Byte-level BPE and packing against the libraries and against exhaustive search."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tideline.llm import bpe, packing

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
HARD = ["", " ", "  a  b \n c", "<|endoftext|> x  y", "a\x1c b", "tab\t x  　 z", "don't 'street' 12ab  ", "\n\n x\n  ",
        "a" * 3000, "ab1 " * 500, "'s" * 800, "!'s" * 700, " " * 900 + "x", "語" * 700, "x1" * 900, "é  é" * 50, "\U0001f600́ x"]


def test_parts_do_not_change_ids():
    coder = bpe.encoding(RANKS, P.PATTERN)
    assert isinstance(coder, tiktoken.Encoding)
    for text in HARD:
        ids = bpe.encode_text(text, coder, size=13)
        assert ids.tolist() == coder.encode_ordinary(text)
        assert bpe.decode_ids(ids, coder) == text.encode()


def test_words_do_not_change_ids():
    whole = Tokenizer.from_file(JSON)
    whole.encode_special_tokens = True
    for text in HARD:
        want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.encode_text(text, JSON) == want
        assert packing.encode_text(text, JSON) == want  # remembered


def test_memory_of_words_turns_over(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 3)
    packing.memo_of.cache_clear()
    whole = Tokenizer.from_file(JSON)
    text = " ".join(f"word{i % 7} thing{i % 5}, x" for i in range(60))
    assert np.frombuffer(packing.encode_text(text, JSON), "<u4").tolist() == whole.encode(text).ids
    assert len(packing.memo_of(JSON, " ")) <= 3
    packing.memo_of.cache_clear()


def test_digests(documents, no_documents):
    got = bpe.digests(bpe.round_trip(documents, RANKS, P.PATTERN))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    coder = bpe.encoding(RANKS, P.PATTERN)
    want = []
    for row in documents.collect():
        ids = coder.encode_ordinary(row.text or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (row.text or "").encode())]
        want.append((row.doc_id, len(ids), *sha))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert bpe.digests(bpe.round_trip(no_documents, RANKS, P.PATTERN)).count() == 0


def bins(found):
    return sum(times for _, times in found)


def smallest_packing(items, capacity):
    """Fewest bins by search over all ways (few items)."""
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= items[i]:
                place(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - items[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_is_part_of_an_optimal_packing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 50])
    items = sorted((rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 10))), reverse=True)
    rest = Counter(items)
    fixed = packing.dominating(rest, capacity)
    left = sorted(rest.elements(), reverse=True)
    assert bins(fixed) + smallest_packing(left, capacity) == smallest_packing(items, capacity)
    found = packing.patterns(Counter(items), capacity)
    assert Counter({x: 0 for x in items}) + sum((Counter({x: n * t for x, n in Counter(p).items()}) for p, t in found), Counter()) == Counter(items)
    assert all(sum(p) <= capacity for p, _ in found)


def test_patterns_do_not_grow_with_the_items():
    counts = {n: 1 + (n * 7919) % 1000 for n in range(1, 1024)}
    few, many = (packing.patterns({k: v * f for k, v in counts.items()}, 1024) for f in (1, 1000))
    assert len(few) < 4 * 1024 and len(many) < 4 * 1024
    total = sum(k * v for k, v in counts.items())
    assert bins(many) <= 1.01 * 1000 * total / 1024


def check_packed(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_pack(documents, no_documents):
    rows = packing.packed_digests(documents, JSON, 64).collect()
    check_packed(rows, 64)
    whole = Tokenizer.from_file(JSON)
    whole.encode_special_tokens = True
    want = []
    for d in documents.collect():
        ids = whole.encode(d.text or "", add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert packing.packed_digests(no_documents, JSON).count() == 0


def test_pack_ranks_a_frequent_length_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    pieces = spark.range(3000).selectExpr("id doc_id", "cast(if(id % 3 = 0, id % 9 + 1, 7) as bigint) length")
    rows = packing.pack(pieces, 10).collect()
    assert len(rows) == 3000
    total = sum(r.length for r in rows)
    assert -(-total // 10) <= check_packed(rows, 10) <= 2000 + 1000
