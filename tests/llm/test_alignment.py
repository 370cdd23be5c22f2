"""Alignment of two tokenizers: against the libraries on whole texts and plain loops."""

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tideline.llm import alignment
from tideline.llm.alignment import alignments, groups_of, link_statistics, overlaps_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(texts, coders):
    """(a ids, a ends, b ids, b ends) of each text, by whole texts; the bytes of both are spelled out."""
    a_coder, b_coder = coders
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    byte = {chr(b) if b in shown else chr(next(spare)): b for b in range(256)}
    out = []
    for text in texts:
        ids_a = a_coder.encode(" " + (text or ""), add_special_tokens=False).ids
        names_a = [bytes(byte[c] for c in a_coder.id_to_token(i)) for i in ids_a]
        ids_b = b_coder.encode(text or "")
        names_b = []
        for i in ids_b:
            name = b_coder.id_to_piece(i)
            names_b.append(bytes([int(name[3:5], 16)]) if b_coder.is_byte(i) else name.replace("▁", " ").encode())
        whole = (" " + (text or "")).encode()
        if not text or b"".join(names_a) != whole or b"".join(names_b) != whole:
            out.append(([], [], [], []))
            continue
        out.append((ids_a, np.cumsum([len(n) for n in names_a]).tolist(), ids_b, np.cumsum([len(n) for n in names_b]).tolist()))
    return out


def expected(rows, coders):
    tokens = plain([t for _, t in rows], coders)
    links = []
    for a, ea, b, eb in tokens:
        at_a, at_b = dict(zip(ea, a)), dict(zip(eb, b))
        links.append([(at_a[e], at_b[e]) for e in ea if e in at_b])
    counts = Counter(pair for found in links for pair in found)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for (doc_id, _), (a, ea, b, eb), found in zip(rows, tokens, links):
        spelled, before = [], 0
        for e in sorted(set(ea) & set(eb)):
            inside = [[str(i) for i in ids[bisect_right(ends, before) : bisect_right(ends, e)]] for ids, ends in ((a, ea), (b, eb))]
            spelled.append("|".join(map(",".join, inside)))
            before = e
        digest = hashlib.sha256(";".join(spelled).encode()).hexdigest() if spelled else ""
        out.append((doc_id, len(a), len(b), len(spelled), len(found), sum(counts[p] == highest[p[1]] for p in found),
                    sum(counts[p] for p in found), digest))
    return out


EDGES = [None, "", " ", "   ", "a", " a", "a ", "a  b", "  a   b    ", "\n", "a\n b\n\n  c\t d", "don't we'll I'm", "语言 模型 语", "a▁b",
         "▁", "<s> </s> <unk> <|endoftext|> <0x41>", "x y　z", "é é ﬁ", "\U0001f600 \U0001f468‍\U0001f469", "\x00\x01\x7f",
         "12345 6789 3.14", "def f(x):\n        return x\n", "a" * 300, " " * 50 + "end", "\r\n\r\n", "Ünïcödé straße",
         "line.\nNext line\nlast", "a\n\nb;\r\nc", "a \0b", "x\0\ny", "tab\tinside it", "\nstart", " \n start"]


def test_equals_whole_texts(spark, coders, prose):
    rows = list(enumerate(EDGES)) + [(100 + i, prose(i, 80)) for i in range(30)] + [(7, "a  b"), (None, "one two"), (200, prose(1, 20_000))]
    rows += [(101, prose(1, 80))] * 2
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = sorted((tuple(r) for r in link_statistics(df, A, B).select(*COLUMNS).collect()), key=repr)
    assert got == sorted(expected(rows, coders), key=repr)


def test_blocks_do_not_matter(spark, coders, prose, monkeypatch):
    rows = [(i, prose(i, 40)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(alignment, "BLOCK", 500)
    got = sorted(tuple(r) for r in link_statistics(df, A, B).select(*COLUMNS).collect())
    assert got == sorted(expected(rows, coders))


def test_alignments_name_tokens_groups_and_overlaps(spark, coders, prose):
    rows = list(enumerate(EDGES + [prose(3, 50)]))
    got = {r.doc_id: r for r in alignments(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    for (i, _), (a, ea, b, eb) in zip(rows, plain([t for _, t in rows], coders)):
        r = got[i]
        assert (r.a, r.b) == (a, b)
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        pairs = [(x, y, ea[x] == eb[y]) for x in range(len(a)) for y in range(len(b)) if sa[x] < eb[y] and sb[y] < ea[x]]
        assert sorted(zip(r.over_a, r.over_b, r.together)) == pairs
        both = sorted(set(ea) & set(eb))
        assert r.group_a == [int(np.searchsorted(both, e)) for e in ea] and r.group_b == [int(np.searchsorted(both, e)) for e in eb]


def test_broken_bytes_have_no_tokens(spark):
    df = spark.range(1).selectExpr("id AS doc_id", "CAST(X'61FF62' AS STRING) AS text")
    assert [tuple(r)[1:] for r in link_statistics(df, A, B).select(*COLUMNS).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert link_statistics(df, A, B).count() == 0 and alignments(df, A, B).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab1. \n\t\r\0\x1c\xa0\u3000▁é'!")), max_size=12))
def test_units_are_encoded_apart(coders, text):
    keys = alignment.keys_of(text)
    assert "".join(map(alignment.unit_of, keys)) == " " + text
    a, _, b, _ = plain([text], coders)[0]
    got = alignment.text_tokens([text.encode()], A, B)
    assert got[0].tolist() == a and got[2].tolist() == b


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.data())
def test_groups_and_overlaps_of_any_cuts(widths, data):
    total = sum(widths)
    cuts = data.draw(st.sets(st.integers(1, total - 1))) if total > 1 else set()
    end_a, end_b = np.cumsum(widths), np.array(sorted(cuts | {total}))
    start_a, start_b = end_a - widths, np.concatenate([[0], end_b[:-1]])
    group_a, group_b = groups_of(start_a, end_a, start_b, end_b)
    both = np.intersect1d(end_a, end_b)
    assert group_a.tolist() == np.searchsorted(both, end_a).tolist() and group_b.tolist() == np.searchsorted(both, end_b).tolist()
    a, b, together = overlaps_of(end_a, end_b)
    want = [(i, j) for i in range(len(end_a)) for j in range(len(end_b)) if start_a[i] < end_b[j] and start_b[j] < end_a[i]]
    assert list(zip(a.tolist(), b.tolist())) == want and together.sum() == len(both)
