"""Fill-in-middle: against a plain version, and back again."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tideline.llm.fill_in_middle import Middle, digests, fill_in_middle, named_by, restore

SCHEMA = "doc_id long, text string, form string, pieces string"


def expected(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = ["".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return n, "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


@pytest.fixture(scope="module")
def lined(spark, prose):
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "a\r\nb\r\n", "é\n語\n😀 x\n\n", "<", "<\n<P", "P>\n<", "S>M>\n>", "x <P> y\n",
             "a\n<M>", " line\x0b\x0c\n", "\n".join(prose(i, 7) for i in range(3000)), "word " * 60_000]
    rows = [(i * 13 + k, t, "f", "p") for i, t in enumerate(texts) for k in range(4)]
    rows += [(5, "one\ntwo\n", "f", "p")] * 2 + [(None, "one\ntwo\nthree", "f", "p"), (-9, "one\ntwo", "f", "p")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_equals_a_plain_version(lined, rate, spm):
    how = Middle(rate=rate, spm_rate=spm)
    made = restore(fill_in_middle(lined, how), how)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made.collect()), key=repr)
    want = sorted(((r.doc_id, *expected(r.doc_id, r.text, 7, rate, spm), r.text or "") for r in lined.collect()), key=repr)
    assert got == want


def test_pieces_name_the_output(lined):
    made = fill_in_middle(lined).join(lined.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id")
    text = F.coalesce("text", F.lit(""))
    assert made.where(named_by(F.col("pieces"), text, "<P><S><M>") != F.col("output")).count() == 0
    assert made.where("form <> 'plain' AND size(pieces) <> 6").count() == 0


def test_digests(lined):
    for r in digests(fill_in_middle(lined)).collect():
        assert len(r.output_sha256) == 64
    sums = {r.restored_sha256 for r in digests(fill_in_middle(lined)).collect()}
    assert sums == {hashlib.sha256((r.text or "").encode()).hexdigest() for r in lined.collect()}


def test_other_sentinels_and_columns(spark):
    how = Middle(prefix="[pre]", suffix="[suf]", middle="[mid]", seed=3)
    df = spark.createDataFrame([(i, "a\nb\n[pre\nc]d\n" * i) for i in range(20)], "id long, body string")
    made = restore(fill_in_middle(df, how, "id", "body"), how)
    assert {(r.doc_id, r.restored) for r in made.collect()} == {(r.id, r.body) for r in df.collect()}
    assert made.where("form <> 'plain'").count() == 19


@pytest.mark.parametrize("bad", [("", "b", "c"), ("ab", "ba", "c"), ("aa", "b", "c"), ("abc", "b", "d")])
def test_sentinels_that_overlap_are_refused(bad):
    with pytest.raises(ValueError):
        Middle(prefix=bad[0], suffix=bad[1], middle=bad[2])


def test_no_rows_and_no_shuffle(spark, lined):
    made = digests(fill_in_middle(lined.limit(0)))
    assert made.count() == 0
    plan = digests(fill_in_middle(spark.createDataFrame([], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
