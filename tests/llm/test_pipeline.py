"""The pipeline's stages against brute force, the registered queries, and life without the subpackage."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, connection
from tests.llm.test_near_duplicates import plain_fingerprint, union
from tests.llm.test_tokens import check_packed
from tideline.llm import quality, toxicity
from tideline.llm.queries import ORACLE, QUERIES

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    """A folder with documents and labels: insults, junk, copies, edge rows."""
    folder = tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for i in range(500):
        words = prose(i, 30 + i % 50).split()
        toxic, bad = i % 7 == 0, i % 9 == 1
        if toxic:
            for k in range(3):
                words.insert((i * 5 + k * 11) % len(words), ("vomp", "gralker", "zutter")[(i // 7 + k) % 3])
        text = " ".join(w.upper() + "!!" for w in words) if bad and not toxic else " ".join(words)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "copy", len(rows[i][1])) for i in range(2, 120, 4)]
    rows += [rows[5], (2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, prose(77, 3000), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash_near_dedup", "best_fit_packing"]
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, corpus)
        docs.write.parquet(f"{corpus}/{name}")
        docs = spark.read.parquet(f"{corpus}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        results[name] = (before.collect(), docs.collect())

    was, now = results["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{corpus}/documents.parquet"), labels)
    key = lambda r: tuple(map(str, r))
    assert sorted(now, key=key) == sorted((r for r in was if model.score(r.text or "") < 0.5), key=key)
    assert not any(r.doc_id % 7 == 0 for r in now if r.doc_id < 500) and len(now) > 400

    was, now = results["quality"]
    ids = {r.doc_id for r in now}
    assert not any(r.doc_id % 9 == 1 for r in now if r.doc_id < 500)
    assert {r.doc_id for r in was if r.doc_id >= 2000 or r.doc_id % 1000 % 9 != 1} <= ids
    cuts = quality.decisions(spark.createDataFrame(was, docs_schema(spark, corpus)), labels).collect()
    assert {r.doc_id for r in sorted(cuts, key=lambda r: -r.key)[: len(now)]} == ids

    was, now = results["simhash_near_dedup"]
    prints = [plain_fingerprint(r.text or "") for r in was]
    root = union(len(was), [(i, j) for i in range(len(was)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    first = {}
    for r, k in zip(was, root):
        first[k] = min(first.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in now) == sorted(first.values())

    was, now = results["best_fit_packing"]
    check_packed(now, corpus_pipeline.CAPACITY)
    assert {r.doc_id for r in now} == {r.doc_id for r in was}
    ran = corpus_pipeline.run(spark, corpus).collect()
    assert {r[:5] for r in ran} == {r[:5] for r in now} and len(ran) == len(now)


def docs_schema(spark, corpus):
    return spark.read.parquet(f"{corpus}/documents.parquet").schema


def test_stages_on_no_rows(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), corpus).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_01, name):
    assert compare(QUERIES[name](spark, sf_01), connection(sf_01), ORACLE[name]) == ""


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


def test_labels_are_learned_from_sql_side(spark, sf_01):
    rows = QUERIES["op4_quality_classifier"](spark, sf_01).join(spark.read.parquet(f"{sf_01}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.95
    assert all(r.kept for r in rows if r.quality)


def test_the_rest_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "oracle.py", "tideline"):
        (tmp_path / name).symlink_to(ROOT / name) if name != "tideline" else None
    (tmp_path / "tideline").mkdir()
    for part in (ROOT / "tideline").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "tideline" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(n.startswith('op') for n in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
