"""Near-duplicate operators and top-k search against brute force."""

import sys

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import embeddings, simhash, topk
from tideline.llm.components import components
from tideline.sources import stages


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(i, 0) for i in range(1, 30)] + [(50, 49), (49, 51)],
    [(i % 17, (i * 5 + 3) % 60) for i in range(50)] + [(7, 8), (8, 7), (7, 8)],
])
def test_components(spark, edges):
    links = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    root = union(64, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def plain_fingerprint(text, width=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(documents, no_documents, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 100)
    rows = documents.collect()
    prints = [plain_fingerprint(r.text or "") for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    root = union(len(rows), pairs)
    smallest = {}
    for r, k in zip(rows, root):
        if r.doc_id is not None:
            smallest[k] = min(smallest.get(k, r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{p:016x}", smallest.get(k)) for r, p, k in zip(rows, prints, root)]
    got = simhash.groups(documents).drop("group")
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert simhash.groups(no_documents).count() == 0


def test_near_pairs_finds_all_within_the_distance(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    flipped = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (4, 2))]
    values = sorted({*map(int, base), *flipped, 0, -1, 1, 3, 7, -2})
    got = {tuple(sorted(r)) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "bits long")).collect()}
    count = simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "bits long")).count()
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want and count == len(want)
    with pytest.raises(ValueError):
        simhash.near_pairs(spark.createDataFrame([(1,)], "bits long"), 2, 32)


def test_keep_one(documents, no_documents):
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    groups = simhash.groups(documents)
    assert kept.count() == groups.select("group").distinct().count()
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 12 not in ids and None in ids
    assert simhash.keep_one(no_documents).count() == 0


def test_near_duplicates_broadcast_nothing(spark, documents, monkeypatch):
    """Neither the cells that fingerprints are sent to, nor links, nor documents go through the driver, however small their files."""
    plans = []

    def planned(df, label):
        plans.append((label, df._jdf.queryExecution().sparkPlan().toString()))
        return stages.materialise(df, label)

    monkeypatch.setattr(simhash, "materialise", planned)
    monkeypatch.setattr(sys.modules[components.__module__], "materialise", planned)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        planned(simhash.keep_one(documents), "kept")
        planned(simhash.groups(documents), "groups")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sum("SortMergeJoin" in plan for _, plan in plans) >= 6  # pairs, rounds and results
    assert [label for label, plan in plans if "Broadcast" in plan] == []


def vectors(spark, seed=3, n=260, width=12):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    for i in range(80, 140):  # around a few centres, so that links chain
        x[i] = x[i % 5] + 0.12 * rng.standard_normal(width)
    x[140:150] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(7, rows[7][1]), (300, None), (301, []), (302, [0.0] * width), (303, [float("nan")] * width), (None, rows[9][1])]
    rows += [(304, [None] + [1.0] * (width - 1)), (305, [float("inf")] * width), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [1e200] * width)]
    return spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, cell string, key int").repartition(3)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 40)
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    monkeypatch.setattr(embeddings, "PAIRS", 64)
    df = vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if good else None for (_, v), good in zip(rows, ok)]
    near = lambda i, j: ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if near(i, j)]
    links = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    root = union(len(rows), pairs)
    smallest = {}
    for (vec_id, _), k in zip(rows, root):
        if vec_id is not None:
            smallest[k] = min(smallest.get(k, vec_id), vec_id)
    want = [(v, int(n), smallest.get(k), v is not None and v == smallest.get(k)) for (v, _), n, k in zip(rows, links, root)]
    got = embeddings.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert links.max() > 5 and len(set(root)) < len(rows) - 40
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_no_group_of_a_large_cell_holds_more_than_two_tiles(spark, monkeypatch):
    """Most vectors in one cell, and many guests of a neighbour that has few rows itself."""
    monkeypatch.setattr(embeddings, "TILE", 40)
    held, kind = [], type(spark.range(0))
    real = kind.groupBy

    def watched(df, *keys):
        if "tile" in keys:
            held.append(real(df, *keys).agg(F.count("*").alias("n"), F.sum(F.col("guest").cast("int")).alias("guests")))
        return real(df, *keys)

    monkeypatch.setattr(kind, "groupBy", watched)
    rng = np.random.default_rng(5)
    middle = rng.standard_normal(16)
    rows = [(i, 1, (middle + 0.05 * rng.standard_normal(16)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "key long, n long, embedding array<double>").repartition(3)
    parts = embeddings.near_links(df, 16, 0.95, 4, 1).collect()
    links = np.zeros(len(rows), int)
    for r in parts:
        links[r.key] += r.links
    units = np.array([r[2] for r in rows]) / np.linalg.norm([r[2] for r in rows], axis=1, keepdims=True)
    assert links.tolist() == ((units @ units.T >= 0.95).sum(axis=1) - 1).tolist()
    groups = held[0].collect()
    assert max(r.n for r in groups) < 3 * 40 and sum(r.n - r.guests for r in groups) > 600


def plain_top_k(rows, asks, k):
    ok = [(i, np.floor(np.array(v) * 64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in ok)
    padded = [(i, [int(x) for x in v] + [0] * (width - len(v))) for i, v in ok]
    out = []
    for a, (i, q) in enumerate(padded):
        if asks(i):
            found = [(-min(max(sum(x * y for x, y in zip(q, p)), -(2**63 - 1)), 2**63 - 1), j) for b, (j, p) in enumerate(padded) if a != b]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "NODE", 30)
    monkeypatch.setattr(topk, "SUMMARIES", 4)
    monkeypatch.setattr(topk, "GROUPS", 3)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "CHILD", 2)
    df = vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = topk.exact_top_k(df, F.col("vec_id") % 5 == 0, k=7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top_k(rows, lambda i: i % 5 == 0, 7)
    few = df.where("vec_id < 4")
    own = [(r.vec_id, r.embedding) for r in few.collect()]
    assert sorted(map(tuple, topk.exact_top_k(few, F.col("vec_id") % 2 == 0, k=7).collect())) == plain_top_k(own, lambda i: i % 2 == 0, 7)
    assert topk.exact_top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.exact_top_k(df, F.lit(False)).count() == 0


def test_bound_holds_and_prunes():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((50, 6)) + 3, rng.standard_normal((60, 6)) - 3
    qa, qb = topk.cover_tree(a), topk.cover_tree(b)
    assert topk.bound(qa.centre, qa.radius, qa.size, qb.centre, qb.radius, qb.size) >= (a @ b.T).max()
    rows = np.sort(np.concatenate([c.rows for c in qa.children])) if qa.children else qa.rows
    assert rows.tolist() == list(range(50))


def test_top_k_sends_nodes_where_pairs_are(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "node string, ids int")
    pairs = spark.createDataFrame([("x", "a", 0), ("y", "a", 0), ("z", "a", 7), ("x", "c", 0)], "ask string, node string, salt int")
    got = sorted(map(tuple, topk._called(nodes, pairs).select("node", "ids", "salt").collect()))
    assert got == [("a", 1, 0), ("a", 1, 7), ("c", 3, 0)]
