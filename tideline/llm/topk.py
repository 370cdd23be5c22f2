"""Exact top-k search by inner product with cover trees over queries and data together.

Rows and queries share one index: cells around centres of a net, cut into nodes of bounded size. A query group first
meets the data of its own node, which gives every query a k-th score to beat. A pair of query group and data node
is dropped if the bound from centres and covering radii stays below the worst k-th score of the group; pairs that are
left descend the cover trees of both sides by the same rule.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.llm.common import materialise, only
from tideline.llm.vectors import matrix, usable

#: Rows that the net of the first level is made from, and its centres at most.
SAMPLE, CELLS = 4096, 1024

#: Rows of a data node, on average; rows and query groups that meet in one pruning task.
NODE, SUMMARIES = 4096, 4096

#: Query groups that meet a data node in one task, on average.
GROUPS = 64

#: A tree node of this size is not split further; children with fewer rows than the second stay in one leaf.
LEAF, CHILD = 128, 16

LONG = 2**63 - 1
EXACT = float(2**53)


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole doubles; what overflows is cut to the largest double."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(vectors * scale))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-number rows as longs; beyond the range of long they are cut to it."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(whole, -LONG, LONG).astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    big = np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)
    return big * np.sqrt(((x / big[:, None]) ** 2).sum(axis=1))


@dataclass
class Node:
    """A cover-tree node: its centre is one of its rows, and all its rows are within ``radius``."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list["Node"] = field(default_factory=list)
    size: float = 0.0

    def __post_init__(self):
        self.size = float(norms(self.centre[None])[0])


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None, base: float = 2.0) -> Node:
    """Nets with shrinking radius: the rows of a node go to children within radius / base of a row of the node.

    Rows that gather hardly any others stay together in one leaf under the centre of the node.
    """
    if rows is None:
        rows = np.arange(len(x))
        centre = int(np.argmin(norms(x - x.mean(axis=0))))
    away = norms(x[rows] - x[centre])
    node = Node(x[centre], float(away.max(initial=0)), rows)
    if len(rows) <= LEAF or node.radius == 0:
        return node
    left, rest, pick, gathered = rows, [], centre, 0
    for tries in range(1, 65):
        near = (norms(x[left] - x[pick]) <= node.radius / base) | (left == pick)
        if CHILD <= near.sum() < len(rows):
            node.children.append(cover_tree(x, left[near], pick, base))
            gathered += int(near.sum())
        else:
            rest.append(left[near])
        left = left[~near]
        if not len(left) or tries >= 16 and gathered < len(rows) * tries / 64:
            break
        pick = int(left[0])
    loose = np.concatenate([left, *rest])
    if len(loose) and node.children:
        node.children.append(Node(x[centre], float(norms(x[loose] - x[centre]).max()), loose))
    return node


def bound(qc: np.ndarray, qr: float, qn: float, pc: np.ndarray, pr: float, pn: float) -> float:
    """No inner product between the two balls is larger; a little more, for rounding."""
    best = float(qc @ pc) + qr * pn + pr * qn + qr * pr
    return best + 1e-9 * (qn + qr) * (pn + pr) + 1e-6


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.rows = k, [np.empty(0, np.int64)] * queries, [np.empty(0, np.int64)] * queries
        self.kth = np.full(queries, -np.inf)

    def add(self, query: int, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        scores, rows = np.concatenate([self.scores[query], scores]), np.concatenate([self.rows[query], rows])
        order = np.lexsort((rows, ids[rows], -scores))[: self.k]
        self.scores[query], self.rows[query] = scores[order], rows[order]
        if len(order) == self.k:
            self.kth[query] = max(self.kth[query], self.scores[query][-1])


def dual_search(asks: Node, q: np.ndarray, qkey: np.ndarray, data: Node, p: np.ndarray, pkey: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Adds to ``best`` every row of ``p`` that can be among a query's k best, other than the query's own row."""
    roots = asks, data
    value = lambda a, b: bound(a.centre, a.radius, a.size, b.centre, b.radius, b.size)
    heap, tick = [(-value(*roots), 0, roots)], 0
    while heap:
        top, _, (a, b) = heapq.heappop(heap)
        if -top < best.kth[a.rows].min():
            continue
        if a.children or b.children:
            split = a.children and (not b.children or a.radius >= b.radius)
            for pair in ((c, b) for c in a.children) if split else ((a, c) for c in b.children):
                tick += 1
                if (v := value(*pair)) >= best.kth[pair[0].rows].min():
                    heapq.heappush(heap, (-v, tick, pair))
            continue
        scores = products(q[a.rows], p[b.rows])
        hits = (scores >= best.kth[a.rows][:, None]) & (qkey[a.rows][:, None] != pkey[b.rows][None, :])
        for i in np.flatnonzero(hits.any(axis=1)):
            some = np.flatnonzero(hits[i])
            if len(some) > 4 * best.k:  # the k best and their ties are enough
                least = np.partition(scores[i, some], len(some) - best.k)[len(some) - best.k]
                some = some[scores[i, some] >= least]
            best.add(int(a.rows[i]), scores[i, some], b.rows[some], ids)


def net(x: np.ndarray, centres: int) -> np.ndarray:
    """Rows that are far from each other, farthest first, so every prefix is a net of its own radius."""
    picked = [0]
    away = norms(x - x[0])
    while len(picked) < min(centres, len(x)) and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, norms(x - x[picked[-1]]))
    return x[picked]


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _ball(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    centre = x.mean(axis=0)
    return centre, float(norms(x - centre).max()), float(norms(centre[None])[0])


SUMMARY = "node string, centre binary, radius double, size double"


def _node_rows(k: int, width: int, scale: float):
    """Per node: a row for its data and a row for its queries, these with what they found in the node."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, keys, ids = quantised(matrix(table.column("vector"), width), scale), table.column("key").to_numpy(), table.column("id").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        out = []
        for kind, mine in (("data", np.ones(len(x), bool)), ("ask", asks)):
            if not mine.any():
                continue
            own, worst, found = x[mine], None, None
            if kind == "ask":
                best = Best(len(own), k)
                dual_search(cover_tree(own), own, keys[mine], cover_tree(x), x, keys, ids, best)
                worst = float(best.kth.min())
                found = [_blob(best.kth), *(_blob(np.concatenate([np.full(len(r), i) if part is None else part[r] for i, r in enumerate(best.rows)]))
                                            for part in (None, keys, ids)), _blob(np.concatenate(best.scores))]
            centre, radius, size = _ball(own)
            out.append([key[0].as_py(), kind, _blob(centre), radius, size, worst, _blob(own), _blob(keys[mine]), _blob(ids[mine]), *(found or [None] * 5)])
        return pa.table(dict(zip(NODE_NAMES, map(list, zip(*out)))), schema=NODE_ARROW)

    return run


NODE_NAMES = ["node", "kind", "centre", "radius", "size", "worst", "vectors", "keys", "ids", "kth", "found_query", "found_key", "found_id", "found_score"]
NODE_ARROW = pa.schema(
    [(n, pa.string() if n in ("node", "kind") else pa.float64() if n in ("radius", "size", "worst") else pa.binary()) for n in NODE_NAMES]
)
NODE_SCHEMA = ", ".join(f"{n} {'string' if n in ('node', 'kind') else 'double' if n in ('radius', 'size', 'worst') else 'binary'}" for n in NODE_NAMES)


def _prune(asks: pa.Table, data: pa.Table) -> pa.Table:
    """Pairs of query group and data node that the bound does not rule out; a group has met its own node."""
    unpack = lambda t: np.array([np.frombuffer(c) for c in t.column("centre").to_pylist()])
    out_ask, out_data = [], []
    if len(asks) and len(data):
        centres, radius, size = unpack(data), data.column("radius").to_numpy(), data.column("size").to_numpy()
        names = np.array(data.column("node").to_pylist(), object)
        for row, centre in zip(asks.select(["node", "radius", "size", "worst"]).to_pylist(), unpack(asks)):
            best = centres @ centre + row["radius"] * size + radius * row["size"] + row["radius"] * radius
            best += 1e-9 * (row["size"] + row["radius"]) * (size + radius) + 1e-6
            left = names[(best >= row["worst"]) & (names != row["node"])]
            out_ask += [row["node"]] * len(left)
            out_data += left.tolist()
    return pa.table({"ask": pa.array(out_ask, pa.string()), "node": pa.array(out_data, pa.string())})


def _search(k: int, width: int):
    def run(data: pa.Table, asks: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "key": [], "id": [], "score": []}
        read = lambda blob, kind=np.int64: np.frombuffer(blob, kind)
        for d in data.to_pylist():
            p, pkey, ids = read(d["vectors"], np.float64).reshape(-1, width), read(d["keys"]), read(d["ids"])
            tree = cover_tree(p)
            for a in asks.to_pylist():
                q, qkey = read(a["vectors"], np.float64).reshape(-1, width), read(a["keys"])
                best = Best(len(q), k)
                best.kth = read(a["kth"], np.float64).copy()
                dual_search(cover_tree(q), q, qkey, tree, p, pkey, ids, best)
                for i, rows in enumerate(best.rows):
                    out["query"] += [int(qkey[i])] * len(rows)
                    out["key"] += pkey[rows].tolist()
                    out["id"] += ids[rows].tolist()
                    out["score"] += best.scores[i].tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What query groups found in their own nodes."""
    for batch in batches:
        for row in batch.to_pylist():
            read = lambda name: np.frombuffer(row[name], np.int64)
            yield pa.RecordBatch.from_pydict(
                {"query": read("keys")[read("found_query")], "key": read("found_key"), "id": read("found_id"), "score": read("found_score")}
            )


def _called(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes with each salt that a pair of theirs has: a node travels only to where pruning left something of it."""
    joined = nodes.join(pairs.select("node", "salt").distinct(), "node")
    return joined.select(*(F.col(c).alias(c) for c in joined.columns))  # columns of its own beside the other side's


def exact_top_k(
    vectors: DataFrame, asks: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """For each row where ``asks`` is true, the ``k`` rows with the largest inner product, other than itself.

    Returns query_id, rank (from 1), vec_id, score, with components floor(scale * x) and ties to the smaller vec_id.
    All rows are candidates and the result is exact. Fewer than ``k`` other rows are all returned. Vectors that
    are NULL, empty or hold NULL or non-finite components take no part, nor do rows without id; a shorter vector
    counts as filled up with zeros. Repeated ids are rows of their own, so a query meets its copies, and a repeated
    query is answered twice. Scores beyond long are cut to its range. ``asks`` may use any column of ``vectors``.
    The net of the first level comes from a bounded sample (``SAMPLE`` rows); it decides only where rows lie.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    valid = given.where(usable("vector") & F.col("id").isNotNull()).withColumn("key", F.monotonically_increasing_id())
    rows = materialise(valid, "search-rows")
    total, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    zeros = F.array_repeat(F.lit(0.0), width)
    rows = rows.withColumn("vector", F.slice(F.concat(F.col("vector").cast("array<double>"), zeros), 1, width))
    sample = rows.orderBy(F.xxhash64("id"), "key").limit(SAMPLE).select("vector").toPandas()
    centres = net(quantised(np.array(sample["vector"].tolist(), np.float64), scale), int(np.clip(total // NODE, 1, CELLS)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = quantised(matrix(batch.column("vector"), width), scale)
            with np.errstate(over="ignore", invalid="ignore"):  # a wrong cell for huge values costs time only
                cell = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    celled = materialise(rows.mapInArrow(assign, "id long, vector array<double>, asks boolean, key long, cell int"), "search-cells")
    sizes = {r.cell: -(-r.n // NODE) for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS
    parts = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))[F.col("cell")]
    node = F.concat_ws(":", F.col("cell"), F.pmod(F.xxhash64("key"), parts))
    nodes = materialise(
        celled.withColumn("node", node).groupBy("node").applyInArrow(_node_rows(k, width, scale), NODE_SCHEMA), "search-nodes"
    )
    data, groups = nodes.where("kind = 'data'"), nodes.where("kind = 'ask'")
    counts = {r.kind: r.n for r in nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    across, down = (-(-counts.get(kind, 0) // SUMMARIES) for kind in ("data", "ask"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.lit(max(n, 1)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)).cast("array<bigint>"))
    ask_side = groups.select("node", "centre", "radius", "size", "worst", part(down).alias("i"), every(across).alias("j"))
    data_side = data.select("node", "centre", "radius", "size", every(down).alias("i"), part(across).alias("j"))
    pairs = materialise(
        ask_side.groupBy("i", "j").cogroup(data_side.groupBy("i", "j")).applyInArrow(lambda a, d: _prune(a, d), "ask string, node string"),
        "search-pairs",
    )
    salts = max(1, -(-counts.get("ask", 0) // GROUPS))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("ask"), F.lit(salts)))
    meeting = salted.join(groups.select(F.col("node").alias("ask"), "vectors", "keys", "kth"), "ask").select(
        "node", "salt", "vectors", "keys", "kth"
    )
    called = _called(data.select("node", "vectors", "keys", "ids"), salted)
    met = called.groupBy("node", "salt").cogroup(meeting.groupBy("node", "salt")).applyInArrow(
        _search(k, width), "query long, key long, id long, score long"
    )
    seeds = groups.select("keys", "found_query", "found_key", "found_id", "found_score").mapInArrow(
        _seeds, "query long, key long, id long, score long"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "key")
    names = rows.where("asks").select(F.col("key").alias("query"), F.col("id").alias("query_id"))
    return (
        met.unionByName(seeds).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .join(names, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
