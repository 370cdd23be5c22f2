"""Embedding near-duplicates: a pigeonhole join over subspaces of the rotated vectors.

Unit vectors with cosine t or more are at squared distance 2 - 2t or less. A rotation keeps that; cut into blocks
of coordinates, at least one block of such a pair is within its share of the squared distance. So each block is
range-joined on its own, and the union of what the blocks find is verified on the whole vectors.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import materialise, only
from tideline.llm.components import components
from tideline.llm.vectors import matrix, usable

SEED = 20_240_601

#: Rows that are compared as the home rows, or as the guests, of one task, on average; larger cells are cut into tiles.
TILE = 4096

#: Home rows compared at once, and pairs examined at once.
CHUNK, PAIRS = 256, 1 << 17

#: Rounding allowance: for the search (generous) and for deciding which block a pair belongs to.
LOOSE, TIGHT = 1e-7, 1e-11


@functools.lru_cache(maxsize=4)
def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def blocks_of(width: int, blocks: int) -> list[slice]:
    edges = np.linspace(0, width, min(blocks, width) + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(edges.tolist(), edges[1:].tolist())]


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cells(rotated: np.ndarray, block: slice, radius: float, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, grid cells, 0 at home or 1 as a guest): each row in its cell and in cells before it that it can reach.

    Cells are two radii wide. Of two neighbouring cells the later one sends guests to the earlier one.
    """
    x = rotated[:, block][:, :depth] / (2 * radius)
    home = np.floor(x).astype(np.int64)
    yield np.arange(len(x)), home, 0
    low = x - home <= 0.5 + LOOSE  # near enough to the cell below, or above
    high = x - home >= 0.5 - LOOSE
    for step in itertools.product((0, 1, -1), repeat=home.shape[1]):
        if step > (0,) * len(step):
            near = np.ones(len(x), bool)
            for k, s in enumerate(step):
                near &= low[:, k] if s > 0 else high[:, k] if s < 0 else True
            rows = np.flatnonzero(near)
            yield rows, home[rows] - np.array(step), 1


def scatter(width: int, threshold: float, blocks: int, depth: int):
    """For one batch: rows sent to grid cells of every block."""
    distance = 2 - 2 * threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                rotated = unit(matrix(batch.column("embedding"), width)) @ rotation(width)
                for j, block in enumerate(blocks_of(width, blocks)):
                    radius = np.sqrt(distance * (block.stop - block.start) / width)
                    for rows, cells, guest in _cells(rotated, block, radius, depth):
                        names = pa.array([f"{j}:{','.join(map(str, c))}" for c in cells.tolist()], pa.string())
                        sent = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [names, pa.array(np.full(len(rows), j, np.int32)), pa.array(np.full(len(rows), bool(guest))),
                             sent.column("key"), sent.column("n"), sent.column("embedding")],
                            ["cell", "block", "guest", "key", "n", "embedding"],
                        )

    return run


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; parents point to smaller positions."""
    while len(a):
        while True:  # roots of both ends
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def match(width: int, threshold: float, blocks: int, depth: int):
    """For two tiles: links between home rows and guests, and for ``other`` 0 among the home rows, as sums and a forest."""
    distance = 2 - 2 * threshold
    slots = blocks_of(width, blocks)
    budget = [distance * (s.stop - s.start) / width for s in slots]

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("guest").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        homes = len(order) - int(table.column("guest").to_numpy().sum())
        j, inner = table.column("block")[0].as_py(), table.column("other")[0].as_py() == 0
        units = unit(matrix(table.column("embedding"), width))
        rotated = units @ rotation(width)
        part = rotated[:, slots[j]]
        along = part[:, min(depth, part.shape[1] - 1)]
        # Home rows and guests each in the order of a coordinate that the grid does not use.
        rank = np.concatenate([np.argsort(along[:homes], kind="stable"), homes + np.argsort(along[homes:], kind="stable")])
        table, units, rotated, part, along = table.take(pa.array(rank)), units[rank], rotated[rank], part[rank], along[rank]
        weight = table.column("n").to_numpy()
        squares = (part * part).sum(axis=1)
        links, parent, reach = np.zeros(len(rank), np.int64), np.arange(len(rank)), np.sqrt(budget[j]) + LOOSE

        def examine(rows: slice, others: slice) -> None:
            d = squares[rows, None] + squares[None, others] - 2 * part[rows] @ part[others].T
            near = d <= budget[j] + LOOSE
            if others.start < homes:
                near &= np.arange(others.start, others.stop)[None, :] > np.arange(rows.start, rows.stop)[:, None]
            used = np.flatnonzero(near.any(axis=0))
            if not len(used):
                return
            close = near[:, used] & (units[rows] @ units[others][used].T >= threshold)
            a, b = np.nonzero(close)
            a, b = a + rows.start, used[b] + others.start
            for at in range(0, len(a), PAIRS):
                p, q = a[at : at + PAIRS], b[at : at + PAIRS]
                for i, slot in enumerate(slots[: j + 1]):  # the first block that finds a pair has it
                    apart = ((rotated[p, slot] - rotated[q, slot]) ** 2).sum(axis=1) <= budget[i] + TIGHT
                    mine = apart if i == j else ~apart
                    p, q = p[mine], q[mine]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                _merge(parent, p, q)

        for start in range(0, homes, CHUNK):
            rows = slice(start, min(start + CHUNK, homes))
            low, high = along[rows.start] - reach, along[rows.stop - 1] + reach
            for first, last in ((start, homes if inner else start), (homes, len(rank))):
                a, b = np.searchsorted(along[first:last], [low, high]) + [0, 0]
                for at in range(first + a, first + b, 8 * CHUNK):
                    examine(rows, slice(at, min(at + 8 * CHUNK, first + b)))
        found = np.flatnonzero(links)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        key = table.column("key").to_numpy()
        return pa.table({"key": key[found], "links": links[found], "root": key[parent[found]]})

    return run


def tiled(sent: DataFrame) -> DataFrame:
    """Rows of grid cells dealt to pairs of tiles: (cell, tile, other) holds a tile of home rows and one of guests at most.

    Home rows and guests from other cells are cut into tiles of ``TILE`` rows on average. ``other`` counts the tiles of
    guests, then the home tiles, of which a later one is the guest of an earlier one; 0 also stands for the home tile
    itself.
    """
    tiles = lambda rows: F.greatest(F.lit(1), F.ceil(rows / TILE).cast("int"))
    guests = F.sum(F.col("guest").cast("long"))
    large = (
        sent.groupBy("cell").agg(guests.alias("guests"), (F.count("*") - guests).alias("homes"))
        .where(F.greatest("guests", "homes") > TILE)
        .select("cell", tiles(F.col("homes")).alias("homes"), tiles(F.col("guests")).alias("guests"))
    )
    place = lambda tile, other, guest: F.struct(
        F.lit(tile).alias("tile"), F.lit(other).alias("other"), F.lit(guest).alias("guest")
    )
    homes, guests = F.coalesce("homes", F.lit(1)), F.coalesce("guests", F.lit(1))
    own = F.pmod(F.xxhash64("key"), F.when(F.col("guest"), guests).otherwise(homes)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    as_home = F.transform(upto(guests), lambda k: place(F.col("own"), k, False))
    with_homes = F.transform(
        F.filter(upto(homes), lambda k: k != F.col("own")),
        lambda k: place(F.least(k, "own"), guests + F.greatest(k, "own"), k < F.col("own")),
    )
    as_guest = F.transform(upto(homes), lambda k: place(k, F.col("own"), True))
    return (
        sent.join(large, "cell", "left").withColumn("own", own)
        .withColumn("place", F.explode(F.when(F.col("guest"), as_guest).otherwise(F.concat(as_home, with_homes))))
        .select("cell", "place.tile", "place.other", "block", "place.guest", "key", "n", "embedding")
    )


def near_links(distinct: DataFrame, width: int, threshold: float, blocks: int, depth: int) -> DataFrame:
    """Links among different vectors: (key, links, root) parts, to be summed by key; (key, root) are links or equal.

    ``distinct`` has key, n (copies) and embedding of ``width`` components. Cells with more home rows or guests than
    ``TILE`` are cut into tiles; every pair of them is one group.
    """
    sent = distinct.mapInArrow(
        scatter(width, threshold, blocks, depth),
        f"cell string, block int, guest boolean, key long, n long, {distinct.select('embedding').schema[0].simpleString().replace(':', ' ', 1)}",
    )
    return tiled(sent).groupBy("cell", "tile", "other").applyInArrow(
        match(width, threshold, blocks, depth), "key long, links long, root long"
    )


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, blocks: int = 8, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Links by cosine >= ``threshold`` (above 0): vec_id, n_links, component_id, kept, one row per input row.

    n_links counts the other rows linked directly, component_id is the smallest id reachable, kept says whether that
    is the row's own. The result is exact. Equal vectors are one row of the search and count as links of each other.
    Vectors that are NULL, empty, all zero or hold NULL or non-finite components link with nothing, nor do vectors of
    different lengths. Repeated ids count as rows of their own (all of them are kept); rows without id take part,
    name no component and are not kept. Further columns are not read. The grid of a block uses one more
    coordinate for each factor of about eight in the rows.
    """
    rows = materialise(only(vectors, vec_id=vec_id, embedding=embedding), "vectors")
    takes_part = usable("embedding") & F.exists("embedding", lambda e: e != 0)
    distinct = materialise(
        rows.where(takes_part).groupBy("embedding")
        .agg(F.min("vec_id").alias("smallest"), F.count("*").alias("n"))
        .withColumn("key", F.monotonically_increasing_id()),
        "distinct-vectors",
    )
    sizes = distinct.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("rows")).collect()
    parts = []
    for width, n in sorted(sizes):
        depth = min(max(1, round(np.log(max(n / TILE, 1)) / np.log(8)) + 1), 4)
        parts.append(near_links(distinct.where(F.size("embedding") == width).select("key", "n", "embedding"), width, threshold, blocks, depth))
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "key long, links long, root long")
    links = materialise(functools.reduce(DataFrame.unionByName, parts, empty), "vector-links")
    rooted = components(links.select("key", "root"), "key", "root")
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    named = (
        distinct.join(counts, "key", "left")
        .join(rooted.withColumnRenamed("node", "key"), "key", "left")
        .select("embedding", "smallest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    )
    smallest = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    found = named.join(smallest, "root").select("embedding", "n_links", "component_id")
    alone = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        rows.where(takes_part).join(found, "embedding").select("vec_id", "n_links", "component_id").unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
