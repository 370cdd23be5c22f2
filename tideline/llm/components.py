"""Connected components of a table of links, by repeated stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import materialise


def _smallest_beside(pairs: DataFrame) -> DataFrame:
    """Per node u: the smallest node among u and what it is linked with."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node that each linked node can reach: one row ``node``, ``root`` per node that occurs in a link.

    ``links`` has two columns of one ordered type; direction, repeats, links of a node to itself and NULL ends do
    not matter. Each round hangs all larger neighbours of a node on its smallest neighbour (large star), then all
    smaller ones (small star); the rounds end when a round changes nothing, so after about log(longest path)
    rounds. Every round writes its links to the shared folder. A hub with very many links costs a partial
    aggregate and one join side that the adaptive join can split, never a list; the joins are by merge, so the
    driver never holds the nodes for a broadcast. No links give no rows.
    """
    u, v = F.col("u"), F.col("v")
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b))
    edges, seen = materialise(links.distinct(), "links"), None
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        large = (
            both.hint("merge").join(_smallest_beside(both), "u").where(v > u)
            .select(v.alias("u"), F.col("m").alias("v"))
        )
        kept = large.where(u != v).distinct()
        small = kept.hint("merge").join(_smallest_beside(kept), "u").select(
            F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v")
        )
        edges = materialise(small.where(u != v).distinct(), "links")
        # Stars only: no root hangs on anything. The sums tell whether a round changed anything.
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.select(u.alias("node"), v.alias("root"))
    return roots.unionByName(edges.select(v.alias("node"), v.alias("root")).distinct())
