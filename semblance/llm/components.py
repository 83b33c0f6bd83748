"""Connected components of an undirected graph by alternating large-star and small-star rounds.

Every round is a map-side combined minimum and an equi-join on a node. The edges of a hub, a node of more than
``LEAST_HUB`` edges and of more than one in ``MOST_HUBS`` of all, never meet in one task: hubs, of which there are
twice MOST_HUBS at most, are broadcast with their minimum. Each round is written to the shared folder, which cuts
the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, kept


LEAST_HUB, MOST_HUBS = 200_000, 20_000


def _with_least(edges: DataFrame, count: int) -> DataFrame:
    """edges (u, v) with m, the least v of their u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if count <= LEAST_HUB:  # then no node is a hub
        return edges.join(least.select("u", "m"), "u")
    most = max(LEAST_HUB, count // MOST_HUBS)
    marked = edges.join(F.broadcast(least.where(F.col("n") > most).select("u", "m")), "u", "left")
    rest = marked.where("m is null").select("u", "v").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return marked.where("m is not null").unionByName(rest)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the least node of its component.

    Nodes are of any type that sorts. Null ends, loops and repeated edges change nothing; no edges give no rows.
    """
    now = kept(edges.where("u < v or v < u").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = _with_least(both, 2 * state[0])
        large = least.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        down = _with_least(large, state[0])
        small = down.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        old, now = now, kept(small.distinct())
        discard(old)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
