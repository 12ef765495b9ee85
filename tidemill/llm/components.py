"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no node's neighbours are ever
gathered in one place. Nodes with very many edges, of which there are HUBS at
most, are joined by broadcast, so that their edges stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.frames import cut

MAX_ROUNDS = 60
HUBS = 100_000
HUB_EDGES = 20_000  # a node with fewer is no hub


def _least_linked(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """``edges`` (u, v) as (v, least of u); u with more than ``hub`` edges are few, and none if ``hub`` is None."""
    if hub is None:
        return edges.join(least.drop("n"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hubs = F.broadcast(least.where(F.col("n") > hub).select(F.col("u").alias("h"), F.col("m").alias("hm")))
    met = edges.join(hubs, F.col("u") == F.col("h"), "left")
    joined = met.where("h IS NULL").select("u", "v").join(least.where(F.col("n") <= hub), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.where("h IS NOT NULL").select(F.col("v").alias("u"), F.col("hm").alias("v")).unionByName(joined)


def _star(edges: DataFrame, large: bool, hub: int | None) -> DataFrame:
    """edges (u, v) with u > v; links each node's larger (large) or smaller neighbours to its least one."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        linked = _least_linked(around.where("v > u"), least, hub)
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        linked = _least_linked(edges, least, hub).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _most(edges: DataFrame) -> int:
    """The largest number of edges that a node has."""
    return edges.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node with an edge; component is the least node it reaches.

    Edges with a null end are ignored; loops give a node its own component
    only if nothing else does, and repeated edges count once.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    stars = cut(both.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    state = _state(stars)
    for _ in range(MAX_ROUNDS if state[0] else 0):
        hub = max(HUB_EDGES, 2 * state[0] // HUBS)  # edges have two ends, so HUBS nodes at most have more
        if state[0] <= hub or _most(stars) <= hub:
            hub = None
        stars = cut(_star(_star(stars, True, hub), False, hub))
        before, state = state, _state(stars)
        if before == state:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
