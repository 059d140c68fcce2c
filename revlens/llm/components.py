"""Connected components of a distributed edge table.

Alternating large-star and small-star steps, which keep the number of edges
bounded by the input and end in stars around each component's smallest node in
a logarithmic number of rounds. Minima are aggregated before each shuffle and
joined back, so that a hub with most of the edges is split by the skew-join
rule and is never one task's list. Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import Scratch


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node next to it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 60) -> DataFrame:
    """``edges`` (u, v of type long) -> ``node``, ``component``: the smallest node reachable. Nodes without an edge to another are left out."""
    state = scratch.save(_directed(edges).distinct(), f"{name}-0")
    seal = None
    for k in range(1, rounds + 1):
        following = scratch.save(_small_star(_directed(_large_star(state)).distinct()).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        state = following
        now = tuple(state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seal or not now[0]:
            break
        seal = now
    else:
        raise RuntimeError("components have not settled")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
