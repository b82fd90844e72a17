"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialise, release

_KEY = 0x5DEECE66D


def _with_minimum(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Edges (u, v) with m: the least of u and its neighbours.

    The minimum is an aggregate with map-side combining, so a hub never gathers
    in one row. The join is on a key the aggregate isn't partitioned by: both
    sides then come straight from exchanges, and adaptive execution splits the
    partition a hub's edges are in.
    """
    if both_ways:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    key = F.col("u").bitwiseXOR(F.lit(_KEY).cast("bigint")).alias("k")
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(key, "m")
    return edges.select(key, "u", "v").join(least, "k").drop("k")


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u becomes a neighbour of u's least neighbour."""
    e = _with_minimum(edges, both_ways=True).where("v > u")
    return e.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours become neighbours of the least of them."""
    e = _with_minimum(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), both_ways=False)
    pairs = e.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
    return pairs.select("p.u", "p.v").where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: bigint).

    ``component`` is the least node of the component. Self-loops and repeated
    edges change nothing; rows with a null end are dropped; no edges give no
    rows. Each round is written to the shared folder and the one before removed,
    so lineage stays short and a lost executor costs one round at most. Rounds grow with the
    logarithm of the component size; not converging within ``max_rounds``
    raises instead of returning a partial result.
    """
    e = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        before, e = e, materialise(small_star(large_star(e)), "edges")
        release(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
