"""Connected components of an undirected edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, measured, stored


def components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges, taken both ways.

    Nodes without an edge to another node are not listed; rows with a null end
    and self-edges are ignored. Each round hangs every node on the smallest
    neighbour it knows (large star, then small star), so the number of rounds
    grows with the logarithm of the graph's size. Minima are combined before
    the shuffle, so that a hub does not gather its neighbours in one task. The
    write of a round also tells whether it changed anything; the table of the
    round before is deleted then.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    e, before = stored(e, "edges"), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new, state = measured(small, "edges", n=F.count("*"), x=F.bit_xor(F.xxhash64("u", "v")))
        discard(e)
        e = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
