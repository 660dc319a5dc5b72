"""Least costs over a graph too deep for a job a step, by blocks of nodes.

Nodes are cut into ranges of about as many edges; each block's edges are a
file of their own. A round gives each block the costs that edges from other
blocks offer its nodes; a task settles the block to its own fixpoint, however
long the paths within it, and gives back what changed and what its edges offer
other blocks. So only offers across blocks travel, and rounds are as many as
the crossings of blocks on a best path. The state is a log: a folder of
changes for each round, by block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..storage import discard, fresh, measured, stored

#: Edges that a task holds, about.
EDGES_A_BLOCK = 1 << 20
FAR = np.iinfo(np.int64).max


def settled(u: np.ndarray, v: np.ndarray, w: np.ndarray, seen: np.ndarray, cost: np.ndarray, to: np.ndarray, offer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes whose least cost falls, and what it is then, of a block with edges (u, v, w), known costs (seen, cost) and offers (to, offer). Weights are not negative."""
    ids = np.unique(np.concatenate([u, v, seen, to]))
    at = lambda x: np.searchsorted(ids, x)
    best = np.full(len(ids), FAR)
    np.minimum.at(best, at(seen), cost)
    old = best.copy()
    np.minimum.at(best, at(to), offer)
    order = np.argsort(u, kind="stable")
    tail, head, weight = at(u[order]), at(v[order]), w[order]
    first = np.searchsorted(tail, np.arange(len(ids) + 1))
    front = np.nonzero(best < old)[0]
    while len(front):
        n = first[front + 1] - first[front]
        e = np.repeat(first[front] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        before = best[head[e]]
        np.minimum.at(best, head[e], best[tail[e]] + weight[e])
        front = np.unique(head[e][best[head[e]] < before])
    changed = np.nonzero(best < old)[0]
    return ids[changed], best[changed]


def _column(folder: str, names: list[str]) -> list[np.ndarray]:
    """Columns of all Parquet files of a folder; none where it is missing."""
    import pyarrow.parquet as pq

    parts = []
    if files.exists(folder):
        for f in files.listed(folder):
            fs, path = files.opened(f)
            parts.append(pq.read_table(path, filesystem=fs, columns=names, partitioning=None))
    return [np.concatenate([p.column(c).to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for c in names]


def least_costs(edges: DataFrame, start: DataFrame, edges_a_block: int = EDGES_A_BLOCK, max_rounds: int | None = None) -> tuple[DataFrame, int]:
    """(node, cost) of all nodes reached, and the rounds that it took.

    edges(u, v, w) and start(node, cost) are longs; weights are whole and not
    negative. Repeated edges and starts count once, by their least. A node of
    more edges than ``edges_a_block`` makes a block larger by those. Rounds
    that reach a bound with offers left are an error.
    """
    spark = edges.sparkSession
    n = edges.count()
    blocks = max(1, -(-n // edges_a_block))
    bounds = np.unique(np.array(edges.approxQuantile("u", [k / blocks for k in range(1, blocks)], 0.1 / blocks) if blocks > 1 else [], np.int64))  # a number a block
    home, log = fresh(spark, "blocks"), fresh(spark, "costs")
    by = edges.select("u", "v", F.col("w").cast("long").alias("w")).withColumn("block", _blocks(bounds, F.col("u")))
    by.repartition(min(blocks, 10_000), "block").sortWithinPartitions("block", "u").write.partitionBy("block").parquet(home)
    offers = stored(start.select(F.col("node").cast("long").alias("to"), F.col("cost").cast("long").alias("offer")).withColumn("block", _blocks(bounds, F.col("to"))), "offers")
    out = "block int, node long, cost long, kind int"
    local = lambda p: p.removeprefix("file:") if p.startswith("file:/") and not p.startswith("file://") else p
    rounds = 0

    def settle(f):
        import pandas as pd

        b = int(f["block"].iloc[0])
        u, v, w = _column(f"{local(home)}/block={b}", ["u", "v", "w"])
        known = [_column(f"{local(log)}/round={r}/block={b}", ["node", "cost"]) for r in range(done)]
        seen, cost = (np.concatenate([k[i] for k in known]) if known else np.zeros(0, np.int64) for i in (0, 1))
        own = np.searchsorted(bounds, v, side="right") == b
        node, now = settled(u[own], v[own], w[own], seen, cost, f["to"].to_numpy(), f["offer"].to_numpy())
        i = np.searchsorted(node, u[~own])
        hit = (i < len(node)) & (node[np.minimum(i, max(0, len(node) - 1))] == u[~own]) if len(node) else np.zeros(int((~own).sum()), bool)
        to, offer = v[~own][hit], now[i[hit]] + w[~own][hit] if len(node) else np.zeros(0, np.int64)
        return pd.concat([pd.DataFrame({"block": b, "node": node, "cost": now, "kind": 0}), pd.DataFrame({"block": np.searchsorted(bounds, to, side="right"), "node": to, "cost": offer, "kind": 1})], ignore_index=True)

    while True:
        done = rounds
        few = offers.groupBy("block", "to").agg(F.min("offer").alias("offer"))
        both, facts = measured(few.groupBy("block").applyInPandas(settle, out), "settled", changed=F.count_if(F.col("kind") == 0), offers=F.count_if(F.col("kind") == 1))
        discard(offers)
        both.where("kind = 0").select("node", "cost", "block").repartition("block").write.partitionBy("block").parquet(f"{log}/round={rounds}")
        offers = stored(both.where("kind = 1").select(F.col("node").alias("to"), F.col("cost").alias("offer"), "block"), "offers")
        discard(both)
        rounds += 1
        if not facts["offers"]:
            break
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"offers are left after {max_rounds} rounds")
    changes = spark.read.schema("node long, cost long, round int, block int").parquet(log)
    return changes.groupBy("node").agg(F.min("cost").alias("cost")), rounds


def _blocks(bounds: np.ndarray, node) -> object:
    """The block of a node: how many bounds do not exceed it, by halving."""

    def find(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(node >= F.lit(int(bounds[mid])), find(mid + 1, high)).otherwise(find(low, mid))

    return find(0, len(bounds)).cast("int")
