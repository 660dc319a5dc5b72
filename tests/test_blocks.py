"""Least costs by blocks against a plain search, for blocks of any size and long chains."""

import heapq
import random
import time

import numpy as np
import pytest

from linkweave.operators import blocks, graph


def plain(edges, starts):
    out, best = {}, [(c, n) for n, c in starts]
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
    heapq.heapify(best)
    while best:
        c, n = heapq.heappop(best)
        if n not in out:
            out[n] = c
            for v, w in near.get(n, ()):
                heapq.heappush(best, (c + w, v))
    return out


@pytest.mark.parametrize("size", [10, 70, 100_000])
def test_least_costs(spark, size):
    rng = random.Random(size)
    edges = [(rng.randint(-50, 50), rng.randint(-50, 60), rng.randint(0, 4)) for _ in range(220)] + [(1, 2, 3), (1, 2, 0), (5, 5, 1)]
    starts = [(1, 0), (1, 7), (40, 2), (999, 5)]
    got, rounds = blocks.least_costs(spark.createDataFrame(edges, "u long, v long, w long"), spark.createDataFrame(starts, "node long, cost long"), size)
    assert {r["node"]: r["cost"] for r in got.collect()} == plain(edges, starts)
    assert rounds == 1 if size == 100_000 else rounds > 1


def test_no_start_no_edges(spark):
    e, s = spark.createDataFrame([], "u long, v long, w long"), spark.createDataFrame([], "node long, cost long")
    assert blocks.least_costs(e, s)[0].count() == 0
    assert [tuple(r) for r in blocks.least_costs(e, spark.createDataFrame([(3, 1)], s.schema))[0].collect()] == [(3, 1)]
    none = np.zeros(0, np.int64)
    assert len(blocks.settled(none, none, none, none, none, none, none)[0]) == 0


def test_chain_of_ten_thousand(spark):
    """A chain along the source takes a round for each block; one against it has a pass for each article."""
    n = 10_000
    rows = [(i, f"{i}", f"t{i}", 1.0, [f"t{i + 1}"]) for i in range(n)]
    a = spark.createDataFrame(rows, "seq long, id string, title string, byte_length double, links array<string>")
    t = time.time()
    got = graph.tier_passes(a, edges_a_block=2500)
    assert got.count() == n and got.where("pass = 0").count() == n
    back = spark.createDataFrame([(0, "0", "t0", 1.0, [f"t{n - 1}"]), *[(i, f"{i}", f"t{i}", 1.0, [f"t{i - 1}"]) for i in range(1, n)]], a.schema)
    deep = {r["seq"]: r["pass"] for r in graph.tier_passes(back, edges_a_block=2500).collect()}
    assert deep == {i: 0 if i in (0, n - 1) else n - 1 - i for i in range(n)}
    assert time.time() - t < 240
    with pytest.raises(RuntimeError):
        graph.tier_passes(a, max_rounds=2, edges_a_block=2500)
