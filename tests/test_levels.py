"""Breadth-first orders by contracted chains against a plain walk, on graphs of every shape."""

import random

import pytest

from linkweave.operators import graph, levels

from .test_whole import fnv


def walked(edges):
    """[(id, level)] in breadth-first order, components by their smallest member by (hash, id)."""
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    k = lambda i: (fnv(i), i)
    out, seen = [], {}
    for s in sorted(near, key=k):
        todo = [s] if s not in seen else []
        seen.setdefault(s, 0)
        for a in todo:
            out.append((a, seen[a]))
            new = sorted((b for b in near[a] if b not in seen), key=k)
            seen.update(dict.fromkeys(new, seen[a] + 1))
            todo += new
    return out


def shapes():
    r = random.Random(3)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(300)]
    ring = [(f"r{i}", f"r{(i + 1) % 41}") for i in range(41)]
    tree = [(f"t{i}", f"t{r.randrange(i)}") for i in range(1, 120)]
    ladder = [(f"l{i}", f"l{i + 2}") for i in range(40)] + [(f"l{i}", f"l{i + 1}") for i in range(0, 40, 2)]
    loops = [(f"o{7 * i}", f"o{7 * i + 7}") for i in range(12)] + [(f"o{7 * i + j}", f"o{7 * i + j + 1}") for i in range(12) for j in range(7)]
    dense = [(f"d{r.randrange(60)}", f"d{r.randrange(60)}") for _ in range(150)]
    return {"chain": chain, "ring": ring, "tree": tree, "ladder": ladder, "loops": loops, "dense": dense, "all": chain + ring + tree + loops + dense + [("p", "q"), ("q", "p"), ("p", "p")]}


@pytest.mark.parametrize("shape", ["ring", "ladder", "all"])
def test_order_of_shapes(spark, shape):
    edges = shapes()[shape]
    got = graph.connected_order(spark.createDataFrame(edges, "src string, dst string")).orderBy("pos").collect()
    assert [(r["id"], r["level"]) for r in got] == walked(edges)
    assert [r["pos"] for r in got] == list(range(1, len(got) + 1))


def test_order_of_nothing(spark):
    assert graph.connected_order(spark.createDataFrame([("a", "a"), (None, "b")], "src string, dst string")).count() == 0


def test_chain_takes_jobs_by_the_logarithm_of_its_depth(spark, monkeypatch):
    """Jobs of a chain of 2000 nodes; a job a level would be over 2000."""
    sc, n = spark.sparkContext, 2000
    sc.setJobGroup("deep", "a chain")
    edges = spark.range(n).selectExpr("'c' || id AS src", "'c' || (id + 1) AS dst")
    got = graph.connected_order(edges).orderBy("pos").collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("deep"))
    sc.setJobGroup("", "")
    assert [(r["id"], r["level"]) for r in got] == walked([(f"c{i}", f"c{i + 1}") for i in range(n)])
    assert jobs < 500


def test_arcs_through_chains(spark):
    """a - 1 - 2 - b, and a loop a - 3 - 4 - a."""
    p = [(10, 1), (1, 2), (2, 20), (10, 3), (3, 4), (4, 10)]
    arcs = spark.createDataFrame(p + [(b, a) for a, b in p], "u long, v long")
    inner = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "u long")
    got = {(r["a"], r["b"]): (r["y"], r["n"]) for r in levels.through_chains(arcs, inner).collect()}
    assert got == {(10, 1): (20, 3), (20, 2): (10, 3), (1, 2): (20, 2), (2, 1): (10, 2), (10, 3): (10, 3), (10, 4): (10, 3), (3, 4): (10, 2), (4, 3): (10, 2)}
