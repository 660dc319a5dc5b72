"""The dense core is that of all nodes, not of those with most links."""

import random

import numpy as np

from linkweave.operators import graph, peel

from .test_operators import slow_dense


def test_nodes_of_few_links_count(spark):
    """A clique whose nodes have fewer links than a hundred others, which link nothing but dead ends."""
    r = random.Random(3)
    edges = [(f"h{i}", f"leaf{j}") for i in range(108) for j in r.sample(range(20), 8)] + [(f"c{i}", f"c{j}") for i in range(5) for j in range(5) if i != j]
    ids = sorted({x for e in edges for x in e})
    nodes, e = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "seq long, id string"), spark.createDataFrame(edges, "src string, dst string")
    want = slow_dense(set(ids), edges, 2)
    assert [x["id"] for x in graph.dense_order(nodes, e, 2).orderBy("pos").collect()] == want and all(i.startswith("c") for i in want)
    assert all(x["id"].startswith("h") for x in graph.dense_order(nodes, e, 2, pool=102).collect())


def test_peel_of_arrays():
    r = random.Random(5)
    for n, m, want in ((1, 0, 1), (30, 60, 4), (60, 500, 7), (40, 40, 39)):
        links = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)}, key=lambda e: e[1])
        links = [e for e in links if e[0] != e[1]]
        tie = r.sample(range(n), n)
        live = set(range(n))
        while len(live) > want:
            live.remove(min(live, key=lambda i: (sum(a == i and b in live for a, b in links), tie[i])))
        into = np.cumsum([0, *np.bincount([d for _, d in links], minlength=n)]) if links else np.zeros(n + 1, np.int64)
        assert set(peel.peeled(np.array(tie), np.array([s for s, _ in links], np.int32), into, want)) == live
