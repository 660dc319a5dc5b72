"""Sums and tables over pairs by chunks against all pairs one by one: crowded and lonely places, nodes at one place, the plane and space."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave import storage
from linkweave.functions import layout as L
from linkweave.functions.layout import Settings
from linkweave.operators import chunks, layout


def placed(n, over, seed=3):
    r = random.Random(seed)
    at = [tuple(r.gauss(0, 40) for _ in over) for _ in range(n - 3)] + [(1e4,) * len(over)] + [(7.0,) * len(over)] * 2
    return [(k, *(float(v) for v in p), 1.0 + k % 5) for k, p in enumerate(at)]


@pytest.mark.parametrize("over", [["x", "y"], ["x", "y", "z"]])
def test_pairs_and_sums(spark, over):
    rows = placed(300, over)
    n = spark.createDataFrame([*rows, (999, *[None] * len(over), 1.0)], "idx long, " + "".join(f"{c} double, " for c in over) + "r double")
    off = {(i, j): spark.range(1).select(F.expr(L.jiggle(f"{i}L", f"{j}L"))).first()[0] for i, j in ((298, 299), (299, 298))}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] != b[0]:
                way = [b[1 + k] - a[1 + k] for k in range(len(over))]
                if (a[0], b[0]) in off:
                    way[0] = off[a[0], b[0]]
                want[a[0], b[0]] = way, math.sqrt(sum(w * w for w in way))
    got = {(r["i"], r["j"]): r for r in chunks.pairs(n, over, 25.0, chunk=40).collect()}
    assert got.keys() == {k for k, (_, d) in want.items() if d <= 25.0} and (298, 299) in got
    assert all([r[f"d{c}"] for c in over] == pytest.approx(want[k][0]) and r["d"] == pytest.approx(want[k][1]) for k, r in got.items())
    for own, near in ((None, lambda a, b, d: d <= 25.0), ("r", lambda a, b, d: d < rows[a][-1] + rows[b][-1])):
        law = lambda d, a, b: b["r"] / np.maximum(d, 1.0)
        s = chunks.sums(n, over, law, ["r"], reach=None if own else 25.0, own=own, chunk=40)
        s = {r["idx"]: r for r in s.groupBy("idx").agg(*[F.sum(f"i{c}").alias(c) for c in over], F.sum("n").alias("n")).collect()}
        for i, *_ in rows:
            mine = [(j, w, d) for (k, j), (w, d) in want.items() if k == i and near(i, j, d)]
            assert (s[i]["n"] if i in s else 0) == len(mine)
            for k, c in enumerate(over):
                if mine:
                    assert s[i][c] == pytest.approx(sum(rows[j][-1] / max(d, 1.0) * w[k] for j, w, d in mine), abs=1e-9)


def test_unrelated_without_a_budget_takes_all_in_range(spark):
    """From 2000 nodes on, too; and 420 stays the reach."""
    r = random.Random(1)
    rows = [(k, r.uniform(0, 2000), r.uniform(0, 2000), k % 50 == 0) for k in range(2100)]
    edges = [(k, (k + 1) % 2100) for k in range(2100)]
    n, e = spark.createDataFrame(rows, "idx long, x double, y double, hub boolean"), spark.createDataFrame(edges, "a long, b long")
    got = {x["idx"]: (x["dvx"], x["dvy"]) for x in layout.unrelated(n, e, Settings(unrelated_budget=0), 0.5).where("idx < 40").collect()}
    linked = set(edges) | {(b, a) for a, b in edges}
    for i, x, y, hub in rows[:40]:
        if hub:
            continue
        f = [0.0, 0.0]
        for j, u, v, other in rows:
            d = math.hypot(u - x, v - y)
            if not other and i != j and d <= 420 and (i, j) not in linked:
                k = min(14, 40 / max(28, d) * (1 - d / 420)) * 0.5 / d
                f[0] -= k * (u - x)
                f[1] -= k * (v - y)
        assert got[i] == pytest.approx(f, abs=1e-6)


def test_pairs_leave_chunks_only(spark):
    """Of what pairs are made from, one copy of the nodes stays on disk, and no pair is stored."""
    import os

    home = storage.root(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(home))
    nodes = spark.range(300).selectExpr("id AS idx", "id % 20 * 1D AS x", "floor(id / 20) * 1D AS y")
    assert chunks.pairs(nodes, ["x", "y"], 1.0, chunk=64).count() == 2 * (19 * 15 + 20 * 14)
    assert {n.split("-")[0] for n in set(os.listdir(home)) - before} == {"chunks", "boxes"}
