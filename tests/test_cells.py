"""Nearest neighbours by a quadtree against all pairs, with clumps, equal places and nodes far off."""

import random

import pytest

from linkweave.functions.layout import Settings
from linkweave.operators import cells, layout

KIND = "idx long, x double, y double"


def slow(rows, reach, k):
    out = set()
    for i, x, y, want in rows:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b, _ in rows if j != i)
        out |= {(i, j, n + 1) for n, (d, j) in enumerate([p for p in near if p[0] ** 0.5 <= reach][:want])}
    return out


@pytest.mark.parametrize("cap", [2, 7, 64])
def test_nearest(spark, cap):
    r = random.Random(cap)
    at = [(r.uniform(-300, 300), r.uniform(-300, 300)) for _ in range(60)] + [(40 + r.gauss(0, 0.5), -40 + r.gauss(0, 0.5)) for _ in range(120)] + [(7.0, 7.0)] * 25 + [(100.0 * i, 0.0) for i in range(-3, 4)] + [(1e7, 1e7)]
    rows = [(i, x, y, r.choice([0, 1, 3, 3, 9])) for i, (x, y) in enumerate(at)]
    got = cells.nearest(spark.createDataFrame(rows, KIND + ", want long").repartition(3), 100.0, 3, cap)
    assert {tuple(x) for x in got.collect()} == slow(rows, 100.0, 3)


def test_nodes_without_a_place_and_none_at_all(spark):
    nan, inf = float("nan"), float("inf")
    n = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 0.0, nan), (4, inf, 0.0), (5, 3.0, 4.0)], KIND)
    assert {tuple(x) for x in cells.nearest(n, 5.0, 2).collect()} == {(1, 5, 1), (5, 1, 1)}
    assert cells.nearest(n.where("idx > 9"), 5.0, 2).count() == 0


def test_a_clump_in_one_square(spark):
    """100 000 nodes in a square as wide as the reach: all pairs would be ten billion."""
    n = spark.range(100_000).selectExpr("id AS idx", "CAST(id % 317 AS DOUBLE) AS x", "CAST(id div 317 AS DOUBLE) AS y")
    got = cells.nearest(n, 512.0, 4)
    inner = got.where("i % 317 BETWEEN 1 AND 315 AND i div 317 BETWEEN 1 AND 313")
    bad = inner.groupBy("i").agg({"*": "count"}).where("`count(1)` <> 4").count() + inner.where("abs(i - j) NOT IN (1, 317)").count()
    assert bad == 0 and got.count() == 400_000


def test_unrelated_takes_the_nearest_unlinked(spark):
    """From 2000 nodes on each node answers to its nearest that no link joins with it."""
    r = random.Random(1)
    rows = [(i, r.uniform(0, 3000), r.uniform(0, 3000), False) for i in range(2100)]
    edges = [(i, r.randrange(2100)) for i in range(2100) for _ in range(2)]
    edges = [e for e in edges if e[0] != e[1]]
    s = Settings(unrelated_budget=2100 * 3)
    got = {x["idx"]: (x["dvx"], x["dvy"]) for x in layout.unrelated(spark.createDataFrame(rows, KIND + ", hub boolean"), spark.createDataFrame(edges, "a long, b long"), s, 0.5).collect()}
    linked = set(edges) | {(b, a) for a, b in edges}
    rho = min(3.0, max(1.0, (2 * len({tuple(sorted(e)) for e in edges}) / 2100 / 6) ** 0.5))
    for i, x, y, _ in rows[:80]:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b, _ in rows if j != i and (i, j) not in linked)[:3]
        want = [0.0, 0.0]
        for d2, j in near:
            d = d2**0.5
            if d <= 480:
                f = min(14.0, 40 * rho / max(28.0, d) * (1 - d / 480)) * 0.5 / d
                want[0] -= f * (rows[j][1] - x)
                want[1] -= f * (rows[j][2] - y)
        assert got[i] == pytest.approx(tuple(want), rel=1e-6, abs=1e-9)
