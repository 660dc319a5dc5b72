"""Charge by blocks that lie apart, the nearest by chunks, and what a tick costs, against plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.functions.layout import Settings
from linkweave.operators import chunks, layout


def test_charge_by_blocks_is_the_sum_over_pairs(spark):
    """Crowded and lonely places, equal ones, and a reach that cuts through blocks; few pairs are gone through one by one."""
    r = np.random.default_rng(5)
    at = np.concatenate([r.normal(0, 375, (2400, 2)), r.normal((900, -700), 0.3, (300, 2)), r.uniform(-4000, 4000, (294, 2)), [[1e6, 0.0]], [[7.0, 7.0]] * 2, [[7.0, 7.5]] * 2, [[-2000.0, 30.0]]])
    n = len(at)
    nodes = spark.createDataFrame([(k, float(x), float(y), k % 10 / 10) for k, (x, y) in enumerate(at)], "idx long, x double, y double, importance double")
    edges = spark.createDataFrame([(0, 1)], "a long, b long")
    got = {row["idx"]: (row["dvx"], row["dvy"]) for row in layout.charge(nodes, edges, Settings(), 0.8).collect()}
    reach, q = 480 * min(2.5, (n / 250) ** 0.25), -(115 + 126 * (np.arange(n) % 10 / 10)) * 0.8
    way = at[None, :, :] - at[:, None, :]
    i, j = np.nonzero((way == 0).all(2))
    way[i, j, 0] = np.where(i == j, np.inf, chunks.jiggled(i, j))
    d = np.hypot(way[..., 0], way[..., 1])
    f = np.where(d <= reach, q[None, :] / np.maximum(d * d, 1), 0.0)[..., None] * np.where(np.isfinite(way), way, 0.0)
    want, size = f.sum(1), np.abs(f).sum(1)
    near = (d <= reach).any(1)
    assert got.keys() == set(np.flatnonzero(near).tolist())
    assert all(abs(got[k][c] - want[k, c]) <= 1e-12 * size[k, c] + 1e-12 for k in got for c in (0, 1))


def test_few_pairs_are_gone_through_one_by_one():
    """Four times the nodes take less than ten times the pairs, not sixteen, and 40 000 less than a fifth of all."""
    r, took = np.random.default_rng(2), []
    for n in (10_000, 40_000):
        t, box = chunks.blocks({"idx": np.arange(n), "x": r.normal(0, 375, n), "y": r.normal(0, 375, n)}, ["x", "y"])
        far, _ = chunks.apart(box, box, 1200.0)
        single = (chunks.gaps(box, box) <= 1200.0**2) & ~far
        took.append(int((single * np.outer(box["n"], box["n"])).sum()))
    assert took[1] < 10 * took[0] and took[1] < 40_000**2 / 5


@pytest.mark.parametrize("chunk", [20, 100, None])
def test_nearest_by_chunks(spark, chunk):
    r = random.Random(9)
    at = [(r.uniform(-300, 300), r.uniform(-300, 300)) for _ in range(150)] + [(40 + r.gauss(0, 0.5), -40 + r.gauss(0, 0.5)) for _ in range(120)] + [(7.0, 7.0)] * 90 + [(100.0 * i, 0.0) for i in range(-3, 4)] + [(1e7, 1e7)]
    r.shuffle(at)
    rows = [(i, x, y, r.choice([0, 1, 3, 3, 9, 200])) for i, (x, y) in enumerate(at)]
    want = {}
    for i, x, y, most in rows:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b, _ in rows if j != i)
        want |= {(i, j): n + 1 for n, (d, j) in enumerate([p for p in near if p[0] ** 0.5 <= 100.0][:most])}
    n = spark.createDataFrame([*rows, (999, None, 0.0, 3)], "idx long, x double, y double, want long").repartition(3)
    got = chunks.nearest(n, ["x", "y"], 100.0, chunk=chunk).collect()
    assert {(g["i"], g["j"]): g["k"] for g in got} == want and len(got) == len(want)
    assert all((g["dx"], g["dy"]) == (at[g["j"]][0] - at[g["i"]][0], at[g["j"]][1] - at[g["i"]][1]) for g in got)


def test_nearest_of_nodes_at_one_place(spark):
    """The others of smallest idx, though all are as near: 20 000 nodes would be 400 million pairs."""
    n = spark.range(20_000).selectExpr("id AS idx", "5D AS x", "6D AS y", "2L AS want")
    got = chunks.nearest(n, ["x", "y"], 100.0)
    assert got.count() == 40_000 and got.where("j > 2 OR (i > 1 AND j <> k - 1)").count() == 0


def test_a_tick_lays_out_its_nodes_once_for_each_state(spark):
    """Counts, links and squares are not made anew by each force: a tick of 2100 nodes ran 180 jobs before."""
    r = random.Random(1)
    rows = [(i, str(i), r.gauss(0, 375), r.gauss(0, 375), 0.0, 0.0, i % 10 / 10, 6.0, i < 10, 0.9 if i < 10 else 0.0) for i in range(2100)]
    nodes = spark.createDataFrame(rows, "idx long, id string, x double, y double, vx double, vy double, importance double, radius double, hub boolean, hub_score double")
    edges = nodes.select(F.col("idx").alias("a"), F.explode(F.array(F.lit(1), F.lit(7), F.lit(31))).alias("o")).select("a", F.expr("(a + o) % 2100").alias("b"))
    spark.sparkContext.setJobGroup("one tick", "one tick")
    try:
        out = layout.tick(nodes, edges, Settings(), 0.8).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one tick"))
    assert len(out) == 2100 and jobs < 150, jobs


def test_work_is_dealt_out_in_tiles(spark):
    """Each pair of chunks in reach is in one item, in order, and an item reads few chunks for the pairs it has."""
    nodes = spark.range(6000).selectExpr("id AS idx", "CAST(id % 77 AS DOUBLE) AS x", "CAST(id div 77 AS DOUBLE) AS y")
    _, items = chunks.work(nodes, ["x", "y"], 1000.0, chunk=50)
    rows = [[(p["a"], p["b"]) for p in r["pairs"]] for r in items.collect()]
    every = sorted(p for r in rows for p in r)
    n = len({a for a, _ in every})
    assert every == [(a, b) for a in range(n) for b in range(n)] and n >= 120 and all(r == sorted(r) for r in rows)
    assert all(len({a for a, _ in r}) <= chunks.TILE and len({b for _, b in r}) <= chunks.TILE for r in rows) and len(rows) < n * n / 16
