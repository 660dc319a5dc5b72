"""The title index against going through all titles; adjacency files against the entries that went in."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.operators import rank
from linkweave.sources import csr, files, titles


def test_title_index(spark, tmp_path):
    rng = random.Random(1)
    rows = [(str(i), " ".join(rng.choice(["Art", "art of", "ÉCOLE", "a  b", "Zürich", "x", "bridge", "Bridges (a)"]) for _ in range(rng.randint(1, 4)))) for i in range(400)] + [("n", None), ("e", ""), ("t", "art"), ("t", "art")]
    a = spark.createDataFrame(rows, "id string, title string")
    titles.write(a, str(tmp_path / "t"))
    for q in ("art", " ART ", "a", "rt of", "bridges (", "école z", "a b", "xyz", "art of bridge", "", "   ", "%", "é", "t of a"):
        want = [tuple(r) for r in rank.search(a, q, 15).collect()]
        assert [tuple(r) for r in titles.search(spark, str(tmp_path / "t"), q, 15).collect()] == want, q
    plan = titles.search(spark, str(tmp_path / "t"), "art of")._jdf.queryExecution().toString()
    assert "EqualTo(gram," in plan or "PushedFilters: [IsNotNull(gram)" in plan
    titles.write(a.limit(0), str(tmp_path / "none"))
    assert titles.search(spark, str(tmp_path / "none"), "art").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    e = np.unique(np.stack([rng.integers(-5, 40, 3000) * (1 if seed else 10**15), rng.integers(-(10 ** (3 * seed)), 10 ** (4 * seed) + 2, 3000)]), axis=1)
    for part in (e, e[:, :1], e[:, -7:]):
        node, t = csr.decoded(csr.encoded(part[0], part[1]))
        assert np.array_equal(node, part[0]) and np.array_equal(t, part[1])


def test_adjacency_files(spark, tmp_path):
    """A hub spans blocks; ranges read their own bytes; nulls and repeated edges are passed over; no edges give an empty table."""
    rng = random.Random(2)
    rows = [(7, i) for i in range(3000)] + [(rng.randint(0, 500), rng.randint(0, 500)) for _ in range(2000)] + [(1, None), (None, None), (7, 1), (7, 7)]
    facts = csr.write(spark.createDataFrame(rows, "src long, dst long"), str(tmp_path / "g"), 256)
    want = sorted({(a, b) for a, b in rows if a is not None and b is not None} | {(b, a) for a, b in rows if a is not None and b is not None})
    assert facts["entries"] == len(want) and facts["bytesAnEntry"] < 4 and files.read_json(str(tmp_path / "g" / "meta.json")) == facts
    assert sorted(map(tuple, csr.read(spark, str(tmp_path / "g")).collect())) == want
    for low, high in ((7, 7), (100, 120), (2999, None), (None, 3), (5000, 6000)):
        got = sorted(map(tuple, csr.read(spark, str(tmp_path / "g"), low, high).collect()))
        assert got == [(a, b) for a, b in want if (low is None or a >= low) and (high is None or a <= high)]
    assert csr.write(spark.createDataFrame([], "src long, dst long"), str(tmp_path / "none"))["bytesAnEntry"] == 0
    assert csr.read(spark, str(tmp_path / "none")).count() == 0


def test_nearest_and_relations(spark):
    from linkweave.operators import graph, layout

    p = spark.createDataFrame([(i, float(i * i), 0.0) for i in range(8)], "idx long, x double, y double")
    got = {(r["i"], r["k"]): r["j"] for r in layout.nearest(p, 30.0, 2).collect()}
    assert got[0, 1] == 1 and got[3, 1] == 2 and got[3, 2] == 4 and (7, 2) in got
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert {r["id"]: r["linked"] for r in graph.linked_with(n, e, n.where("id = 'b'")).collect()} == {"a": True, "b": False, "c": False}
    assert tuple(graph.averages(n, e, F.col("id") != "c").first()) == (2 / 3, 2) and graph.averages(n.limit(0), e.limit(0), F.lit(True)).first()[0] == 0
