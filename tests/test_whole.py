"""Queries over all of their input, against brute force on the smallest tables."""

import pytest

from linkweave.plans import fixtures as X
from linkweave.plans.catalog import QUERIES

from .conftest import SF
from .test_operators import fnv, slow_dense


@pytest.fixture(scope="module")
def links(duck):
    """All distinct edges of the tables, as numbers."""
    return [(int(a), int(b)) for a, b in duck.execute(f"{X.with_edges(False)} SELECT src, dst FROM edges").fetchall()]


def neighbours(links):
    near = {}
    for a, b in links:
        near.setdefault(str(a), set()).add(str(b))
        near.setdefault(str(b), set()).add(str(a))
    return near


def test_components_of_all_links(spark, links):
    near, want = neighbours(links), {}
    for s in sorted(near):
        todo = [s] if s not in want else []
        for a in todo:
            if want.setdefault(a, s) == s:
                todo += [b for b in near[a] if b not in want and b not in todo]
    assert dict(map(tuple, QUERIES["components_min_label"](spark, SF).collect())) == want


def test_connected_order_of_all_links(spark, links):
    near = neighbours(links)
    k = lambda i: (fnv(i), i)
    want, seen = [], set()
    for s in sorted(near, key=k):
        todo = [s] if s not in seen else []
        seen.add(s)
        for a in todo:
            want.append(a)
            new = [b for b in sorted(near[a], key=k) if b not in seen]
            seen.update(new)
            todo += new
    assert [r["id"] for r in QUERIES["j3_j9_connected_order"](spark, SF).orderBy("pos").collect()] == want


def test_dense_core_of_all_links(spark, duck, links):
    ids = [r[0] for r in duck.execute("SELECT p_partkey FROM part").fetchall()]
    deg = {i: 2 * sum(a == i for a, _ in links) + sum(b == i for _, b in links) for i in ids}
    pool = [str(i) for i in sorted(ids, key=lambda i: (-deg[i], fnv(str(i)), str(i)))[:400]]
    want = slow_dense(set(pool), [(str(a), str(b)) for a, b in links], 50)
    assert [r["id"] for r in QUERIES["j4_dense_core"](spark, SF).orderBy("pos").collect()] == want


def test_tier_passes_of_all_links(spark, duck, links):
    seqs = sorted(r[0] for r in duck.execute("SELECT p_partkey FROM part").fetchall())
    start = duck.execute(f"WITH {X.refs_sql(False)} SELECT min(seq) FROM raw").fetchone()[0]
    to = {}
    for a, b in links:
        to.setdefault(a, set()).add(b)
    want, frontier, pass_, size = {start: 0}, set(to.get(start, ())), 0, 0
    scan = [s for s in seqs if s > start]
    while len(want) > size:
        size = len(want)
        for s in scan:
            if s in frontier and s not in want:
                want[s] = pass_
                frontier |= to.get(s, set())
        pass_, scan = pass_ + 1, seqs
    assert {r["seq"]: r["pass"] for r in QUERIES["j6_tier_passes"](spark, SF).collect()} == want


def test_repulsion_of_all_links(spark, duck, links):
    n = duck.execute("SELECT count(*) FROM part").fetchone()[0]
    want = min(3.0, max(1.0, 2 * len({(min(p), max(p)) for p in links}) / n / 6) ** 0.5)
    assert abs(QUERIES["f3_repulsion_scale"](spark, SF).first()[0] - want) < 1e-6
