"""What a set is indexed under: units by cost, and whether sets that link always meet."""

import random

import numpy as np
import pytest

from linkweave.llm import jaccard

from .test_llm import docs


def orders(seed):
    """Orders of all bands from costs at random, some segments hot and neighbourhoods cheap or dear."""
    rng = np.random.default_rng(seed)
    out = {}
    for band in range(0, 12):
        n = jaccard.segments(band)
        held = rng.integers(1, 100, n)
        out[band] = jaccard.allocation(np.stack([held, rng.pareto(0.5, n) * 100, np.maximum(1, held // 2), held * rng.integers(1, 4, n), rng.pareto(0.5, n) * 100]), int(rng.integers(1, 50)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_sets_that_link_meet_under_any_costs(seed):
    rng, order = random.Random(seed), orders(seed)
    for n in (1, 2, 5, 9, 10, 30, 64, 127, 128, 200, 513, 1500):
        for _ in range(12):
            pool = rng.sample(range(1 << 62), 2 * n)
            a, b = set(pool[:n]), set(pool[:n])
            while True:  # as far apart as a link allows
                grown = b | {pool[n + len(b - a)]} if rng.random() < 0.5 else b - {rng.choice(sorted(b & a))} if len(b & a) > 1 else b
                if grown == b or 100 * len(a & grown) < 80 * len(a | grown):
                    break
                b = grown
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            assert len(np.intersect1d(jaccard.signatures(x, order), jaccard.signatures(y, order))), (n, len(a & b), len(a | b))


def test_order_of_units():
    """A segment comes before its neighbourhood; a cheap neighbourhood before a dear segment; ties by level and segment."""
    sums = np.array([[10, 10, 10, 10], [0, 0, 1e6, 0], [5, 5, 5, 0], [10, 10, 10, 0], [0, 1e7, 0, 0]], float)
    first, second = jaccard.allocation(sums, 1)
    assert first[:2].tolist() == [0, 1] and first[3] == 2 and (first < second).all()
    assert second[0] < first[2] < second[1]


def passage_texts(seed=4):
    """Texts of their own words that share one long passage, and some near copies."""
    rng = random.Random(seed)
    shared = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(rng.randint(70, 80))) + " " + shared for _ in range(300)]
    for i in range(0, 60, 2):
        w = texts[i].split()
        w[rng.randint(0, 9)] = "changed"
        texts[i + 1] = " ".join(w)
    return texts


def test_neighbourhoods_are_chosen_where_segments_are_hot(monkeypatch):
    """Where many sets share a segment, sets take the neighbourhood of another one instead; fewer pairs come up, and the links stay."""
    sets = jaccard.shingle_sets(passage_texts())
    costs = jaccard.Costs()
    for s in sets:
        costs.add(s)
    costs.flush()
    order = {band: jaccard.allocation(x, 1000) for band, x in costs.sums.items()}  # as if of a corpus a thousand times as large
    exact = {band: (np.argsort(np.argsort(np.concatenate([a, b])[: len(a)])), len(a) + np.arange(len(a))) for band, (a, b) in order.items()}  # the same costs, segments only
    deep = 0
    for s in sets:
        for band, most in jaccard.roles(len(s)):
            seg, _, own, _ = jaccard.segment_sums(s, band)
            place, _, level = jaccard._units(own, np.bincount(np.searchsorted(own, seg)), band, order)
            deep += int((level[np.argsort(place)[: most + 1]] == 2).sum())
    assert deep > len(sets)

    def pairs(order):
        by = {}
        for i, s in enumerate(sets):
            for g in jaccard.signatures(s, order).tolist():
                by.setdefault(g, []).append(i)
        return {(a, b) for m in by.values() for k, a in enumerate(m) for b in m[k + 1 :]}

    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    few, many = pairs(order), pairs(exact)
    assert len(links) >= 30 and links <= few and links <= many and len(few) < len(many)


def test_costs_count_as_defined(monkeypatch):
    """Rows and colliding pairs of segments and neighbourhoods, chunk by chunk, against counting them one by one."""
    monkeypatch.setattr(jaccard, "CHUNK", 40)
    sets = jaccard.shingle_sets(passage_texts()[:90])
    costs = jaccard.Costs()
    for s in sets:
        costs.add(s)
    costs.flush()
    assert costs.chunks == 3
    for band, got in costs.sums.items():
        want = np.zeros_like(got)
        for at in range(0, 90, 40):
            one, both = {}, {}
            for s in sets[at : at + 40]:
                if band not in [b for b, _ in jaccard.roles(len(s))]:
                    continue
                seg, m, own, total = jaccard.segment_sums(s, band)
                for g, t in zip(own.tolist(), total):
                    inner = m[seg == g]
                    want[0, g] += 1
                    one[g, int(t)] = one.get((g, int(t)), 0) + 1
                    both[g, int(t)] = both.get((g, int(t)), 0) + 1
                    if len(inner) > 1:
                        want[2, g] += 1
                        want[3, g] += len(inner)
                        for x in inner:
                            k = (g, (int(t) - int(x)) % 2**64)
                            both[k] = both.get(k, 0) + 1
            for (g, _), c in one.items():
                want[1, g] += c * (c - 1) / 2
                want[4, g] -= c * (c - 1) / 2
            for (g, _), c in both.items():
                want[4, g] += c * (c - 1) / 2
        assert np.array_equal(got, want)


def test_links_do_not_depend_on_costs(spark, monkeypatch):
    rows = list(enumerate(passage_texts()))
    got = sorted(map(tuple, jaccard.near_duplicates(docs(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()))
    monkeypatch.setattr(jaccard, "PAIR", 1e6)
    assert got == sorted(map(tuple, jaccard.near_duplicates(docs(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()))
    assert sum(a != c for a, _, c in got) == 30
