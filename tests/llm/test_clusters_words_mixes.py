"""Centroid clustering, spelling variants and source mixing on odd tables and against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.llm import centroids, mixing, spelling

from .test_llm import ODD, docs

VEC = "vec_id long, embedding array<float>, cluster int, v string, norms string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 7, "mine", "mine") for i, x in rows], VEC)


def test_nearest_is_exact_and_screens():
    rng = np.random.default_rng(1)
    c = rng.integers(-300, 300, (16, 64)).astype(np.int64)
    x = np.concatenate([c[rng.integers(0, 16, 400)] + rng.integers(-9, 9, (400, 64)), c[:2], (c[:1] + c[1:2]) // 2, np.zeros((1, 64), np.int64)])
    own = np.sqrt(np.add.reduceat(x.astype(float) ** 2, np.arange(0, 64, centroids.BLOCK), axis=1))
    at, d, tried = centroids.nearest(x, own, np.concatenate([c, c[:3]]))  # repeated centroids: the smaller number
    want = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert at.tolist() == want.argmin(axis=1).tolist() and d.tolist() == want.min(axis=1).tolist()
    assert tried < 0.5 * len(x) * 19


def test_vectors_with_odd_rows(spark):
    """Kept rows only; null and repeated ids, ties and huge components; other columns with the operator's names."""
    one = [0.5] * 64
    rows = [(1, one), (2, one), (2, one), (None, [0.25] * 64), (3, None), (4, one[:63]), (5, [None] + one[1:]), (6, [float("nan")] + one[1:]), (7, [float("inf")] + one[1:]), (8, [3e38] * 64), (9, [])]
    got = centroids.cluster(vectors(spark, rows), k=2, rounds=3).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(["1", "2", "2", "None", "8"])
    assert len({(r["cluster"], r["distance"]) for r in got if r["vec_id"] in (1, 2)}) == 1
    assert all(r["distance"] >= 0 for r in got)
    assert centroids.cluster(vectors(spark, [])).count() == 0
    few = centroids.cluster(vectors(spark, rows[:1])).first()
    assert (few["cluster"], few["distance"], few["inertia"]) == (0, 0, 0)


def test_one_edit():
    words = ["abcdefg", "abcdefgh", "abcdef", "abcxefg", "aabcdefg", "bbcdefg", "abcdegf", "abcdefg"]
    for s, t in itertools.product(words, words):
        if len(s) <= len(t):
            same = len(s) == len(t) and sum(a != b for a, b in zip(s, t)) == 1
            longer = any(t[:i] + t[i + 1 :] == s for i in range(len(t)))
            assert spelling.one_edit(s, t) == (same or (len(t) == len(s) + 1 and longer)), (s, t)


def brute_near(words):
    return {(s, t) for s, t in itertools.combinations(sorted(words), 2) if spelling.one_edit(*sorted((s, t), key=len))}


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
def test_near_words(spark, block):
    """All near pairs once in both directions, also where every group is dealt out in blocks; repeated letters and a very long word."""
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(n)) for n in (7, 7, 7, 8, 8, 9, 10) for _ in range(40)} | {"éclairs", "éclair" + "ß", "eclairs", "x" * 5000, "x" * 5001, "x" * 4999 + "y", "ÀÀÀÀÀÀÀ", "ÀÀÀÀÀÀÀÀ"}
    df = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(sorted(words))], "word string, n long")
    n = {r["word"]: r["n"] for r in df.collect()}
    got = [(r["word"], r["other"], r["other_n"]) for r in spelling.near_words(df, block).collect()]
    want = brute_near(words)
    assert len(got) == len(set(got)) == 2 * len(want)
    assert {(a, b) for a, b, _ in got} == want | {(b, a) for a, b in want} and all(n[b] == c for _, b, c in got)


def test_variants_brute(spark):
    """Counts, altered occurrences, forms with ties and chains, by the definition."""
    text = "commonly " * 300 + "commonla " * 20 + "commonle " * 20 + "ommonle Ommonle " + "COMMONLY naïveté÷ 1234567 " + "tieword " * 2 + "tiewordx " * 30 + "tiewordy " * 30
    rows = ODD + [(11, text), (12, text), (13, "short word sh"), (None, "commonly nullids nullids"), (11, text)]
    d = docs(spark, rows).withColumns({c: F.lit("mine") for c in ("word", "n", "key")})
    count: dict[str, int] = {}
    for i, t in rows:
        run = ""
        for ch in [*(t or ""), " "]:
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                w = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                count[w] = count.get(w, 0) + 1
                run = ""
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near: dict[str, list] = {w: [] for w in count}
    for a, b in brute_near(count):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best and count[best] >= 10 * count[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    want = {w: (form[w], root(w), count[w], len(near[w]), count[form[w]] if form[w] else None) for w in count}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(d).collect()}
    assert got == want
    assert any(f and form[f] for f in form.values())  # a chain of two forms
    assert spelling.variants(docs(spark, [])).count() == 0


def test_roots_of_long_chains(spark):
    f = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w30")], "word string, form string")
    assert {r["root"] for r in spelling.roots(f).collect()} == {"w37"} and spelling.roots(f).count() == 38


@pytest.mark.parametrize("schedule", mixing.SCHEDULES + (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.25, 4.0), (1.0, 0.0))))
def test_schedule_is_inverted(spark, schedule):
    """The share of a schedule's integral up to the time reached is the share asked for."""
    grid = np.linspace(0, 1, 200_001)
    v = np.interp(grid, *zip(*schedule))
    c = np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 2)])
    c /= c[-1]
    got = spark.range(1, 100).select((F.col("id") / 100).alias("u")).withColumn("t", mixing.reached(F.col("u"), schedule)).collect()
    for r in got:
        assert abs(np.interp(r["t"], grid, c) - r["u"]) < 1e-6


def want_targets(sizes, weights, passes):
    left = {s: weights[k % len(weights)] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    out, rest = {}, sum(sizes.values())
    while True:
        w = sum(left.values())
        over = [s for s in left if left[s] * rest > passes * sizes[s] * w]
        if not over:
            return out | {s: left[s] * rest / w for s in left}
        for s in over:
            out[s] = passes * sizes[s]
        rest = sum(sizes.values()) - sum(out.values())
        left = {s: w for s, w in left.items() if s not in out}


def test_mixing(spark):
    """Targets by the definition with several rounds of limits, words taken as the targets rounded, nothing over three times, all in order of time."""
    rng = random.Random(5)
    rows = [(k, "w " * rng.randint(0, 40), "en", s, 0) for k, s in enumerate(["a"] * 3 + ["b"] * 200 + ["c"] * 9 + ["d"] * 2 + [None] * 40 + ["é"] * 5 + ["empty"] * 2)] + [(None, "null id", "en", "b", 0), (7, "same id", "en", "b", 0), (7, "same id", "en", "b", 0), (500, None, "en", "c", 0), (501, "x " * 30_000, "en", "z", 0)]
    rows = [(i, "" if s == "empty" else t, l, s, n) for i, t, l, s, n in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in ("nr", "size", "target", "taken", "w", "part")})
    size: dict = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    documents, placed = mixing.mix(d)
    own = {(r["source"], r["target"]) for r in documents.collect()}
    want = want_targets(size, (5, 2, 1), 3)
    assert {s: round(t, 6) for s, t in own} == {s: round(t, 6) for s, t in want.items()} and len(own) == len(size)
    assert abs(sum(want.values()) - sum(size.values())) < 1e-6
    m = placed.collect()
    taken = {s: sum(r["words"] for r in m if r["source"] == s) for s in size}
    assert taken == {s: round(t) for s, t in want.items()}
    got = mixing.digest(documents, placed).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    place = [r["position"] for r in m]
    assert min(place) >= 0 and max(place) <= 1
    for p in placed.select(F.spark_partition_id().alias("p"), "position").groupBy("p").agg(F.min("position").alias("a"), F.max("position").alias("b")).orderBy("a").collect():
        assert p["a"] <= p["b"]
    heavy = sorted(r["position"] for r in m if r["source"] == "b")  # weighs 2: most of it in the middle
    assert sum(0.25 < x < 0.75 for x in heavy) > 0.55 * len(heavy)
    again = mixing.digest(*mixing.mix(d)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.digest(*mixing.mix(d.where("doc_id < 0"))).count() == 0


def test_mixing_of_odd_documents(spark):
    got = mixing.digest(*mixing.mix(docs(spark))).collect()
    assert len(got) == len(ODD) and sum(r["taken"] for r in got) == sum(r["size"] for r in got)
    none = mixing.digest(*mixing.mix(docs(spark, [(1, None), (2, "")]))).collect()
    assert [(r["size"], r["target"], r["taken"], r["position"]) for r in none] == [(0, 0.0, 0, None)] * 2
