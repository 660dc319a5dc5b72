"""Order-dependent operators against sequential models, and properties of the layout."""

import random

import pytest
from pyspark.sql import functions as F

from linkweave import api
from linkweave.functions import text as T
from linkweave.functions.layout import Settings
from linkweave.operators import graph, layout, rank
from linkweave.sources import articles as S
from linkweave.streaming import ingest


def fnv(s):
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def random_articles(spark, seed, n=25, m=40):
    r = random.Random(seed)
    links = [[] for _ in range(n)]
    for _ in range(m):
        links[r.randrange(n)].append(str(r.randrange(n + 3)))
    rows = [(i, str(i), f"T{i}", 1.0, x) for i, x in enumerate(links)]
    return rows, spark.createDataFrame(rows, "seq long, id string, title string, byte_length double, links array<string>")


@pytest.mark.parametrize("seed", range(2))
def test_tiers(spark, seed):
    rows, df = random_articles(spark, seed)
    start = next(r[0] for r in rows if r[4])
    got, frontier, pass_ = {start: 0}, set(map(int, rows[start][4])), 0
    changed = True
    scan = [r for r in rows if r[0] > start]
    while changed:
        changed = False
        for r in scan:
            if r[0] in frontier and r[0] not in got:
                got[r[0]] = pass_
                frontier |= set(map(int, r[4]))
                changed = True
        pass_ += 1
        scan = rows
    assert {r["seq"]: r["pass"] for r in graph.tier_passes(df).collect()} == got


@pytest.mark.parametrize("seed", range(2))
def test_connected_order(spark, seed):
    rows, df = random_articles(spark, seed, 20, 16)
    near = {}
    for r in rows:
        for x in r[4]:
            if x != r[1] and int(x) < len(rows):
                near.setdefault(r[1], set()).add(x)
                near.setdefault(x, set()).add(r[1])
    k = lambda i: (fnv(i), i)
    want, seen = [], set()
    for s in sorted(near, key=k):
        if s in seen:
            continue
        seen.add(s)
        queue = [s]
        for a in queue:
            want.append(a)
            for b in sorted(near[a], key=k):
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
    got = [r["id"] for r in graph.connected_order(graph.resolve(df)).orderBy("pos").collect()]
    assert got == want


def test_hubs_and_peel(spark):
    rows, df = random_articles(spark, 5, 40, 80)
    e = graph.resolve(df)
    n = graph.degrees(df.select("id"), e)
    edges = [(r["src"], r["dst"]) for r in e.collect()]
    deg = {r["id"]: r["in_degree"] + r["out_degree"] for r in n.collect()}
    picked = []
    for i in sorted(deg, key=lambda i: (-deg[i], i)):
        if not any((i, p) in edges or (p, i) in edges for p in picked):
            picked.append(i)
    assert [r["id"] for r in graph.hubs(n, e).orderBy("rank").collect()] == picked[: graph.hub_count(40)]
    pool = {i for i, *_ in sorted(((i, 2 * sum(a == i for a, _ in edges) + sum(b == i for _, b in edges), fnv(i)) for i in deg), key=lambda x: (-x[1], x[2], x[0]))[:110]}
    assert [r["id"] for r in graph.dense_order(n.join(df.select("id", "seq"), "id"), e, 10).orderBy("pos").collect()] == slow_dense(pool, edges, 10)


def slow_dense(pool, edges, want):
    """Peel by inner out-degree, degree within the pool, largest id; then breadth first by (hash, id)."""
    inside = [(a, b) for a, b in edges if a in pool and b in pool]
    degree = {i: sum(i in p for p in inside) for i in pool}
    live = set(pool)
    while len(live) > want:
        inner = {i: sum(a == i and b in live for a, b in inside) for i in live}
        least = min((inner[i], degree[i]) for i in live)
        live.remove(max(i for i in live if (inner[i], degree[i]) == least))
    near = {i: {b for a, b in inside if a == i and b in live} | {a for a, b in inside if b == i and a in live} for i in live}
    k, order = lambda i: (fnv(i), i), []
    for s in sorted((i for i in live if near[i]), key=k):
        queue = [s] if s not in order else []
        for a in queue:
            order.append(a)
            queue += [b for b in sorted(near[a], key=k) if b not in order and b not in queue]
    return order + sorted(live - set(order), key=k)


def test_alias_loops(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("t", "u"), ("u", "y"), ("s", "s"), (None, "a")], "src string, dst string")
    assert dict(map(tuple, graph.alias_closure(df).collect())) == {"a": "c", "b": "c", "x": "x", "y": "y", "t": "y", "u": "y", "s": "s"}
    assert dict(map(tuple, graph.alias_closure(df.where("src < 'c'")).collect())) == {"a": "c", "b": "c"}
    assert graph.alias_closure(df.limit(0)).count() == 0


def test_empty_corpus(spark):
    _, df = random_articles(spark, 0)
    none = df.limit(0)
    assert graph.resolve(none).count() == 0 and graph.tier_passes(none).count() == 0
    assert tuple(api.Engine(none).stats().first()) == (0, 0, 0.0)
    with pytest.raises(LookupError):
        api.Engine(none).graph(5)


def test_text(spark):
    row = spark.range(1).select(
        T.title(F.lit("_foo  bar_")).alias("a"), T.title(F.lit("Category: x")).alias("b"), T.title(F.lit("ß")).alias("c"), T.stable_hash(F.lit("é漢😀")).alias("d"), T.stable_hash(F.lit("")).alias("e"),
        T.links(F.lit("[[:a b#c|d]] [[#x]] [[File:y]] [[a_b]]")).alias("f"), T.svg_number(F.lit(-0.0001)).alias("g"), T.energy(F.lit(1234.0)).alias("h"), T.key(F.lit(None).cast("string")).alias("i"),
    ).first()
    assert tuple(row) == ("Foo bar", None, "SS", fnv("é漢😀"), fnv(""), ["A b"], "0", "1.23 kJ", "")


def test_dump(spark, tmp_path):
    import bz2

    page = lambda t, i, x: f"<page><title>{t}</title><ns>0</ns><id>{i}</id><revision><text>{x}</text></revision></page>".encode()
    (tmp_path / "d.xml.bz2").write_bytes(b"".join(bz2.compress(x) for x in [b"<mediawiki>", page("A", 1, "[[B]] [[B#x|y]]"), page("C (disambiguation)", 2, ""), page("D", 3, "{{hndis}}"), b"</mediawiki>"]))
    got = S.articles_of(S.dump(spark, str(tmp_path / "d.xml.bz2"))).collect()
    assert [(r["id"], r["title"], r["links"]) for r in got] == [("1", "A", ["B"])]


def test_stream_resumes(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(src)
        if k != 1:
            ingest.ingest(spark, src, "id long", out, chk)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(30))


def ring(spark, n, k):
    nodes = layout.seeded(spark.range(n).withColumnRenamed("id", "idx"), n).withColumns({"importance": F.lit(0.2), "radius": F.lit(7.2), "hub": F.lit(False), "hub_score": F.lit(0.0)})
    e = spark.range(n).select(F.col("id").alias("a"), F.explode(F.array(*[F.lit(o + 1) for o in range(k)])).alias("o")).select("a", F.expr(f"(a + o) % {n}").alias("b"))
    return nodes, e


def test_density(spark):
    assert layout.repulsion_scale(*ring(spark, 1000, 3)) == 1.0
    assert layout.repulsion_scale(*ring(spark, 1000, 12)) == 2.0
    n, e = ring(spark, 100, 40)
    assert layout.repulsion_scale(n, e) == 3.0
    dirty = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(e.select("a", F.col("a").alias("b")))
    assert layout.repulsion_scale(n, dirty) == layout.repulsion_scale(n, e)


def test_springs_conserve_momentum(spark):
    n, e = ring(spark, 60, 2)
    r = layout.springs(n, e, Settings(), 0.8).agg(F.sum("dvx"), F.sum("dvy")).first()
    assert abs(r[0]) < 1e-8 and abs(r[1]) < 1e-8


def test_ticks_stay_finite(spark):
    n, e = ring(spark, 60, 2)
    seen = []
    out = layout.bake(n, e, ticks=2, on_tick=lambda k, a: seen.append(k)).collect()
    assert len(out) == 60 and seen == [0, 1] and all(abs(r["x"]) < 1e6 for r in out)


def test_settings():
    s = Settings()
    a = s.alpha
    for _ in range(s.ticks):
        a += (s.alpha_target - a) * s.alpha_decay
    assert abs(a - s.alpha_min) < 1e-9
    assert s.merged({"center": 1, "other": 2}).center == 1.0
    assert rank.clamp("x", 1, 100, 20) == 20 and rank.clamp(0, 1, 100, 20) == 20 and rank.clamp(500, 1, 100, 20) == 100
    assert S.known_input(["index.json"]) == "index.json"
    with pytest.raises(ValueError):
        S.data_root("relative")
