"""Files written and read back: dumps of several streams, index, tiers, graphs, tile caches; and what the host makes of them."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from linkweave import api
from linkweave.functions import layout as L
from linkweave.functions.layout import Settings
from linkweave.operators import graph, labels, layout, rank
from linkweave.sources import articles, corpus, drawing, dumps, files, paged

#: First numbers of the generator for seed 7, times 2^32.
SEEDED = [3055, 1718083504, 77058691, 763264993]


def page(title, i, text, more=""):
    return f"<page><title>{title}</title><ns>0</ns><id>{i}</id>{more}<revision><text>{text}</text></revision></page>"


def test_dump_of_streams(spark, tmp_path):
    path = str(tmp_path / "d.xml.bz2")
    streams = ["<mediawiki>", page("A", 1, "[[B]]") + page("R", 2, "", '<redirect title="A" />'), page("B", 3, "[[A]] [[A#x|y]]"), page("C (disambiguation)", 4, ""), "</mediawiki>"]
    (tmp_path / "d.xml.bz2").write_bytes(b"".join(bz2.compress(x.encode()) for x in streams))
    at = [(r["offset"], r["length"]) for r in dumps.stream_offsets(spark, path, chunk=40).orderBy("offset").collect()]
    sizes = [len(bz2.compress(x.encode())) for x in streams]
    assert at == [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]
    for parallel in (False, True):
        out = str(tmp_path / f"out-{parallel}")
        m = dumps.parse(spark, path, out, parallel=parallel)
        assert (m["pagesRead"], m["recordsWritten"], m["pagesSkipped"]) == (4, 2, 2)
        rows = [json.loads(x.value) for x in spark.read.text(out).collect()]
        assert sorted((r["id"], r["title"], tuple(r["links"])) for r in rows) == [("1", "A", ("B",)), ("3", "B", ("A",))]
    assert dumps.parse(spark, path, None, limit=1, parallel=True)["recordsWritten"] == 1
    with pytest.raises(Exception):
        dumps.parse(spark, path, str(tmp_path / "out-True"))  # never overwritten
    (tmp_path / "bad").write_bytes(b"x" + bz2.compress(b"y"))
    with pytest.raises(ValueError):
        dumps.stream_offsets(spark, str(tmp_path / "bad"))


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A root with 30 articles in a ring of links to the next two, one broken line, one disambiguation page."""
    d = tmp_path_factory.mktemp("root")
    lines = [json.dumps({"id": str(i), "title": f"T{i}", "byteLength": 10 * i, "links": [f"T{(i + 1) % 30}", f"t{(i + 2) % 30}", "nowhere"]}) for i in range(30)]
    (d / "articles.jsonl").write_text("\n".join([*lines[:5], "{broken", "", json.dumps({"id": "x", "title": "X (disambiguation)"}), *lines[5:]]) + "\n")
    return str(d)


def test_index_and_tiers(spark, root):
    bare = api.Host(spark, root)
    assert bare.stats()["source"] == "lines" and bare.stats()["articles"] == 30 and bare.stats()["links"] == 90
    assert bare.graph(40)["nodes"].count() == 30 and bare.capacity() is None
    m = corpus.build_index(spark, f"{root}/articles.jsonl", root)
    assert (m["records"], m["malformed"]) == (30, 1) and m["bytes"] > 0
    with pytest.raises(FileExistsError):
        corpus.build_index(spark, f"{root}/articles.jsonl", root)
    nodes, links = corpus.read_graph(spark, f"{root}/index/sample")
    assert nodes.count() == 30 and links.count() == 60 and {tuple(r) for r in nodes.select("in_degree", "out_degree").collect()} == {(2, 2)}
    assert corpus.known_records(f"{root}/articles.jsonl") == 30
    host = api.Host(spark, root)
    got = host.graph(10)
    assert got["tier"] is None and got["nodes"].count() == 10 and host.stats()["source"] == "index"
    t = corpus.build_tiers(spark, f"{root}/articles.jsonl", f"{root}/tiers", [20, 5, 5])
    assert [(x["count"], x["nodes"]) for x in t["tiers"]] == [(5, 5), (20, 20)] and t["passes"] == 1 and t["tiers"][1]["links"] == 37
    got = host.graph(4)
    assert got["tier"] == 5 and got["nodes"].count() == 4 and got["source"] == "corpus"
    assert host.graph(25)["tier"] is None and host.graph(25)["nodes"].count() == 25  # more than the tiers hold: from the lines
    assert host.stats()["source"] == "tiers" and host.capacity() == 30 and [x["count"] for x in host.health()["tiers"]] == [5, 20]
    assert [r["id"] for r in host.search("t29", "x").collect()] == ["29"] and host.article(" T3 ").first()["id"] == "3"
    whole = corpus.build_tiers(spark, f"{root}/articles.jsonl", f"{root}/all", [7], corpus=True)
    assert [x["count"] for x in whole["tiers"]] == [7, 30] and whole["selection"] == "source-order"
    assert corpus.build_tiers(spark, "/a", "/b", [3], dry_run=True)["tiers"] == [{"count": 3}]
    assert corpus.status(root)["index"]["bytes"] > 0 and corpus.status(root)["positions"] is None
    with pytest.raises(ValueError):
        rank.tier_counts([0, -1])


def test_made_up_graph_says_so(spark, tmp_path):
    host = api.Host(spark, str(tmp_path))
    got = host.graph("nonsense")
    assert got["source"] == "fallback" and not got["indexed"] and got["nodes"].count() == 50 and host.stats()["articles"] == 0
    assert host.search("x") is None and not host.health()["indexed"]


def test_fetch_by_source(spark, root):
    host = api.Host(spark, root)
    assert api.fetch(10, host.graph, None, spark)["local"]
    nodes = host.graph(3)
    public = lambda n: (nodes["nodes"], nodes["edges"])
    assert api.fetch(900, host.graph, public, spark)["source"] == "public"  # the local answer is short
    with pytest.raises(LookupError):
        api.fetch(5000, host.graph, public, spark)
    assert api.fetch(10, None, None, spark)["source"] == "fallback"


def test_caches_follow_files(spark, tmp_path):
    host, path = api.Host(spark, str(tmp_path)), str(tmp_path / "tiers" / "manifest.json")
    files.write_json(path, {"tiers": [{"count": 3, "nodes": 3, "file": "3"}]})
    assert host.manifest() is host.manifest() and host.capacity() == 3
    files.write_json(path, {"tiers": [{"count": 30, "nodes": 30, "file": "30"}], "more": 1})
    assert host.capacity() == 30


def test_bake_and_tiles(spark, root, tmp_path):
    nodes, edges = corpus.load_graph(spark, f"{root}/articles.jsonl", limit=20)
    assert nodes.count() == 20 and corpus.load_graph(spark, f"{root}/articles.jsonl", edge_limit=7)[1].count() == 7
    n, e, hubs = layout.prepared(nodes, edges)
    assert hubs == 1 and n.where("hub").count() == 1 and e.count() == edges.count() == 37
    drawing.write_positions(n, str(tmp_path / "positions"))
    assert spark.read.json(str(tmp_path / "positions")).count() == 20
    svg, cache = str(tmp_path / "drawing.svg"), str(tmp_path / "tiles")
    drawing.write_svg(n, edges, svg)
    parts = sorted(p for p in (tmp_path / "drawing.svg").iterdir() if p.name.startswith("part-"))
    text = "".join(p.read_text() for p in parts)
    import xml.etree.ElementTree as ET

    tree = ET.fromstring(text.encode())
    kinds = [x.tag.rpartition("}")[2] for g in tree for x in g]
    assert (kinds.count("circle"), kinds.count("text"), kinds.count("line")) == (20, 20, 37 + 20)
    box = drawing.view_box(spark, svg)
    assert [float(x) for x in tree.get("viewBox").split()] == list(box) and box == pytest.approx(drawing.svg_box(n), abs=1e-3)
    meta = drawing.build_tiles(spark, svg, cache, grid=4, caps={"line": 3, "circle": 2, "text": 1})
    assert meta["counts"] == {"line": 57, "circle": 20, "text": 20}
    every = drawing.tiles.read_tiles(spark, cache, (0, 3, 0, 3))
    kept = every.groupBy("tx", "ty", "kind").count().groupBy("kind").agg(F.max("count")).collect()
    assert len(kept) == 3 and all(r[1] <= {"line": 3, "circle": 2, "text": 1}[r[0]] for r in kept)
    assert drawing.view_tiles(spark, cache, (-1e9, -1e9, 1e9, 1e9), 1.0).count() == 97
    near = drawing.view_tiles(spark, cache, (0.0, 0.0, 1.0, 1.0), 2.0)
    assert 0 < near.count() < every.count()
    server = drawing.tiles.TileServer(spark, cache)
    span = drawing.tile_range((0.0, 0.0, 1.0, 1.0), box, 4)
    got = sorted((tx, ty, k, str(v)) for tx, ty, d in server.tiles(span) for k in ("line", "circle", "text") for v in d[k])
    assert got == sorted((r["tx"], r["ty"], r["kind"], str([*r["values"], *([r["text"]] if r["kind"] == "text" else [])])) for r in near.collect())
    size = files.tree_bytes(f"{cache}/packs")
    assert 0 < server.bytes_read < size and server.tile(99, 0)["counts"] == {} and sum(d["counts"].get("circle", 0) for _, _, d in server.tiles((0, 3, 0, 3))) == 20
    own = sum(r["length"] for r in drawing.tiles.located(spark, cache, span).collect())
    read = server.bytes_read
    server.tiles(span)
    assert own <= server.bytes_read - read <= own + drawing.tiles.GAP * 4
    with pytest.raises(ValueError):
        drawing.svg_lines(n.limit(0), edges)
    (tmp_path / "bad.svg").write_text('<svg viewBox="1 2 x 4">\n')
    with pytest.raises(ValueError):
        drawing.view_box(spark, str(tmp_path / "bad.svg"))
    m = drawing.write_bake_manifest(str(tmp_path / "m.json"), Settings(), 20, 37, 1, 5, 1.25)
    assert files.read_json(str(tmp_path / "m.json")) == m and m["peakRssKb"] > 0


def test_progress_clock_and_requests(spark):
    said, now = [], [0.0]
    p = api.Progress("x", 100, said.append, lambda: now[0])
    due = [p.update(k) for k in range(101)]
    assert sum(due) == 21 and said[-1].startswith("x [####################] 100% (100/100)")
    now[0] = 31.0
    assert p.update(50) and not p.update(51)
    c = api.DecayClock()
    assert [c.advance(0), c.advance(15_000), c.done, c.advance(60_000), c.done] == [150_000, 18_759, False, 10, True]
    r = api.Requests(spark)
    assert r.run(lambda: spark.range(3).count()) == 3 and r.run(lambda: 4) == 4
    assert r.run(lambda: r.run(lambda: 1)) is None  # a newer request came in between


def test_crawl(spark):
    """The best-linked titles come next, through aliases too; missing ones are asked for once; nulls and empty titles are passed over."""
    links = {f"P{i}": [f"p{(i + 1) % 12}", f"P{(i * 5) % 12}", f"alias {i}", "nowhere", ""] for i in range(12)}
    pages = spark.createDataFrame(list(links.items()), "title string, links array<string>")
    aliases = spark.createDataFrame([(f"Alias {i}", f"P{i}") for i in range(12)], "alias string, title string")
    asked = []
    source = paged.stored_pages(pages, aliases)

    def read(titles):
        asked.append([r["k"] for r in titles.orderBy(F.desc("score"), "k").collect()])
        return source(titles)

    seeds = spark.createDataFrame([("P3",), (" p3 ",), ("P7",), (None,), ("",)], "title string")
    got, found, known = paged.crawl(read, seeds, 8, batch=2)
    rows = got.collect()
    assert 8 <= len(rows) <= 9 and len({r["title"] for r in rows}) == len(rows) and {r["title"] for r in rows} <= set(links)
    assert asked[0] == ["p3", "p7"] and asked[1][0] == "nowhere"  # two links name it
    flat = [k for a in asked for k in a]
    assert len(flat) == len(set(flat)) and all(len(a) <= 2 for a in asked)
    assert found.count() == 4 * len(rows) and all(r["title"].startswith("P") for r in known.collect())
    assert paged.crawl(paged.stored_pages(pages), seeds, 100, batch=50)[0].count() == 12
    with pytest.raises(ValueError):
        paged.crawl(source, seeds.limit(0), 3)


def test_page_order(spark):
    order = graph.page_pick([f"t{i}" for i in range(9)], [(f"t{a}", f"t{b}") for a in range(4) for b in range(4) if a != b] + [("t8", "t0")], 4)
    assert order == ["t0", "t1", "t2", "t3"]
    e = spark.createDataFrame([(f"t{a}", f"t{b}") for a in range(4) for b in range(4)], "src string, dst string")
    assert [r["title"] for r in graph.page_order(spark.createDataFrame([(f"t{i}",) for i in range(9)], "title string"), e, 4).orderBy("pos").collect()] == order
    with pytest.raises(ValueError):
        graph.page_order(spark.range(9).select(F.col("id").cast("string").alias("title")), e, 4, most=5)


def test_overlaps_and_pins(spark):
    rows = [(i, 3.0 * i, 0.0, 0.0, 0.0, 8.0, 0.0 if i == 0 else None, None) for i in range(6)] + [(6, 3.0, 0.0, 0.0, 0.0, 8.0, None, None), (7, 500.0, 0.0, 0.0, 0.0, 90.0, None, None)]
    df = spark.createDataFrame(rows, "idx long, x double, y double, vx double, vy double, radius double, fx double, fy double")
    over = lambda rs: sum(max(0.0, a["radius"] + b["radius"] + 36 - ((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) ** 0.5) for k, a in enumerate(rs) for b in rs[:k])
    done = layout.separated(df, rounds=20).orderBy("idx").collect()
    assert over(done) < 0.2 * over(df.collect()) and (done[0]["x"], done[0]["y"]) == (0.0, 0.0) and (done[7]["x"], done[7]["y"]) == (500.0, 0.0)
    assert layout.separated(df, most=3) is df and layout.separated(df.limit(0)).count() == 0
    moved = layout.integrate(df.withColumns({"vx": F.lit(5.0), "vy": F.lit(1.0)}), Settings()).orderBy("idx").collect()
    assert moved[0]["x"] == 0.0 and moved[0]["vx"] == 0.0 and moved[1]["x"] == 6.0


@pytest.mark.parametrize("show_all,nodes", [(False, True), (True, True), (False, False)])
def test_labels_as_if_one_by_one(spark, show_all, nodes):
    """Rounds give what placing the labels one after the other gives."""
    import random

    rng = random.Random(2)
    c = [(str(i), rng.uniform(0, 260), rng.uniform(0, 200), 5.0, rng.choice([20.0, 45.0, 70.0]), rng.choice([0.1, 0.5, 0.9])) for i in range(70)]
    df = spark.createDataFrame(c, "id string, x double, y double, radius double, width double, priority double")
    view, pad, high = (-40.0, -40.0, 240.0, 230.0), 4.0, 10.5 * 1.18
    got = {r["id"]: (round(r["x"], 6), round(r["y"], 6)) for r in labels.placed_labels(df, df if nodes else df.limit(0), view, 1.0, show_all).collect()}
    want, taken = {}, []
    for i, x, y, r, w, _ in sorted(c, key=lambda v: (-v[5], v[0])):
        places = [(x + dx * (r + 7 + w / 2), {"under": y + r + 7, "over": y - r - 7 - high, "level": y - high / 2}[at]) for dx, at in ((0, "under"), (0, "over"), (1, "level"), (-1, "level"), (1, "under"), (-1, "under"))]
        seen = [(px, py) for px, py in places if px + w / 2 >= view[0] and px - w / 2 <= view[2] and py + high >= view[1] and py <= view[3]]

        def free(px, py):
            apart = all(px + w / 2 <= a - pad or px - w / 2 >= b + pad or py + high <= t - pad or py >= u + pad for a, b, t, u in taken)
            clear = not nodes or all(n[1] == x or (n[1] - min(max(n[1], px - w / 2), px + w / 2)) ** 2 + (n[2] - min(max(n[2], py), py + high)) ** 2 >= (5 + pad) ** 2 for n in c if -45 <= n[1] <= 245 and -45 <= n[2] <= 235)
            return apart and clear

        at = next((p for p in seen if free(*p)), seen[0] if show_all and seen else None)
        if at:
            want[i] = (round(at[0], 6), round(at[1], 6))
            taken.append((at[0] - w / 2, at[0] + w / 2, at[1], at[1] + high))
    assert got == want and 5 < len(got) <= 70


def test_random_numbers():
    r = L.seeded_random(7)
    x = [next(r) for _ in range(1000)]
    assert [round(v * 2**32) for v in x[:4]] == SEEDED and all(0 <= v < 1 for v in x) and 0.45 < sum(x) / 1000 < 0.55 and x[:3] == [next(q) for q in [L.seeded_random(7)] for _ in range(3)]


def test_data_roots():
    for good in ("/data/x", "hdfs://name:8020/data", "s3a://bucket/data", "file:///data", "file:/data"):
        assert articles.data_root(good) == good
    for bad in ("data", "/", "hdfs://name:8020/", "s3a://bucket", "file:///", "./x", "C:x"):
        with pytest.raises(ValueError):
            articles.data_root(bad)


def test_repeated_ids_and_index_columns(spark, tmp_path):
    """Of lines with one id the first is placed, once; the index keeps url and extract."""
    rows = [{"id": "a", "title": "A", "links": ["b"], "url": "u:a", "extract": "about a"}, {"id": "b", "title": "B", "links": ["c"], "url": 5, "extract": ""}, {"id": "a", "title": "A again", "links": ["d"]}, {"id": "c", "title": "C (x)", "links": []}, {"id": "d", "title": "D", "links": []}]
    (tmp_path / "articles.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    t = corpus.build_tiers(spark, str(tmp_path / "articles.jsonl"), str(tmp_path / "tiers"), [10])
    assert t["tiers"][0]["nodes"] == 3 and t["selected"] == 3
    n, e = corpus.read_graph(spark, str(tmp_path / "tiers" / "10"))
    assert [r["id"] for r in n.orderBy("seq").collect()] == ["a", "b", "c"] and n.where("id = 'a'").first()["title"] == "A"
    assert sorted(map(tuple, e.select("src", "dst").collect())) == [("a", "b"), ("b", "c")]
    whole = corpus.build_tiers(spark, str(tmp_path / "articles.jsonl"), str(tmp_path / "all"), [10], corpus=True)
    assert whole["tiers"][0]["nodes"] == 4
    corpus.build_index(spark, str(tmp_path / "articles.jsonl"), str(tmp_path))
    got = [(r["id"], r["url"], r["extract"]) for r in spark.read.schema("id string, url string, extract string").json(str(tmp_path / "index" / "articles.jsonl")).collect()]
    assert sorted(got, key=str) == sorted([("a", "u:a", "about a"), ("b", "https://en.wikipedia.org/wiki/B", None), ("a", "https://en.wikipedia.org/wiki/A_again", None), ("c", "https://en.wikipedia.org/wiki/C_(x)", None), ("d", "https://en.wikipedia.org/wiki/D", None)], key=str)


def test_more_hubs_than_act(spark):
    n = spark.range(300).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("id"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), (F.col("id") < 150).alias("hub"), F.lit(0.5).alias("hub_score"))
    e = spark.range(150).select(F.col("id").alias("a"), (F.col("id") + 150).alias("b"))
    for f in (lambda x: layout.hub_pairs(x, 480.0), lambda x: layout.hub_forces(x, e, Settings(), 0.5)):
        with pytest.raises(ValueError):
            f(n)
        assert f(n.withColumn("hub", F.col("idx") < 100)).count() > 0


def test_dump_stopped_and_resumed(spark, tmp_path):
    """Whatever ends a parse, and wherever, lines and counters come out as those of one that ran through."""
    from linkweave.streaming import dump as stream

    (tmp_path / "dump").mkdir()
    k = 0
    for f in range(3):
        parts = ["<mediawiki>"]
        for _ in range(5):
            parts.append("".join(page(f"T{k + j}" + (" (disambiguation)" if (k + j) % 4 == 3 else ""), k + j, f"[[T{k + j + 1}]]") for j in range(3)))
            k += 3
        (tmp_path / "dump" / f"p{f}.bz2").write_bytes(b"".join(bz2.compress(x.encode()) for x in [*parts, "</mediawiki>"]))
    source, whole = str(tmp_path / "dump"), str(tmp_path / "whole")
    want = stream.parse(spark, source, whole, streams_a_batch=4)
    assert (want["pagesRead"], want["recordsWritten"], want["pagesSkipped"], want["streams"], want["batches"]) == (45, 34, 11, 21, 6)
    lines = [r[0] for r in stream.read_lines(spark, whole).collect()]
    assert sorted(int(json.loads(x)["id"]) for x in lines) == [i for i in range(45) if i % 4 != 3]
    at = str(tmp_path / "stopped")
    for fails in (0, 2, 2, 5):  # once before the first commit, twice at the same batch, and at the last

        def stop(batch_id, facts, fails=fails):
            if batch_id == fails:
                raise RuntimeError("killed")

        with pytest.raises(Exception, match="killed"):
            stream.parse(spark, source, at, streams_a_batch=4, streams_a_task=2, on_batch=stop)
        assert stream.progress(at)["batches"] == fails and stream.read_lines(spark, at).count() <= 34
    got = stream.parse(spark, source, at, streams_a_batch=1)  # the first call's size of a batch holds
    assert {k: v for k, v in got.items() if k != "output"} == {k: v for k, v in want.items() if k != "output"}
    assert sorted(r[0] for r in stream.read_lines(spark, at).collect()) == sorted(lines)
    assert stream.parse(spark, source, at) == got  # nothing is left to do
    (tmp_path / "dump" / "p9.bz2").write_bytes(bz2.compress(b"<mediawiki>"))
    with pytest.raises(ValueError):
        stream.parse(spark, source, at)
    with pytest.raises(ValueError):
        stream.parse(spark, source, "relative")


def test_many_small_batches(spark, tmp_path):
    """Batches of one stream each share a micro-batch, also one that ends in the middle, and each is committed by itself."""
    from linkweave.streaming import dump as stream

    pages = ["".join(page(f"T{k}", k, "[[X]]") for k in range(3 * j, 3 * j + 3)) for j in range(40)]
    (tmp_path / "d.bz2").write_bytes(b"".join(bz2.compress(x.encode()) for x in pages))
    heard = []

    def hear(batch_id, facts):
        heard.append((batch_id, facts["pagesRead"]))
        if len(heard) == 18:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        stream.parse(spark, str(tmp_path / "d.bz2"), str(tmp_path / "out"), streams_a_batch=1, on_batch=hear)
    assert stream.progress(str(tmp_path / "out"))["batches"] == 17
    m = stream.parse(spark, str(tmp_path / "d.bz2"), str(tmp_path / "out"), on_batch=hear)
    assert heard == [(k, 3) for k in range(18)] + [(k, 3) for k in range(17, 40)]
    assert (m["batches"], m["pagesRead"], stream.read_lines(spark, str(tmp_path / "out")).count()) == (40, 120, 120)
    assert len(list((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"))) == 1  # 40 before


def test_small_batches_share_files(spark, tmp_path):
    """Files and counters go with micro-batches, not with batches, and progress reads what came since."""
    from linkweave.streaming import dump as stream

    pages = ["".join(page(f"T{k}", k, "[[X]]") for k in range(3 * j, 3 * j + 3)) for j in range(30)]
    (tmp_path / "d.bz2").write_bytes(b"".join(bz2.compress(x.encode()) for x in pages))
    out = str(tmp_path / "out")

    def stop(batch_id, facts):
        if batch_id == 4:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        stream.parse(spark, str(tmp_path / "d.bz2"), out, streams_a_batch=2, on_batch=stop)
    assert sorted(json.loads(r[0])["id"] for r in stream.read_lines(spark, out).collect()) == sorted(str(k) for k in range(24))
    first = stream.progress(out)
    assert (first["batches"], first["streams"], first["pagesRead"]) == (4, 8, 24)
    m = stream.parse(spark, str(tmp_path / "d.bz2"), out)
    assert sorted(p.name for p in (tmp_path / "out" / "counters").iterdir()) == ["0.json", "4.json"]
    assert sorted(p.name for p in (tmp_path / "out" / "lines").iterdir() if p.name[0] != ".") == ["from=0", "from=4"]
    assert (m["batches"], m["pagesRead"]) == (15, 90) and stream.progress(out, first) == m
    assert sorted(int(json.loads(r[0])["id"]) for r in stream.read_lines(spark, out).collect()) == list(range(90))
