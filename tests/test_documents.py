"""A graph document is read by ranges of its bytes, wherever these are cut."""

import json

import pytest
from pyspark.sql import functions as F

from linkweave.sources import articles, documents

NODES = [{"id": "1", "title": 'a "quoted" {title}'}, {"id": "2", "title": "back\\slash\\", "more": {"links": [{"source": "no"}], "x": "]}"}}, {"id": "3", "title": "[é]"}, {"id": "4"}]
LINKS = [{"source": "1", "target": 'back\\\\"'}, {"target": "3", "source": "2"}]


def rows(spark, path, chunk):
    n, e = articles.graph_document(spark, str(path), chunk)
    return [tuple(r) for r in n.orderBy("pos").select("id", "title").collect()], [tuple(r) for r in e.orderBy("pos").select("source", "target").collect()]


def test_cut_anywhere(spark, tmp_path):
    want = [(r["id"], r.get("title")) for r in NODES], [(r["source"], r["target"]) for r in LINKS]
    doc = {"meta": {"nodes": [{"id": "no"}], "links": [1]}, "about": 'nodes": [{', "nodes": NODES, "other": [{"id": "no"}], "links": LINKS, "end": None}
    (tmp_path / "a.json").write_text(json.dumps(doc, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=3))
    for name, chunk in (("a.json", 7), ("a.json", 50), ("a.json", 1 << 20), ("b.json", 31)):
        assert rows(spark, tmp_path / name, chunk) == want
    n, _ = articles.graph_document(spark, str(tmp_path / "a.json"), 11)
    assert sorted(r[0] for r in n.select("pos").collect()) == [0, 1, 2, 3]


def test_odd_documents(spark, tmp_path):
    cases = {"{}": ([], []), '{"nodes":null,"links":[]}': ([], []), '{"nodes":{"a":{"id":"x"}}}': ([], []), '{"nodes":[{"id":"x"}],"nodes":[{"id":"y"}]}': ([("y", None)], []), '[{"nodes":[{"id":"x"}]}]': ([("x", None)], [])}
    for k, (text, want) in enumerate(cases.items()):
        (tmp_path / f"{k}.json").write_text(text)
        assert rows(spark, tmp_path / f"{k}.json", 9) == want
    (tmp_path / "two.json").mkdir()
    for k in "ab":
        (tmp_path / "two.json" / f"{k}.json").write_text(json.dumps({"nodes": [{"id": k + "0"}, {"id": k + "1"}]}))
    n, _ = articles.graph_document(spark, str(tmp_path / "two.json"))
    assert sorted(tuple(r) for r in n.select("id", "pos").collect()) == [("a0", 0), ("a1", 1), ("b0", 0), ("b1", 1)]
    for text in ('{"nodes":[{"id":"x"}', '{"nodes":[{"id":"x', "nodes"):
        (tmp_path / "broken.json").write_text(text)
        with pytest.raises(ValueError):
            articles.graph_document(spark, str(tmp_path / "broken.json"))


def test_written_by_many_tasks(spark, tmp_path):
    """Files in order are one document, and no row holds it whole."""
    n = spark.range(300).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), F.concat(F.lit('t "'), "id").alias("title"))
    e = spark.range(900).select(F.col("id").alias("seq"), (F.col("id") % 300).cast("string").alias("source"), (F.col("id") % 7).cast("string").alias("target"))
    joined = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joined, "false")
    try:
        documents.write(n, e, str(tmp_path / "g.json"), ["seq"])
    finally:
        spark.conf.unset(joined)
    parts = sorted((tmp_path / "g.json").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and [r["id"] for r in doc["nodes"]] == [str(i) for i in range(300)] and len(doc["links"]) == 900
    assert max(len(line) for p in parts for line in p.read_text().splitlines()) < 100
    got = rows(spark, tmp_path / "g.json", 1000)
    assert got == ([(r["id"], r["title"]) for r in doc["nodes"]], [(r["source"], r["target"]) for r in doc["links"]])
    documents.write(n.limit(0), e.limit(0), str(tmp_path / "none.json"), ["seq"])
    assert rows(spark, tmp_path / "none.json", 1000) == ([], [])
