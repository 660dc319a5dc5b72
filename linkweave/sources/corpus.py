"""A data root on disk: article index, tiers with their manifest, graph documents, status.

root/articles.jsonl or root/index/articles.jsonl hold article lines,
root/index/sample a sample graph, root/tiers/<count> the nested graphs. Graphs
are folders of JSON lines, nodes and links, so that any number of tasks writes
and reads them; a single {nodes, links} document is read, too.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, rank
from ..storage import positions, stored
from . import articles as S
from . import files, titles

SAMPLE = 500
#: Edges of the tier of the whole corpus.
CORPUS_EDGES = 8_000_000
NODE = "seq long, id string, title string, byte_length double, in_degree long, out_degree long"


def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or folder with their state and place (A6); seq goes by file and line.

    Spark deals files to partitions by size, so a partition's number says
    nothing of their order. Within a block of a file lines are numbered by the
    task that reads it; a count for each block, gathered in order of files and
    blocks, tells where it begins.
    """
    at = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), at.alias("_at"))
    blocks = sorted(tuple(r) for r in lines.groupBy("_f", "_b").agg(F.min("_at"), F.count("*")).collect())
    base, rows = 0, []
    for f, b, first, n in blocks:
        rows.append((f, b, base - first))
        base += n
    shift = spark.createDataFrame(rows, "_f string, _b long, _shift long")  # a row for each block
    lines = lines.join(F.broadcast(shift), ["_f", "_b"]).select("value", (F.col("_at") + F.col("_shift")).alias("seq"))
    return S.read_lines(lines)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """articles(seq, id, title, byte_length, links) of accepted lines."""
    return read_states(spark, path).where("state = 'accepted'").select("seq", "id", "title", "byte_length", "links")


def once(articles: DataFrame) -> DataFrame:
    """articles with one row an id, the first of the source. Structs are compared before the shuffle, so that an id with many lines is no hot key."""
    return articles.groupBy("id").agg(F.min_by(F.struct(*articles.columns), "seq").alias("first")).select("first.*")


def build_index(spark: SparkSession, source: str, root: str, limit: int | None = None) -> dict:
    """Normalise article lines into root/index, with a title index, a sample graph and a manifest.

    limit counts accepted articles. An index that is there is left as it is:
    an error, nothing is overwritten.
    """
    out = f"{root}/index/articles.jsonl"
    if files.exists(out):
        raise FileExistsError(f"{out}: move it aside before building anew")
    states = stored(read_states(spark, source), "states")
    good = states.where("state = 'accepted'")
    bad = states.where("state = 'malformed'")
    if limit is not None:
        good = stored(good.orderBy("seq").limit(limit), "accepted")
        last = good.agg(F.max("seq")).first()[0]
        bad = bad.where(F.col("seq") < (last if last is not None and good.count() >= limit else 1 << 62))
    rows = stored(good.select("seq", "id", "title", "url", "extract", F.col("byte_length").alias("byteLength"), "links").repartitionByRange("seq").sortWithinPartitions("seq"), "index")
    rows.drop("seq").write.json(out)
    titles.write(rows.select("id", "title"), f"{root}/index/titles")
    picked = positions(rank.hash_sample(good, SAMPLE), ["h", "seq"], "place")  # at most SAMPLE rows
    edges = graph.resolve_own(picked.drop("seq").withColumnRenamed("place", "seq"))
    write_graph(graph.degrees(picked.select("seq", "id", "title", "byte_length"), edges), edges, f"{root}/index/sample")
    manifest = {"type": "index", "source": source, "output": "index/articles.jsonl", "sample": "index/sample", "records": rows.count(), "malformed": bad.count(), "bytes": files.tree_bytes(out), "completedAt": now()}
    files.write_json(f"{root}/index/manifest.json", manifest)
    return manifest


def write_graph(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """A graph as two folders of JSON lines, in order; Spark commits each whole or not at all."""
    nodes.repartitionByRange("seq").sortWithinPartitions("seq").write.json(f"{path}/nodes")
    order = [c for c in ("seq", "pos") if c in links.columns] or ["src", "dst"]
    links.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("src").alias("source"), F.col("dst").alias("target")).write.json(f"{path}/links")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links(src, dst)) of write_graph() or of a {nodes, links} document."""
    if path.endswith(".json") and not files.exists(f"{path}/nodes"):
        n, e = S.graph_document(spark, path)
        a = n.select(F.col("pos").cast("long").alias("seq"), "id", "title", F.lit(None).cast("double").alias("byte_length"))
        return a, graph.relinked(a, e.select("source", "target", F.col("pos").cast("long").alias("seq")))
    n = spark.read.schema(NODE).json(f"{path}/nodes")
    return n, spark.read.schema("source string, target string").json(f"{path}/links").select(F.col("source").alias("src"), F.col("target").alias("dst"))


def load_graph(spark: SparkSession, path: str, limit: int | None = None, edge_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with degrees and edges for a bake, from article lines or a graph document, by the name's ending."""
    if path.endswith(".jsonl"):
        a = read_articles(spark, path)
        a = a if limit is None else a.orderBy("seq").limit(limit)
        e = graph.resolve(a, "last_wins", limit=edge_limit)
        return graph.degrees(a.select("seq", "id", "title", "byte_length"), e), e
    n, e = read_graph(spark, path)
    if limit is not None:
        n = n.orderBy("seq").limit(limit)
        e = graph.induced(e, n)
    if edge_limit is not None:
        order = [c for c in ("seq", "pos") if c in e.columns] or ["src", "dst"]
        e = e.orderBy(*order).limit(edge_limit)
    return graph.degrees(n, e), e


def known_records(path: str) -> float | None:
    """Records of a source by its index, a manifest beside it, or the checkpoint of the parser."""
    folder, _, name = path.rpartition("/")
    for file in (f"{folder}/index/manifest.json", f"{folder}/manifest.json", f"{folder}/{name.rpartition('.')[0]}.checkpoint.json"):
        found = files.read_json(file) or {}
        for key in ("records", "recordsWritten"):
            if isinstance(found.get(key), (int, float)) and not isinstance(found[key], bool):
                return found[key]
    return None


def build_tiers(spark: SparkSession, source: str, out: str, counts: list[int], corpus: bool = False, dry_run: bool = False) -> dict:
    """Nested graphs of the first articles of connected expansion, and their manifest (A10).

    Of lines that share an id the first counts. corpus adds a tier of all records, of at most CORPUS_EDGES edges, in
    source order; the order of all tiers is then the source's.
    """
    for p in (source, out):
        S.data_root(p)
    sizes = rank.tier_counts(counts, int(known_records(source) or 0) if corpus else None)
    if dry_run:
        return {"source": source, "tiers": [{"count": n} for n in sizes]}
    a = stored(once(read_articles(spark, source)), "articles")
    placed = graph.tier_order(a, whole=True) if corpus else graph.tier_passes(a)
    passes = 1 if corpus else 1 + (placed.agg(F.max("pass")).first()[0] or 0)
    if not corpus:
        placed = positions(placed, ["pass", "seq"], "tier_pos").withColumn("tier_pos", F.col("tier_pos") + 1)
    ordered = stored(a.join(placed.select("seq", "tier_pos"), "seq").drop("seq").withColumnRenamed("tier_pos", "seq"), "ordered")
    tiers = []
    for n in sizes:
        part = ordered.where(F.col("seq") <= n)
        e = stored(graph.resolve(part, "title_first", limit=CORPUS_EDGES if corpus and n == sizes[-1] else None), "edges")
        nodes = graph.degrees(part.select("seq", "id", "title", "byte_length"), e)
        write_graph(nodes, e, f"{out}/{n}")
        tiers.append({"count": n, "file": str(n), "nodes": part.count(), "links": e.count(), "bytes": files.tree_bytes(f"{out}/{n}")})
    manifest = {
        "type": "tiers", "source": source, "scanned": known_records(source) or a.count(), "malformed": 0, "passes": passes, "selected": ordered.where(F.col("seq") <= sizes[-1]).count(),
        "selection": "source-order" if corpus else "connected-expansion-prefix", "tiers": tiers, "completedAt": now(),
    }
    files.write_json(f"{out}/manifest.json", manifest)
    return manifest


def status(root: str) -> dict:
    """Which parts of a data root are there, and how large."""
    parts = {"articles": "articles.jsonl", "index": "index/articles.jsonl", "sample": "index/sample", "tiers": "tiers", "positions": "positions"}
    out = {k: {"bytes": files.tree_bytes(f"{root}/{p}")} if files.exists(f"{root}/{p}") else None for k, p in parts.items()}
    return out | {"manifest": files.read_json(f"{root}/index/manifest.json")}
