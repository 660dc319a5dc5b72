"""The serving surface: fixed questions over one corpus (group O)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, rank
from .sources import corpus, files, titles

#: Most nodes of an answer.
MOST = 10_000_000


@dataclass
class Engine:
    """Answers over articles(seq, id, title, byte_length, links)."""

    articles: DataFrame

    def graph(self, count: int | None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the first count articles; a short answer is an error (O1)."""
        n = rank.clamp(count, 1, 1 << 30, 50)
        nodes, edges = rank.jsonl_sample(self.articles, n)
        if nodes.count() < n:
            raise LookupError(f"fewer than {n} articles")
        return nodes, edges

    def stats(self) -> DataFrame:
        """(articles, links, bytes), zeros for an empty corpus (O2, F2)."""
        return stats(self.articles)

    def search(self, q: str, limit: int = 20) -> DataFrame:
        return rank.search(self.articles, q, limit)

    def article(self, ref: str) -> DataFrame:
        return rank.find_article(self.articles, ref)

    def tiers(self, counts: list[int]) -> DataFrame:
        """(seq, id, tier_pos) by connected expansion, then what it does not reach in source order (H4); tiers are prefixes (A10)."""
        return graph.tier_order(self.articles).where(F.col("tier_pos") <= max(counts))

    def health(self) -> dict:
        return {"index": bool(self.articles.limit(1).count())}


def stats(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("articles"), F.coalesce(F.sum(F.size("links")), F.lit(0)).cast("long").alias("links"), F.coalesce(F.sum("byte_length"), F.lit(0.0)).alias("bytes"))


def sample(nodes: DataFrame, edges: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """The link-dense part of a stored graph: count nodes, the edges among them, degrees counted anew (I5). A request is answered from a pool of eight times as many nodes, those of most links."""
    chosen = graph.dense_order(nodes, edges, count, max(8 * max(1, count), max(1, count) + 100)).where(F.col("pos") <= max(1, count))
    e = graph.induced(edges, chosen)
    return graph.degrees(nodes.join(chosen.select("id"), "id", "left_semi"), e), e


@dataclass
class Host:
    """Answers from a data root: tiers, sample, lines, in the order that serves a request best.

    Tables of a file are kept while the file stays what it is (M3).
    """

    spark: SparkSession
    root: str
    cache: dict = field(default_factory=dict)

    def _kept(self, path: str, make: Callable):
        now = files.identity(path)
        if now is None:
            return None
        if self.cache.get(path, (None,))[0] != now:
            self.cache[path] = (now, make(path))
        return self.cache[path][1]

    @property
    def lines(self) -> DataFrame | None:
        for name in ("index/articles.jsonl", "articles.jsonl"):
            found = self._kept(f"{self.root}/{name}", lambda p: corpus.read_articles(self.spark, p))
            if found is not None:
                return found
        return None

    def manifest(self) -> dict:
        return self._kept(f"{self.root}/tiers/manifest.json", files.read_json) or {}

    def capacity(self) -> int | None:
        """How many articles a graph can hold."""
        index = self._kept(f"{self.root}/index/manifest.json", files.read_json) or {}
        return rank.capacity(self.manifest().get("tiers", []), index.get("records"), self.lines is not None, MOST)

    def graph(self, count=None) -> dict:
        """nodes, edges, source, indexed and tier of a request (O1).

        A tier that serves it, else the stored sample for up to 500, else the
        article lines, else the made-up graph, which says so. An answer that
        is short although the corpus is large enough is an error.
        """
        n = rank.clamp(count, 1, MOST, 50)
        tier = rank.pick_tier(self.manifest().get("tiers", []), n, self.lines is not None)
        stored = tier and self._kept(f"{self.root}/tiers/{tier['file']}/nodes", lambda p: corpus.read_graph(self.spark, p.removesuffix("/nodes")))
        if not stored and n <= 500:
            stored = self._kept(f"{self.root}/index/sample/nodes", lambda p: corpus.read_graph(self.spark, p.removesuffix("/nodes")))
        if stored:
            nodes, edges = sample(*stored, n)
        elif self.lines is not None:
            nodes, edges = rank.jsonl_sample(self.lines, n)
        else:
            e = rank.fallback_graph(n, self.spark)
            nodes = self.spark.range(max(1, min(n, 51))).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("id"))
            e = e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
            return {"nodes": graph.degrees(nodes, e), "edges": e, "source": "fallback", "indexed": False, "tier": None}
        if (self.capacity() or 0) >= n and (got := nodes.count()) < n:
            raise LookupError(f"{got} of {n} articles")
        return {"nodes": nodes, "edges": edges, "source": "corpus", "indexed": True, "tier": tier["count"] if tier and stored else None}

    def stats(self) -> dict:
        """Counts from the tiers' manifest, else the index's, else a scan; zeros for nothing (O2, F2)."""
        tiers, index = self.manifest(), files.read_json(f"{self.root}/index/manifest.json") or {}
        if tiers.get("scanned"):
            return {"articles": tiers["scanned"], "graphArticles": self.capacity(), "links": None, "bytes": None, "indexed": True, "source": "tiers"}
        if self.lines is not None and index.get("records") is not None:
            return {"articles": index["records"], "graphArticles": self.capacity(), "links": None, "bytes": None, "indexed": True, "source": "index"}
        if self.lines is None:
            return {"articles": 0, "graphArticles": 0, "links": 0, "bytes": 0, "indexed": False, "source": "fallback"}
        r = stats(self.lines).first()
        return {"articles": r["articles"], "graphArticles": self.capacity() or r["articles"], "links": r["links"], "bytes": r["bytes"], "indexed": True, "source": "lines"}

    def search(self, q: str, limit=None) -> DataFrame | None:
        """Titles that hold q (O3): from the title index where there is one, else by going through all lines."""
        n = rank.clamp(limit, 1, 100, 20)
        if files.exists(f"{self.root}/index/titles/counts"):
            return titles.search(self.spark, f"{self.root}/index/titles", q, n)
        return None if self.lines is None else rank.search(self.lines, q, n)

    def article(self, ref: str) -> DataFrame | None:
        return None if self.lines is None else rank.find_article(self.lines, ref)

    def health(self) -> dict:
        """Whether there is an index, and which tiers."""
        return {"ok": True, "indexed": self.lines is not None or bool(self.manifest()), "tiers": self.manifest().get("tiers", [])}


def fetch(count: int, local: Callable[[int], dict] | None, public: Callable[[int], tuple[DataFrame, DataFrame]] | None, spark: SparkSession, preview: int = 1000, public_most: int = 500) -> dict:
    """A graph from the best source that answers: local, then a bounded public one, then the made-up graph.

    A local answer that is short is refused; a large request that only the
    local source could serve fails with its error instead of a small preview.
    """
    n = max(1, int(count or 1))
    if local is not None:
        try:
            got = local(n)
            if got["indexed"]:
                if (have := got["nodes"].count()) < n:
                    raise LookupError(f"{have} of {n} articles")
                return got | {"local": True}
        except (LookupError, OSError):  # a broken job is no missing source
            if n > preview:
                raise
    n = min(n, preview if local is not None else public_most)
    if public is not None:
        nodes, edges = public(n)
        if nodes.limit(1).count():
            return {"nodes": nodes, "edges": edges, "source": "public", "indexed": True, "local": False, "tier": None}
    return Host(spark, "/nonexistent").graph(n) | {"local": False}


@dataclass
class Requests:
    """Only the latest request of a caller counts: a new one cancels the jobs of the one before (M5)."""

    spark: SparkSession
    tag: str | None = None

    def run(self, work: Callable[[], object]):
        if self.tag is not None:
            self.spark.interruptTag(self.tag)
        mine = self.tag = f"request-{uuid.uuid4().hex}"
        self.spark.addTag(mine)
        try:
            out = work()
        finally:
            self.spark.removeTag(mine)
        return out if self.tag == mine else None


@dataclass
class Progress:
    """Reports of a long loop: at every twentieth of the work or 30 seconds, with rate and time left."""

    label: str
    total: int
    say: Callable[[str], None] = print
    clock: Callable[[], float] = __import__("time").monotonic
    every: float = 30.0

    def __post_init__(self):
        self.start = self.last_at = self.clock()
        self.last = 0

    def update(self, value: int, force: bool = False) -> bool:
        """Whether a report was due and made."""
        value, now = max(0, min(self.total, value)), self.clock()
        due = force or value >= self.total or value == 1 or value - self.last >= max(1, -(-self.total // 20)) or now - self.last_at >= self.every
        if not due:
            return False
        spent = max(0.0, now - self.start)
        share = value / self.total if self.total else 1.0
        bar = "#" * round(20 * share) + "." * (20 - round(20 * share))
        left = "done" if value >= self.total else f"{spent * (self.total - value) / value:.0f} s left" if value else "unknown"
        self.say(f"{self.label} [{bar}] {100 * share:.{1 if 0 < share < 0.1 else 0}f}% ({value:,}/{self.total:,}) {value / spent if spent else 0:,.1f}/s, {left}")
        self.last, self.last_at = value, now
        return True


@dataclass
class DecayClock:
    """The link distance of a running layout: advances by ticks and stops at 30 s."""

    elapsed_ms: float = 0.0

    def advance(self, ms: float) -> float:
        self.elapsed_ms = min(30_000.0, self.elapsed_ms + max(0.0, ms))
        return round(10 + 149990 * (1 - self.elapsed_ms / 30_000) ** 3)

    @property
    def done(self) -> bool:
        return self.elapsed_ms >= 30_000


def main(argv: list[str] | None = None) -> int:
    """parse, index, tiers, bake, tiles as commands."""
    import argparse
    import time

    p = argparse.ArgumentParser(prog="linkweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *options in (
        ("parse", ("source", str), ("output", str), ("--limit", int), ("--parallel", bool), ("--dry-run", bool)), ("index", ("source", str), ("root", str), ("--limit", int)), ("tiers", ("source", str), ("out", str), ("--tiers", str), ("--corpus", bool), ("--dry-run", bool)),
        ("bake", ("source", str), ("out", str), ("--limit", int), ("--edge-limit", int), ("--iterations", int), ("--no-links", bool), ("--no-labels", bool)), ("tiles", ("svg", str), ("cache", str), ("--grid", int)),
    ):
        c = sub.add_parser(name)
        for o, kind in options:
            c.add_argument(o, **({"action": "store_true"} if kind is bool else {"type": kind}))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"linkweave-{a.command}").getOrCreate()
    if a.command == "parse":
        from .sources import dumps

        print(dumps.parse(spark, a.source, None if a.dry_run else a.output, a.limit, a.parallel))
    elif a.command == "index":
        print(corpus.build_index(spark, a.source, a.root, a.limit))
    elif a.command == "tiers":
        print(corpus.build_tiers(spark, a.source, a.out, [int(x) for x in (a.tiers or "1000,5000,25000,100000").split(",")], a.corpus, a.dry_run))
    elif a.command == "tiles":
        from .sources import drawing

        print(drawing.build_tiles(spark, a.svg, a.cache, a.grid or drawing.GRID))
    else:
        from .functions.layout import Settings
        from .operators import layout
        from .sources import drawing

        began, s = time.monotonic(), Settings()
        nodes, edges = corpus.load_graph(spark, a.source, a.limit, a.edge_limit)
        nodes, pairs, n_hubs = layout.prepared(nodes, edges)
        steps = a.iterations or 10
        report = Progress("Layout", steps)
        done = layout.bake(nodes, pairs, s, steps, lambda k, _alpha: report.update(k + 1))
        drawing.write_positions(done, f"{a.out}/positions")
        drawing.write_svg(done, edges, f"{a.out}/drawing.svg", labels=not a.no_labels, no_links=a.no_links)
        print(drawing.write_bake_manifest(f"{a.out}/manifest.json", s, done.count(), edges.count(), n_hubs, steps, time.monotonic() - began))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
