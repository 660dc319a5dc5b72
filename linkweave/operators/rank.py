"""Search, lookup, ranking, filters, sampling and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.text import is_disambiguation_title, is_year_or_day, key, stable_hash
from ..storage import measured, positions
from .graph import degrees, induced


def clamp(value: int | float | None, low: int, high: int, default: int) -> int:
    """Requested count within bounds; 0 and what is no number mean the default."""
    try:
        n = float(value or 0)
    except (TypeError, ValueError):
        n = 0
    return int(min(high, max(low, n))) if n == n and n else default


def clamp_of(value: Column, low: int, high: int, default: int) -> Column:
    """clamp() of a column of numbers."""
    return F.when(value.isNull() | (value == 0), default).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), value))).cast("long")


def search(articles: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Titles that contain q, shortest first (G1)."""
    needle = key(F.lit(q))
    return articles.where((needle != "") & F.contains(key(F.col("title")), needle)).orderBy(F.length("title"), F.collate("title", "UNICODE"), "id").limit(clamp(limit, 1, 100, 20)).select("id", "title")


def finder(articles: DataFrame, q: str, limit: int = 18) -> DataFrame:
    """Score 0 exact, 1 prefix, 2 inside the title, 3 in the id only; then place of the match and title."""
    q = q.strip().lower()
    t, i = F.lower("title"), F.lower("id")
    at = F.instr(t, q)
    score = F.when(t == q, 0).when(at == 1, 1).when(at > 0, 2).when(F.instr(i, q) > 0, 3)
    place = F.when(at > 0, at).otherwise(F.instr(i, q))
    return articles.select("id", "title", score.alias("score"), place.alias("place")).where("score is not null").orderBy("score", "place", "title", "id").limit(limit)


def find_article(articles: DataFrame, ref: str) -> DataFrame:
    """The first article whose id or title has the key of ref."""
    k = key(F.lit(ref))
    return articles.where((key(F.col("id")) == k) | (key(F.col("title")) == k)).orderBy("seq").limit(1)


def related(edges: DataFrame, node: str, limit: int = 5) -> DataFrame:
    """Ids linked with node, either way, in order of the first edge."""
    e = edges.where((F.col("src") == node) | (F.col("dst") == node)).withColumn("id", F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")))
    return e.groupBy("id").agg(F.min(F.struct("seq", "pos")).alias("at")).orderBy("at", "id").limit(limit).select("id")


def visible(nodes: DataFrame, hubs: DataFrame, count: int, edges: DataFrame | None = None, selected: str | None = None) -> DataFrame:
    """All hubs, then others by degree up to count, then the selected node and its neighbours."""
    n, h = nodes.count(), hubs.count()
    deg = F.col("in_degree") + F.col("out_degree")
    rest = nodes.join(hubs.select("id"), "id", "left_anti").orderBy(F.desc(deg), "id").limit(max(h, min(n, int(count))) - h).select("id")
    out = hubs.select("id").unionByName(rest)
    if selected is not None and edges is not None:
        out = out.unionByName(nodes.where(F.col("id") == selected).select("id")).unionByName(related(edges, selected, 1 << 30).join(nodes.select("id"), "id", "left_semi"))
    return out.distinct()


def without_calendar(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are no year or day, the edges among them, degrees counted anew."""
    kept = nodes.where(~is_year_or_day(F.col("title")))
    e = induced(edges, kept)
    return degrees(kept, e), e


def hash_sample(articles: DataFrame, k: int = 500) -> DataFrame:
    """The k smallest hashes of id; ties in source order."""
    return articles.withColumn("h", stable_hash(F.col("id"))).orderBy("h", "seq").limit(k)


def jsonl_sample(articles: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """The first count articles in source order, by hash, with their edges up to the cap."""
    from .graph import resolve

    first = articles.orderBy("seq").limit(count).withColumn("h", stable_hash(F.col("id")))
    ranked = positions(first, ["h", "id"], "hseq")
    e = resolve(ranked.drop("seq").withColumnRenamed("hseq", "seq"), "last_wins", limit=min(8_000_000, max(100_000, 10 * count)))
    return degrees(ranked, e), e


def decimate(df: DataFrame, order: list[str], cap: int) -> DataFrame:
    """Every ceil(n / cap)-th row in order."""
    step = max(1, -(-df.count() // cap))
    return positions(df, order, "_n").where(F.col("_n") % step == 0).drop("_n")


def tile(v: Column, low: float, extent: float, grid: int = 256) -> Column:
    """Index of the tile that holds v."""
    return F.least(F.lit(grid - 1), F.greatest(F.lit(0), F.floor((v - low) / extent * grid).cast("int")))


def tile_sample(rows: DataFrame, keys: list[str], caps: dict[str, int]) -> DataFrame:
    """Per tile and kind the rows of smallest hash, up to the kind's cap (I2 by hash; I4 with no keys). Each kind has a limit of its own, a number that Spark applies before it shuffles, so that no tile is sorted whole in one task."""
    w, out = W.partitionBy(*keys).orderBy(stable_hash(F.col("id")), "id"), None
    for kind, cap in caps.items():
        part = rows.where(F.col("kind") == kind).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
        out = part if out is None else out.unionByName(part)
    return out


def bottom_k(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Of each kind the rows of smallest hash, up to its cap, by one top-k for each kind (I4): no kind is sorted in one task."""
    out = None
    for kind, cap in caps.items():
        part = rows.where(F.col("kind") == kind).withColumn("_h", stable_hash(F.col("id"))).orderBy("_h", "id").limit(cap).drop("_h")
        out = part if out is None else out.unionByName(part)
    return out


def valid_tiers(manifest: DataFrame) -> DataFrame:
    """The tiers of a manifest (count, ...) whose count is a positive whole number, smallest first."""
    n = F.col("count").cast("double")
    return manifest.where((n > 0) & (n == F.floor(n))).orderBy("count")


def tier_of(want: Column, counts: list[int]) -> Column:
    """The smallest of the counts that is at least ``want``, else the largest; null without counts."""
    out = F.lit(max(counts)) if counts else F.lit(None)
    for c in sorted(counts, reverse=True):
        out = F.when(want <= c, c).otherwise(out)
    return out.cast("long")


def pick_tier(tiers: list[dict], count: int, lines: bool) -> dict | None:
    """The tier that answers a request, or None where article lines, if there are any, do it better.

    tiers: rows of a manifest (count, nodes). Lines take over beyond 100 000
    wanted articles if the tier holds more than wanted, and where it holds too few.
    """
    good = sorted((t for t in tiers if isinstance(t.get("count"), int) and t["count"] > 0), key=lambda t: t["count"])
    if not good:
        return None
    tier = next((t for t in good if t["count"] >= count), good[-1])
    holds = tier["count"] if tier.get("nodes") is None else tier["nodes"]
    return None if lines and (count > holds or (count > 100_000 and holds > count)) else tier


def capacity(tiers: list[dict], records: float | None, lines: bool, most: int = 1 << 30) -> int | None:
    """How many articles a graph request can get: the largest tier, or all indexed records if their lines are there (G7); None for nothing."""
    largest = max((t for t in tiers if isinstance(t.get("count"), int) and t["count"] > 0), key=lambda t: t["count"], default={})
    n = max(largest.get("nodes") or largest.get("count") or 0, records or 0 if lines else 0)
    return int(min(n, most)) or None


def ticks(values: Column, top: Column) -> Column:
    """Distinct values up to ``top``, sorted."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x <= top)))


def tier_counts(wanted: list[int], corpus: int | None = None) -> list[int]:
    """Tier sizes to build: the wanted ones and that of the whole corpus, distinct and sorted; none is an error (H6)."""
    out = sorted({n for n in [*wanted, corpus or 0] if isinstance(n, int) and n > 0})
    if not out:
        raise ValueError("no positive tier size")
    return out


def tier_counts_of(wanted: Column, corpus: Column) -> Column:
    """tier_counts() of columns (H6)."""
    return F.array_sort(F.filter(F.array_union(wanted, F.array(corpus)), lambda x: x > 0))


def payload_valid(rows: DataFrame, order: list, valid: Column, sample: int = 2000) -> DataFrame:
    """(valid, tested): whether each ceil(n / sample)-th row in order, and the last, is valid; a payload without rows is."""
    n = rows.count()
    step = max(1, -(-n // sample))
    at = positions(rows, order, "_n")
    tested = at.where((F.col("_n") % step == 0) | (F.col("_n") == n - 1))
    return tested.agg(F.coalesce(F.min(F.coalesce(valid, F.lit(False))), F.lit(True)).alias("valid"), F.count("*").alias("tested"))


def merge_batches(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of batches that came one after the other (H3).

    nodes(batch, id, ...), links(batch, src, dst). Of equal ids the first batch
    counts. A link counts from the first batch that brings it when both ends
    are known by then; self-links and repetitions don't.
    """
    first = nodes.groupBy("id").agg(F.min_by(F.struct(*nodes.columns), "batch").alias("n")).select("n.*")
    known = first.select("id", F.col("batch").alias("since"))
    e = links.where("src <> dst").join(known.select(F.col("id").alias("src"), F.col("since").alias("s")), "src").join(known.select(F.col("id").alias("dst"), F.col("since").alias("t")), "dst")
    return first, e.where("s <= batch and t <= batch").groupBy("src", "dst").agg(F.min("batch").alias("batch"))


def top_up(fetch, wanted: int, most: int, calendar: bool = True) -> DataFrame:
    """Ask for more until enough articles are left after the filters, or the source has no more.

    fetch(n) gives nodes(title, ...) for a request of n. Nothing is cut off
    the last answer. calendar: years and days don't count either.
    """
    ask, before = max(1, int(wanted)), (-1, -1)
    other = is_disambiguation_title(F.col("title"))
    if calendar:
        other |= is_year_or_day(F.col("title"))
    while True:
        nodes = fetch(ask)
        n, good = nodes.agg(F.count("*"), F.count_if(~other)).first()
        if good >= wanted or ask >= most or (n <= before[0] and good <= before[1]):
            return nodes
        before, ask = (n, good), min(most, max(ask + 1, ask + wanted - good))


def labelled(candidates: DataFrame, zoom: float, show_all: bool = False) -> DataFrame:
    """Candidates (id, degree, active, hub) that get a label (G11): all active ones and hubs, then others by degree up to the budget. Candidates are made once and stored, as they are counted, ranked and read again."""
    if show_all:
        return candidates
    candidates, facts = measured(candidates, "candidates", n=F.count("*"), hubs=F.count_if("hub"), must=F.count_if(F.col("hub") | F.col("active")))
    n, hubs, must = facts["n"], facts["hubs"], facts["must"]
    budget = candidates.sparkSession.range(1).select(F.expr(L.label_budget(f"{n}L", zoom, f"{hubs}L"))).first()[0]
    rest = candidates.where("not hub and not active").orderBy(F.desc("degree"), "id").limit(max(0, budget - must))
    return candidates.where("hub or active").unionByName(rest)


def depth_order(points: DataFrame, depth: str = "depth") -> DataFrame:
    """points with their place from far to near."""
    return positions(points, [F.desc(depth), "idx"], "place").withColumn("place", F.col("place") + 1)


def hit(points: DataFrame, x: float, y: float, reach: str, depth: str | None = None) -> DataFrame:
    """The point under the pointer, or none (G13): of those within ``reach`` the first, or in space (depth) the nearest."""
    near = points.where(F.expr(f"sqrt((x - {x!r}D) * (x - {x!r}D) + (y - {y!r}D) * (y - {y!r}D)) <= {reach}"))
    return near.orderBy(*([depth] if depth else []), "idx").limit(1)


def seeds(clusters: DataFrame, tail: DataFrame, cap: int) -> DataFrame:
    """Clusters' titles in turn, then the tail; first occurrence kept, up to cap (H7). clusters(cluster, titles), tail(pos, title)."""
    a = clusters.select("cluster", F.posexplode("titles").alias("r", "title")).select(F.struct(F.lit(0).alias("part"), F.col("r").cast("long").alias("r"), F.col("cluster").cast("long").alias("c")).alias("at"), "title")
    b = tail.select(F.struct(F.lit(1).alias("part"), F.col("pos").cast("long").alias("r"), F.lit(0).cast("long").alias("c")).alias("at"), "title")
    return a.unionByName(b).groupBy("title").agg(F.min("at").alias("at")).orderBy("at").limit(cap).select("title", F.col("at.part").alias("part"))


def fallback_graph(count: int, spark) -> DataFrame:
    """Circulant edges at offsets 1, 2, 4 over min(count, 51) nodes."""
    n = max(1, min(int(count), 51))
    e = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("o")).select(F.col("i").alias("src"), ((F.col("i") + F.col("o")) % n).alias("dst"))
    return e.where("src <> dst").distinct()


def csr(edges: DataFrame) -> DataFrame:
    """(pos, node, t): both directions of every edge, sorted, each at its place in the targets' array (D7). A node's neighbours may lie in several tasks."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("t")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("t"))).distinct()
    return positions(both, ["node", "t"]).select("pos", "node", "t")


def csr_offsets(entries: DataFrame) -> DataFrame:
    """(node, first, n): where a node's neighbours begin in csr(), and how many they are."""
    return entries.groupBy("node").agg(F.min("pos").alias("first"), F.count("*").alias("n"))


def dense_index(articles: DataFrame, order: str = "seq") -> DataFrame:
    """articles with a 0-based index in load order."""
    return positions(articles, [order], "idx")


def colour(hub: Column, degree: Column, colours: tuple[str, str, str] = ("#254fef", "#6e86f2", "#b6c4ff")) -> Column:
    """A node's colour by kind: hub, linked four times or more, other (D8); any Column may stand in its place (N3). The colours."""
    return F.when(hub, colours[0]).when(degree >= 4, colours[1]).otherwise(colours[2])


def with_defaults(nodes: DataFrame) -> DataFrame:
    """nodes with id, where empty, from the title, and url, where missing, made of it (D3)."""
    from ..functions.text import url_component

    n = nodes.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), "title"))
    return n.withColumn("url", F.coalesce("url", url_component(F.col("title"))) if "url" in nodes.columns else url_component(F.col("title")))
