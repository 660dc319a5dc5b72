"""What a layout is written as: positions, a bake's manifest, an SVG drawing, and the tile cache of a large drawing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as T
from ..functions.layout import Settings
from ..operators import rank, reservoir
from ..storage import stored
from . import articles as S
from . import files, tiles

#: Rows of a tile and of the overview that are kept, by kind.
TILE_CAPS = {"line": 2500, "circle": 1500, "text": 250}
OVERVIEW_CAPS = {"line": 200_000, "circle": 150_000, "text": 40_000}
GRID = 256
#: Fixed values of drawings: margin, label size, gap and width of a letter.
MARGIN, FONT, GAP, LETTER = 42.0, 12.0, 10.0, 7.2


def positions_table(nodes: DataFrame) -> DataFrame:
    """(seq, id, title, x, y, inDegree, outDegree) of laid-out nodes."""
    return nodes.select("seq", "id", "title", "x", "y", F.col("in_degree").alias("inDegree"), F.col("out_degree").alias("outDegree"))


def write_positions(nodes: DataFrame, path: str) -> None:
    """Positions as JSON lines in order of seq."""
    positions_table(nodes).repartitionByRange("seq").sortWithinPartitions("seq").drop("seq").write.json(path)


def write_bake_manifest(path: str, settings: Settings, nodes: int, links: int, hubs: int, ticks: int, seconds: float) -> dict:
    """Settings, counts and times of a bake (A23); the memory is the driver's peak."""
    import resource
    from dataclasses import asdict

    m = {"type": "bake", "settings": asdict(settings), "nodes": nodes, "links": links, "hubs": hubs, "iterations": ticks, "durationSeconds": round(seconds, 3), "peakRssKb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss}
    files.write_json(path, m)
    return m


def _points(nodes: DataFrame, padding: float) -> DataFrame:
    point = {"x": F.expr(L.finite("x")), "y": F.expr(L.finite("y")), "r": F.expr(L.export_radius("radius", padding=padding))}
    text = F.regexp_replace(F.coalesce("title", "id"), "[\\r\\n]+", " ")
    return nodes.select("seq", "id", text.alias("text"), "hub", *[v.alias(k) for k, v in point.items()])


def svg_box(nodes: DataFrame, labels: bool = True, padding: float = 18.0) -> tuple[float, float, float, float] | None:
    """(left, top, width, height) of a drawing with its labels and margin; None for no nodes."""
    p = _points(nodes, padding).withColumn("w", F.greatest(F.lit(FONT), F.length("text") * LETTER))
    right = F.greatest(F.col("x") + F.col("r"), F.col("x") + F.col("r") + GAP + F.col("w")) if labels else F.col("x") + F.col("r")
    half = F.greatest(F.col("r"), F.lit(FONT * 0.7)) if labels else F.col("r")
    b = p.agg(F.min(F.col("x") - F.col("r")), F.min(F.col("y") - half), F.max(right), F.max(F.col("y") + half)).first()
    if b[0] is None:
        return None
    return b[0] - MARGIN, b[1] - MARGIN, max(1.0, b[2] - b[0] + 2 * MARGIN), max(1.0, b[3] - b[1] + 2 * MARGIN)


def svg_lines(nodes: DataFrame, links: DataFrame, labels: bool = True, no_links: bool = False, width: float | None = None, height: float | None = None, padding: float = 18.0, fill: Column | None = None) -> DataFrame:
    """(section, seq, part, value): the drawing line by line.

    nodes(seq, id, title, hub, x, y, radius), links(src, dst). ``fill`` is any
    Column over nodes' id, hub, x, y and r (N3). No nodes is an error.
    """
    spark = nodes.sparkSession
    box = svg_box(nodes, labels, padding)
    if box is None:
        raise ValueError("no nodes to draw")
    n, c = T.svg_number, lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    x0, y0, w, h = box
    num = lambda v: "0" if (t := f"{v:.3f}".rstrip("0").rstrip(".")) == "-0" else t
    p = stored(_points(nodes, padding), "points")
    stroke = lambda other: F.when(F.col("hub"), "#2f9e44").otherwise(other)
    facts = p.count(), 0 if no_links else links.count()
    # fixed format from here on: elements and their attributes as readers of drawings expect them
    head = [
        '<?xml version="1.0" encoding="UTF-8"?>', f'<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="{num(width or w)}" height="{num(height or h)}" viewBox="{num(x0)} {num(y0)} {num(w)} {num(h)}" role="img" aria-labelledby="graph-title graph-description">',
        f'<title id="graph-title">{facts[0]:,} articles</title>', f'<desc id="graph-description">Article graph with {facts[1]:,} connections{" and labels" if labels else ""}.</desc>',
        '<defs><marker id="arrow" viewBox="0 0 8 8" refX="7" refY="4" markerWidth="8" markerHeight="8" orient="auto" markerUnits="userSpaceOnUse"><path d="M 0 0 L 8 4 L 0 8 z" fill="#73777f" fill-opacity=".34" /></marker></defs>',
        f'<rect x="{num(x0)}" y="{num(y0)}" width="{num(w)}" height="{num(h)}" fill="#fbfcfe" />',
    ]
    fixed = [(0, k, 0, v) for k, v in enumerate(head)]
    fixed += [] if no_links else [(1, 0, 0, '<g class="links" fill="none" stroke="#73777f" stroke-opacity=".28" stroke-width="1" stroke-linecap="round" marker-end="url(#arrow)">'), (3, 0, 0, "</g>")]
    fixed += [(4, 0, 0, '<g class="nodes">'), (6, 0, 0, "</g>")]
    fixed += [(7, 0, 0, f'<g class="labels" font-size="{FONT:g}" text-anchor="middle" dominant-baseline="central">'), (9, 0, 0, "</g>")] if labels else []
    out = spark.createDataFrame([*fixed, (10, 0, 0, "</svg>")], "section int, seq long, part int, value string")
    row = lambda df, section, value, part=0: df.select(F.lit(section).alias("section"), F.col("seq").cast("long").alias("seq"), F.lit(part).alias("part"), value.alias("value"))
    if not no_links:
        end = lambda k: p.select(F.col("id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
        e = links.join(end("src"), "src").join(end("dst"), "dst").withColumn("seq", F.xxhash64("src", "dst") if "seq" not in links.columns else F.col("seq"))
        out = out.unionByName(row(e, 2, c('<line x1="', n(F.col("xsrc")), '" y1="', n(F.col("ysrc")), '" x2="', n(F.col("xdst")), '" y2="', n(F.col("ydst")), '" />')))
    paint = F.lit("#9aabf8") if fill is None else fill
    out = out.unionByName(row(p, 5, c('<circle data-node-id="', T.xml_escape(F.col("id")), '" cx="', n(F.col("x")), '" cy="', n(F.col("y")), '" r="', n(F.col("r")), '" fill="', paint, '" stroke="', stroke("rgba(28, 32, 39, .28)"), '" stroke-width="', F.when(F.col("hub"), "1.6").otherwise("1"), '" />')))
    if labels:
        at = F.col("x") + F.col("r") + GAP + F.greatest(F.lit(FONT), F.length("text") * LETTER) / 2
        tick = c('<line x1="', n(F.col("x") + F.col("r")), '" y1="', n(F.col("y")), '" x2="', n(F.col("x") + F.col("r") + 3), '" y2="', n(F.col("y")), '" stroke="', stroke("#9aa4b8"), '" stroke-opacity=".34" stroke-width=".7" />')
        text = c('<text data-node-label="', T.xml_escape(F.col("id")), '" x="', n(at), '" y="', n(F.col("y")), '" fill="#555c68" font-weight="', F.when(F.col("hub"), "600").otherwise("500"), '">', T.xml_escape(F.col("text")), "</text>")
        out = out.unionByName(row(p, 8, tick)).unionByName(row(p, 8, text, 1))
    return out


def write_svg(nodes: DataFrame, links: DataFrame, path: str, **options) -> None:
    """The drawing as text files whose order is the drawing's; put one after the other they are one SVG."""
    lines = svg_lines(nodes, links, **options)
    lines.repartitionByRange("section", "seq", "part", "value").sortWithinPartitions("section", "seq", "part", "value").select("value").write.text(path)


def view_box(spark: SparkSession, path: str) -> tuple[float, float, float, float]:
    """The four finite numbers of a drawing's viewBox; an error if they are not there."""
    head = spark.read.text(path).where(F.col("value").rlike("(?i)<svg\\b")).limit(1).collect()
    found = re.search(r'(?i)<svg\b[^>]*\bviewBox="([^"]+)"', head[0][0]) if head else None
    if not found:
        raise ValueError(f"{path} has no viewBox")
    try:
        box = tuple(float(x) for x in re.split("[ ,]+", found[1].strip()))
    except ValueError:
        box = ()
    if len(box) != 4 or any(v != v or abs(v) == float("inf") for v in box):
        raise ValueError(f"{path} has a bad viewBox: {found[1]}")
    return box


def tiled(elements: DataFrame, box: tuple[float, float, float, float], grid: int = GRID, *carry: str) -> DataFrame:
    """(kind, values, text, tx, ty) of svg_elements(): numbers of each and the tile of its middle."""
    a = lambda k, d=0.0: F.coalesce(F.expr(f"try_cast(attributes['{k}'] AS DOUBLE)"), F.lit(d))
    kind = F.col("kind")
    values = F.when(kind == "line", F.array(a("x1"), a("y1"), a("x2"), a("y2"))).when(kind == "circle", F.array(a("cx"), a("cy"), a("r", 2.0))).otherwise(F.array(a("x"), a("y")))
    e = elements.withColumn("values", values)
    mid = lambda k: F.when(kind == "line", (F.col("values")[k] + F.get("values", F.lit(k + 2))) * 0.5).otherwise(F.col("values")[k])
    e = e.withColumns({"tx": rank.tile(mid(0), box[0], box[2], grid), "ty": rank.tile(mid(1), box[1], box[3], grid)})
    return e.select("kind", "values", "text", "tx", "ty", *carry)


def svg_text(spark: SparkSession, svg: str) -> DataFrame:
    """(value, at): the lines of a drawing with their place in it, by file, part of the file and line."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(svg).select("value", at.alias("at"))


def build_tiles(spark: SparkSession, svg: str, cache: str, grid: int = GRID, caps: dict[str, int] | None = None) -> dict:
    """Bucket a drawing's elements into tiles, keep a reservoir of each and of all, and write them to a tile store with their counts."""
    box, caps = view_box(spark, svg), caps or TILE_CAPS
    e = stored(tiled(S.svg_elements(svg_text(spark, svg), "at"), box, grid, "at"), "elements")
    n = stored(e.groupBy("tx", "ty", "kind").agg(F.count("*").alias("n")), "counts")
    counts = {r["kind"]: r["n"] for r in n.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    kept = reservoir.reservoirs(e, ["tx", "ty"], ["at"], caps, reservoir.tile_start(F.col("tx"), F.col("ty")))
    index = stored(tiles.packed(kept, n, f"{cache}/packs"), "index")
    index.repartitionByRange("z").sortWithinPartitions("z").write.parquet(f"{cache}/index")
    n.write.parquet(f"{cache}/counts")
    whole = reservoir.reservoirs(e, [], ["at"], OVERVIEW_CAPS, F.lit(reservoir.WHOLE))
    whole.select("tx", "ty", "kind", "values", "text").write.parquet(f"{cache}/overview")
    meta = {"version": 2, "input": svg, "viewBox": list(box), "grid": grid, "caps": caps, "counts": counts, "tiles": index.count()}
    files.write_json(f"{cache}/meta.json", meta)
    return meta


def tile_range(view: tuple[float, float, float, float], box: tuple[float, float, float, float], grid: int = GRID) -> tuple[int, int, int, int]:
    """First and last tile, across and down, that a view (left, top, right, bottom) shows (L4)."""
    import math

    first = lambda v, low, extent: max(0, math.floor((v - low) / extent * grid))
    last = lambda v, low, extent: min(grid - 1, math.ceil((v - low) / extent * grid))
    return first(view[0], box[0], box[2]), last(view[2], box[0], box[2]), first(view[1], box[1], box[3]), last(view[3], box[1], box[3])


def in_tiles(elements: DataFrame, span: tuple[int, int, int, int]) -> DataFrame:
    return elements.where(F.col("tx").between(span[0], span[1]) & F.col("ty").between(span[2], span[3]))


def view_tiles(spark: SparkSession, cache: str, view: tuple[float, float, float, float], scale: float) -> DataFrame:
    """(tx, ty, kind, values, text) to draw: the overview below a scale of 1.5, else the tiles in view, of which only their own bytes are read."""
    meta = files.read_json(f"{cache}/meta.json")
    if meta is None:
        raise FileNotFoundError(f"no cache at {cache}")
    if scale < 1.5:
        return spark.read.schema("tx int, ty int, kind string, values array<double>, text string").parquet(f"{cache}/overview")
    return tiles.read_tiles(spark, cache, tile_range(view, tuple(meta["viewBox"]), meta["grid"]))
