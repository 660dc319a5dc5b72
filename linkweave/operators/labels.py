"""Label placement as rounds over a table of conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..storage import discard, measured, positions, stored

#: Most labels of a view, and most nodes that labels keep clear of.
MOST, OBSTACLES = 2000, 800
Box = tuple[float, float, float, float]


def boxes(candidates: DataFrame, bounds: Box, scale: float) -> DataFrame:
    """(rank, id, x, anchor, px, py, l, t, r, b): the six places of each label that meet the view, best first.

    Fixed values: sizes and gaps of text at a scale, and the places: below,
    above, right, left, right below, left below.
    """
    size = min(32.0, max(9.0, 10.5 / max(0.25, scale)))
    high, gap = size * 1.18, max(5.0, 7 / max(0.25, scale))
    side, under, over, level = f"(radius + {gap}D + width / 2)", f"y + radius + {gap}D", f"y - radius - {gap + high}D", f"y - {high / 2}D"
    places = [("x", under), ("x", over), (f"x + {side}", level), (f"x - {side}", level), (f"x + {side}", under), (f"x - {side}", under)]
    each = F.posexplode(F.array(*[F.struct(F.expr(px).alias("px"), F.expr(py).alias("py")) for px, py in places])).alias("anchor", "p")
    b = candidates.select("rank", "id", "x", "width", each).select("rank", "id", "x", "anchor", "p.px", "p.py", F.expr("p.px - width / 2").alias("l"), F.col("p.py").alias("t"), F.expr("p.px + width / 2").alias("r"), F.expr(f"p.py + {high}D").alias("b"))
    return b.where(f"r >= {bounds[0]}D and l <= {bounds[2]}D and b >= {bounds[1]}D and t <= {bounds[3]}D")


def conflicts(places: DataFrame, pad: float, cell: float) -> DataFrame:
    """(hi, ha, lo, la): places of two labels that do not go together, the label of better rank first. Boxes meet in the cells that they cover."""
    cover = lambda a, b, more: F.sequence(F.floor((F.col(a) - more) / cell), F.floor((F.col(b) + more) / cell))
    one = lambda k, more: places.select(*[F.col(c).alias(c + k) for c in ("rank", "anchor", "l", "t", "r", "b")], F.explode(cover("l", "r", more)).alias("cx"), cover("t", "b", more).alias("ys")).withColumn("cy", F.explode("ys")).drop("ys")
    both = one("1", 0.0).join(one("2", pad), ["cx", "cy"]).where(f"rank1 < rank2 and l2 < r1 + {pad}D and r2 > l1 - {pad}D and t2 < b1 + {pad}D and b2 > t1 - {pad}D")
    return both.select(F.col("rank1").alias("hi"), F.col("anchor1").alias("ha"), F.col("rank2").alias("lo"), F.col("anchor2").alias("la")).distinct()


def placed_labels(candidates: DataFrame, nodes: DataFrame, bounds: Box, scale: float, show_all: bool = False, most: int = MOST) -> DataFrame:
    """(id, x, y) of the labels that find a place.

    By priority, then id, each label takes its first place that meets no label
    of better rank that has one and no node; show_all puts those without such
    a place at their first one in view. The answer is that of going through
    the labels one by one, but in rounds: all labels that wait for no better
    one take their places at once, then places that meet those are struck out.
    As in the definition at most ``most`` labels are looked at, and nodes count
    if the view holds at most OBSTACLES.
    """
    pad = max(3.0, 4 / max(0.25, scale))
    top = candidates.orderBy(F.desc("priority"), "id").limit(most)
    ranked = stored(positions(top, [F.desc("priority"), "id"], "rank").select("rank", "id", "x", "y", "radius", "width"), "labels")
    every = stored(boxes(ranked, bounds, scale), "places")
    cell = max(1.0, every.agg(F.max(F.greatest(F.col("r") - F.col("l"), F.col("b") - F.col("t")))).first()[0] or 1.0)
    meets = stored(conflicts(every, pad, cell), "conflicts")
    near = nodes.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("radius").alias("nr")).where(F.expr(L.in_view("nx", "ny", "nr", bounds))).limit(OBSTACLES + 1)
    near = stored(near, "obstacles")
    free = every
    if near.count() <= OBSTACLES:  # at most OBSTACLES rows, sent along
        hit = F.expr(f"nx <> x AND pow(nx - greatest(l, least(nx, r)), 2) + pow(ny - greatest(t, least(ny, b)), 2) < pow(nr + {pad}D, 2)")
        free = every.join(F.broadcast(near), hit, "left_anti")
    free = stored(free.select("rank", "anchor"), "free")
    open_ = ranked.select("rank").join(every.select("rank"), "rank", "left_semi") if show_all else free.select("rank").distinct()
    first = every.groupBy("rank").agg(F.min("anchor").alias("first"))
    open_ = stored(open_, "open")
    done = None
    while True:
        # a label waits while a better open one may still take a place that meets one of its own
        may = every.select("rank", "anchor").join(open_, "rank", "left_semi") if show_all else free
        waits = meets.join(may.select(F.col("rank").alias("hi"), F.col("anchor").alias("ha")), ["hi", "ha"], "left_semi").join(free.select(F.col("rank").alias("lo"), F.col("anchor").alias("la")), ["lo", "la"], "left_semi").select(F.col("lo").alias("rank")).distinct()
        ready = open_.join(waits, "rank", "left_anti").join(free.groupBy("rank").agg(F.min("anchor").alias("anchor")), "rank", "left").join(first, "rank")
        ready, facts = measured(ready.select("rank", F.coalesce("anchor", "first" if show_all else F.lit(None).cast("int")).alias("anchor")), "ready", n=F.count("*"))
        if not facts["n"]:
            break
        done = ready if done is None else done.unionByName(ready)
        struck = meets.join(ready.select(F.col("rank").alias("hi"), F.col("anchor").alias("ha")), ["hi", "ha"], "left_semi").select(F.col("lo").alias("rank"), F.col("la").alias("anchor"))
        left = stored(free.join(struck, ["rank", "anchor"], "left_anti").join(ready.select("rank"), "rank", "left_anti"), "free")
        rest = stored(open_.join(ready.select("rank"), "rank", "left_anti"), "open")
        discard(free, open_)
        free, open_ = left, rest
    if done is None:
        return ranked.select("id", "x", "y").limit(0)
    return done.where("anchor is not null").join(every, ["rank", "anchor"]).select("id", F.col("px").alias("x"), F.col("py").alias("y"))
