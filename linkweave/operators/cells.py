"""Nearest neighbours by a quadtree, so that a clump of nodes does not make a square of pairs.

The plane is cut into squares as wide as the reach; a square of more nodes
than ``cap`` is cut into four, and so on. A node that shares a square with
enough others has them within that square's far corner, so it looks no
further; it visits the leaves that this circle meets, which are few where
nodes are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, fresh, measured, stored

#: Halvings of a square; what is as near as that is not parted further.
DEPTH = 24
#: Squares cut at a level that are sent along; more are joined.
FEW = 50_000
#: Rounding of a square's edge, as a share of its width and place.
SLACK = 1e-9


def _held(df: DataFrame, cut: DataFrame, n: int, how: str) -> DataFrame:
    return df.join(F.broadcast(cut) if n <= FEW else cut, ["cx", "cy"], how)


def leaves(nodes: DataFrame, reach: float, cap: int, depth: int = DEPTH) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """Nodes(idx, x, y, want) with their leaf (level, cx, cy) and ``far``, a square distance within which at least ``want`` others lie, null where none is known; and by level the squares (cx, cy) that are cut, with their number.

    A square whose nodes all stand at one place is not cut, whatever their number.
    """
    spark, home = nodes.sparkSession, fresh(nodes.sparkSession, "leaves")
    cut: list[tuple[DataFrame, int]] = []
    now = stored(nodes.select("idx", "x", "y", "want", F.floor(F.col("x") / reach).cast("long").alias("cx"), F.floor(F.col("y") / reach).cast("long").alias("cy"), F.lit(None).cast("double").alias("far")), "crowd")
    kind = "idx long, x double, y double, want long, cx long, cy long, far double, level int"
    for level in range(depth + 1):
        box = now.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        crowded = (F.col("n") > cap) & ((F.col("x0") < F.col("x1")) | (F.col("y0") < F.col("y1")))
        split, facts = measured(box.where(crowded if level < depth else F.lit(False)), "cut", n=F.count("*"))
        _held(now, split.select("cx", "cy"), facts["n"], "left_anti").select("idx", "x", "y", "want", "cx", "cy", "far").write.parquet(f"{home}/level={level}")
        cut.append((split.select("cx", "cy"), facts["n"]))
        if not facts["n"]:
            break
        s = reach / 2 ** (level + 1)
        corner = F.pow(F.greatest(F.col("x") - F.col("x0"), F.col("x1") - F.col("x")), 2) + F.pow(F.greatest(F.col("y") - F.col("y0"), F.col("y1") - F.col("y")), 2)
        deeper = _held(now, split, facts["n"], "inner").withColumn("far", F.when(F.col("n") > F.col("want"), F.least("far", corner)).otherwise(F.col("far")))
        deeper = stored(deeper.select("idx", "x", "y", "want", F.floor(F.col("x") / s).cast("long").alias("cx"), F.floor(F.col("y") / s).cast("long").alias("cy"), "far"), "crowd")
        discard(now)
        now = deeper
    return spark.read.schema(kind).parquet(home), cut


def visits(points: DataFrame, cut: list[tuple[DataFrame, int]], reach: float) -> DataFrame:
    """(i, x, y, want, far, level, cx, cy): the leaves, and squares without nodes, that each node's circle meets. The circle's square radius is the lesser of ``far`` and the reach's."""
    spark, home = points.sparkSession, fresh(points.sparkSession, "visits")
    r2 = F.least(F.coalesce("far", F.lit(reach * reach)), F.lit(reach * reach))
    around = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)])
    now = points.select(F.col("idx").alias("i"), "x", "y", "want", r2.alias("r2"), F.floor(F.col("x") / reach).cast("long").alias("cx"), F.floor(F.col("y") / reach).cast("long").alias("cy"), F.explode(around).alias("s"))
    now = now.select("i", "x", "y", "want", "r2", (F.col("cx") + F.col("s.p")).alias("cx"), (F.col("cy") + F.col("s.q")).alias("cy"))

    def met(df: DataFrame, side: float) -> DataFrame:
        gap = lambda v, c: F.greatest(F.lit(0.0), F.greatest(F.col(c) * side - F.col(v), F.col(v) - (F.col(c) + 1) * side) - SLACK * (side + F.abs(v)))
        return df.where(F.pow(gap("x", "cx"), 2) + F.pow(gap("y", "cy"), 2) <= F.col("r2") * (1 + SLACK))

    now = stored(met(now, reach), "circles")
    four = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (0, 1) for q in (0, 1)])
    for level, (split, n) in enumerate(cut):
        _held(now, split, n, "left_anti").write.parquet(f"{home}/level={level}")
        if not n:
            break
        inside = _held(now, split, n, "left_semi").withColumn("s", F.explode(four)).select("i", "x", "y", "want", "r2", (2 * F.col("cx") + F.col("s.p")).alias("cx"), (2 * F.col("cy") + F.col("s.q")).alias("cy"))
        deeper = stored(met(inside, reach / 2 ** (level + 1)), "circles")
        discard(now)
        now = deeper
    return spark.read.schema("i long, x double, y double, want long, r2 double, cx long, cy long, level int").parquet(home)


def nearest(nodes: DataFrame, reach: float, k: int, cap: int | None = None) -> DataFrame:
    """(i, j, k): of each node (idx, x, y) the k nearest others within reach, numbered from 1, ties by idx.

    A column ``want`` asks for other numbers node by node; a node's circle is
    the smaller the fewer it wants. Nodes without a place have no neighbours.
    Of nodes at one place only as many as the most wanted, and one more, of
    smallest idx can be anyone's nearest, so the others are not listed there.
    Nodes that have fewer than they want in their widest square (as wide as
    the reach) look at all within reach.
    """
    n = nodes.where("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")
    n = n.select("idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("want") if "want" in nodes.columns else F.lit(k)).cast("long").alias("want"))
    most = n.agg(F.max("want")).first()[0] or 0
    points, cut = leaves(n, reach, max(64, 4 * k) if cap is None else cap)
    key = ["level", "cx", "cy"]
    box = points.groupBy(*key).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    corner = F.pow(F.greatest(F.col("x") - F.col("x0"), F.col("x1") - F.col("x")), 2) + F.pow(F.greatest(F.col("y") - F.col("y0"), F.col("y1") - F.col("y")), 2)
    own = points.join(box, key).withColumn("far", F.when(F.col("n") > F.col("want"), F.least("far", corner)).otherwise(F.col("far"))).select("idx", "x", "y", "want", "far")
    target = points.select(F.col("idx").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), *key)
    target = target.withColumn("_n", F.row_number().over(W.partitionBy(*key, "xj", "yj").orderBy("j"))).where(F.col("_n") <= most + 1).drop("_n")
    p = visits(own, cut, reach).join(target, key).where("i <> j").withColumn("d2", F.expr("(xj - x) * (xj - x) + (yj - y) * (yj - y)"))
    p = p.where(F.col("d2") <= F.col("r2") * (1 + SLACK)).where(F.sqrt("d2") <= reach)
    place = F.row_number().over(W.partitionBy("i").orderBy("d2", "j"))
    return p.withColumn("k", place).where(F.col("k") <= F.col("want")).select("i", "j", F.col("k").cast("long").alias("k"))
