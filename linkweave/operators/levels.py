"""Levels and places of breadth-first orders in graphs that are too deep for a job a level.

Nodes are longs. Paths of nodes of degree two are contracted to one weighted
edge by pointer doubling before levels are settled; and where every node of a
stretch of levels has one parent, the places of all of them follow from the
places where the stretch begins, again by doubling. So jobs grow with the
logarithm of the depth, and besides with the levels where paths meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, fresh, measured, positions, stored, written
from .blocks import least_costs


def through_chains(arcs: DataFrame, inner: DataFrame) -> DataFrame:
    """(a, b, y, n): an arc from a to an inner node b comes, n steps from a, to y, the first node that is not inner.

    arcs(u, v) hold both directions; inner(u) have two neighbours each. A ring
    of inner nodes alone has no such y, so one of its nodes must be left out.
    """
    ends = arcs.join(inner, "u", "left_semi").groupBy("u").agg(F.min("v").alias("p"), F.max("v").alias("q"))
    there = ends.select(F.col("p").alias("a"), F.col("u").alias("b"), F.col("u").alias("c"), F.col("q").alias("d"), F.lit(1).cast("long").alias("n"))
    back = ends.select(F.col("q").alias("a"), F.col("u").alias("b"), F.col("u").alias("c"), F.col("p").alias("d"), F.lit(1).cast("long").alias("n"))
    s, moved = stored(there.unionByName(back), "chains"), 1
    while moved:
        on = s.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("c").alias("c2"), F.col("d").alias("d2"), F.col("n").alias("n2"))
        step = s.join(on, ["c", "d"], "left").select("a", "b", F.coalesce("c2", "c").alias("c"), F.coalesce("d2", "d").alias("d"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.col("n2").isNotNull().alias("moved"))
        new, facts = measured(step, "chains", n=F.count_if("moved"))
        discard(s)
        s, moved = new.drop("moved"), facts["n"]
        s.stored_path = new.stored_path
    return s.select("a", "b", F.col("d").alias("y"), (F.col("n") + 1).alias("n"))


def levels(arcs: DataFrame, starts: DataFrame, edges_a_block: int | None = None) -> DataFrame:
    """(u, level): steps from the nearest of starts(u), of which each component of arcs(u, v), in both directions, has one or more."""
    inner = stored(arcs.groupBy("u").count().where("count = 2").select("u").join(starts.select("u"), "u", "left_anti"), "inner")
    ends = through_chains(arcs, inner)
    held = inner.select(F.col("u").alias("a"))
    direct = arcs.join(inner, "u", "left_anti").join(inner.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v", F.lit(1).cast("long").alias("w"))
    short = ends.join(held, "a", "left_anti").where("a <> y").groupBy(F.col("a").alias("u"), F.col("y").alias("v")).agg(F.min("n").alias("w"))
    kept = stored(direct.unionByName(short), "kept")
    bound = {} if edges_a_block is None else {"edges_a_block": edges_a_block}
    costs, _ = least_costs(kept, starts.select(F.col("u").alias("node"), F.lit(0).alias("cost")), **bound)
    costs = stored(costs, "costs")
    away = arcs.join(inner, "u", "left_semi").join(ends.select(F.col("a").alias("u"), F.col("b").alias("v"), "y", "n"), ["u", "v"], "left")
    away = away.select("u", F.coalesce("y", "v").alias("node"), F.coalesce("n", F.lit(1).cast("long")).alias("n")).join(costs, "node")
    return costs.select(F.col("node").alias("u"), F.col("cost").alias("level")).unionByName(away.groupBy("u").agg(F.min(F.col("cost") + F.col("n")).alias("level")))


def by_tops(nodes: DataFrame) -> DataFrame:
    """(u, top, rank) of nodes(u, parent, depth): the ancestor of depth 0, and a rank that orders nodes of one top and depth as their paths from it, compared from the top down by number, are ordered."""
    s = stored(nodes.where("depth > 0").select("u", F.col("parent").alias("anc"), (F.col("depth") - 1).alias("left"), F.col("u").alias("rank")), "paths")
    while s.where("left > 0").limit(1).count():
        up = s.select(F.col("u").alias("anc"), F.col("anc").alias("anc2"), F.col("left").alias("left2"), F.col("rank").alias("above"))
        step = s.where("left > 0").join(up, "anc").select("u", F.col("anc2").alias("anc"), F.col("left2").alias("left"), "above", "rank")
        new = positions(step, ["above", "rank"], "place").select("u", "anc", "left", F.col("place").alias("rank"))
        new = stored(s.where("left = 0").unionByName(new), "paths")  # finished paths are ancestors of others, so they stay
        discard(s)
        s = new
    return nodes.where("depth = 0").select("u", F.col("u").alias("top"), F.lit(0).cast("long").alias("rank")).unionByName(s.select("u", F.col("anc").alias("top"), "rank"))


def places(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(u, top, place, rank): among nodes of one component and level, breadth-first order is that of (place, rank).

    nodes(u, component, level); within a component the order of equal parents'
    children is that of u. A level where a node has several parents, as any
    level 0, begins a stretch; stretches of all components are gone through
    together, the first of each, then the second.
    """
    spark = nodes.sparkSession
    low, high = nodes.select("u", F.col("level").alias("lu")), nodes.select(F.col("u").alias("v"), F.col("level").alias("lv"))
    up = stored(arcs.join(low, "u").join(high, "v").where("lu + 1 = lv").select(F.col("v").alias("u"), F.col("u").alias("parent")), "parents")
    one = up.groupBy("u").agg(F.count("*").alias("parents"), F.min("parent").alias("parent"))
    n = stored(nodes.join(one, "u", "left"), "nodes")
    begun = positions(n.where("level = 0 or parents > 1").select("component", "level").distinct(), ["component", "level"], "at")
    begun = stored(begun.join(begun.groupBy("component").agg(F.min("at").alias("first")), "component").select("component", "level", (F.col("at") - F.col("first")).alias("r")), "stretches")
    # a level belongs to the last stretch begun: levels and beginnings in one order, carried on by a maximum over what stands before
    level = stored(n.select("component", "level").distinct().join(begun, ["component", "level"], "left"), "levels")
    own = stored(carried(level), "levels")
    n = n.join(own, ["component", "level"]).select("u", "component", "level", "r", "parent", (F.col("level") - F.col("begins")).alias("depth"))
    n = stored(n, "nodes")
    tops = stored(by_tops(n), "tops")
    rounds = begun.agg(F.max("r")).first()[0] or 0
    into = n.where("depth = 0 and r > 0").select("u", "component", "r").join(up, "u").join(tops.select(F.col("u").alias("parent"), "top", "rank"), "parent")
    folder = fresh(spark, "into")
    into.select("u", "component", "top", "rank", "r").repartitionByRange("r", "u").write.partitionBy("r").parquet(folder)
    kind = "u long, component " + nodes.schema["component"].dataType.simpleString() + ", top long, rank long, r long"
    home = fresh(spark, "places")
    last = written(n.where("level = 0").select("u", F.lit(0).cast("long").alias("place")), f"{home}/r=0")
    for r in range(1, rounds + 1):
        met = spark.read.schema(kind).parquet(folder).where(F.col("r") == r).join(last.withColumnRenamed("u", "top"), "top")
        best = met.groupBy("u", "component").agg(F.min(F.struct("place", "rank")).alias("by"))
        last = written(positions(best, ["component", "by", "u"], "place_").select("u", F.col("place_").alias("place")), f"{home}/r={r}")
    all_ = spark.read.schema("u long, place long, r int").parquet(home).select(F.col("u").alias("top"), "place")
    return tops.join(all_, "top").select("u", "top", "place", "rank")


def carried(levels_: DataFrame) -> DataFrame:
    """levels(component, level, r or null) with the r and level of the last beginning at or before each level, whatever the number of levels: by place over a range sort, and the last beginning of the partitions before."""
    at = positions(levels_, ["component", "level"], "at")
    at = stored(at.withColumn("part", F.expr("at div 65536")), "levels")
    mark = F.when(F.col("r").isNotNull(), F.struct("at", "r", F.col("level").alias("begins")))
    before = at.groupBy("part").agg(F.max(mark).alias("m"))
    # a row for each 65 536 levels
    before = before.select("part", F.max("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("m0"))
    here = F.max(mark).over(W.partitionBy("part").orderBy("at"))
    both = at.withColumn("m", here).join(before, "part").withColumn("m", F.coalesce("m", "m0"))
    return both.select("component", "level", "m.r", "m.begins")
