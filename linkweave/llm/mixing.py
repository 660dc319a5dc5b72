"""Mixing sources to target weights along a curriculum that changes with time.

A source's target is its share of all words by weight, at most PASSES times its
own. Its schedule says how its weight runs over training time, from 0 to 1; the
integral of the schedule, scaled to the target, is the demand for its words up
to a time. A document stands at the time at which the demand reaches the words
that its source has given before it, for each time that the mix takes it; the
mix is all of them, sorted by that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, stored
from ..storage import positions

#: Weights of the sources in order of their names, repeating; most times that a source is taken.
WEIGHTS, PASSES = (5, 2, 1), 3
#: For each of WEIGHTS (time, relative weight), straight in between: the heavy sources first, the light ones last.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))


def reached(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a schedule is this share of the whole; weights must be positive within it."""
    spans = list(zip(schedule, schedule[1:]))
    areas = [(t1 - t0) * (v0 + v1) / 2 for (t0, v0), (t1, v1) in spans]
    out, before = None, 0.0
    for (((t0, v0), (t1, v1)), area) in zip(spans, areas):
        got, slope = share * F.lit(sum(areas)) - F.lit(before), (v1 - v0) / (t1 - t0)
        # the root of v0 d + slope d^2 / 2 = got, in a form that bears a slope of zero
        time = F.lit(t0) + F.lit(2.0) * got / (F.lit(v0) + F.sqrt(F.greatest(F.lit(v0 * v0) + F.lit(2.0 * slope) * got, F.lit(0.0))))
        before += area
        out = time if out is None else F.when(got >= 0, time).otherwise(out)
    return F.least(F.greatest(out, F.lit(schedule[0][0])), F.lit(schedule[-1][0]))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size, nth, target) of (source, source_size).

    Sources are weighted in code-point order, null last. What is above
    ``passes`` times a source's size is shared anew by weight among the rest:
    each round sums up those that are at their limit, until there are no more.
    """
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    s = positions(sizes, [F.col("source").asc_nulls_last()], "place")
    s = stored(s.withColumn("nth", F.pmod("place", F.lit(len(weights))).cast("int")).withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("nth") + 1)), "sources")
    wide = lambda c: c.cast("decimal(38,0)")
    rest, w, held = total, s.agg(F.sum("w")).first()[0] or 0, -1
    while True:
        over = wide(F.col("w")) * wide(F.lit(rest)) > wide(F.col("source_size")) * wide(F.lit(passes * w))
        at = s.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("source_size") * passes)).alias("size"), F.sum(F.when(over, F.col("w"))).alias("w"), F.sum("w").alias("all")).first()
        if at["n"] == held:
            break
        held, rest, w = at["n"], total - (at["size"] or 0), (at["all"] or 0) - (at["w"] or 0)
    share = F.col("w") * F.lit(rest) / F.lit(float(max(w, 1)))
    return s.select("source", "source_size", "nth", F.when(over, F.col("source_size") * passes).otherwise(share).cast("double").alias("target"))


def measured_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(nr, doc_id, source, size, before), in an order by source and the id's hash: words of a document, and those of its source in documents before it.

    Rows are sorted by range and stored; sums before a row are those of the
    source in earlier partitions, a number for each partition and source, and
    those within the row's own. So a source of any size needs no task of its own.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.md5(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("h"), F.xxhash64(text).alias("h2"))
    order = [F.col("source").asc_nulls_last(), "h", "doc_id", "h2"]
    t = stored(stored(d, "sizes").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("nr", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("nr", 33))
    earlier = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("part", "source").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)
    base = t.groupBy(F.col("part").alias("at"), F.col("source").alias("of")).agg(F.sum("size").alias("s")).select("at", "of", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inner = t.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    both = inner.join(base, (F.col("part") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    return both.select("nr", "doc_id", "source", "size", (F.col("inner") + F.col("base")).alias("before"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, schedules=SCHEDULES) -> tuple[DataFrame, DataFrame]:
    """(documents, mix): a row for each row of docs, and the rows of the mix in training order.

    documents: nr, doc_id, source, size, source_size, target. mix: nr, doc_id,
    source, copy, words, position (the training time, 0 to 1); the last copy
    of one document of a source may be cut, so that the words taken are the
    target rounded. Null and empty texts have no words and are not in the mix;
    a null source is one like any other, null ids count as empty, and of equal
    ids the text's hash decides. Repeated rows have a row each. An empty table
    gives none.
    """
    d = stored(measured_documents(docs, doc_id, text, source), "measured")
    t = stored(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes), "targets")
    of = t.withColumnRenamed("source", "of")
    j = d.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    quota, n = F.round("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    whole = F.floor(quota / n)
    copies = j.withColumns({"quota": quota, "n": n}).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), whole)))
    start = F.col("copy") * F.col("n") + F.col("before")
    c = copies.withColumns({"start": start, "words": F.least("size", F.col("quota") - start)}).where("words > 0")
    share, at = F.col("start") / F.col("quota"), None
    for k, s in enumerate(schedules):
        at = reached(share, s) if at is None else F.when(F.col("nth") == k, reached(share, s)).otherwise(at)
    c = c.select("nr", "doc_id", "source", "copy", "words", F.round(at, 9).alias("position"))
    order = ["position", "source", "nr", "copy"]
    placed = stored(c.repartitionByRange(*order).sortWithinPartitions(*order), "mix")
    return j.select("nr", "doc_id", "source", "size", "source_size", "target"), placed


def digest(documents: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position): words that the mix takes of each row, and where it is met first."""
    got = placed.groupBy("nr").agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    return documents.join(got, "nr", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "position")
