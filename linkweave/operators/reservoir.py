"""Reservoir samples by key that any split of the rows gives as a scan in order does.

A reservoir of a key takes the first rows of each kind up to the kind's cap;
each later one draws a number from the key's generator, which its kinds share,
and takes the place of that number modulo the rows of its kind so far, if the
reservoir has that place. So a row's place follows from two counts, and the
last row in order holds a place. The generator is linear, so its j-th number
comes from the binary digits of j: each is an affine map, composed beforehand.
Counts are sums over earlier partitions plus those within the row's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Multiplier and increment of the generator (modulo 2^32), its start for all rows, and the factors of a tile's start.
MULTIPLIER, INCREMENT, WHOLE, ACROSS, DOWN = 1664525, 1013904223, 0x9E3779B9, 73856093, 19349663
MASK = 0xFFFFFFFF
#: Binary digits of the number of draws of a key.
DIGITS = 40


def drawn(start: Column, j: Column, digits: int = DIGITS) -> Column:
    """The j-th number of the generator from a start; the 0th is the start itself."""
    a, c = MULTIPLIER, INCREMENT
    steps = []
    for _ in range(digits):
        steps.append((a, c))
        a, c = a * a & MASK, (a * c + c) & MASK
    # products are split in two, so that they stay within 63 bits
    maps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a >> 16).cast("long").alias("h"), F.lit(a & 0xFFFF).cast("long").alias("l"), F.lit(c).cast("long").alias("c")) for k, (a, c) in enumerate(steps)])

    def step(v: Column, m: Column) -> Column:
        moved = (F.shiftleft((v * m["h"]).bitwiseAND(MASK), 16) + v * m["l"] + m["c"]).bitwiseAND(MASK)
        return F.when(F.pmod(F.floor(j / F.pow(F.lit(2.0), m["k"])), F.lit(2)) == 1, moved).otherwise(v)

    return F.aggregate(maps, start.cast("long"), step)


def tile_start(tx: Column, ty: Column) -> Column:
    """Where a tile's generator starts."""
    return (tx.cast("long") * ACROSS).bitwiseAND(MASK).bitwiseXOR((ty.cast("long") * DOWN).bitwiseAND(MASK))


def counted(t: DataFrame, keys: list[str], what: Column, name: str) -> DataFrame:
    """t(_part, _at, ...) with the sum of ``what`` over the rows of the same keys up to and with the row's own, in order of _at. Keys must not be null."""
    own = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_inner", F.sum(what).over(own))
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = t.groupBy("_part", *keys).agg(F.max("_inner").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return t.join(base, ["_part", *keys]).withColumn(name, F.col("_inner") + F.col("_base")).drop("_inner", "_base")


def reservoirs(rows: DataFrame, keys: list[str], order: list[str], caps: dict[str, int], start: Column) -> DataFrame:
    """rows(kind, ...) that are in their key's reservoir at the end, with their place ``slot`` (I2; I4 with no keys).

    caps: of each kind; rows of other kinds, or with a null key, are left out.
    ``order`` must tell all rows apart. Rows travel once by order and, narrow,
    once for each count; a place's row is chosen before the shuffle, so that a
    key that holds most rows is no hot key.
    """
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("kind")]
    good = rows.where(F.col("kind").isin(list(caps)))
    for k in keys:
        good = good.where(F.col(k).isNotNull())
    own = [c for c in rows.columns]
    t = good.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct(*own).alias("_row"), "kind", *keys, F.monotonically_increasing_id().alias("_at"))
    t = stored(t, "ordered")
    slim = t.select("kind", *keys, "_at", F.shiftright("_at", 33).alias("_part"))
    n = stored(counted(slim, [*keys, "kind"], F.lit(1).cast("long"), "_n").withColumn("_over", (F.col("_n") > cap).cast("long")), "counted")
    late = counted(n, keys, F.col("_over"), "_j")
    slot = F.when(F.col("_over") == 0, F.col("_n") - 1).otherwise(F.pmod(drawn(start, F.col("_j")), F.col("_n")))
    kept = late.withColumn("slot", slot).where(F.col("slot") < cap).groupBy(*keys, "kind", "slot").agg(F.max("_at").alias("_at"))
    return t.select("_row", "_at").join(kept.select("_at", "slot"), "_at").select("_row.*", "slot")
