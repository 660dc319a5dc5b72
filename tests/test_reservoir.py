"""Reservoirs against a scan in order, for several splits of the rows; runs of the tile store."""

import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators import reservoir
from linkweave.sources import tiles


def scanned(rows, caps, start):
    """What the generator and the reservoirs hold after going through the rows one by one."""
    state, count, held = {}, {}, {}
    for seq, kind, tx, ty in rows:
        key = (tx, ty)
        n = count[key, kind] = count.get((key, kind), 0) + 1
        slot = n - 1
        if n > caps[kind]:
            state[key] = (state.get(key, start(tx, ty)) * reservoir.MULTIPLIER + reservoir.INCREMENT) % 2**32
            slot = state[key] % n
        if slot < caps[kind]:
            held[tx, ty, kind, slot] = seq
    return held


@pytest.mark.parametrize("parts", ["1", "5", "16"])
def test_any_split_gives_the_scan(spark, parts):
    """One tile holds half of all rows; kinds share the tile's generator; rows of another kind are left out."""
    rng = random.Random(11)
    rows = [(i, rng.choice("aab"), *((3, 200) if rng.random() < 0.5 else (rng.randint(0, 5), rng.randint(0, 5)))) for i in range(4000)]
    caps = {"a": 40, "b": 7}
    df = spark.createDataFrame([*rows, (9999, "other", 0, 0)], "seq long, kind string, tx int, ty int").orderBy(F.rand(4))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r["tx"], r["ty"], r["kind"], r["slot"]): r["seq"] for r in reservoir.reservoirs(df, ["tx", "ty"], ["seq"], caps, reservoir.tile_start(F.col("tx"), F.col("ty"))).collect()}
        whole = {r["slot"]: r["seq"] for r in reservoir.reservoirs(df.where("kind = 'a'"), [], ["seq"], caps, F.lit(reservoir.WHOLE)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == scanned(rows, caps, lambda tx, ty: (tx * 73856093 % 2**32) ^ (ty * 19349663 % 2**32))
    assert {k[3]: v for k, v in scanned([(s, k, 0, 0) for s, k, _, _ in rows if k == "a"], caps, lambda tx, ty: 0x9E3779B9).items()} == whole


def test_jump_ahead(spark):
    x, want = 123456789, {0: 123456789}
    for j in range(1, 3000):
        x = want[j] = (x * 1664525 + 1013904223) % 2**32
    got = spark.range(3000).select("id", reservoir.drawn(F.lit(123456789), F.col("id")).alias("x")).collect()
    assert {r["id"]: r["x"] for r in got} == want
    a, c = pow(1664525, 10**11, 2**32), 1013904223 * ((pow(1664525, 10**11, 1664524 * 2**32) - 1) // 1664524) % 2**32
    assert spark.range(1).select(reservoir.drawn(F.lit(5), F.lit(10**11))).first()[0] == (5 * a + c) % 2**32


def test_curve_and_runs(spark):
    p = spark.range(64).select((F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    assert sorted(r[0] for r in p.select(tiles.z_order(F.col("x"), F.col("y"))).collect()) == list(range(64))
    assert all(r["z"] == tiles._z(r["x"], r["y"]) for r in p.withColumn("z", tiles.z_order(F.col("x"), F.col("y"))).collect())
    assert tiles.runs([("a", 10, 5), ("a", 0, 10), ("b", 0, 3), ("a", 9000, 1)]) == [("a", 0, 15), ("a", 9000, 1), ("b", 0, 3)]
