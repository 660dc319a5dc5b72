"""Tiers hold as many articles as they say."""

from linkweave import api


def test_unreached_articles_follow_in_source_order(spark):
    rows = [(i, str(i), f"T{i}", 1.0, x) for i, x in enumerate([[], ["4"], [], ["0"], ["1"], []])]
    df = spark.createDataFrame(rows, "seq long, id string, title string, byte_length double, links array<string>")
    got = [(r["seq"], r["tier_pos"]) for r in api.Engine(df).tiers([2, 5]).orderBy("tier_pos").collect()]
    assert got == [(1, 1), (4, 2), (0, 3), (2, 4), (3, 5)]
