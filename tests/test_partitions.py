"""Queries bound what a task takes of a shuffle, and leave a tighter setting as it is."""

from linkweave.plans import fixtures

from .conftest import SF

NAME = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_partitions_stay_small(spark):
    before = spark.conf.get(NAME)
    try:
        for have, want in (("64m", str(fixtures.PARTITION)), ("1m", "1m")):
            spark.conf.set(NAME, have)
            fixtures.tables(spark, SF, "part")
            assert spark.conf.get(NAME) == want
    finally:
        spark.conf.set(NAME, before)


def test_no_broadcast_by_the_size_of_a_file(spark, tmp_path):
    """Aliases of 400 000 parts, some 2 MB as Parquet and over 100 in memory, are not broadcast to be met by references."""
    from linkweave.operators import graph

    spark.range(400_000).selectExpr("id AS p_partkey", "concat('part ', id % 10) AS p_name", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    (tmp_path / "lineitem.parquet").symlink_to("/root/testdata/sf0.1/lineitem.parquet")  # planned, not run
    assert sum(f.stat().st_size for f in (tmp_path / "part.parquet").glob("*.parquet")) < 10 << 20
    a = fixtures.articles(spark, str(tmp_path))
    plan = graph.resolve(a)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_own_factor_of_files_stays(spark):
    name = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(name)
    try:
        for have, want in (("1.0", str(fixtures.IN_MEMORY)), ("50.0", "50.0")):
            spark.conf.set(name, have)
            fixtures.tables(spark, SF, "part")
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
