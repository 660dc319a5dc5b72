"""A merge as a stream gives the rows of the merge at once, however its rows are split and wherever it stops."""

import random

import pytest

from linkweave.operators import rank
from linkweave.streaming import merge

NODES, LINKS = "batch long, id string, title string", "batch long, src string, dst string"


def rows(seed):
    r = random.Random(seed)
    nodes = [(b, f"n{r.randrange(30)}", f"t{b}") for b in range(1, 6) for _ in range(6)]
    links = [(b, "n0" if r.random() < 0.3 else f"n{r.randrange(34)}", f"n{r.randrange(34)}") for b in range(1, 6) for _ in range(30)]
    nodes = list({(b, i): (b, i, t) for b, i, t in nodes}.values())  # of one batch an id comes once
    return nodes + [(None, "n1", "x"), (2, None, "x")], links + [(1, None, "n1"), (None, "n1", "n2"), (3, "n3", "n3")]


def put(spark, data, schema, folder, parts, order):
    for k in range(parts):
        spark.createDataFrame([x for j, x in enumerate(order(data)) if j * parts // len(data) == k], schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("order,in_order", [(lambda d: sorted(d, key=lambda x: -(x[0] or 0)), False), (lambda d: random.Random(5).sample(d, len(d)), False), (lambda d: sorted(d, key=lambda x: x[0] or 0), True)])
def test_any_split_and_order(spark, tmp_path, order, in_order):
    nodes, links = rows(1)
    t = str(tmp_path)
    put(spark, nodes, NODES, f"{t}/n", 2, order)
    put(spark, links, LINKS, f"{t}/l", 2, order)
    stream = lambda schema, f, n: spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(f)
    n_at_a_time = 100 if in_order else 1  # in order: a batch's rows are not behind those of a later one
    merge.merge_stream(stream(NODES, f"{t}/n", n_at_a_time), stream(LINKS, f"{t}/l", 1), f"{t}/out", f"{t}/cp", salts=3, in_order=in_order)
    want_n, want_l = rank.merge_batches(spark.createDataFrame([x for x in nodes if x[0] and x[1]], NODES), spark.createDataFrame(links, LINKS))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, merge.merged_links(spark, f"{t}/out").collect()), key=key) == sorted(map(tuple, want_l.collect()), key=key)
    assert sorted(map(tuple, merge.merged_nodes(spark, f"{t}/out").collect()), key=key) == sorted(map(tuple, want_n.select("batch", "id", "title").collect()), key=key)


def test_goes_on_where_it_stopped(spark, tmp_path):
    """A second call takes up only what came since, and links that waited then go on; the session keeps its state store."""
    t = str(tmp_path)
    before = spark.conf.get(merge.PROVIDER, None)

    def run():
        merge.merge_stream(spark.readStream.schema(NODES).parquet(f"{t}/n"), spark.readStream.schema(LINKS).parquet(f"{t}/l"), f"{t}/out", f"{t}/cp")
        return {tuple(r) for r in merge.merged_links(spark, f"{t}/out").collect()}

    spark.createDataFrame([(1, "a", "")], NODES).write.mode("append").parquet(f"{t}/n")
    spark.createDataFrame([(2, "a", "b"), (1, "a", "b"), (3, "b", "a")], LINKS).write.mode("append").parquet(f"{t}/l")
    assert run() == set()
    spark.createDataFrame([(2, "b", "")], NODES).write.mode("append").parquet(f"{t}/n")
    assert run() == {("a", "b", 2), ("b", "a", 3)}
    spark.createDataFrame([(1, "b", "")], NODES).write.mode("append").parquet(f"{t}/n")
    assert run() == {("a", "b", 1), ("b", "a", 3)}
    assert spark.conf.get(merge.PROVIDER, None) == before


def test_no_python_for_each_key(spark, tmp_path):
    """Rows in any order are joined by Spark itself: a call of Python for each id took longer than all else."""
    stream = lambda schema, f: spark.readStream.schema(schema).parquet(str(tmp_path / f))
    for f in "nl":
        (tmp_path / f).mkdir()
    for log in (merge.first_rows(stream(NODES, "n")), merge.known_links(stream(NODES, "n"), stream(LINKS, "l"))):
        assert "TransformWithState" not in log._jdf.queryExecution().analyzed().toString()


def test_waiting_links_are_rows_of_a_table(spark, tmp_path):
    """What waits is a table that the next micro-batch joins; a link that found its ends is not looked at again, and no state store is asked for each row."""
    t = str(tmp_path)
    run = lambda: merge.merge_stream(spark.readStream.schema(NODES).parquet(f"{t}/n"), spark.readStream.schema(LINKS).parquet(f"{t}/l"), f"{t}/out", f"{t}/cp")
    spark.createDataFrame([(1, "a", "x")], NODES).write.mode("append").parquet(f"{t}/n")
    spark.createDataFrame([(2, "a", "a2"), (1, "a", "b"), (1, "a", "b"), (4, "a", "c")], LINKS).write.mode("append").parquet(f"{t}/l")
    run()
    spark.createDataFrame([(3, "c", "y"), (1, "a", "later"), (2, "a", "later")], NODES).write.mode("append").parquet(f"{t}/n")
    run()
    waits = spark.read.parquet(f"{t}/out/.state/waiting/run=1/met=false")
    assert sorted(map(tuple, waits.select("src", "dst", "batch").collect())) == [("a", "a2", 2), ("a", "b", 1)]
    assert {tuple(r) for r in merge.merged_links(spark, f"{t}/out").collect()} == {("a", "c", 4)}
    assert {tuple(r) for r in merge.merged_nodes(spark, f"{t}/out").collect()} == {(1, "a", "x"), (3, "c", "y")}
    assert not (tmp_path / "cp" / "rows" / "state").exists()
    again = spark.createDataFrame([(3, "c", "y"), (1, "a", "later"), (2, "a", "later")], NODES).selectExpr("struct(*) AS n", "CAST(NULL AS struct<src:string,dst:string,batch:bigint>) AS k")
    merge._merged(spark, again, 1, f"{t}/out")  # an attempt that is made again
    assert {tuple(r) for r in merge.merged_links(spark, f"{t}/out").collect()} == {("a", "c", 4)} and spark.read.parquet(f"{t}/out/nodes").count() == 2
