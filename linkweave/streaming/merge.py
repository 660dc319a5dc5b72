"""Progressive merge as a stream: ids that are known are state, and links wait there for their ends (H3, M4).

Rows carry the number of the batch that brought them, and may come in any
order and any split into micro-batches: what is merged in the end is what
rank.merge_batches() gives for all rows at once. Both outputs are logs that
only grow; of a key the row of the smallest batch counts, and that can only
fall, so a reader may look at any time.

A micro-batch is merged by joins of tables: what it brings and what still
waits meet the ids that are known, and a link that found both of its ends is
not looked at again. So a row of state costs what a row of a join does, not a
look into a state store for each of its ends. Rows in order of their batches
may keep state by key instead.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..storage import _path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of all rows. A semi-join of streams asks for a time by which its state may go; as none is later than another, none goes.
TIME = "timestamp'2000-01-01 00:00:00'"
#: Rows of state that a task holds at a time.
AT_ONCE = 8192


class KnownEnds(StatefulProcessor):
    """For rows in order. Of each id: its smallest batch, and the links that came in a batch before it; they go on when the id turns out to have been there.

    Rows (batch, src, dst) are links, and without src they say that the id is
    there. Links that wait stay in the list after they went on, as a still
    smaller batch of the id must not send them again: each fall of the batch
    sends those between the new and the old. in_order: rows come in order of
    their batches, so the first batch seen is the smallest, and nothing waits
    once the id is known.
    """

    def __init__(self, in_order: bool) -> None:
        self.in_order = in_order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "batch long")
        self.waiting = handle.getListState("waiting", "src string, dst string, batch long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        known = self.since.get() if self.since.exists() else None
        since = known[0] if known else None
        for f in rows:
            there = f[f["src"].isna()]
            if len(there) and (since is None or int(there["batch"].min()) < since) and not (self.in_order and since is not None):
                before, since = since, int(there["batch"].min())
                self.since.update((since,))
                out = []
                for src, dst, batch in self.waiting.get() if self.waiting.exists() else ():
                    if batch >= since and (before is None or batch < before):
                        out.append((src, dst, batch))
                    if len(out) == AT_ONCE:
                        yield pd.DataFrame(out, columns=["src", "dst", "batch"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["src", "dst", "batch"])
                if self.in_order:
                    self.waiting.clear()
            links = f[f["src"].notna()]
            now = links["batch"] >= since if since is not None else pd.Series(False, index=links.index)
            if now.any():
                yield links[now][["src", "dst", "batch"]]
            if not now.all() and not (self.in_order and since is not None):
                self.waiting.appendList([(s, d, int(b)) for s, d, b in links[~now][["src", "dst", "batch"]].itertuples(index=False)])

    def close(self) -> None:
        pass


def first_rows(nodes: DataFrame) -> DataFrame:
    """Rows of a stream nodes(batch, id, ...), one for each batch of an id; merged_nodes() takes the earliest. Rows without id or batch are left out."""
    return nodes.where("id is not null and batch is not null").dropDuplicates(["id", "batch"])


def known_links(nodes: DataFrame, links: DataFrame, salts: int = 4, in_order: bool = False) -> DataFrame:
    """(src, dst, batch) of the links of a stream links(batch, src, dst), none to itself, whose ends are in nodes(batch, id) of that batch or one before.

    Each end is a semi-join of streams: a link goes on once, with the first
    row of nodes that lets it, and waits in state until there is one. An id's
    links are dealt to ``salts`` keys by their other end, and the id is told
    to each of them, so that what many link with isn't one key. in_order
    keeps less (see KnownEnds), but calls Python for each key.
    """
    ids = nodes.where("id is not null and batch is not null")
    told = ids.select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("batch").cast("long").alias("batch"))
    out = links.where("src <> dst and batch is not null").select("src", "dst", F.col("batch").cast("long").alias("batch"))
    if in_order:
        told = told.withColumns({"src": F.lit(None).cast("string"), "dst": F.lit(None).cast("string")})
        for end, other in (("src", "dst"), ("dst", "src")):
            dealt = out.select(F.col(end).alias("k"), _salt(other, salts).alias("salt"), "batch", "src", "dst")
            out = told.unionByName(dealt).groupBy("k", "salt").transformWithStateInPandas(KnownEnds(in_order), "src string, dst string, batch long", "Append", "None")
        return out
    out = out.withColumn("t", F.expr(TIME)).withWatermark("t", "1 day")
    known = told.select("k", "salt", F.col("batch").alias("since"), F.expr(TIME).alias("told")).withWatermark("told", "1 day")
    for end, other in (("src", "dst"), ("dst", "src")):
        met = (F.col(end) == F.col("k")) & (_salt(other, salts) == F.col("salt")) & (F.col("t") == F.col("told")) & (F.col("since") <= F.col("batch"))
        out = out.join(known, met, "left_semi")
    return out.select("src", "dst", "batch")


def _salt(end: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(end), F.lit(salts)).cast("int")


def merge_stream(nodes: DataFrame, links: DataFrame, target: str, checkpoint: str, salts: int = 4, in_order: bool = False) -> None:
    """Take up what the streams nodes and links hold, from where an earlier call with this checkpoint stopped, and add it to the logs below target.

    The state of rows in any order is tables below target (see _merged). With
    in_order it lies in RocksDB, off the heap, so that ids and links that wait
    may be more than an executor's memory; the session's own provider is set
    again afterwards. salts and in_order must stay those of the first call.
    """
    spark = nodes.sparkSession
    if not in_order:
        n, k = nodes.schema, links.select("src", "dst", F.col("batch").cast("long").alias("batch"))
        rows = nodes.select(F.struct("*").alias("n"), F.lit(None).cast(k.schema).alias("k")).unionByName(k.select(F.lit(None).cast(n).alias("n"), F.struct("*").alias("k")))
        rows.writeStream.foreachBatch(lambda df, run: _merged(spark, df, run, target)).option("checkpointLocation", f"{checkpoint}/rows").trigger(availableNow=True).start().awaitTermination()
        return
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for name, log in (("nodes", first_rows(nodes)), ("links", known_links(nodes, links, salts, in_order))):
            log.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start(f"{target}/{name}").awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _merged(spark: SparkSession, df: DataFrame, run: int, target: str) -> None:
    """One micro-batch of rows (n) and (k), a node or a link each, from the state that the one before left below target to its own.

    What it writes lies in folders of its number, which an attempt that is
    made again writes anew; links go to the log at once, by one rename. State
    before that of the last run goes.
    """
    at = lambda what, r=run: f"{target}/.state/{what}/run={r}"
    read = lambda schema, path: spark.read.schema(schema).parquet(path)
    fs = _path(spark, target)[1]
    for what in ("known", "waiting"):
        fs.delete(_path(spark, at(what, run - 2))[0], True)
    came = {c: df.where(f"{c} is not null").select(f"{c}.*") for c in "nk"}
    came["n"] = came["n"].where("id is not null and batch is not null")
    came["k"] = came["k"].where("src <> dst and batch is not null")
    for c, rows in came.items():  # a stream's own session plans without what it learns of sizes on the way
        rows.write.mode("overwrite").parquet(at(c))
        came[c] = read(rows.schema, at(c))

    since = "id string, since long"
    before = read(since, at("known", run - 1)) if run else spark.createDataFrame([], since)
    first = came["n"].groupBy("id").agg(F.min_by(F.struct(*came["n"].columns), "batch").alias("n")).select("n.*")
    first = first.join(before.withColumnRenamed("since", "_since"), "id", "left").where("_since is null or batch < _since").select(*came["n"].columns)
    first.write.mode("overwrite").parquet(f"{target}/nodes/_run={run}")
    now = came["n"].select(F.col("id").cast("string").alias("id"), F.col("batch").cast("long").alias("since")).unionByName(before)
    now.groupBy("id").agg(F.min("since").alias("since")).write.mode("overwrite").parquet(at("known"))

    known, links = read(since, at("known")), came["k"]
    if run and fs.exists(_path(spark, at("waiting", run - 1) + "/met=false")[0]):
        links = links.unionByName(read(links.schema, at("waiting", run - 1) + "/met=false"))
    links = links.repartition("src").dropDuplicates()
    for end in ("src", "dst"):
        links = links.join(known.select(F.col("id").alias(end), F.col("since").alias(f"_{end}")), end, "left")
    met = F.coalesce((F.col("_src") <= F.col("batch")) & (F.col("_dst") <= F.col("batch")), F.lit(False))
    links.select("src", "dst", "batch", met.alias("met")).write.mode("overwrite").partitionBy("met").parquet(at("waiting"))
    log, found = _path(spark, f"{target}/links/_run={run}")[0], _path(spark, at("waiting") + "/met=true")[0]
    fs.mkdirs(log.getParent())
    fs.delete(log, True)
    if fs.exists(found):
        fs.rename(found, log)
    for c in "nk":
        fs.delete(_path(spark, at(c))[0], True)


def merged_links(spark: SparkSession, target: str) -> DataFrame:
    """(src, dst, batch): each link once, with the first batch in which it counts."""
    return spark.read.schema("src string, dst string, batch long").parquet(f"{target}/links").groupBy("src", "dst").agg(F.min("batch").alias("batch"))


def merged_nodes(spark: SparkSession, target: str) -> DataFrame:
    """Each id once, as its first batch has it."""
    log = spark.read.parquet(f"{target}/nodes").drop("_run")
    return log.groupBy("id").agg(F.min_by(F.struct(*log.columns), "batch").alias("n")).select("n.*")
