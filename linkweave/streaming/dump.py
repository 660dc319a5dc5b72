"""The parse of a dump as a stream that goes on where it stopped.

A streaming source whose offsets are numbers of bz2 streams in a plan; a
micro-batch is a range of them, dealt to tasks that unpack only their own
bytes. It holds one large batch or many small ones, whose article lines share
a folder, named by the first of them and written over what an attempt before
may have left, and are committed together by one file of counters beside it;
where one is refused, those before it are. So whatever ends a run, the next one
commits the batches after the last committed one, and lines and counters are
those of a run without a break. Files and jobs go with micro-batches, however
small a batch is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import articles as S
from ..sources import dumps, files

PAGES = "n long, k long, xml string"
#: A micro-batch takes as many batches as make so many tasks, a call's first one and, each four times the one before, at most; and no more than so many batches.
EARLY, TASKS, BATCHES = 128, 1024, 8192


@dataclass
class Streams(InputPartition):
    """Streams (n, file, offset, length) that one task unpacks."""

    streams: list[tuple[int, str, int, int]]


class DumpReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.plan, self.until, self.task = options["plan"], int(options["until"]), int(options["streamsATask"])

    def initialOffset(self) -> dict:
        return {"stream": 0}

    def latestOffset(self) -> dict:
        return {"stream": self.until}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = dumps.read_plan(self.plan, start["stream"], end["stream"])
        return [Streams(rows[i : i + self.task]) for i in range(0, len(rows), self.task)]

    def read(self, partition: Streams) -> Iterator[pa.RecordBatch]:
        return unpacked(partition.streams)


def unpacked(streams: list[tuple[int, str, int, int]]) -> Iterator[pa.RecordBatch]:
    """(n, k, xml): the pages of streams (n, file, offset, length), numbered within each."""
    schema = pa.schema([("n", pa.int64()), ("k", pa.int64()), ("xml", pa.string())])
    rows, size = [], 0
    for n, file, offset, length in streams:
        pages = dumps.pages_of(file, offset, length)
        rows += [(n, k, x) for k, x in enumerate(pages)]
        size += sum(map(len, pages))
        if size >= dumps.AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class DumpStreams(DataSource):
    """format("bz2-streams"): pages of the streams of a plan up to number ``until``."""

    @classmethod
    def name(cls) -> str:
        return "bz2-streams"

    def schema(self) -> str:
        return PAGES

    def streamReader(self, schema) -> DumpReader:
        return DumpReader(self.options)


def committed(output: str, first: int = 0) -> Iterator[tuple[int, dict]]:
    """The number of the first batch, and the counters, of each folder of lines that has been committed, from a batch on that begins one."""
    while (c := files.read_json(f"{output}/counters/{first}.json")) is not None:
        yield first, c
        first += len(c["pagesRead"])


def progress(output: str, before: dict | None = None) -> dict:
    """What has been committed below output: pagesRead, recordsWritten, pagesSkipped, streams, batches (M1). Batches count by the files that commit them, so none counts twice. before: what an earlier call gave."""
    out = dict(before or {"type": "checkpoint", "pagesRead": 0, "recordsWritten": 0, "pagesSkipped": 0, "streams": 0, "batches": 0, "output": f"{output}/lines"})
    for _, c in committed(output, out["batches"]):
        for k in ("pagesRead", "recordsWritten", "pagesSkipped"):
            out[k] += sum(c[k])
        out["streams"], out["batches"] = c["streams"][-1], out["batches"] + len(c["streams"])
    return out


def read_lines(spark: SparkSession, output: str) -> DataFrame:
    """The article lines of the committed batches, as text; an attempt that was not committed is not read."""
    done = [f"{output}/lines/from={b}" for b, _ in committed(output)]
    return spark.read.text(done) if done else spark.createDataFrame([], "value string")


def parse(spark: SparkSession, source: str, output: str, streams_a_batch: int = 4096, streams_a_task: int = 64, on_batch: Callable[[int, dict], None] | None = None, system: str = "/") -> dict:
    """Turn a dump (a file of bz2 streams, or a folder of such) into article lines below output/lines, from where an earlier call stopped (A1, A2, M1, M2).

    The plan of streams and the size of a batch are fixed by the first call
    and kept below output, with the stream's checkpoint; a later call finds
    them there. A dump of another size than the plan's is an error. on_batch
    hears of each batch once it is written, with others of its micro-batch,
    and before they are committed; if it raises, those before are committed.
    Returns progress(). Pages come in order of the file within a batch, and
    batches in order of their numbers; a dump without pages gives no lines.
    """
    S.data_root(output, system)
    plan, state = f"{output}/plan.parquet", files.read_json(f"{output}/plan.json")
    size_of = sum(files.sizes(source).values())
    if state is None:
        n = dumps.write_plan(spark, source, plan)
        state = {"source": source, "streams": n, "streamsABatch": streams_a_batch, "bytes": size_of}
        files.write_json(f"{output}/plan.json", state)
    elif state["bytes"] != size_of:
        raise ValueError(f"{source} is not the dump that {output} was begun with")
    spark.dataSource.register(DumpStreams)

    size = state["streamsABatch"]
    tasks, done = EARLY, progress(output)

    def articles(pages: DataFrame) -> DataFrame:
        pages = pages.select(F.floor(F.col("n") / size).alias("batch"), F.struct("n", "k").alias("at"), F.from_xml("xml", S.PAGE).alias("p")).select("batch", "at", "p.*")
        # a batch is sorted in its tasks: its partitions are ranges of streams already
        return S.articles_of(pages, "batch", "at")

    def put(lines: DataFrame, first: int) -> None:
        lines.sortWithinPartitions("batch", "at").drop("batch", "at").write.mode("overwrite").json(f"{output}/lines/from={first}")

    def write(run: DataFrame, _: int) -> None:
        first, until = progress(output, done)["batches"], -(-files.read_json(f"{output}/next.json")["until"] // size)
        counts = lambda c: F.histogram_numeric(c, F.lit(until - first + 1)).alias("n")  # noqa: E731  exact, as there is a bin for each batch

        def count_of(seen: Observation) -> Counter:
            out: Counter = Counter()
            for r in seen.get["n"] or ():  # several bins may be of one batch; all rows of a bin are
                out[round(r["x"])] += round(r["y"])
            return out

        read, kept = Observation(), Observation()
        run = run.where(F.col("n") >= first * size)  # those before were committed by an attempt that ended here
        put(articles(run.observe(read, counts(F.floor(F.col("n") / size)))).observe(kept, counts(F.col("batch"))), first)
        n_read, n_kept = count_of(read), count_of(kept)
        facts = [{"pagesRead": n_read[b], "recordsWritten": n_kept[b], "pagesSkipped": n_read[b] - n_kept[b], "streams": min(state["streams"], (b + 1) * size)} for b in range(first, until)]
        good, refused = len(facts), None
        for b in range(first, until) if on_batch else ():
            try:
                on_batch(b, facts[b - first])
            except Exception as e:
                good, refused = b - first, e
                break
        if refused and good:  # lines of the folder are those of the batches before
            some = spark.createDataFrame(dumps.read_plan(plan, first * size, (first + good) * size), "n long, file string, offset long, length long")
            some = some.repartitionByRange(max(1, -(-good * size // streams_a_task)), "n").sortWithinPartitions("n")
            put(articles(some.mapInArrow(lambda batches: (p for b in batches for p in unpacked(list(zip(*b.to_pydict().values())))), PAGES)), first)
        if good:
            files.write_json(f"{output}/counters/{first}.json", {k: [f[k] for f in facts[:good]] for k in facts[0]})
        if refused:
            raise refused

    while done["streams"] < state["streams"]:
        planned = files.read_json(f"{output}/next.json")  # an attempt that ended has its range in the checkpoint
        if planned is None or planned["until"] <= done["streams"]:
            planned = {"until": min(state["streams"], (done["batches"] + max(1, min(BATCHES, tasks * streams_a_task // size))) * size)}
            files.write_json(f"{output}/next.json", planned)
        stream = spark.readStream.format("bz2-streams").option("plan", plan).option("until", planned["until"]).option("streamsATask", streams_a_task).load()
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        tasks, before, done = min(TASKS, 4 * tasks), done, progress(output, done)
        if done["streams"] == before["streams"]:
            raise RuntimeError(f"no progress beyond stream {done['streams']}; {output}/checkpoint is of another run")
    return done
