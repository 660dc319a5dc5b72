"""Page dumps of many bz2 streams: where the streams begin, their pages, and the run that turns a dump into article lines."""

from __future__ import annotations

import bz2
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import articles as S
from . import files

#: Fixed format: the first ten bytes of a bz2 stream, the level's digit aside.
MAGIC = b"1AY&SY"
#: Bytes that a task searches for streams.
CHUNK = 64 << 20
#: Small files that a task searches at most, and characters of pages that it hands on at a time.
SMALL, AT_ONCE = 256, 1 << 20


def stream_offsets(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(file, offset, length) of each bz2 stream of a file or of a folder's files (A3).

    Files are searched in parts that overlap by the length of a mark; one that
    does not begin with a stream is an error.
    """
    sizes = files.sizes(path)
    parts = [(f, k * chunk, n) for f, n in sizes.items() for k in range(max(1, -(-n // chunk)))]

    def search(batches: Iterator) -> Iterator:
        import re

        import pandas as pd

        for b in batches:
            found = []
            for file, start, size in zip(b["file"], b["start"], b["size"]):
                data = files.part(file, int(start), min(int(size), int(start) + chunk + 9) - int(start))
                found += [(file, int(start) + m.start(), int(size)) for m in re.finditer(rb"BZh[1-9]" + re.escape(MAGIC), data)]
            yield pd.DataFrame(found, columns=["file", "offset", "size"]).astype({"offset": "int64", "size": "int64"})

    tasks = max(-(-len(parts) // SMALL), -(-sum(sizes.values()) // chunk), spark.sparkContext.defaultParallelism)  # a task takes one part of a large file or many small files
    todo = spark.createDataFrame(parts, "file string, start long, size long").repartition(max(1, min(len(parts), tasks)))
    found = stored(todo.mapInPandas(search, "file string, offset long, size long").distinct(), "offsets")
    begun = found.where("offset = 0").select("file")
    if begun.count() < len(sizes):
        raise ValueError(f"{min(set(sizes) - {r[0] for r in begun.collect()})} does not begin with a bz2 stream")
    following = F.lead("offset").over(Window.partitionBy("file").orderBy("offset"))  # a number a stream of one file, as a split plan has
    return found.select("file", "offset", (F.coalesce(following, "size") - F.col("offset")).alias("length"))


def write_plan(spark: SparkSession, path: str, plan: str) -> int:
    """Number the streams of a dump in order of file and offset, and write (n, file, offset, length) to one small file; gives how many they are."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = stream_offsets(spark, path).orderBy("file", "offset").toArrow()  # a name and some 20 bytes a stream
    fs, p = files.opened(plan)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    pq.write_table(rows.add_column(0, "n", pa.array(range(rows.num_rows), pa.int64())), p, filesystem=fs)
    return rows.num_rows


def read_plan(plan: str, start: int, end: int) -> list[tuple[int, str, int, int]]:
    """The streams of a plan from number start on, before end."""
    import pyarrow.parquet as pq

    fs, p = files.opened(plan)
    t = pq.read_table(p, filesystem=fs).slice(start, max(0, end - start))
    return list(zip(*[t.column(c).to_pylist() for c in ("n", "file", "offset", "length")]))


def pages_of(file: str, offset: int, length: int) -> list[str]:
    """The page elements of one stream; a page lies within one stream."""
    import re

    return re.findall(r"<page>.*?</page>", bz2.decompress(files.part(file, offset, length)).decode("utf-8"), re.S)


def stream_pages(spark: SparkSession, offsets: DataFrame, streams_a_task: int = 64) -> DataFrame:
    """(at, page struct) of all pages, in order of file and offset (A2, A4). Each stream is unpacked where it is needed."""

    def unpack(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows, size = [], 0
            for file, offset, length in zip(b["file"], b["offset"], b["length"]):
                pages = pages_of(file, int(offset), int(length))
                rows += [(file, int(offset), k, x) for k, x in enumerate(pages)]
                size += sum(map(len, pages))
                if size >= AT_ONCE:
                    yield pd.DataFrame(rows, columns=["file", "offset", "k", "xml"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["file", "offset", "k", "xml"])

    n = offsets.count()
    raw = offsets.repartitionByRange(max(1, -(-n // streams_a_task)), "file", "offset").mapInPandas(unpack, "file string, offset long, k long, xml string")
    return raw.select(F.struct("file", "offset", "k").alias("at"), F.from_xml("xml", S.PAGE).alias("p")).select("at", "p.*")


def parse(spark: SparkSession, source: str, output: str | None, limit: int | None = None, parallel: bool = False, system: str = "/") -> dict:
    """Turn a dump into article lines (JSON) below ``output`` and count.

    Returns pagesRead, recordsWritten, pagesSkipped. limit: pages from the
    front of the file. parallel: by bz2 streams instead of the XML reader's
    own splits. A parse that may be stopped is streaming.dump.parse. output None is a dry run; an output that is there is an error.
    """
    if output is not None:
        S.data_root(output, system)
    if parallel:
        pages = stream_pages(spark, stream_offsets(spark, source))
    else:
        pages = S.dump(spark, source).withColumn("at", F.struct(F.monotonically_increasing_id().alias("offset"), F.lit(0).cast("long").alias("k")))
    if limit is not None:
        pages = pages.orderBy("at").limit(limit)
    pages = stored(pages, "pages")
    kept = S.articles_of(pages, "at")
    read = pages.count()
    if output is None:
        written = kept.count()
    else:
        ordered = stored(kept.repartitionByRange("at").sortWithinPartitions("at"), "articles")
        written = ordered.count()
        ordered.drop("at").write.json(output)
    return {"type": "checkpoint", "pagesRead": read, "recordsWritten": written, "pagesSkipped": read - written, "output": output}
