"""Shared-folder tables, bounded Arrow batches and native span lists."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, exists, fresh, measured, stored  # noqa: F401  used by the operators

#: Rows and bytes an Arrow batch may hold, so that a batch of long texts fits a worker.
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20
#: White space of the contracts, as a Java and Python character class.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes; a batch ends with the text that takes it over the bound. Tighter settings of the user stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now. It does so only when the driver collects its garbage, and a job of many steps would else keep all of them on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z only; other letters keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Maximal runs of non-white-space characters; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+", -1), "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also where the optimizer moves or repeats the expression."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str, kind: str, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches with code-point offsets: array<struct<start,kind,end,hit>>.

    The gaps between matches come from split, the matches from
    regexp_extract_all; their lengths add up to the offsets. ``gate`` is a
    cheap necessary condition that spares most texts the search.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:string,end:int,hit:string>>").alias("out"))

    def step(s, x):
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    found = F.aggregate(pairs, state, step, lambda s: s["out"])
    none = F.array().cast("array<struct<start:int,kind:string,end:int,hit:string>>")
    met = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(met, found).otherwise(none)


def joined(found: Column, order: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(found, lambda s: F.struct(s["start"], rank[s["kind"]].alias("rank"), s["kind"], s["end"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
