"""Tables in the folder that driver and executors share; they cut lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; it goes when the application ends.

    Where the setting is missing, a local session gets a temporary folder of
    its own; on a cluster that would be another disk for each executor, so it
    is an error there.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            named = "file://" + tempfile.mkdtemp(prefix="linkweave-")
        uri = f"{named.rstrip('/')}/linkweave-{app}-{uuid.uuid4().hex[:8]}"
        path, fs = _path(spark, uri)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots[app] = uri
    return _roots[app]


def fresh(spark: SparkSession, what: str) -> str:
    return f"{root(spark)}/{what}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, uri: str) -> bool:
    path, fs = _path(spark, uri)
    return fs.exists(path)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back."""
    return written(df, fresh(df.sparkSession, what))


def measured(df: DataFrame, what: str, **facts: Column) -> tuple[DataFrame, dict]:
    """stored(df), and aggregates over its rows that the same job computes."""
    seen = Observation()
    out = stored(df.observe(seen, *[v.alias(k) for k, v in facts.items()]), what)
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads again: all that was made of them must be stored itself."""
    for df in tables:
        path, fs = _path(df.sparkSession, df.stored_path)
        fs.delete(path, True)


def positions(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """df with its 0-based place in the given order, for any number of rows.

    Rows are sorted over a range partitioning and stored, so that a place is
    the rows of all partitions before plus the place in the own one; only a
    count for each partition is gathered. Ties are placed in some order, which
    the stored table fixes.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()  # partition in the upper 31 bits, place in the lower 33
    t = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "sorted")
    part = F.shiftright("_at", 33)
    before, rows = 0, []
    for p, n in sorted(tuple(r) for r in t.groupBy(part.alias("p")).count().collect()):
        rows.append((p, before))
        before += n
    base = spark.createDataFrame(rows, "_p long, _base long")  # a row for each partition
    return t.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_base", "_at")
