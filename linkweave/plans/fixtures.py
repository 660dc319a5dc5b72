"""Views of the driver's tables in the engine's terms, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def refs_sql(sparse: bool) -> str:
    """raw(seq, pos, ref): the next line's part of each order, as id, title, padded upper-case title or a dangling name."""
    return f"""nxt AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem {"WHERE l_orderkey % 20 = 0" if sparse else ""}),
raw AS (SELECT p AS seq, row_number() OVER (PARTITION BY p ORDER BY o, n, t) - 1 AS pos,
 CASE WHEN o % 11 = 5 THEN 'dangling ' || CAST(o AS STRING) WHEN o % 4 = 1 THEN q.p_name || ' ' || CAST(t AS STRING) WHEN o % 4 = 2 THEN '  ' || upper(q.p_name) || '  ' || CAST(t AS STRING) || ' ' ELSE CAST(t AS STRING) END AS ref
 FROM nxt JOIN part q ON q.p_partkey = t WHERE t IS NOT NULL)"""


#: nodes and distinct edges, the same under every mode because these titles are unique.
EDGES = """art AS (SELECT p_partkey AS seq, CAST(p_partkey AS STRING) AS id, p_name || ' ' || CAST(p_partkey AS STRING) AS title, p_size * 100.0 AS byte_length FROM part),
hit AS (SELECT CAST(seq AS STRING) AS src, regexp_extract(trim(ref), '([0-9]+)$', 1) AS dst, seq, pos FROM raw WHERE NOT ref LIKE 'dangling%'),
edges AS (SELECT src, dst, min(seq) AS seq, min(pos) AS pos FROM hit WHERE src <> dst GROUP BY src, dst)"""


def with_edges(sparse: bool) -> str:
    return f"WITH {refs_sql(sparse)}, {EDGES}"


#: Bytes of a shuffle that a task takes, at most, where its keys allow it: rows in a sort or a list are many times that.
PARTITION = 8 << 20
#: Bytes of a row as a join holds it for one in Parquet, of which it reads a few columns, too: what a plan takes for small enough to broadcast goes by the size of files.
IN_MEMORY = 20.0


def small_partitions(spark: SparkSession) -> None:
    """Let adaptive execution join shuffle partitions up to PARTITION only, and plans count files as IN_MEMORY times their size; tighter settings of the user stay.

    A table that a plan broadcasts by the size of its file is a hundred times that in each executor, and grows
    with the input. One that is shuffled first is broadcast only where its rows, as they are then known, are few.
    """
    name, size = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if size(spark.conf.get(name)) > PARTITION:
        spark.conf.set(name, str(PARTITION))
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor)) < IN_MEMORY:
        spark.conf.set(factor, str(IN_MEMORY))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    small_partitions(spark)
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def run_sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """sql over the named tables, without touching the session's views."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **tables(spark, sf_dir, *names))


def articles(spark: SparkSession, sf_dir: str, sparse: bool = False, unique: bool = True) -> DataFrame:
    """articles(seq, id, title, byte_length, links); with unique=False titles repeat."""
    title = "p_name || ' ' || CAST(p_partkey AS STRING)" if unique else "p_name"
    return run_sql(
        spark, sf_dir,
        f"""WITH {refs_sql(sparse)}, l AS (SELECT seq, transform(array_sort(collect_list(struct(pos, ref))), x -> x.ref) AS links FROM raw GROUP BY seq)
        SELECT CAST(p_partkey AS BIGINT) AS seq, CAST(p_partkey AS STRING) AS id, {title} AS title, CAST(p_size * 100.0 AS DOUBLE) AS byte_length, coalesce(links, CAST(array() AS ARRAY<STRING>)) AS links FROM part LEFT JOIN l ON l.seq = p_partkey""",
        "lineitem", "part",
    )


#: Layout positions from the first two embedding dimensions.
POSITIONS = "pos AS (SELECT vec_id AS idx, CAST(embedding[{0}] AS DOUBLE) * 3000 AS x, CAST(embedding[{1}] AS DOUBLE) * 3000 AS y, label FROM embeddings)"
POS_SPARK, POS_DUCK = POSITIONS.format(0, 1), POSITIONS.format(1, 2)
