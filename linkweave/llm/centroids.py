"""Centroid clustering of integer vectors, screened by the norms of their blocks.

A vector is stored with the norm of each block of components. By Cauchy and
Schwarz the squared distance to a centroid is at least the sum over blocks of
the squared difference of both norms. So a vector gets an exact distance to the
centroid of smallest bound first, and then only to those whose bound does not
exceed that distance: the rest can be neither nearer nor tied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stored

DIMS, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Components of a block.
BLOCK = 4
#: Integer components stay within this, so that a squared distance fits a long.
MOST = 1 << 27


def integers(x: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, taken as double; null where a component is null or not finite."""
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    cut = lambda v: F.least(F.greatest(F.floor(v.cast("double") * scale).cast("double"), F.lit(float(-MOST))), F.lit(float(MOST))).cast("int")
    return F.when(ok, F.transform(x, cut))


def compressed(v: Column, dims: int = DIMS) -> Column:
    """Norms of the blocks of an integer vector."""
    square = lambda b: F.aggregate(F.slice(v, b + 1, BLOCK), F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1), F.lit(BLOCK)), lambda b: F.sqrt(square(b)))


def norms(c: np.ndarray) -> np.ndarray:
    """The same of centroids, a row each."""
    at = np.arange(0, c.shape[1], BLOCK)
    return np.sqrt(np.add.reduceat(c.astype(float) ** 2, at, axis=1))


def nearest(x: np.ndarray, own: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances computed) of each row of x with block norms ``own``; ties go to the smaller number."""
    of = norms(c)
    bound = np.zeros((len(x), len(c)))
    for b in range(of.shape[1]):
        bound += (own[:, b, None] - of[None, :, b]) ** 2
    # rounding of norms and bounds is far below this share of both squared lengths
    slack = 1e-9 * (1 + (own**2).sum(axis=1) + (of**2).sum(axis=1).max(initial=0))
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    first, rows = bound.argmin(axis=1), np.arange(len(x))
    exact[rows, first] = ((x - c[first]) ** 2).sum(axis=1)
    open_ = bound <= (exact[rows, first] + slack)[:, None]
    open_[rows, first] = False
    for k in range(len(c)):
        at = np.nonzero(open_[:, k])[0]
        if len(at):
            exact[at, k] = ((x[at] - c[k]) ** 2).sum(axis=1)
    best = exact.argmin(axis=1)
    return best.astype(np.int32), exact[rows, best], len(x) + int(open_.sum())


def _batch(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    flat = lambda name: b.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat("v").reshape(-1, dims).astype(np.int64), flat("norms").reshape(b.num_rows, -1)


def _moved(vectors: DataFrame, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after one round, and the exact distances that it computed. A task sends a row for each cluster that it met."""
    k, dims = c.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, tried = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for b in batches:
            x, own = _batch(b, dims)
            at, _, n = nearest(x, own, c)
            tried += n
            count += np.bincount(at, minlength=k)
            order = np.argsort(at, kind="stable")
            met, start = np.unique(at[order], return_index=True)
            if len(met):
                total[met] += np.add.reduceat(x[order], start, axis=0)
        met = np.nonzero(count)[0]
        if len(met):
            yield pa.RecordBatch.from_pydict({"cluster": met, "n": count[met], "total": list(total[met]), "tried": [tried, *[0] * (len(met) - 1)]}, schema=pa.schema([("cluster", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64())), ("tried", pa.int64())]))

    part = vectors.mapInArrow(sums, "cluster long, n long, total array<long>, tried long")
    out, tried = c.copy(), 0
    # k rows of dims sums each, combined before they come
    for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("tried").alias("tried"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dims)]).alias("total")).collect():
        out[r["cluster"]] = [t // r["n"] for t in r["total"]]
        tried += r["tried"]
    return out, tried


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in order of the hash; vectors without an id come last, and equal hashes go by components."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k vectors
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, k: int = K, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector.

    Kept are vectors of ``dims`` components, none null or not finite; fewer
    than k of them give as many centroids, none an empty table. Repeated rows
    and ids count each; a null id stays null and is a seed only where ids are
    too few. Equal distances go to the smaller number. Components beyond
    +-2^27 are cut there; an inertia that no long holds is null. Other columns
    are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = vectors.where(F.size(embedding) == dims).select(F.col(vec_id).alias("id"), integers(F.col(embedding), scale).alias("v")).where(F.col("v").isNotNull())
    v = stored(v.withColumn("norms", compressed(F.col("v"), dims)), "vectors")
    c = seeds(v, k)
    if not len(c):
        return spark.createDataFrame([], f"{vec_id} {vectors.schema[vec_id].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        c, _ = _moved(v, c)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d, _ = nearest(*_batch(b, dims), c)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at, pa.int32()), pa.array(d, pa.int64())], ["id", "cluster", "distance"])

    done = stored(v.mapInArrow(last, f"id {v.schema['id'].dataType.simpleString()}, cluster int, distance long"), "assigned")
    own = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.expr("try_sum(distance)").alias("s")).collect()}  # k rows at most
    whole = sum(s for s in own.values() if s is not None) if None not in own.values() else None
    whole = whole if whole is not None and whole < 1 << 63 else None
    rows = [(int(n), s, whole, _digest(c[n])) for n, s in own.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


def screened(spark: SparkSession, vectors: DataFrame, centroids: np.ndarray) -> float:
    """Share of the distances to centroids that the bounds spare, over stored vectors (id, v, norms)."""
    n = vectors.count()
    return 1 - _moved(vectors, centroids)[1] / (n * len(centroids)) if n else 0.0
