"""Line deduplication through sharded minimal perfect hashes."""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files
from .common import WS_CHARS, bounded_batches, fresh, lower_ascii, partitions, stored

LEAST = 10
#: Keys a shard holds, about; and bytes of arrays that every task may probe in place.
SHARD_KEYS, PROBE_BOUND = 1 << 20, 128 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the splitmix64 finalizer


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bit arrays with ranks, about 4 bits a key."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray], starts: list[int], rest: np.ndarray):
        self.levels, self.ranks, self.starts, self.rest = levels, ranks, starts, rest

    @classmethod
    def of(cls, keys: np.ndarray, gamma: float = 2.0, most: int = 24) -> PerfectHash:
        levels, ranks, starts, at = [], [], [], 0
        left = keys.astype(np.uint64)
        for level in range(most):
            if not len(left):
                break
            size = max(64, int(gamma * len(left)) + 63 & ~63)
            pos = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(pos, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            levels.append(words)
            ranks.append((np.cumsum(ones) - ones).astype(np.uint32))
            starts.append(at)
            at += int(ones.sum())
            left = left[~alone[pos]]
        return cls(levels, ranks, [*starts, at], np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """0..n-1, each once, for the keys it was built of; any index or -1 for others."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (words, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                return out
            pos = mix(keys[todo], level) % np.uint64(64 * len(words))
            w, b = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
            got = words[w]
            hit = (got >> b & np.uint64(1)).astype(bool)
            below = np.bitwise_count(got & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = self.starts[level] + rank[w[hit]] + below[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            i = np.searchsorted(self.rest, keys[todo])
            ok = (i < len(self.rest)) & (self.rest[np.minimum(i, len(self.rest) - 1)] == keys[todo])
            out[todo[ok]] = self.starts[-1] + i[ok]
        return out


class LineShard:
    """Arrays under one perfect hash: 64-bit fingerprints, counts, smallest document.

    ``twins`` lists, sorted by fingerprint, the keys whose first hash another
    key of the shard has too (about n*n/2^65 of them): (first hash, fingerprint,
    count, smallest document), looked up when the hash gives another key.
    """

    def __init__(self, h: PerfectHash, prints: np.ndarray, counts: np.ndarray, first: np.ndarray, twins: np.ndarray):
        self.h, self.prints, self.counts, self.first, self.twins = h, prints, counts, first, twins

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, first: np.ndarray) -> LineShard:
        alone = np.zeros(len(h1), bool)
        alone[np.unique(h1, return_index=True)[1]] = True
        twins = np.stack([h1, h2, counts, first]).astype(np.int64)[:, ~alone]
        h1, h2, counts, first = h1[alone], h2[alone], counts[alone], first[alone]
        keys = h1.astype(np.int64).view(np.uint64)
        h = PerfectHash.of(keys)
        i = h.index(keys)
        out = cls(h, np.empty_like(h2), np.empty(len(i), np.uint32), np.empty(len(i), np.int64), twins[:, np.argsort(twins[1], kind="stable")])
        out.prints[i], out.counts[i], out.first[i] = h2, np.minimum(counts, 2**32 - 1), first
        return out

    def owner(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, smallest document) for each probed line."""
        if not len(self.prints):
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        i = self.h.index(h1.view(np.uint64))
        at = np.maximum(i, 0)
        found, first = (i >= 0) & (self.prints[at] == h2), self.first[at]
        if self.twins.shape[1]:
            low, high = np.searchsorted(self.twins[1], h2, "left"), np.searchsorted(self.twins[1], h2, "right")
            for k in np.nonzero(~found & (low < high))[0]:
                for j in range(low[k], high[k]):
                    if self.twins[0, j] == h1[k]:
                        found[k], first[k] = True, self.twins[3, j]
        return found, first

    def dump(self) -> bytes:
        buf = io.BytesIO()
        n = len(self.h.levels)
        np.savez(buf, prints=self.prints, counts=self.counts, first=self.first, twins=self.twins, rest=self.h.rest, starts=np.array(self.h.starts), **{f"l{k}": self.h.levels[k] for k in range(n)}, **{f"r{k}": self.h.ranks[k] for k in range(n)})
        return buf.getvalue()

    @classmethod
    def load(cls, data: bytes) -> LineShard:
        z = np.load(io.BytesIO(data))
        n = sum(k[0] == "l" and k[1:].isdigit() for k in z.files)
        h = PerfectHash([z[f"l{k}"] for k in range(n)], [z[f"r{k}"] for k in range(n)], z["starts"].tolist(), z["rest"])
        return cls(h, z["prints"], z["counts"], z["first"], z["twins"])


@functools.lru_cache(maxsize=1)
def _shards(paths: tuple[str, ...]) -> list[LineShard]:
    return [LineShard.load(files.read(p)) for p in paths]


@functools.lru_cache(maxsize=2)
def _shard(path: str) -> LineShard:
    return LineShard.load(files.read(path))


def hashes(text: Column) -> Column:
    """array<struct<a,b>> of two 64-bit hashes of each line's key; null for keys too short to count."""
    key = lambda x: lower_ascii(F.btrim(x, F.lit(WS_CHARS)))
    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), key), lambda k: F.when(F.length(k) >= LEAST, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("line"), k).alias("b"))))


def index(docs: DataFrame, doc_id: str, text: str, shard_keys: int = SHARD_KEYS) -> tuple[int, list[tuple[int, str, int]]]:
    """Build the shards of keys held by two documents or more: how many keys were dealt to, and (shard, file, bytes) of each."""
    spark = docs.sparkSession
    held = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.explode(F.array_distinct(F.filter(hashes(F.col(text)), lambda h: h.isNotNull()))).alias("h"))
    # minima, maxima and counts are combined before the shuffle, so a line that all documents share is no hot key
    shared = stored(held.groupBy("h.a", "h.b").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n")).where("first < last").select("a", "b", "first", "n"), "lines")
    n = shared.count()
    shards = max(1, -(-n // shard_keys))
    folder = fresh(spark, "line-shards")

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["a", "b"]).reset_index(drop=True)
        data = LineShard.of(f["a"].to_numpy(), f["b"].to_numpy(), f["n"].to_numpy(), f["first"].to_numpy()).dump()
        k = int(f["shard"].iloc[0])
        path = files.attempt(folder, f"shard-{k:06d}")
        files.write(path, data)
        return pd.DataFrame({"shard": [k], "path": [path], "bytes": [len(data)]})

    keyed = shared.withColumn("shard", F.pmod("b", F.lit(shards)).cast("int"))
    built = stored(keyed.repartition(min(shards, 10_000), "shard").groupBy("shard").applyInPandas(build, "shard int, path string, bytes long"), "line-manifest")
    return shards, sorted(tuple(r) for r in built.collect())


def _drops(d: np.ndarray, known: np.ndarray, h1: np.ndarray, h2: np.ndarray, row: np.ndarray, shards: int, get) -> np.ndarray:
    """Which lines go: found in a shard, and not in the smallest document that holds them."""
    out = np.zeros(len(h1), bool)
    ok = known & (row >= 0)
    of = h2 % shards
    for k in np.unique(of[ok]):
        at = np.nonzero(ok & (of == k))[0]
        s = get(int(k))
        if s is not None:
            found, first = s.owner(h1[at], h2[at])
            out[at] = found & (first != d[row[at]])
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", probe_bound: int = PROBE_BOUND, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs with ``text`` less its repeated lines, and n_lines and n_dropped added; a row for each row.

    A line goes if its key (stripped, A-Z lowered, LEAST code points or more)
    is in a document of smaller id. Null text counts as one empty line and
    comes out empty. Rows that share an id are one document; rows with a null
    id pass unchanged and do not count. Columns named n_lines or n_dropped give
    way. If all shards together are under ``probe_bound`` bytes, tasks probe
    them where the documents are; else the probes travel to the shards, salted.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    count, shards = index(docs, doc_id, text, shard_keys)
    own = docs.select(F.struct(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")]).alias("own"), F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if not shards:
        probed = own.select("own", F.array().cast("array<boolean>").alias("gone"))
    elif sum(b for *_, b in shards) <= probe_bound:
        h = own.withColumn("h", hashes(F.col("t")))
        probed = h.select("own", "d", F.transform("h", lambda x: x["a"]).alias("a"), F.transform("h", lambda x: x["b"]).alias("b"))
        probed = probed.mapInArrow(_probe_in_place(shards, count), _with_gone(own))
    else:
        probed = _probe_by_shard(own, shards, count, partitions(spark))
    own_text = F.coalesce(F.col("own")[text], F.lit(""))
    lines = F.split(own_text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n")
    n_gone = F.size(F.filter("gone", lambda g: g)).cast("long")
    out = probed.select("own", F.size(lines).cast("long").alias("n_lines"), n_gone.alias("n_dropped"), F.when(n_gone > 0, kept).otherwise(own_text).alias("kept"))
    cols = [F.col("kept").alias(c) if c == text else F.col("own")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*cols, "n_lines", "n_dropped")


def _with_gone(own: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([own.schema["own"], T.StructField("gone", T.ArrayType(T.BooleanType()))])


def _probe_in_place(shards: list[tuple[int, str, int]], count: int):
    paths = {k: p for k, p, _ in shards}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = tuple(paths[k] for k in sorted(paths))
        held = dict(zip(sorted(paths), _shards(order)))
        for b in batches:
            d = b.column("d")
            ids = d.fill_null(0).to_numpy(zero_copy_only=False)
            a, bb = b.column("a"), b.column("b")
            flat_a, flat_b = a.flatten(), bb.flatten()
            lengths = np.diff(a.offsets.to_numpy())
            row = np.repeat(np.where(np.asarray(d.is_valid()), np.arange(len(ids)), -1), lengths)
            known = np.asarray(flat_a.is_valid())
            gone = _drops(ids, known, flat_a.fill_null(0).to_numpy(zero_copy_only=False), flat_b.fill_null(0).to_numpy(zero_copy_only=False), row, count, held.get)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(gone))
            yield pa.RecordBatch.from_arrays([b.column("own"), lists], ["own", "gone"])

    return probe


def _probe_by_shard(own: DataFrame, shards: list[tuple[int, str, int]], count: int, parts: int) -> DataFrame:
    base = stored(own.withColumn("nr", F.monotonically_increasing_id()), "line-docs")
    paths = {k: p for k, p, _ in shards}
    h = F.posexplode(hashes(F.col("t"))).alias("i", "h")
    probes = base.where(F.col("d").isNotNull()).select("nr", "d", h).where(F.col("h").isNotNull()).select("nr", "d", "i", "h.a", "h.b")
    probes = probes.withColumn("shard", F.pmod("b", F.lit(count)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("nr"), F.lit(16)))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            gone = _drops(f["d"].to_numpy(), np.ones(len(f), bool), f["a"].to_numpy(), f["b"].to_numpy(), np.arange(len(f)), count, lambda k: _shard(paths[k]) if k in paths else None)
            yield f.loc[gone, ["nr", "i"]]

    hit = probes.repartition(parts, "shard", "salt").sortWithinPartitions("shard").mapInPandas(probe, "nr long, i int").groupBy("nr").agg(F.collect_set("i").alias("at"))
    n = F.size(F.split("t", "\n", -1))
    return base.join(hit, "nr", "left").withColumn("gone", F.when(F.col("at").isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains("at", i)))).select("own", F.coalesce("gone", F.array().cast("array<boolean>")).alias("gone"))
