"""Token-id shards: a concatenated id array with Elias-Fano coded document boundaries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import bounded_batches, fresh, partitions, stored
from .tokens import encoder, release

MAGIC = b"LWEFIDS2"
_HEAD = struct.Struct("<8sBBBqqqqqqqq")  # magic, bytes an id, low bits of bounds and of names, null names, documents, least name, bytes of low and high twice, samples being 4 bytes each
STEP = 64  # ones between select samples
#: Bytes of ids after which a task begins its next shard; a shard holds one document more at most.
SHARD_BYTES = 64 << 20
#: Documents whose bounds a reader has in hand at once.
GROUP = 4096


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(u/n) bits each, with select."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: unsigned 64-bit integers in order."""
        v = np.asarray(values).astype(np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        lows = np.unpackbits(np.ascontiguousarray(v.astype("<u8")).view(np.uint8), bitorder="little").reshape(n, 64)[:, :bits]
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1 if n else 0), dtype=np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(lows.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::STEP].astype("<u4"))

    def select(self, first: int, last: int) -> np.ndarray:
        """Values number first to last - 1, as unsigned 64-bit integers.

        The sample before ``first`` gives the place to start in the unary
        part; as many bytes are unpacked as hold the ones that are asked for,
        and as many low bits.
        """
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        want = last - first
        if not want:
            return np.empty(0, np.uint64)
        at, skip = int(self.samples[first // STEP]), first % STEP
        byte, stop = at // 8, at // 8
        found, parts = 0, []
        while found < skip + want:  # the samples bound how far; gaps are runs of zero bytes
            stop = min(len(self.high), byte + max(64, (skip + want - found) // 2))
            bits = np.unpackbits(self.high[byte:stop], bitorder="little")
            if not parts:
                bits[: at % 8] = 0
            ones = np.nonzero(bits)[0] + 8 * byte
            parts.append(ones)
            found, byte = found + len(ones), stop
        ones = np.concatenate(parts)[skip : skip + want]
        upper = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.bits)
        b0, b1 = first * self.bits, last * self.bits
        lows = np.unpackbits(self.low[b0 // 8 : (b1 + 7) // 8], bitorder="little")[b0 % 8 : b0 % 8 + b1 - b0].reshape(want, self.bits)
        wide = np.zeros((want, 64), np.uint8)
        wide[:, : self.bits] = lows
        return upper | np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def pack_shard(doc_ids: list, lengths: list[int], parts: list[bytes], width: int) -> list[bytes]:
    """The sections of a shard file: head, bounds, names, token ids. doc_ids ascend, nulls before all; both sequences are Elias-Fano coded."""
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]))
    nulls = sum(d is None for d in doc_ids)
    least = doc_ids[nulls] if nulls < len(doc_ids) else 0
    names = EliasFano.of(np.array([d - least for d in doc_ids[nulls:]], dtype=np.uint64))
    head = _HEAD.pack(MAGIC, width, bounds.bits, names.bits, nulls, len(doc_ids), least, len(bounds.low), len(bounds.high), len(names.low), len(names.high), sum(map(len, parts)))
    return [head, *(x.tobytes() for e in (bounds, names) for x in (e.low, e.high, e.samples)), *parts]


class Shard:
    """A shard file in memory; bounds and names are looked up with select."""

    def __init__(self, data: bytes):
        magic, width, bits, name_bits, self.nulls, self.n, self.least, low, high, name_low, name_high, size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = _HEAD.size

        def take(size: int, dtype) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, dtype=dtype, count=size // np.dtype(dtype).itemsize, offset=at - size)

        coded = lambda n, bits, low, high: EliasFano(n, bits, take(low, np.uint8), take(high, np.uint8), take(4 * -(-n // STEP), "<u4"))
        self.bounds = coded(self.n + 1, bits, low, high)
        self.names = coded(self.n - self.nulls, name_bits, name_low, name_high)
        self.array = take(size, f"<u{width}")

    def doc_ids(self, first: int, last: int) -> list:
        a, b = max(first - self.nulls, 0), max(last - self.nulls, 0)
        return [None] * (min(last, self.nulls) - min(first, self.nulls)) + [self.least + int(x) for x in self.names.select(a, b)]

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(i, i + 2).tolist()
        return self.array[a:b]


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 1, words: bool = True, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append end_id, and write shards in ascending order of document id.

    Returns the manifest (task, shard, path, documents, ids, before), one row a
    shard, ``before`` being the task's ids in earlier shards. A task rolls over
    to its next shard after ``shard_bytes`` of ids, so memory doesn't grow with
    the table. Null ids come first; equal ids are ordered by their text's hash; null text is
    empty, so only end_id is written. An empty table gives an empty manifest.
    A task writes under a name of its own, so a lost or repeated attempt
    leaves no half file in the manifest.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or fresh(spark, "token-ids")

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary, words)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        doc_ids, lengths, parts, held, before, rows = [], [], [], 0, 0, []
        k = TaskContext.get().partitionId()

        def close() -> None:
            nonlocal doc_ids, lengths, parts, held, before
            path = files.attempt(folder, f"shard-{k:06d}-{len(rows):06d}")
            files.write(path, *pack_shard(doc_ids, lengths, parts, enc.dtype.itemsize))
            rows.append((k, len(rows), path, len(doc_ids), sum(lengths), before))
            before += rows[-1][4]
            doc_ids, lengths, parts, held = [], [], [], 0

        for b in batches:
            for d, e in zip(b["d"], enc.encode(b["t"].tolist())):
                doc_ids.append(None if pd.isna(d) else int(d))
                lengths.append(len(e) // enc.dtype.itemsize + 1)
                parts += (e, end)
                held += len(e)
                if held >= shard_bytes:
                    close()
        release()
        if doc_ids:
            close()
        yield pd.DataFrame(rows, columns=["task", "shard", "path", "documents", "ids", "before"])

    t = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = t.repartitionByRange(partitions(spark), "d", "h").sortWithinPartitions("d", "h").select("d", "t")
    return stored(ordered.mapInPandas(shard, "task long, shard long, path string, documents long, ids long, before long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, task, shard) of every document, from the files themselves: bounds and names through select, a group of documents at a time."""
    spark = manifest.sparkSession
    # a row a task, not a shard or document
    at, bases = 0, []
    for k, ids in sorted(tuple(r) for r in manifest.groupBy("task").agg(F.sum("ids")).collect()):
        bases.append((k, at))
        at += ids

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, no, path, base in zip(b["task"], b["shard"], b["path"], b["base"]):
                s = Shard(files.read(path))
                for i in range(0, s.n, GROUP):
                    j = min(s.n, i + GROUP)
                    bounds = s.bounds.select(i, j + 1).astype(np.int64)
                    crc = [zlib.crc32(s.array[x:y].astype("<u4").tobytes()) for x, y in zip(bounds[:-1], bounds[1:])]
                    yield pd.DataFrame({"doc_id": pd.array(s.doc_ids(i, j), dtype="Int64"), "start": bounds[:-1] + base, "n_tokens": np.diff(bounds), "ids_crc32": crc, "task": k, "shard": no})

    shards = manifest.join(F.broadcast(spark.createDataFrame(bases, "task long, at long")), "task").select("task", "shard", "path", (F.col("at") + F.col("before")).alias("base"))
    n = manifest.count()
    return shards.repartition(max(1, min(n, 10_000)), "path").mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, task long, shard long")
