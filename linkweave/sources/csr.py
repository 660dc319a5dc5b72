"""Adjacency as files: blocks of delta-coded neighbour lists with an offset index, read by ranges of nodes.

Entries (node, t) lie in order of both. A block holds some thousand of them:
the differences of nodes and of neighbours within a node, each array in the
fewest bytes that hold it, compressed. The index says which nodes a block
spans; a node of many neighbours spans several.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from . import files
from .tiles import runs

ENTRIES = 8192
INDEX = "first long, last long, entries long, file string, offset long, length long"


def _narrow(x: np.ndarray) -> bytes:
    """The width in bytes, then the numbers; differences are not negative but for a first one."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _wide(data: bytes, n: int) -> tuple[np.ndarray, bytes]:
    width = data[0]
    return np.frombuffer(data, f"<i{width}", n, 1).astype(np.int64), data[1 + n * width :]


def encoded(node: np.ndarray, t: np.ndarray) -> bytes:
    """A block of sorted entries: steps from node to node, and from neighbour to neighbour, which begin anew with each node."""
    new = np.concatenate([[True], node[1:] != node[:-1]])
    at = np.nonzero(new)[0]
    size = np.diff(np.append(at, len(node)))
    steps = np.diff(t, prepend=0)
    starts = np.diff(t[at], prepend=0)
    return zlib.compress(len(at).to_bytes(4, "little") + len(node).to_bytes(4, "little") + _narrow(np.diff(node[at], prepend=0)) + _narrow(size) + _narrow(starts) + _narrow(steps[~new]))


def decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    nodes, n, rest = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little"), data[8:]
    steps, rest = _wide(rest, nodes)
    size, rest = _wide(rest, nodes)
    starts, rest = _wide(rest, nodes)
    inner, _ = _wide(rest, n - nodes)
    node, first = np.repeat(np.cumsum(steps), size), np.cumsum(size) - size
    d = np.empty(n, np.int64)
    new = np.zeros(n, bool)
    new[first] = True
    d[new], d[~new] = np.cumsum(starts), inner
    total = np.cumsum(d)
    return node, total - np.repeat(total[first] - d[first], size) if n else d


def write(edges: DataFrame, path: str, entries: int = ENTRIES) -> dict:
    """Write both directions of edges(src, dst), longs, each once, and their index; gives entries, bytes and bytes an entry (D7). Ranges are cut by node and neighbour, so that no task holds a hub."""
    both = edges.select(F.col("src").cast("long").alias("node"), F.col("dst").cast("long").alias("t"))
    both = both.unionByName(both.select(F.col("t").alias("node"), F.col("node").alias("t"))).where("node is not null and t is not null").distinct()

    def pack(batches: Iterator) -> Iterator:
        import pandas as pd

        name, out, at, held, index = f"{uuid.uuid4().hex}.csr", None, 0, None, []

        def put(x: np.ndarray) -> None:
            nonlocal out, at
            if out is None:
                fs, p = files.opened(f"{path}/blocks/{name}")
                fs.create_dir(p.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(p, compression=None)
            data = encoded(x[0], x[1])
            out.write(data)
            index.append((int(x[0, 0]), int(x[0, -1]), x.shape[1], name, at, len(data)))
            at += len(data)

        for b in batches:
            x = np.stack([b["node"].to_numpy(), b["t"].to_numpy()])
            held = x if held is None else np.concatenate([held, x], axis=1)
            while held.shape[1] >= entries:
                put(held[:, :entries])
                held = held[:, entries:]
        if held is not None and held.shape[1]:
            put(held)
        if out is not None:
            out.close()
            yield pd.DataFrame(index, columns=["first", "last", "entries", "file", "offset", "length"])

    index = stored(both.repartitionByRange("node", "t").sortWithinPartitions("node", "t").mapInPandas(pack, INDEX), "index")
    index.repartitionByRange("first", "last").sortWithinPartitions("first", "last").write.parquet(f"{path}/index")
    n, size = index.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    facts = {"entries": n, "bytes": size, "bytesAnEntry": round(size / n, 3) if n else 0.0}
    files.write_json(f"{path}/meta.json", facts)
    return facts


def read(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(node, t) of the nodes from low to high, both included; tasks read only the bytes of the blocks that hold such nodes."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    index = index if low is None else index.where(F.col("last") >= low)
    index = index if high is None else index.where(F.col("first") <= high)

    def unpack(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for file, offset, length in runs(list(b[["file", "offset", "length"]].itertuples(index=False, name=None)), gap=0):
                data = files.part(f"{path}/blocks/{file}", offset, length)
                for o, n in b.loc[(b["file"] == file) & (b["offset"] >= offset) & (b["offset"] < offset + length), ["offset", "length"]].itertuples(index=False):
                    node, t = decoded(data[o - offset : o - offset + n])
                    keep = (node >= (low if low is not None else node.min())) & (node <= (high if high is not None else node.max()))
                    yield pd.DataFrame({"node": node[keep], "t": t[keep]})

    return index.repartitionByRange("first", "last").mapInPandas(unpack, "node long, t long")
