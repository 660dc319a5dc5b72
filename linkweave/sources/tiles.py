"""A tile store: the tiles of a drawing packed into few files, found by an offset index, read by byte range.

Tiles are laid along a Z-order curve, so that the tiles of a view lie in few
runs of few files. Each is one compressed JSON document of its sampled
elements and counts. The index has a row a tile: where it is, and how long.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Binary digits of a tile's place across or down.
DIGITS = 16
#: Gaps between tiles up to this many bytes are read over rather than around.
GAP = 4096
INDEX = "z long, tx int, ty int, file string, offset long, length long"


def z_order(tx: Column, ty: Column) -> Column:
    """The digits of both places in turn."""
    out = F.lit(0).cast("long")
    for k in range(DIGITS):
        bit = lambda v: F.shiftright(v.cast("long"), k).bitwiseAND(1)  # noqa: E731, B023
        out = out + F.shiftleft(bit(tx), 2 * k) + F.shiftleft(bit(ty), 2 * k + 1)
    return out


def packed(kept: DataFrame, counts: DataFrame, folder: str, tiles_a_file: int = 1024) -> DataFrame:
    """Write the tiles of kept(tx, ty, kind, slot, values, text) with counts(tx, ty, kind, n) and return their index.

    Tiles are dealt by ranges of the curve; a task writes one file, tile after
    tile. Every attempt has a file of its own, and the index names those of
    the attempts that counted. A tile is bounded by the caps of its sample.
    """
    z = z_order(F.col("tx"), F.col("ty"))
    rows = kept.select(z.alias("z"), "tx", "ty", "kind", F.col("slot").cast("long").alias("slot"), "values", "text", F.lit(None).cast("long").alias("n"))
    rows = rows.unionByName(counts.select(z.alias("z"), "tx", "ty", "kind", F.lit(-1).cast("long").alias("slot"), F.lit(None).cast("array<double>").alias("values"), F.lit(None).cast("string").alias("text"), "n"))
    parts = max(1, -(-counts.select("tx", "ty").distinct().count() // tiles_a_file))

    def write(batches: Iterator) -> Iterator:
        import pandas as pd

        name, at, out, index, tile, doc = f"{uuid.uuid4().hex}.tiles", 0, None, [], None, {}

        def close() -> None:
            nonlocal at, out
            if tile is None:
                return
            if out is None:
                fs, path = files.opened(f"{folder}/{name}")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            data = zlib.compress(json.dumps(doc, ensure_ascii=False).encode())
            out.write(data)
            index.append((*tile, name, at, len(data)))
            at += len(data)

        for b in batches:
            for z, tx, ty, kind, slot, values, text, n in b[["z", "tx", "ty", "kind", "slot", "values", "text", "n"]].itertuples(index=False):
                if tile != (z, tx, ty):
                    close()
                    tile, doc = (z, tx, ty), {"counts": {}, "line": [], "circle": [], "text": []}
                if slot < 0:
                    doc["counts"][kind] = int(n)
                else:
                    doc[kind].append([*map(float, values), *([text] if kind == "text" else [])])
        close()
        if out is not None:
            out.close()
            yield pd.DataFrame(index, columns=["z", "tx", "ty", "file", "offset", "length"])

    order = ["z", "kind", "slot"]
    return rows.repartitionByRange(parts, "z").sortWithinPartitions(*order).mapInPandas(write, INDEX)


def runs(index: list[tuple[str, int, int]], gap: int = GAP) -> list[tuple[str, int, int]]:
    """(file, offset, length) of the reads that cover the given tiles: those of one file that lie together are one read."""
    out: list[tuple[str, int, int]] = []
    for file, offset, length in sorted(index):
        if out and out[-1][0] == file and offset - out[-1][1] - out[-1][2] <= gap:
            out[-1] = (file, out[-1][1], offset + length - out[-1][1])
        else:
            out.append((file, offset, length))
    return out


def located(spark: SparkSession, cache: str, span: tuple[int, int, int, int]) -> DataFrame:
    """Index rows of the tiles of a span (first and last across, first and last down). The index is sorted along the curve, so that files of it that hold no such tile are passed over."""
    index = spark.read.schema(INDEX).parquet(f"{cache}/index")
    return index.where(F.col("tx").between(span[0], span[1]) & F.col("ty").between(span[2], span[3]) & F.col("z").between(_z(span[0], span[2]), _z(span[1], span[3])))


def _z(tx: int, ty: int) -> int:
    return sum((tx >> k & 1) << 2 * k | (ty >> k & 1) << 2 * k + 1 for k in range(DIGITS))


def read_tiles(spark: SparkSession, cache: str, span: tuple[int, int, int, int]) -> DataFrame:
    """(tx, ty, kind, values, text) of a span of tiles; tasks read only the bytes of the tiles that they are given."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for tx, ty, doc in _documents(cache, list(b[["tx", "ty", "file", "offset", "length"]].itertuples(index=False, name=None))):
                for kind in ("line", "circle", "text"):
                    rows += [(tx, ty, kind, v[:2] if kind == "text" else v, v[2] if kind == "text" else "") for v in doc[kind]]
            yield pd.DataFrame(rows, columns=["tx", "ty", "kind", "values", "text"])

    found = located(spark, cache, span)
    return found.repartitionByRange("z").sortWithinPartitions("z").mapInPandas(read, "tx int, ty int, kind string, values array<double>, text string")


def _documents(cache: str, tiles: list[tuple[int, int, str, int, int]]) -> Iterator[tuple[int, int, dict]]:
    held = {(f, o): (files.part(f"{cache}/packs/{f}", o, n), n) for f, o, n in runs([t[2:] for t in tiles])}
    starts = sorted(held)
    for tx, ty, file, offset, length in tiles:
        start = max(s for s in starts if s[0] == file and s[1] <= offset)
        yield tx, ty, json.loads(zlib.decompress(held[start][0][offset - start[1] : offset - start[1] + length]))


class TileServer:
    """Answers a tile or a view from the store, without Spark work once the index is read (O7). The index has at most a row a tile of the grid; ``bytes_read`` counts what was read for answers."""

    def __init__(self, spark: SparkSession, cache: str):
        meta = files.read_json(f"{cache}/meta.json")
        if meta is None:
            raise FileNotFoundError(f"no cache at {cache}")
        self.cache, self.meta, self.bytes_read = cache, meta, 0
        self.index = {(r["tx"], r["ty"]): (r["file"], r["offset"], r["length"]) for r in spark.read.schema(INDEX).parquet(f"{cache}/index").collect()}  # grid squared at most

    def tile(self, tx: int, ty: int) -> dict:
        """The tile's elements and counts; empty where nothing was drawn."""
        return next((d for _, _, d in self.tiles((tx, tx, ty, ty))), {"counts": {}, "line": [], "circle": [], "text": []})

    def tiles(self, span: tuple[int, int, int, int]) -> list[tuple[int, int, dict]]:
        found = [(tx, ty, *at) for (tx, ty), at in self.index.items() if span[0] <= tx <= span[1] and span[2] <= ty <= span[3]]
        self.bytes_read += sum(n for _, _, n in runs([t[2:] for t in found]))
        return list(_documents(self.cache, found))
