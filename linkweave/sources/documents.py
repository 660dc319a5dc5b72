"""A single {nodes, links} document of any size: written by many tasks, and read by ranges of its bytes.

A document is one file, or a folder whose files in order of their names make
it up. What a range of bytes means depends on all bytes before it, but only by
two things: whether it begins within a string, and how deep. A first pass finds
what each range does to both, the driver adds these few numbers up, and a
second pass takes the elements that begin in a range.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from . import files

#: Bytes that a task looks at at a time.
CHUNK = 8 << 20
RANGE = "n long, file string, start long, stop long, inside boolean, depth long"
FOUND = "n long, kind string, at long, name string, array boolean, key long, i long, value string"


def write(nodes: DataFrame, links: DataFrame, path: str, by: list[str]) -> None:
    """nodes and links, less the columns ``by``, as a folder of text files that in their order are one document, an element a line.

    Both go by these columns, which must tell the rows of a table apart.
    """
    rows = nodes.sparkSession.createDataFrame([(0, '{"nodes":['), (2, '],"links":['), (4, "]}")], "part int, value string")
    for part, df in ((1, nodes), (3, links)):
        t = stored(df, "elements")
        first = t.agg(F.min(F.struct(*by))).first()[0]
        head = F.lit(first is not None) & F.struct(*by).eqNullSafe(F.struct(*[F.lit(None if first is None else first[c]).cast(t.schema[c].dataType).alias(c) for c in by]))
        text = F.concat(F.when(head, "").otherwise(","), F.to_json(F.struct(*[c for c in t.columns if c not in by])))
        rows = rows.unionByName(t.select(F.lit(part).alias("part"), *by, text.alias("value")), allowMissingColumns=True)
    rows.repartitionByRange("part", *by).sortWithinPartitions("part", *by).select("value").write.text(path)


def scan(data: bytes, inside: bool, back: int):
    """(quotes, marks, steps): where strings begin and end, where braces and brackets outside them are, and what these add to the depth.

    inside: the data begin within a string; back: backslashes directly before them.
    """
    import numpy as np

    a = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(a == 34)
    slashes = np.flatnonzero(a == 92)
    if len(quotes) and (len(slashes) or back):
        # length of the run of backslashes that ends before a quote
        new = np.ones(len(slashes), bool)
        new[1:] = np.diff(slashes) > 1
        first = slashes[np.maximum.accumulate(np.where(new, np.arange(len(slashes)), 0))] if len(slashes) else slashes
        k = np.searchsorted(slashes, quotes) - 1
        run = np.zeros(len(quotes), np.int64)
        after = (k >= 0) & (slashes[np.maximum(k, 0)] == quotes - 1) if len(slashes) else np.zeros(len(quotes), bool)
        if after.any():
            begin = first[k[after]]
            run[after] = quotes[after] - begin + np.where(begin == 0, back, 0)
        run[quotes == 0] = back
        quotes = quotes[run % 2 == 0]
    step = np.zeros(256, np.int8)
    step[[123, 91]], step[[125, 93]] = 1, -1
    steps = step[a]
    marks = np.flatnonzero(steps)
    marks = marks[(np.searchsorted(quotes, marks) + inside) % 2 == 0]
    return quotes, marks, steps[marks].astype(np.int64)


def backslashes(file: str, start: int) -> int:
    """How many backslashes there are directly before a place of a file."""
    n, size = 0, 256
    while n < start:
        before = files.part(file, max(0, start - size), min(size, start))
        n = len(before) - len(before.rstrip(b"\\"))
        if n < len(before):
            break
        size *= 4
    return n


def to_end(file: str, start: int) -> bytes:
    """The element that begins in a file at start, outside a string."""
    out, inside, deep, back, block = [], False, 0, 0, 1 << 16
    while True:
        data = files.part(file, start + sum(map(len, out)), block)
        if not data:
            raise ValueError(f"{file} ends within an element")
        quotes, marks, steps = scan(data, inside, back)
        deeper = deep + steps.cumsum()
        done = marks[deeper == 0]
        if len(done):
            return b"".join(out) + data[: int(done[0]) + 1]
        deep, inside = int(deeper[-1]) if len(deeper) else deep, bool((len(quotes) + inside) % 2)
        trail = len(data) - len(data.rstrip(b"\\"))
        back = trail + back if trail == len(data) else trail
        out.append(data)
        block = min(block * 4, CHUNK)


def name_at(file: str, at: int) -> tuple[str, bool] | None:
    """The name that begins at a place of a file, and whether its value is an array; None for another string."""
    size = 256
    while True:
        data = files.part(file, at, size)
        if m := re.match(rb'("(?:[^"\\]|\\.)*")\s*(?:(:)\s*(\S)|[^:\s])', data, re.S):
            return (json.loads(m[1]), m[3] == b"[") if m[2] else None
        if len(data) < size:
            return None
        size *= 4


def elements(spark: SparkSession, path: str, *names: str, chunk: int = CHUNK) -> DataFrame:
    """(name, pos, value): the objects in the arrays that a document has under these names, with their place there, as JSON.

    Of a name that comes twice in a document the last counts; several
    documents, one after the other or in an array, give the elements of each.
    A file may end between elements, not within one. Text that breaks off is
    an error.
    """
    sizes = [(f, files.size(f)) for f in files.listed(path)]
    ranges = [(f, at, min(at + chunk, size)) for f, size in sizes for at in range(0, size, chunk)]
    if not ranges:
        return spark.createDataFrame([], "name string, pos long, value string")
    start = next((b for f, size in sizes if (b := files.part(f, 0, 1 << 16).lstrip(b"\xef\xbb\xbf \t\r\n"))), b"")[:1]
    if start not in (b"{", b"["):
        raise ValueError(f"{path} is no document of nodes and links")
    base = 1 if start == b"[" else 0

    def changes(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for n, file, at, stop in zip(b["n"], b["file"], b["start"], b["stop"]):
                data, back = files.part(file, at, stop - at), backslashes(file, at)
                deep = [int(scan(data, inside, back)[2].sum()) for inside in (False, True)]
                yield pd.DataFrame({"n": [n], "odd": [len(scan(data, False, back)[0]) % 2 == 1], "out": [deep[0]], "within": [deep[1]]})

    def dealt(rows: list, schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 10_000)), "n")

    todo = dealt([(n, *r, False, 0) for n, r in enumerate(ranges)], RANGE)
    inside, depth, states = False, 0, []
    for r, (n, odd, out, within) in zip(ranges, sorted(tuple(x) for x in todo.mapInPandas(changes, "n long, odd boolean, out long, within long").collect())):
        states.append((n, *r, inside, depth))
        depth, inside = depth + (within if inside else out), inside != odd
    if inside or depth:
        raise ValueError(f"{path} breaks off")

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for b in batches:
            for n, file, at, stop, inside, depth in zip(*[b[c] for c in ("n", "file", "start", "stop", "inside", "depth")]):
                data = files.part(file, at, stop - at)
                quotes, marks, steps = scan(data, bool(inside), backslashes(file, at))
                after = depth + steps.cumsum()
                opened = quotes[int(inside) :: 2]
                # depth where a string begins
                level = np.concatenate([[depth], after])[np.searchsorted(marks, opened)]
                rows = [(n, "document", int(at + p), None, None, None, None, None) for p in marks[(steps > 0) & (after == base + 1)]]
                keys = [(int(p), k) for p in opened[level == base + 1] if (k := name_at(file, int(at + p)))]
                rows += [(n, "name", int(at + p), k, array, None, None, None) for p, (k, array) in keys]
                object_ = np.frombuffer(data, np.uint8)[marks] == 123
                begun = marks[(steps > 0) & (after == base + 3) & object_]
                ended = marks[(steps < 0) & (after == base + 2)]
                which = np.searchsorted([p for p, _ in keys], begun) - 1
                end = np.searchsorted(ended, begun)
                count: dict[int, int] = {}
                for p, w, e in zip(begun.tolist(), which.tolist(), end.tolist()):
                    text = data[p : int(ended[e]) + 1] if e < len(ended) else to_end(file, int(at + p))
                    i = count[w] = count.get(w, -1) + 1
                    rows.append((n, "element", int(at + p), None, None, int(at + keys[w][0]) if w >= 0 else None, i, text.decode()))
                if rows:
                    yield pd.DataFrame(rows, columns=["n", "kind", "at", "name", "array", "key", "i", "value"]).astype({"key": "Int64", "i": "Int64", "array": "boolean"})

    found = stored(dealt(states, RANGE).mapInPandas(find, FOUND), "elements")
    # a range's elements before its first name are under the last name before it
    last = {r[0]: r[1] for r in found.where("kind = 'name'").groupBy("n").agg(F.max("at")).collect()}
    before, known = {}, None
    for n in range(len(ranges)):
        before[n] = known
        known = (n, last[n]) if n in last else known
    kept: dict[tuple[int, str], tuple[int, int]] = {}
    arrays, document = set(), 0
    for n, at, kind, name, array in sorted(tuple(r) for r in found.where(F.col("kind").eqNullSafe("document") | ((F.col("kind") == "name") & F.col("name").isin(*names))).select("n", "at", "kind", "name", "array").collect()):
        if kind == "document":
            document += 1
        else:
            kept[document, name] = (n, at)
            arrays |= {(n, at)} if array else set()
    named = {where: name for (_, name), where in kept.items() if where in arrays}
    rows, counted = [], {}
    for n, key, count in sorted((tuple(r) for r in found.where("kind = 'element'").groupBy("n", "key").count().collect()), key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        where = before[n] if key is None else (n, key)
        if where in named:
            rows.append((n, key, named[where], counted.get(where, 0)))
            counted[where] = counted.get(where, 0) + count
    at = spark.createDataFrame(rows, "n_ long, key_ long, name_ string, base_ long")  # a row a range and name
    out = found.where("kind = 'element'").join(F.broadcast(at), (F.col("n") == F.col("n_")) & F.col("key").eqNullSafe(F.col("key_")))
    return out.select(F.col("name_").alias("name"), (F.col("base_") + F.col("i")).alias("pos"), "value")
