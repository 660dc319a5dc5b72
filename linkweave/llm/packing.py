"""Sequence packing: full windows of overlong documents, then best-fit decreasing with a segment tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import encoder, release

WINDOW = 2048
#: Gaps up to this stay as padding; larger ones are filled from the emptiest windows.
SLACK = 16


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i //= 2

    def put(self, window: int, room: int) -> None:
        self.at[room].append(window)
        self._count(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(window, its room) of the smallest room of at least ``need``, taken out; None without one."""
        i = need + self.size
        while not self.tree[i]:
            while i % 2:  # a right child: go up until there is something to the right
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.size:
            i *= 2
            if not self.tree[i]:
                i += 1
        room = i - self.size
        self._count(room, -1)
        return self.at[room].pop(), room


def layout(lengths: list[int], window: int = WINDOW, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces that hold every id of the documents once.

    Documents longer than a window give full windows first. What remains is
    placed in decreasing order in the tightest open window. Windows left with
    more than ``slack`` free are filled by cutting pieces of the emptiest
    windows; the last such window is cut into lengths that are powers of two,
    which need no padding.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        full = n // window
        out += [[(d, k * window, window)] for k in range(full)]
        if n % window:
            rest.append((n % window, d, full * window))
    rest.sort(key=lambda x: (-x[0], x[1]))
    wins: list[list[tuple[int, int, int]]] = []
    rooms: list[int] = []
    open_ = OpenWindows(window)
    for n, d, start in rest:
        found = open_.tightest(n)
        if found is None:
            wins.append([(d, start, n)])
            rooms.append(window - n)
            open_.put(len(wins) - 1, window - n)
        else:
            w, room = found
            wins[w].append((d, start, n))
            rooms[w] = room - n
            open_.put(w, room - n)
    order = sorted(range(len(wins)), key=lambda w: (rooms[w], w))
    i, j = 0, len(order) - 1
    while i < j:
        w, donor = order[i], order[j]
        if rooms[w] <= slack:
            i += 1
        elif not wins[donor]:
            j -= 1
        else:
            d, start, n = wins[donor].pop()
            take = min(n, rooms[w])
            wins[w].append((d, start, take))
            if take < n:
                wins[donor].append((d, start + take, n - take))
            rooms[w] -= take
            rooms[donor] += take
    for w in order:
        if not wins[w]:
            continue
        if rooms[w] <= slack:
            out.append(wins[w])
            continue
        pieces, used = list(wins[w]), window - rooms[w]
        while used:
            size = 1 << (used.bit_length() - 1)
            used -= size
            seq = []
            while size:
                d, start, n = pieces.pop(0)
                take = min(n, size)
                seq.append((d, start, take))
                if take < n:
                    pieces.insert(0, (d, start + take, n - take))
                size -= take
            out.append(seq)
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, words: bool = False, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null text is empty, so the document is end_id alone. Each partition packs
    its own documents in memory bounded by the partition: its number, shifted,
    begins its sequence ids, so a repeated task gives the same rows. Null or
    tied doc_ids pass through. No shuffle.
    """
    bounded_batches(docs.sparkSession)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary, words)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        names, ids = [], []
        for b in batches:
            names += [None if pd.isna(d) else int(d) for d in b["d"]]
            ids += [np.frombuffer(e + end, dtype=enc.dtype) for e in enc.encode(b["t"].tolist())]
        release()
        base = TaskContext.get().partitionId() << 36
        rows, held = [], 0
        for s, seq in enumerate(layout([len(x) for x in ids], window)):
            offset = 0
            for d, start, n in seq:
                rows.append((names[d], start, n, ids[d][start : start + n].astype("<u4").tobytes(), len(ids[d]), base + s, offset))
                offset += n
                held += n
            if held > 2_000_000:
                yield _frame(rows)
                rows, held = [], 0
        if rows:
            yield _frame(rows)

    t = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return t.mapInPandas(packed, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    return f.assign(doc_id=pd.array(f["doc_id"].tolist(), dtype="Int64"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
