"""Pairs of nodes within a reach by chunks, for sums and tables over all of them.

Nodes are cut into strips of equal numbers and the strips into chunks of at
most ``CHUNK`` nodes, each a file with a box around it. A task holds one chunk
and, one after the other, those whose boxes are in reach. Both are cut into
blocks of at most ``BLOCK`` nodes that lie together; blocks out of reach are
passed over, and the pairs of the others are gone through as arrays, a few
rows of the square at a time. So memory is that of the ``KEPT`` chunks wherever
nodes crowd, pairs are never shuffled, and a sum over pairs leaves a task as one
row a node.

In the plane a force that falls as one over the distance is a sum of poles
1 / (z - z_j) of the complex number z = x + iy. Of two blocks that lie apart
and wholly within reach, all such pairs are added up together, by the powers
of the one block's places about its middle and those of the other's about its
own. ``TERMS`` powers leave out less than ``APART`` ** ``TERMS``, 5e-15, of a
block's part, which is what adding up in another order does, too. What the
edge of the reach cuts, and what lies near, is gone through pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..storage import discard, fresh, measured, stored

#: Nodes of a chunk, at most, and chunks on either side of a work item, at most, each of which is read once for all that it meets there.
CHUNK, TILE = 4096, 8
#: Nodes of a block, at most, and blocks that are tried together before each by itself.
BLOCK, TOGETHER = 64, 8
#: Blocks are apart if their radii together are at most this share of the way between their middles; powers that their pairs are added up by.
APART, TERMS = 0.4, 36
#: Chunks that a task keeps at a time.
KEPT = 32
#: Pairs that a task looks at at a time, so few that their arrays stay in a core's cache, and pairs that it gives back at a time.
SQUARE, BATCH = 1 << 15, 1 << 16
#: (distances, values of the ones, values of the others) -> factors of the way from one to the other.
Law = Callable[[np.ndarray, dict, dict], np.ndarray]


def jiggled(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """functions.layout.jiggle() of arrays."""
    low, high = np.minimum(i, j).astype(np.uint64), np.maximum(i, j).astype(np.uint64)
    h = (low * np.uint64(1664525) + high * np.uint64(1013904223)) & np.uint64(0xFFFFFFFF)  # products wrap at 2^64, which keeps these bits
    return np.where(i < j, 1.0, -1.0) * (((h & np.uint64(0xFFFF)) ^ (h >> np.uint64(16))).astype(np.float64) / 65535 - 0.5) * 1e-6


def _laid(nodes: DataFrame, over: list[str], reach: float | None, own: str | None, chunk: int | None) -> tuple[str, DataFrame, int]:
    """The folder of the chunks of nodes(idx, axes, ...), the box around each, and their number."""
    spark = nodes.sparkSession
    good = F.lit(True)
    for c in over:
        good &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    n, facts = measured(nodes.withColumns({c: F.col(c).cast("double") for c in over}).where(good), "points", n=F.count("*"))
    points = n
    count = facts["n"]
    size = chunk or min(CHUNK, max(256, -(-count // 32)))
    strips = max(1, round((count / size) ** (1 / len(over))))
    cut = over[:-1]
    edges = n.approxQuantile(cut, [k / strips for k in range(1, strips)], 0.01 / strips) if strips > 1 and count else [[] for _ in cut]
    below = lambda c, e: F.size(F.filter(F.array(*[F.lit(v) for v in e]).cast("array<double>"), lambda v: v <= F.col(c)))
    keys = [f"_s{c}" for c in cut]
    order = [*keys, over[-1], "idx"]
    n = n.withColumns({k: below(c, e) for k, c, e in zip(keys, cut, edges)}).repartitionByRange(*order).sortWithinPartitions(*order)
    at = stored(n.withColumn("_at", F.monotonically_increasing_id()), "sorted")  # partition in the upper 31 bits, place in the lower 33
    part, place = F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND((1 << 33) - 1)
    base, before, strip, rows = 0, 0, None, []
    for *key, p, low, m in sorted(tuple(r) for r in at.groupBy(*keys, part).agg(F.min(place), F.count("*")).collect()):  # a row for each strip and partition
        if key != strip:
            base, before, strip = base + -(-before // size), 0, key
        rows.append((*key, p, before - low, base))
        before += m
    base += -(-before // size)
    first = spark.createDataFrame(rows, "".join(f"{k} int, " for k in keys) + "_p long, _first long, _base long")
    t = at.withColumn("_p", part).join(F.broadcast(first), [*keys, "_p"])
    t = t.withColumn("c", (F.col("_base") + F.floor((F.col("_first") + place) / size)).cast("long")).drop(*keys, "_p", "_at", "_first", "_base")
    home = fresh(spark, "chunks")
    t.write.partitionBy("c").parquet(home)  # rows are in the order of chunks
    around = {f"{e}{c}": f(c).cast("double") for c in over for e, f in (("lo", F.min), ("hi", F.max))}
    around["r"] = (F.max(own) if own else F.lit(reach / 2)).cast("double")
    box = stored(t.groupBy("c").agg(*[v.alias(k) for k, v in around.items()], F.min("idx").alias("idx")), "boxes")
    discard(points, at)  # the chunks hold all that is read
    return home, box, base


def _met(box: DataFrame, over: list[str]) -> DataFrame:
    """(a, b, gap, low): chunks in reach of each other, the square of the way between their boxes, and the other's smallest idx."""
    a, b = (box.select(*[F.col(c).alias(f"{v}_{c}") for c in box.columns]) for v in "ab")
    gap = F.lit(0.0)
    for c in over:
        gap = gap + F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.col(f"b_lo{c}") - F.col(f"a_hi{c}")), 2)
    met = a.join(F.broadcast(b), gap <= F.pow(F.col("a_r") + F.col("b_r"), 2) * (1 + 1e-9))
    return met.select(F.col("a_c").alias("a"), F.col("b_c").alias("b"), gap.alias("gap"), F.col("b_idx").alias("low"))


def _dealt(items: DataFrame, n: int) -> DataFrame:
    """At most n items over a few tasks for each core, over more where they are many."""
    return items.repartition(max(1, min(n, max(8 * items.sparkSession.sparkContext.defaultParallelism, n // 16), 4000)))


def work(nodes: DataFrame, over: list[str], reach: float | None, own: str | None = None, chunk: int | None = None) -> tuple[str, DataFrame]:
    """The folder of the chunks of nodes(idx, axes, ...), and the items (pairs): chunks a and b in reach of each other, in order.

    ``own`` names a column of radii that are added up instead of ``reach``.
    Nodes without a place are left out.
    """
    home, box, n = _laid(nodes, over, reach, own, chunk)
    tile = max(1, min(TILE, int(n / (16 * nodes.sparkSession.sparkContext.defaultParallelism) ** 0.5)))
    side = lambda v: F.floor(F.col(v) / tile).alias(f"_{v}")
    items = _met(box, over).groupBy(side("a"), side("b")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("pairs"))
    return home, _dealt(items.select("pairs"), (n // tile + 1) ** 2)


def held(home: str, c: int) -> dict[str, np.ndarray]:
    """The columns of a chunk."""
    import pyarrow.parquet as pq

    home = home.removeprefix("file:") if home.startswith("file:/") and not home.startswith("file://") else home
    parts = []
    for f in files.listed(f"{home}/c={c}"):
        fs, path = files.opened(f)
        parts.append(pq.read_table(path, filesystem=fs, partitioning=None))
    t = pa.concat_tables(parts)
    return {k: t.column(k).to_numpy() for k in t.column_names}


def blocks(t: dict, over: list[str], own: str | None = None) -> tuple[dict, dict]:
    """The columns of a chunk with its nodes in the order of blocks, halved along the wider axis, and the blocks' places: first node, number, lowest and highest by axis, largest radius."""
    at = np.stack([t[c] for c in over])
    done, todo = [], [np.arange(at.shape[1])]
    while todo:
        some = todo.pop()
        if len(some) <= BLOCK:
            done.append(some)
            continue
        here = at[:, some]
        order = np.argsort(here[np.argmax(here.max(1) - here.min(1))], kind="stable")
        todo += [some[order[len(some) // 2 :]], some[order[: len(some) // 2]]]
    order, n = np.concatenate(done), np.array([len(d) for d in done])
    t = {k: v[order] for k, v in t.items()}
    first = np.cumsum(n) - n
    box = {"first": first, "n": n, "lo": np.minimum.reduceat(at[:, order], first, axis=1), "hi": np.maximum.reduceat(at[:, order], first, axis=1)}
    box["r"] = np.maximum.reduceat(t[own], first) if own else np.zeros(len(n))
    return t, box


def kept(home: str, over: list[str], own: str | None = None) -> Callable[[int], tuple[dict, dict]]:
    """blocks() of a chunk; the last ``KEPT`` are kept."""
    return lru_cache(KEPT)(lambda c: blocks(held(home, c), over, own))


def together(box: dict) -> dict:
    """The places of each ``TOGETHER`` blocks that follow one another as those of one."""
    at = np.arange(0, len(box["n"]), TOGETHER)
    return {"first": box["first"][at], "n": np.add.reduceat(box["n"], at), "lo": np.minimum.reduceat(box["lo"], at, axis=1), "hi": np.maximum.reduceat(box["hi"], at, axis=1)}


def gaps(a: dict, b: dict) -> np.ndarray:
    """The square of the way between the boxes of each two blocks."""
    way = np.maximum(0.0, np.maximum(a["lo"][:, :, None] - b["hi"][:, None, :], b["lo"][:, None, :] - a["hi"][:, :, None]))
    return (way * way).sum(0)


def apart(a: dict, b: dict, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each two blocks of the plane are apart and wholly within reach, at least 1 from one another, and one over the way between their middles as complex numbers."""
    mid = [(v["lo"] + v["hi"]) / 2 for v in (a, b)]
    ra, rb = (np.hypot(*(v["hi"] - v["lo"])) / 2 for v in (a, b))
    z = (mid[0][0][:, None] - mid[1][0][None, :]) + 1j * (mid[0][1][:, None] - mid[1][1][None, :])
    d, r = np.abs(z), ra[:, None] + rb[None, :]
    far = (r <= APART * d) & (d + r <= reach * (1 - 1e-9)) & (d - r >= max(1 + 1e-9, reach * 1e-6))
    return far, 1 / np.where(far, z / reach, 1.0)


#: For the power l of one block and k of the other: how often the pair of powers occurs.
_OFTEN = np.array([[(-1.0) ** m * comb(m + k, m) for k in range(TERMS)] for m in range(TERMS)], complex)


def moments(t: dict, box: dict, pole: str, reach: float) -> np.ndarray:
    """By power and block: the poles times that power of their places about the block's middle, in units of reach, added up."""
    mid = np.repeat((box["lo"] + box["hi"]) / 2, box["n"], axis=1)
    z = ((t["x"] - mid[0]) + 1j * (t["y"] - mid[1])) / reach
    out, now = [], t[pole].astype(complex)
    for _ in range(TERMS):
        out.append(np.add.reduceat(now, box["first"]))
        now = now * z
    return np.array(out)


def series(far: np.ndarray, inverse: np.ndarray, m: np.ndarray) -> np.ndarray:
    """By power and block of the ones: what the others' moments, where they are far, come to about the middle of the ones."""
    rows, cols, all_rows = far.any(1), far.any(0), len(far)
    if not rows.all() or not cols.all():
        far, inverse, m = far[rows][:, cols], inverse[rows][:, cols], m[:, cols]
    w, u = np.ones_like(inverse), np.empty((TERMS, *far.shape), complex)
    for k in range(TERMS):
        np.multiply(w, m[k][None, :], out=u[k])
        w *= inverse
    v = (_OFTEN @ u.reshape(TERMS, -1)).reshape(u.shape)
    w, out = inverse * far, np.zeros((TERMS, all_rows), complex)
    for k in range(TERMS):
        out[k, rows] = (v[k] * w).sum(1)
        w *= inverse
    return out


def summed(t: dict, box: dict, local: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The series of a block at each of its nodes, as x and y."""
    mid = np.repeat((box["lo"] + box["hi"]) / 2, box["n"], axis=1)
    z, f = ((t["x"] - mid[0]) + 1j * (t["y"] - mid[1])) / reach, np.zeros(len(t["idx"]), complex)
    for k in range(TERMS - 1, -1, -1):
        f = f * z + np.repeat(local[k], box["n"])
    return -f.real / reach, f.imag / reach  # the way goes to the other, and the conjugate of one over it is its way by its square


def squares(a: dict, b: dict, over: list[str]) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
    """Some rows of a against all of b: the ways from one to the other by axis, and the distance; infinite to itself. Coincident ones part as in L.jiggle()."""
    step = max(1, SQUARE // max(1, len(b["idx"])))
    for k in range(0, len(a["idx"]), step):
        rows = slice(k, k + step)
        way = [b[c][None, :] - a[c][rows, None] for c in over]
        d2 = way[0] * way[0]
        for w in way[1:]:
            d2 += w * w
        i, j = np.nonzero(d2 == 0)
        d = np.sqrt(d2, out=d2)
        if len(i):
            at = [w[i, j] == 0 for w in way]  # a square may come to nothing though the way is none
            same = np.logical_and.reduce(at)
            i, j = i[same], j[same]
            off = jiggled(a["idx"][rows][i], b["idx"][j])
            way[0][i, j] = off
            d[i, j] = np.where(a["idx"][rows][i] == b["idx"][j], np.inf, np.sqrt(off * off))
        yield rows, way, d


def met(a: dict, at: dict, b: dict, other: dict, near: np.ndarray) -> Iterator[tuple[dict, dict]]:
    """Each block of a with the nodes of all blocks of b that are near it."""
    for k in range(len(at["n"])):
        some = np.repeat(near[k], other["n"])
        if some.any():
            rows = slice(at["first"][k], at["first"][k] + at["n"][k])
            yield {c: v[rows] for c, v in a.items()}, b if some.all() else {c: v[some] for c, v in b.items()}


def pairs(nodes: DataFrame, over: list[str], reach: float, chunk: int | None = None) -> DataFrame:
    """(i, j, dx, dy, d), and dz in space, for all ordered pairs within reach."""
    home, items = work(nodes.select("idx", *over), over, reach, chunk=chunk)
    names = ["i", "j", *[f"d{c}" for c in over], "d"]
    types = [pa.int64(), pa.int64(), *[pa.float64()] * (len(over) + 1)]

    def found(items: list[dict]) -> Iterator[list[np.ndarray]]:
        get = kept(home, over)
        for item in items:
            for pair in item["pairs"]:
                (a, at), (b, other) = get(pair["a"]), get(pair["b"])
                for one, many in met(a, at, b, other, gaps(at, other) <= reach * reach * (1 + 1e-9)):
                    for rows, way, d in squares(one, many, over):
                        i, j = np.nonzero(d <= reach)
                        yield [one["idx"][rows][i], many["idx"][j], *[w[i, j] for w in way], d[i, j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, n = [], 0
            for part in found(batch.to_pylist()):
                some.append(part)
                n += len(part[0])
                if n >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), t) for v, t in zip(zip(*some), types)], names=names)
                    some, n = [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), t) for v, t in zip(zip(*some), types)], names=names)

    return items.mapInArrow(run, "i long, j long, " + "".join(f"d{c} double, " for c in over) + "d double")


def sums(nodes: DataFrame, over: list[str], law: Law, values: list[str], reach: float | None = None, own: str | None = None, chunk: int | None = None, pole: str | None = None) -> DataFrame:
    """(idx, ix, iy, n), and iz in space: over a node's pairs the factor of a law times the way to the other, added up by parts, and how many pairs there are.

    Pairs are those within ``reach``, or, with ``own``, those nearer than
    their radii together. The law has the ``values`` of both ends. ``pole``
    names the value of which the law is, from a distance of 1 on, that of the
    other end by the distance's square; in the plane such pairs are added up
    by blocks where these are apart.
    """
    home, items = work(nodes.select("idx", *over, *values), over, reach, own, chunk)
    names = ["idx", *[f"i{c}" for c in over], "n"]
    by_blocks = pole is not None and over == ["x", "y"]

    def far_away(levels: list[tuple], b: dict, n: np.ndarray) -> np.ndarray:
        """Adds to the series of the ones' blocks (place, others' place, series) what is far, together or by itself; which blocks that was."""
        done = np.zeros((1, 1), bool)
        for at, other, local in levels:
            far, inverse = apart(at, other, reach)
            done = np.repeat(np.repeat(done, TOGETHER, 0)[: len(far)], TOGETHER, 1)[:, : far.shape[1]] if done.any() else np.zeros(far.shape, bool)
            far &= ~done
            if far.any():
                local += series(far, inverse, moments(b, other, pole, reach))
                n += np.repeat(far @ other["n"], at["n"])
                done = done | far
            if done.all():
                return np.ones((len(levels[-1][0]["n"]), len(levels[-1][1]["n"])), bool)
        return done

    def added(a: dict, at: dict, b: dict, other: dict, near: np.ndarray, total: list[np.ndarray], n: np.ndarray) -> None:
        for k, (one, many) in zip(np.flatnonzero(near.any(1)), met(a, at, b, other, near)):
            first = at["first"][k]
            for rows, way, d in squares(one, many, over):
                close = d < one[own][rows, None] + many[own][None, :] if own else d <= reach
                m, here = np.count_nonzero(close), slice(first + rows.start, first + rows.start + len(close))
                if 4 * m > close.size:  # most are: whole rows
                    if m < close.size:
                        d[~close] = 1.0
                    f = law(d, {v: one[v][rows, None] for v in values}, {v: many[v][None, :] for v in values})
                    if m < close.size:
                        f = f * close
                    n[here] += np.count_nonzero(close, axis=1)
                    for t, w in zip(total, way):
                        t[here] += np.einsum("ij,ij->i", f, w)
                elif m:
                    i, j = np.nonzero(close)
                    f = law(d[i, j], {v: one[v][rows][i] for v in values}, {v: many[v][j] for v in values})
                    n[here] += np.bincount(i, minlength=len(close))
                    for t, w in zip(total, way):
                        t[here] += np.bincount(i, weights=f * w[i, j], minlength=len(close))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = kept(home, over, own)
        for batch in batches:
            for k, some in ((k, list(p)) for item in batch.to_pylist() for k, p in groupby(item["pairs"], lambda p: p["a"])):
                a, at = get(k)
                total, n = [np.zeros(len(a["idx"])) for _ in over], np.zeros(len(a["idx"]), np.int64)
                wider = together(at)
                local = [np.zeros((TERMS, len(v["n"])), complex) for v in (wider, at)]
                for pair in some:
                    b, other = get(pair["b"])
                    wide = np.add.outer(at["r"], other["r"]) ** 2 if own else reach * reach
                    near = gaps(at, other) <= wide * (1 + 1e-9)
                    if by_blocks:
                        near &= ~far_away([(wider, together(other), local[0]), (at, other, local[1])], b, n)
                    added(a, at, b, other, near, total, n)
                for box, l in zip((wider, at), local):
                    if l.any():
                        total = [t + f for t, f in zip(total, summed(a, box, l, reach))]
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(a["idx"][some], pa.int64()), *[pa.array(t[some], pa.float64()) for t in total], pa.array(n[some], pa.int64())], names=names)

    return items.mapInArrow(run, "idx long, " + "".join(f"i{c} double, " for c in over) + "n long")


def nearest(nodes: DataFrame, over: list[str], reach: float, chunk: int | None = None) -> DataFrame:
    """(i, j, k, dx, dy), and dz in space: of each node(idx, axes, want) the ``want`` nearest others within reach, numbered from 1, ties by idx.

    A block of nodes looks first at its own chunk, then at others by the way
    to them, until what is left is farther than the last that each node wants,
    or as far and of larger idx. So places of many nodes are not gone through.
    """
    home, box, n = _laid(nodes.select("idx", *over, F.col("want").cast("long")), over, reach, None, chunk)
    around = F.array_sort(F.collect_list(F.struct(F.col("a") != F.col("b"), "gap", "low", "b")))
    items = _dealt(_met(box, over).groupBy("a").agg(around.alias("bs")), n)
    names = ["i", "j", "k", *[f"d{c}" for c in over]]
    types = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * len(over)]

    def found(one: dict, own: dict, bs: list[dict], get: Callable[[int], tuple[dict, dict]]) -> list[np.ndarray]:
        """(row, square, j, place, ways) of a block."""
        want, widest = one["want"], reach * reach * (1 + 1e-9)
        worst, last = np.where(want > 0, widest, -1.0), np.full(len(want), np.iinfo(np.int64).max)
        best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0) for _ in over]]
        for c in bs:
            act = np.flatnonzero((c["gap"] * (1 - 1e-9) < worst) | ((c["gap"] * (1 - 1e-9) <= worst) & (c["low"] < last)))
            if not len(act):
                continue
            b, other = get(c["b"])
            some = np.repeat(gaps(own, other)[0] * (1 - 1e-9) <= worst[act].max(), other["n"])
            if not some.any():
                continue
            b = {k: v[some] for k, v in b.items()}
            way = [b[v][None, :] - one[v][act, None] for v in over]
            d2 = way[0] * way[0]
            for w in way[1:]:
                d2 += w * w
            d2[one["idx"][act, None] == b["idx"][None, :]] = np.inf
            cut, few = worst[act], want[act] <= d2.shape[1]
            if few.any():
                k = int(want[act][few].max()) - 1
                cut[few] = np.minimum(cut[few], np.partition(d2[few], k, axis=1)[:, k])
            hit = (d2 <= cut[:, None]) & (np.sqrt(d2) <= reach)
            if np.count_nonzero(hit) > 4 * want[act].sum():  # of as many as far, those of smallest idx
                by = np.argsort(b["idx"])
                tie = (hit & (d2 == cut[:, None]))[:, by]
                hit[:, by] &= ~tie | (np.cumsum(tie, axis=1) <= want[act][:, None])
            i, j = np.nonzero(hit)
            best = [np.concatenate(v) for v in zip(best, [act[i], d2[i, j], b["idx"][j], i, *[w[i, j] for w in way]])]
            order = np.lexsort((best[2], best[1], best[0]))
            best = [v[order] for v in best]
            row = best[0]
            best[3] = np.arange(len(row)) - np.searchsorted(row, row) + 1
            full = best[3] == want[row]
            worst[row[full]], last[row[full]] = best[1][full], best[2][full]
            keep = best[3] <= want[row]
            best = [v[keep] for v in best]
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = kept(home, over)
        for batch in batches:
            for item in batch.to_pylist():
                a, at = get(item["a"])
                for k in range(len(at["n"])):
                    rows = slice(at["first"][k], at["first"][k] + at["n"][k])
                    one = {c: v[rows] for c, v in a.items()}
                    row, _, j, place, *way = found(one, {e: at[e][:, k : k + 1] for e in ("lo", "hi")}, item["bs"], get)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([one["idx"][row], j, place, *way], types)], names=names)

    return items.mapInArrow(run, "i long, j long, k long, " + ", ".join(f"d{c} double" for c in over))
