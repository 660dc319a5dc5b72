"""Near-duplicate classes by an exact set join on word shingles (Jaccard of 0.8 or more).

Candidates come from a partition of the universe of shingles: hashing deals a
set's shingles to the segments of its size band. Two sets that link differ in
at most H shingles. A segment is left out of a set's index, or indexed as it
is, which meets sets that have it equal, or with its one-deletion
neighbourhood as well, which meets those that differ by one there. Each of the
two is a unit; of any H + 1 units of a set one meets every set that links. All
sets of a band take their units in one order, the cheapest first, so that the
first unit that meets is among those of both. A unit's cost is what it adds to
the index and the pairs that come to share a signature by it, for each set
that gains it: rows are counted over all classes, pairs among CHUNK classes at
a time and scaled up. Any common order gives the same links, a worse one more
candidates. A set with too few units indexes all segments, empty ones too,
with their neighbourhoods. Every candidate is verified on the full sets.

Exact copies are one class from the start. Links are looked for from a
bucket's leader first; only buckets that then still hold several components
are searched pair by pair, in blocks.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import bounded_batches, discard, partitions, release, stored
from .lines import mix

SHINGLE = 5
#: Rows of a bucket that are compared with each other in one task.
BLOCK = 2048
STAR_ROUNDS = 1
#: Classes among which colliding signatures are counted, and what such a pair costs beside a row of the index.
CHUNK, PAIR = 2000, 0.02
#: Cells of the sketch that pairs of an open bucket must pass.
MID = 512
#: Signatures by which a class knows in a group whom it has met in an earlier one; beyond them a pair may come up again.
MET = 64
#: Fixed odd multipliers of a shingle's five words.
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its 5-word shingles; a shorter text is one shingle, no words none."""
    words = [t.encode().lower().split() for t in texts]  # bytes: ASCII letters and white space only
    padded = [w if not w or len(w) >= SHINGLE else w + [b" "] * (SHINGLE - len(w)) for w in words]  # no word is a space
    ends = np.cumsum([len(w) for w in padded])
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(padded)), np.uint64, int(ends[-1]) if len(ends) else 0)
    m = max(0, len(h) - SHINGLE + 1)
    out = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        out += h[j : j + m] * _MUL[j]
    out = mix(out, 99)
    sets, at = [], 0
    for end in ends:
        s = np.sort(out[at : end - SHINGLE + 1]) if end > at else out[:0]
        sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
        at = end
    return sets


def shingles(text: str) -> np.ndarray:
    return shingle_sets([text])[0]


def name_of(s: np.ndarray, taken: frozenset = frozenset(), bits: int = 64) -> tuple[int, int]:
    """The two halves of a set's 128-bit name: the first (of ``bits``, fewer in tests) names its class, unless other sets have it too (``taken``): then the second does."""
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
    first, second = int(d[0]) >> (64 - bits), int(d[1])
    return (second if first in taken else first), second


def sketch(s: np.ndarray) -> np.ndarray:
    """Shingles in each of 32 cells, up to 255, as four longs; cells differ no more than the sets."""
    return np.minimum(np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=32), 255).astype(np.uint8).view("<i8")


def segments(band: int) -> int:
    return max(64, (2 << band) // 3)


def roles(n: int) -> list[tuple[int, int]]:
    """(band, most differences to a set met there): its own, and the band below if sets there can link."""
    band = n.bit_length() - 1
    out = [(band, (n + n * 10 // 8) // 9)]
    below = (1 << band) - 1
    if band and 10 * below >= 8 * n:
        out.append((band - 1, (n + below) // 9))
    return out


def segment_sums(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each shingle, mixed shingles, non-empty segments, their sums)."""
    seg = (mix(s, 1000 + band) % np.uint64(segments(band))).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg, m = seg[order], mix(s[order], 7)
    at = np.nonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))[0]
    return seg, m, seg[at], np.add.reduceat(m, at)


def _sign(seg: np.ndarray, total: np.ndarray, band: int) -> np.ndarray:
    return mix(total + mix(seg.astype(np.uint64), 31 + band), 77).view(np.int64)


def _units(own: np.ndarray, size: np.ndarray, band: int, order: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the band's order, index of the segment, level) of all units of a set: the exact segment (1), and its neighbourhood (2) where it has two shingles or more. order: of a band, each segment's place at both levels; by default exact ones first."""
    first, second = order[band] if band in order else (np.arange(segments(band)), segments(band) + np.arange(segments(band)))
    more = np.nonzero(size > 1)[0]
    return np.concatenate([first[own], second[own[more]]]), np.concatenate([np.arange(len(own)), more]), np.concatenate([np.ones(len(own), np.int8), np.full(len(more), 2, np.int8)])


def signatures(s: np.ndarray, order: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The signatures that a set is indexed under: those of its first H + 1 units."""
    out = []
    for band, most in roles(len(s)):
        seg, m, own, total = segment_sums(s, band)
        at = np.searchsorted(own, seg)
        place, which, level = _units(own, np.bincount(at), band, order)
        if len(place) > most:
            taken = np.argpartition(place, most)[: most + 1] if len(place) > most + 1 else np.arange(len(place))
            exact = which[taken[level[taken] == 1]]
            out.append(_sign(own[exact], total[exact], band))
            deep = np.zeros(len(own), bool)
            deep[which[taken[level[taken] == 2]]] = True
            k = np.nonzero(deep[at])[0]
            if len(k):
                out.append(_sign(seg[k], total[at[k]] - m[k], band))
            continue
        every = np.zeros(segments(band), np.uint64)
        every[own] = total
        out.append(_sign(np.arange(len(every)), every, band))
        out.append(_sign(seg, every[seg] - m, band))
        if 2 * len(own) <= most:
            raise ValueError("too few segments; a set of so few cells has no guarantee")
    return np.unique(np.concatenate(out))


class Costs:
    """Of each segment of a band: sets that have it, pairs that have it equal, sets with two shingles or more there, their neighbours, and pairs that only these bring together. Pairs are counted among CHUNK sets at a time."""

    def __init__(self) -> None:
        self.held: dict[int, list] = {}
        self.n, self.chunks, self.sums = 0, 0, {}

    def add(self, s: np.ndarray) -> None:
        for band, _ in roles(len(s)):
            self.held.setdefault(band, []).append(segment_sums(s, band))
        self.n += 1
        if self.n == CHUNK:
            self.flush()

    def flush(self) -> None:
        for band, sets in self.held.items():
            out = self.sums.setdefault(band, np.zeros((5, segments(band))))
            own, total = (np.concatenate([x[k] for x in sets]) for k in (2, 3))
            size = np.concatenate([np.bincount(np.searchsorted(x[2], x[0])) for x in sets])
            seg, less = np.concatenate([x[0] for x in sets]), np.repeat(total, size) - np.concatenate([x[1] for x in sets])
            more = np.repeat(size > 1, size)
            out[0] += np.bincount(own, minlength=out.shape[1])
            out[1] += self._pairs(own, _sign(own, total, band), out.shape[1])
            out[2] += np.bincount(own[size > 1], minlength=out.shape[1])
            out[3] += np.bincount(seg[more], minlength=out.shape[1])
            both = self._pairs(np.concatenate([own, seg[more]]), np.concatenate([_sign(own, total, band), _sign(seg[more], less[more], band)]), out.shape[1])
            out[4] += both - self._pairs(own, _sign(own, total, band), out.shape[1])
        self.chunks += bool(self.n)
        self.held, self.n = {}, 0

    @staticmethod
    def _pairs(seg: np.ndarray, sig: np.ndarray, n: int) -> np.ndarray:
        order = np.argsort(sig, kind="stable")
        sig, seg = sig[order], seg[order]
        at = np.nonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))[0]
        count = np.diff(np.append(at, len(sig))).astype(float)
        return np.bincount(seg[at], weights=count * (count - 1) / 2, minlength=n)


def allocation(sums: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a band's units in order of cost for each set that gains one; a neighbourhood never comes before its segment, and ties go by level and segment."""
    held, pairs, deep, near, more = sums
    exact = 1 + PAIR * chunks * pairs / np.maximum(held, 1)
    second = np.maximum(exact, (near + PAIR * chunks * more) / np.maximum(deep, 1))
    n = len(exact)
    order = np.lexsort((np.arange(2 * n), np.round(np.concatenate([exact, second]), 6)))
    place = np.empty(2 * n, np.int64)
    place[order] = np.arange(2 * n)
    return place[:n], place[n:]


def _classes(docs: DataFrame, bits: int) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Members (d, th, n, cls, chk, s0..s3) of all rows, and each band's units in order of cost."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        costs = Costs()
        empty = np.zeros(4, np.int64)
        for b in batches:
            out = []
            for d, th, s in zip(b["d"], b["th"], shingle_sets(b["t"].tolist())):
                cls, chk = name_of(s, bits=bits)
                out.append((0, d, th, len(s), cls, chk, *(sketch(s) if len(s) else empty), 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0))
                if len(s) and cls not in seen:
                    seen.add(cls)
                    costs.add(s)
            yield pd.DataFrame(out, columns=cols).astype({"d": "Int64"})
        costs.flush()
        for band, sums in costs.sums.items():
            seg = np.nonzero(sums[0])[0]
            yield pd.DataFrame({"kind": 1, "d": pd.array([None] * len(seg), "Int64"), **dict.fromkeys(cols[2:10], 0), "band": band, "seg": seg, **{f"c{k}": sums[k][seg] for k in range(5)}})
        if costs.chunks:
            yield pd.DataFrame({"kind": [2], "d": pd.array([None], "Int64"), **dict.fromkeys(cols[2:10], 0), "band": 0, "seg": costs.chunks, **{f"c{k}": 0.0 for k in range(5)}})

    cols = ["kind", "d", "th", "n", "cls", "chk", "s0", "s1", "s2", "s3", "band", "seg", "c0", "c1", "c2", "c3", "c4"]
    schema = "kind int, d long, th long, n long, cls long, chk long, s0 long, s1 long, s2 long, s3 long, band int, seg int, c0 double, c1 double, c2 double, c3 double, c4 double"
    all_ = stored(docs.select("d", "th", "t").mapInPandas(rows, schema), "classes")
    # a row a segment: bounded by the longest text, not by the number of texts
    chunks = all_.where("kind = 2").agg(F.sum("seg")).first()[0] or 0
    sums: dict[int, np.ndarray] = {}
    for r in all_.where("kind = 1").groupBy("band", "seg").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(5)]).collect():
        sums.setdefault(r["band"], np.zeros((5, segments(r["band"]))))[:, r["seg"]] = [r[f"c{k}"] for k in range(5)]
    rank = {band: allocation(x, chunks) for band, x in sums.items()}
    return all_.where("kind = 0").drop("kind", "band", "seg", "c0", "c1", "c2", "c3", "c4"), rank


def _buckets(docs: DataFrame, rank: dict[int, tuple[np.ndarray, np.ndarray]], parts: int, name) -> DataFrame:
    """(sig, cls) of the signatures that several classes share."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            sigs, owners = [], []
            for s in shingle_sets(b["t"].tolist()):
                if len(s) and (cls := name(s)[0]) not in seen:
                    seen.add(cls)
                    sigs.append(signatures(s, rank))
                    owners.append(np.full(len(sigs[-1]), cls, np.int64))
            if sigs:
                yield pd.DataFrame({"sig": np.concatenate(sigs), "cls": np.concatenate(owners)})

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by (sig, cls): a row stays if a neighbour has its sig and another class
        held = None
        for b in batches:
            x = np.stack([b["sig"].to_numpy(), b["cls"].to_numpy()])
            if not x.shape[1]:
                continue
            if held is not None:
                x = np.concatenate([held, x], axis=1)
            x = x[:, np.concatenate([[True], (x[:, 1:] != x[:, :-1]).any(axis=0)])]
            same = x[0, 1:] == x[0, :-1]
            stay = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            # the last row waits for what follows; rows carried over are not given twice
            old = 0 if held is None else held.shape[1] - 1
            give = stay.copy()
            give[:old] = False
            give[-1] = False
            if give.any():
                yield pd.DataFrame({"sig": x[0, give], "cls": x[1, give]})
            held = x[:, -2:]
        if held is not None and held.shape[1] == 2 and held[0, 0] == held[0, 1]:
            yield pd.DataFrame({"sig": held[0, 1:], "cls": held[1, 1:]})

    sigs = docs.select("t").mapInPandas(sign, "sig long, cls long")
    return stored(sigs.repartition(parts, "sig").sortWithinPartitions("sig", "cls").mapInPandas(shared, "sig long, cls long"), "buckets")


def _near(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Pairs that size and sketch leave possible. a, b: sketches, a row each."""
    ok = (10 * np.minimum(na, nb) >= 8 * np.maximum(na, nb)).nonzero()[0]
    out = np.zeros(len(na), bool)
    for i in range(0, len(ok), 65536):
        k = ok[i : i + 65536]
        gap = np.abs(a[k].view(np.uint8).astype(np.int16) - b[k].view(np.uint8)).sum(axis=1)
        out[k] = 9 * gap <= na[k] + nb[k]
    return out


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct (a, b) with both ends' sizes and sketches near enough."""
    part = lambda x: classes.select(F.col("cls").alias(x), F.struct("n", "s0", "s1", "s2", "s3").alias(f"m{x}"))
    j = pairs.distinct().join(part("a"), "a").join(part("b"), "b").select("a", "b", *[F.col(f"m{x}.{k}").alias(f"{k}{x}") for x in "ab" for k in ("n", "s0", "s1", "s2", "s3")])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            side = lambda x, f=f: np.ascontiguousarray(f[[f"s{k}{x}" for k in range(4)]].to_numpy())
            yield f.loc[_near(side("a"), side("b"), f["na"].to_numpy(), f["nb"].to_numpy()), ["a", "b"]]

    return j.mapInPandas(keep, "a long, b long")


def _both(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    # only sets that an end of a pair needs are shuffled where the pairs are few enough for Spark to send them along
    side = lambda x, n, v: sets.select(F.col("cls").alias(x), F.col("n").alias(n), F.col(what).alias(v)).join(pairs.select(x), x, "left_semi")
    return pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets link; a wide sketch spares most others the shipping of their sets."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            gaps = [int(np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8)).sum()) for x, y in zip(f["x"], f["y"])]
            yield f.loc[9 * np.array(gaps, np.int64) <= (f["na"] + f["nb"]).to_numpy(), ["a", "b"]]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            ok = []
            for x, y in zip(f["x"], f["y"]):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= 80 * (len(both) - common))
            yield f.loc[np.array(ok, bool), ["a", "b"]]

    left = stored(_both(pairs, sets, "wide").mapInPandas(near, "a long, b long"), "near-pairs")
    out = stored(_both(left, sets, "set").mapInPandas(check, "a long, b long"), "links")
    discard(left)
    return out


def _in_blocks(rows: DataFrame, parts: int, compare, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """compare() over the rows of each bucket together; large buckets are dealt out in pairs of blocks, none over 2 * BLOCK rows. more: columns besides."""
    size = rows.groupBy("sig").agg(F.count("*").alias("c"))
    k = F.ceil(F.col("c") / BLOCK).cast("int")
    r = rows.join(size, "sig").withColumn("k", k).withColumn("i", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    r = r.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("sig", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "cls", "comp", "n", "s0", "s1", "s2", "s3", *more)

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in batches:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            key = f[["sig", "lo", "hi"]].to_numpy()
            last = int(np.nonzero((key != key[-1]).any(axis=1))[0].max(initial=-1)) + 1
            held = f.iloc[last:]
            if last:
                yield compare(f.iloc[:last])
        if held is not None and len(held):
            yield compare(held)

    return r.repartition(parts, "sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi").mapInPandas(groups, schema)


def _arrays(f: pd.DataFrame):
    key = f[["sig", "lo", "hi"]].to_numpy()
    new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
    cross = key[:, 1] != key[:, 2]
    return key[:, 0], np.cumsum(new), cross, f["i"].to_numpy(), f["cls"].to_numpy(), f["comp"].to_numpy(), f["n"].to_numpy(), np.ascontiguousarray(f[["s0", "s1", "s2", "s3"]].to_numpy())


def _with_mates(rows: DataFrame, parts: int) -> DataFrame:
    """The rows whose class has a class of near enough size and sketch in the same bucket; the others link with none there."""

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        sig, group, _, _, cls, _, n, s = _arrays(f)
        met, x, d = np.zeros(len(f), bool), np.arange(len(f)), 1
        while len(x := x[x + d < len(f)]) and len(x := x[group[x] == group[x + d]]):
            a = x[~(met[x] & met[x + d])]
            a = a[(cls[a] != cls[a + d])]
            a = a[_near(s[a], s[a + d], n[a], n[a + d])]
            met[a] = met[a + d] = True
            d += 1
        return pd.DataFrame({"sig": sig[met], "cls": cls[met]})

    return stored(_in_blocks(rows, parts, compare, "sig long, cls long").distinct(), "mates")


def _block_pairs(rows: DataFrame, parts: int, mids: DataFrame | None = None) -> DataFrame:
    """Possible pairs of different components in a bucket.

    Buckets with the same leader are searched together, so a pair that meets
    in many of them comes up once; marks of a class's buckets (256 bits) keep
    apart most that share none. Pairs that share a signature of a smaller
    leader are left to that leader's group. mids: (cls, mid), a finer sketch that few pairs
    without a link pass; None: pairs go by the rows' own sketch alone.
    """
    marks = ("m0", "m1", "m2", "m3")
    lead = rows.groupBy("sig").agg(F.min(F.struct("comp", F.col("cls").alias("lead"))).alias("l"))
    cell = F.pmod(F.xxhash64("sig"), F.lit(256)).cast("int")
    bit = [F.bit_or(F.when(F.floor(cell / 64) == k, F.expr("shiftleft(1L, cast(pmod(xxhash64(sig), 64) as int))")).otherwise(F.lit(0).cast("long"))).alias(m) for k, m in enumerate(marks)]
    whole = rows.join(lead, "sig").groupBy(F.col("l.lead").alias("to"), "cls").agg(*[F.min(c).alias(c) for c in ("comp", "n", "s0", "s1", "s2", "s3")], *bit)
    mine = rows.join(lead, "sig").groupBy("cls").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.col("l.lead").alias("to"), "sig"))), 1, MET).alias("mine"))
    whole = whole.join(mine, "cls").withColumn("met", F.expr("transform(filter(mine, x -> x.to < to), x -> x.sig)")).drop("mine").withColumnRenamed("to", "sig")
    fine = mids is not None
    if fine:
        whole = whole.join(mids, "cls")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        _, group, cross, i, cls, comp, n, s = _arrays(f)
        met = f[list(marks)].to_numpy()
        mets, sets = f["met"].to_numpy(), {}

        def before(k: int) -> frozenset:
            if k not in sets:
                sets[k] = frozenset(mets[k].tolist())
            return sets[k]

        mid = np.frombuffer(b"".join(f["mid"]), np.uint8).reshape(-1, MID) if fine else None
        got, x, d = [np.empty((0, 2), np.int64)], np.arange(len(f)), 1
        while len(x := x[x + d < len(f)]) and len(x := x[group[x] == group[x + d]]):
            a = x[(comp[x] != comp[x + d]) & ~(cross[x] & (i[x] == i[x + d]))]
            a = a[(met[a] & met[a + d]).any(axis=1)]
            a = a[_near(s[a], s[a + d], n[a], n[a + d])]
            if fine:
                gap = np.abs(mid[a].astype(np.int16) - mid[a + d]).sum(axis=1)
                a = a[9 * gap <= n[a] + n[a + d]]
            a = a[np.array([before(k).isdisjoint(before(k + d)) for k in a.tolist()], bool)]
            got.append(np.stack([np.minimum(cls[a], cls[a + d]), np.maximum(cls[a], cls[a + d])], axis=1))
            d += 1
        p = np.unique(np.concatenate(got), axis=0)
        return pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})

    return _in_blocks(whole, parts, compare, "a long, b long", (*marks, "met", "mid") if fine else (*marks, "met")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id, cls): a row for each row of docs.

    component_id is the smallest doc_id reachable by links, itself included;
    null ids are passed over as smallest. Null or wordless texts have no
    shingles, link with nothing and are their own component. Rows that repeat
    an id are members each by their own text.
    """
    return _grouped(docs, doc_id, text, bits).select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("comp").alias("cls"))


def _grouped(docs: DataFrame, doc_id: str, text: str, bits: int = 64) -> DataFrame:
    """(d, th, n, least, first, comp): near_duplicates() with the text's hash and, of a component with shingles, the (no id, d, th) that is its first."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = partitions(spark)
    t = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    members, rank = _classes(t, bits)

    def class_table(members: DataFrame) -> DataFrame:
        return stored(members.where("n > 0").groupBy("cls").agg(F.min(F.struct("d", "th")).alias("holder"), *[F.min(c).alias(c) for c in ("n", "s0", "s1", "s2", "s3")], F.min("chk").alias("chk"), F.max("chk").alias("chk2")), "class-table")

    classes = class_table(members)
    # names that different sets have: n*n/2^65 of n sets, so three of ten billion
    taken = frozenset(r[0] for r in classes.where("chk <> chk2").select("cls").collect())
    if taken:
        members = members.withColumn("cls", F.when(F.col("cls").isin(list(taken)), F.col("chk")).otherwise(F.col("cls")))
        classes = class_table(members)
        if classes.where("chk <> chk2").limit(1).count():
            raise RuntimeError("two different sets have the same name in both halves")
    name = functools.partial(name_of, taken=taken, bits=bits)
    marks = classes.drop("holder", "chk", "chk2")
    signed = _buckets(t, rank, parts, name)
    buckets = _with_mates(signed.join(marks, "cls").withColumn("comp", F.col("cls")), parts)
    discard(signed)
    release(spark)
    met = buckets.select("cls").distinct().join(classes, "cls").select("cls", "holder.d", "holder.th")
    # texts of classes that share a signature; ids that are null are matched by the text's hash alone;
    # repeated rows go where the join by k put them, before texts become sets, so that no set is shuffled
    fetch = t.withColumn("k", F.coalesce("d", "th")).join(met.select(F.coalesce("d", "th").alias("k"), F.col("th").alias("th2"), "cls"), "k").where("th = th2").select("k", "th", "cls", "t")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(c, s) for c, s in zip(b["cls"], shingle_sets(b["t"].tolist())) if name(s)[0] == c]
            wide = [np.minimum(np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=1024), 255).astype(np.uint8).tobytes() for _, s in found]
            mid = [np.minimum(np.bincount((s >> np.uint64(65 - MID.bit_length())).astype(np.int64), minlength=MID), 255).astype(np.uint8).tobytes() for _, s in found]
            yield pd.DataFrame({"cls": [c for c, _ in found], "n": [len(s) for _, s in found], "mid": mid, "wide": wide, "set": [s.tobytes() for _, s in found]}).astype({"cls": "int64", "n": "int64"})

    sets_df = stored(fetch.dropDuplicates().select("cls", "t").mapInPandas(sets, "cls long, n long, mid binary, wide binary, set binary"), "sets")
    release(spark)
    rows = buckets.withColumn("comp", F.col("cls"))
    links = tried = None
    for _ in range(STAR_ROUNDS):
        # each class tries the leader that it shares most buckets with, of those not tried
        lead = rows.groupBy("sig").agg(F.min(F.struct("comp", F.col("cls").alias("lead"))).alias("l"))
        pairs = rows.join(lead, "sig").where("comp <> l.comp").groupBy("cls", F.col("l.lead").alias("lead")).count()
        if tried is not None:
            pairs = pairs.join(tried, ["cls", "lead"], "left_anti")
        best = stored(pairs.groupBy("cls").agg(F.max(F.struct("count", "lead")).alias("best")).select("cls", "best.lead"), "star-pairs")
        tried = best if tried is None else tried.unionByName(best)
        found = _verified(_possible(best.select(F.col("cls").alias("a"), F.col("lead").alias("b")), classes), sets_df)
        links = found if links is None else links.unionByName(found)
        release(spark)
        comp = components(links, "a", "b")
        named = buckets.join(comp, buckets["cls"] == comp["node"], "left").select("sig", "cls", F.coalesce("component", "cls").alias("comp"))
        open_ = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
        rows = stored(named.join(open_, "sig"), "open-buckets")
        release(spark)
        if not rows.limit(1).count() or not found.limit(1).count():
            break
    if rows.limit(1).count():
        pairs = _block_pairs(rows.join(marks, "cls"), parts, sets_df.select("cls", "mid"))
        done = tried.select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b"))
        links = links.unionByName(_verified(stored(pairs.join(done, ["a", "b"], "left_anti"), "block-pairs"), sets_df))
        release(spark)
        comp = components(links, "a", "b")
    named = members.join(comp, members["cls"] == comp["node"], "left").select("d", "th", "n", "cls", F.coalesce("component", "cls").alias("comp"))
    least = named.where("n > 0").groupBy("comp").agg(F.min("d").alias("least"), F.min(F.struct(F.col("d").isNull().alias("no"), "d", "th")).alias("first"))
    some = named.where("n > 0").join(least, "comp").select("d", "th", "n", "least", "first", "comp")
    none = named.where("n = 0").select("d", "th", "n", F.col("d").alias("least"), F.lit(None).cast(some.schema["first"].dataType).alias("first"), "comp")
    return some.unionByName(none)


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: of its smallest doc_id, then of the smallest hash of a text; the rest are near copies of those.

    Rows without an id come last. Of rows that repeat both id and text any one
    stays. Rows without shingles all stay.
    """
    rows = stored(_grouped(docs, "doc_id", "text").where("n > 0").select("d", "th", (~(F.col("first.d").eqNullSafe(F.col("d")) & (F.col("first.th") == F.col("th")))).alias("held")), "grouped")
    keys = docs.withColumns({"__d": F.col("doc_id").cast("long"), "__th": F.xxhash64(F.coalesce("text", F.lit("")))})

    def at(x: DataFrame, how: str, frame: DataFrame) -> DataFrame:
        y = x.select(F.col("d").alias("__d2"), F.col("th").alias("__th2"))
        return frame.join(y, F.col("__d").eqNullSafe(F.col("__d2")) & (F.col("__th") == F.col("__th2")), how)

    left = at(rows.where("held").distinct(), "left_anti", keys)
    again = rows.where("not held").groupBy("d", "th").count().where("count > 1")
    if again.limit(1).count():
        left = at(again, "left_anti", left).unionByName(at(again, "left_semi", left).dropDuplicates(["__d", "__th"]))
    return left.select(*docs.columns)
