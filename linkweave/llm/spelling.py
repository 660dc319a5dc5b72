"""Spelling variants: words within one edit of each other, and the commoner form that each goes by.

The index is one of positional q-grams (pairs of letters, the word padded at
both ends). One edit changes at most two of the pairs of a word, so two near
words share all but two of those of the longer one, at places that differ by
no more than their lengths do. The index is dealt out by parts: an edit lies in
one third of a word, so near words share the other two, and only words that do
are indexed together; the pairs within the shared parts need no counting. In a
group, the postings of a word's remaining pairs are merged through a heap,
words that come up too seldom are dropped, and the rest is compared.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, lower_ascii, measured, partitions, stored

#: Least code points of a word, least occurrences, and how many times commoner a form is.
LEAST, TWICE, TIMES = 7, 2, 10
#: One occurrence in so many is altered.
ALTERED = 31
#: Words of a group that one task indexes together; larger groups are dealt out in pairs of blocks.
BLOCK = 2048
PAD = "\0"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of words of LEAST code points or more that occur TWICE or more.

    Words are maximal runs of letters, A-Z lowered. An occurrence whose crc32
    with its document's id is a multiple of ALTERED loses a letter. Null texts
    have no words; a null id counts as an empty one.
    """
    run = F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(rf"[a-zÀ-ÿ]{{{LEAST},}}"), F.lit(0)))
    r = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), run.alias("run"))
    r = r.withColumn("h", F.crc32(F.concat(F.col("d"), F.lit(":"), F.col("run"))))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % ALTERED == 0, less).otherwise(F.col("run"))
    return r.select(word.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TWICE)


def thirds(m: int) -> tuple[int, int]:
    """Where the second and the third part of a word of m letters begin."""
    return m // 3, m // 3 + (m - m // 3) // 2


def keyed(words: DataFrame) -> DataFrame:
    """(key, m, kind, word, n): the groups of a word, as a word of length m and as one a letter longer. kind: 0, 1, 2 leave out the last, the middle, the first part."""
    l = F.length("word")
    a, b = F.expr("m div 3").cast("int"), F.expr("m div 3 + (m - m div 3) div 2").cast("int")
    w = words.withColumn("m", F.explode(F.array_compact(F.array(l, F.when(l > LEAST, l - 1)))))
    head = lambda n: F.substring(F.col("word"), F.lit(1), n)
    tail = lambda n: F.substring(F.col("word"), F.length("word") - n + 1, n)
    parts = [F.struct(head(b).alias("x"), F.lit("").alias("y")), F.struct(head(a).alias("x"), tail(F.col("m") - b).alias("y")), F.struct(F.lit("").alias("x"), tail(F.col("m") - a).alias("y"))]
    return w.select("word", "n", "m", F.posexplode(F.array(*parts)).alias("kind", "p")).select(F.xxhash64("m", "kind", "p.x", "p.y").alias("key"), "m", "kind", "word", "n")


def one_edit(s: str, t: str) -> bool:
    """t is s with one letter replaced or, if longer by one, inserted."""
    i = 0
    while i < len(s) and s[i] == t[i]:
        i += 1
    return s[i + 1 :] == t[i + 1 :] if len(s) == len(t) and i < len(s) else len(t) == len(s) + 1 and s[i:] == t[i + 1 :]


def near_in_group(words: list[str], m: int, kind: int, blocks: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Indexes of near words of lengths m and m, or m and m + 1, that do not share a group of an earlier kind. With ``blocks``, only of different blocks."""
    a, b = thirds(m)
    first, last = ((b, m), (a, b), (0, a))[kind]
    index: dict[tuple[int, str], list[int]] = defaultdict(list)

    def met_before(s: str, t: str) -> bool:
        return kind > 0 and s[:b] == t[:b] or kind > 1 and s[:a] == t[:a] and s[len(s) - m + b :] == t[len(t) - m + b :]

    def found(lists: list[list[int]], least: int, j: int) -> Iterator[tuple[int, int]]:
        if len(lists) < least:
            return
        t, held, count = words[j], -1, 0
        for i in heapq.merge(*lists) if len(lists) > 1 else lists[0]:
            count = count + 1 if i == held else 1
            held = i
            if count == least and (blocks is None or blocks[i] != blocks[j]) and one_edit(words[i], t) and not met_before(words[i], t):
                yield i, j

    # pair q of a padded word holds its letters q - 1 and q; those that touch the part left out are first..last
    for j, t in enumerate(words):
        if len(t) == m:
            p = PAD + t + PAD
            own = [(q, p[q : q + 2]) for q in range(first, last + 1)]
            yield from found([index[g] for g in own if g in index], max(1, last - first - 1), j)
            for g in own:
                index[g].append(j)
    for j, t in enumerate(words):
        if len(t) == m + 1 and index:
            p = PAD + t + PAD
            own = dict.fromkeys(g for q in range(first, last + 2) for g in ((q, p[q : q + 2]), (q - 1, p[q : q + 2])))
            yield from found([index[g] for g in own if g in index], last - first, j)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, other, other_n): all ordered pairs of near words of (word, n)."""
    spark = words.sparkSession
    bounded_batches(spark)
    rows = keyed(words)
    hot = stored(rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("k")), "hot-groups")
    r = rows.join(hot, "key", "left").withColumns({"k": F.coalesce("k", F.lit(1))}).withColumn("i", F.pmod(F.xxhash64("word"), F.col("k")).cast("int"))
    r = r.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("key", F.least("i", "o").alias("lo"), F.greatest("i", "o").alias("hi"), "i", "m", "kind", "word", "n")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "lo", "hi", "i", "m", "kind", "word", "n"]
        held = {k: [] for k in names}

        def groups(cols: dict[str, list], cut: np.ndarray) -> Iterator[pa.RecordBatch]:
            left, right, counts = [], [], []
            for at, to in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if to - at < 2:
                    continue
                w, n = cols["word"][at:to], cols["n"][at:to]
                for i, j in near_in_group(w, cols["m"][at], cols["kind"][at], cols["i"][at:to] if cols["lo"][at] != cols["hi"][at] else None):
                    left += (w[i], w[j])
                    right += (w[j], w[i])
                    counts += (n[j], n[i])
                if len(left) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(counts, pa.int64())], ["word", "other", "other_n"])
                    left, right, counts = [], [], []
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(counts, pa.int64())], ["word", "other", "other_n"])

        for b in batches:
            cols = {k: held[k] + b.column(k).to_pylist() for k in names}
            if not cols["key"]:
                continue
            key = np.array([cols[k] for k in ("key", "lo", "hi", "m", "kind")])
            cut = np.concatenate([[0], np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1])
            yield from groups(cols, cut)
            held = {k: v[cut[-1] :] for k, v in cols.items()}
        yield from groups(held, np.array([0, len(held["key"])]))

    return r.repartition(partitions(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "m", "kind").mapInArrow(search, "word string, other string, other_n long")


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root): the last form that a word leads to, of (word, form). A form is ten times as common as its word, so a chain ends; steps double each round."""
    r = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        on = r.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new, seen = measured(r.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")), "roots", n=F.count_if("went"))
        discard(r)
        r = new.drop("went")
        r.stored_path = new.stored_path
        if not seen["n"]:
            return r
    raise RuntimeError(f"forms still lead on after {rounds} rounds")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of the vocabulary.

    A word's form is its near word of largest n (then the first in code-point
    order) if that n is ten times its own; its root is where forms end, itself
    without one. Texts that are null, empty or without such words give no
    rows, as does an empty table; repeated rows count each. Other columns are
    not read.
    """
    words = stored(vocabulary(docs, doc_id, text), "vocabulary")
    best = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    near = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= TIMES * F.col("n"), -F.col("best.less")))
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "form_n"), "near")
    ends = roots(near.where(F.col("form").isNotNull()))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
