"""Benchmark decontamination by winnowing (native).

Every 10-word window of an item or document is represented by the smallest
hash among its 5-word grams (a gram of 5 in a window of 6 grams), so any
shared span of 10 words shares a fingerprint. Fingerprint hits are extended to
the windows around them, which are compared as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, stored

WINDOW, GRAM = 10, 5
#: Characters that part words; digits, letters and all beyond ASCII are words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most fingerprints that are sent along as a hash set in the plan; with more, they are joined.
SET_BOUND = 20_000

_CAND = "array<struct<pos:int,end:int,win:string>>"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP, -1), "")


def _runs_of(n: int):
    """Every run of n words with its hash; a function of the words alone, as higher-order functions count arguments."""

    def runs(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.xxhash64(F.lit(n), F.slice(w, i + 1, n)).alias("fp")))

    return runs


def fingerprints(words: Column, lengths: list[int]) -> Column:
    """array<struct<pos,len,fp>>: one for each 10-word window, and for each shorter run of the given lengths."""
    empty = F.array().cast("array<struct<pos:int,len:int,fp:bigint>>")

    def long_ones(w):
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*[w[i + j] for j in range(GRAM)]))
        least = lambda h, i: F.least(*[h[i + j] for j in range(WINDOW - GRAM + 1)])
        return let(grams, lambda h: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(i.alias("pos"), F.lit(WINDOW).alias("len"), least(h, i).alias("fp"))))

    parts = [F.when(F.size(words) >= WINDOW, let(words, long_ones)).otherwise(empty)]
    for n in lengths:
        parts.append(F.when(F.size(words) >= n, let(words, _runs_of(n))).otherwise(empty))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def item_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, win, len, fp), distinct; an item of under 10 words is one window; null or wordless items have none."""
    w = items.select(F.col(item).alias("item"), item_words(F.col(text)).alias("w"))
    n = F.size("w")
    whole = F.array(F.struct(F.lit(0).alias("pos"), n.alias("len"), F.xxhash64(n, F.col("w")).alias("fp")))
    f = w.where(n > 0).select("item", "w", F.explode(F.when(n < WINDOW, whole).otherwise(fingerprints(F.col("w"), []))).alias("f"))
    return f.select("item", F.concat_ws(" ", F.slice("w", F.col("f.pos") + 1, F.col("f.len"))).alias("win"), F.col("f.len").alias("len"), F.col("f.fp").alias("fp")).distinct()


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", carry: list[str] | None = None, set_bound: int = SET_BOUND) -> DataFrame:
    """One row for each row of docs: the carried columns, n_words, n_hit, n_items, items_sha256, contaminated.

    Null text has no words. Rows are judged one by one, so repeated rows and
    null or tied ids give a row each. Without items nothing is hit. Carried
    columns (default doc_id) are kept apart in a struct, so that their names
    may be any; a carried column named as a result gives way to the result.
    """
    carry = carry or ["doc_id"]
    wins = stored(item_windows(items, item, item_text), "windows")
    lengths = sorted(r[0] for r in wins.where(F.col("len") < WINDOW).select("len").distinct().collect())
    marks = wins.select("fp").distinct()
    n_marks = marks.count()
    base = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), item_words(F.col(text)).alias("w"), F.monotonically_increasing_id().alias("nr"))
    pick = lambda w, found: F.transform(found, lambda f: F.struct(f["pos"].alias("pos"), (f["pos"] + f["len"]).alias("end"), F.concat_ws(" ", F.slice(w, f["pos"] + 1, f["len"])).alias("win")))
    if n_marks <= set_bound:
        known = [r[0] for r in marks.collect()]
        cand = let(F.col("w"), lambda w: pick(w, F.filter(fingerprints(w, lengths), lambda f: f["fp"].isin(known)))) if known else F.array().cast(_CAND)
    else:
        base = stored(base, "words")
        met = base.select("nr", F.explode(fingerprints(F.col("w"), lengths)).alias("f")).join(marks, F.col("f.fp") == F.col("fp")).groupBy("nr").agg(F.collect_list("f").alias("found"))
        base = base.join(met, "nr", "left")
        cand = F.when(F.col("found").isNull(), F.array().cast(_CAND)).otherwise(let(F.col("w"), lambda w: pick(w, F.array_sort("found"))))
    # texts with the same candidate windows are looked up once, however many share a passage
    shared = F.sha2(F.array_join(F.array_sort(F.array_distinct(F.transform("cand", lambda c: c["win"]))), "\n"), 256)
    seen = stored(base.select("row", F.size("w").cast("long").alias("n_words"), cand.alias("cand")).withColumn("shared", F.when(F.size("cand") > 0, shared)), "candidates")
    some = seen.where(F.col("shared").isNotNull())
    distinct = F.array_distinct(F.transform("cand", lambda c: c["win"]))
    found = (
        some.select("shared", distinct.alias("ws")).dropDuplicates(["shared"])
        .select("shared", F.explode("ws").alias("win")).join(wins.select("win", F.col("item").cast("string").alias("item")), "win")
        .groupBy("shared").agg(F.collect_set("win").alias("ok"), F.array_sort(F.collect_set("item")).alias("names"))
    )
    # candidates are compared with the shorter list, of true or of false ones: in a text that is an item from end to end, false ones are few
    cand = F.col("cand")
    true_ones = let(
        F.array_except(distinct, F.col("ok")),
        lambda bad: F.when(F.size(bad) <= F.size("ok"), F.filter(cand, lambda c: ~F.array_contains(bad, c["win"]))).otherwise(F.filter(cand, lambda c: F.array_contains(F.col("ok"), c["win"]))),
    )
    hits = F.array_sort(F.transform(true_ones, lambda c: F.struct(c["pos"], c["end"])))
    covered = F.aggregate(
        hits,
        F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, c: F.struct(F.greatest(s["last"], c["end"]).alias("last"), (s["n"] + F.greatest(F.lit(0), c["end"] - F.greatest(s["last"], c["pos"]))).alias("n")),
        lambda s: s["n"],
    )
    names = F.coalesce(F.col("names"), F.array().cast("array<string>"))
    held = some.join(found, "shared", "left").select("row", "n_words", F.when(F.col("ok").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_hit"), names.alias("names"))
    rest = seen.where(F.col("shared").isNull()).select("row", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("names"))
    results = {"n_words": F.col("n_words"), "n_hit": F.col("n_hit"), "n_items": F.size("names").cast("long"), "items_sha256": F.sha2(F.array_join("names", ","), 256), "contaminated": F.col("n_hit") > 0}
    return held.unionByName(rest).select(*[F.col("row")[c].alias(c) for c in carry if c not in results], *[v.alias(k) for k, v in results.items()])


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with their columns as they were.

    Null and empty texts stay, as they have no words. Rows are judged one by
    one: repeated rows, and rows with tied or null ids, all stay or all go.
    """
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col("text").alias("text"))
    return contamination(own, items, carry=["own"]).where(~F.col("contaminated")).select("own.*")
