"""URL filter: longest matching rule, else boosted trees over lexical features (native).

The trees learn from the URLs that a rule decides. Suffix statistics are shares
of blocked URLs by the host's suffix, by the path's first label, and by both,
counted over all rows; a labelled URL is given the counts of the other folds
only, so no share contains its own label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import MAX_ROWS, Boosted, fit
from .common import lower_ascii, stored

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Shares of blocked URLs: what each is counted by, and the shares whose mean stands for it where it has few labelled URLs.
SHARES = {"block": (["one"], []), "suffix_block": (["one", "suffix"], ["block"]), "lead_block": (["one", "lead"], ["block"]), "pair_block": (["one", "suffix", "lead"], ["suffix_block", "lead_block"])}
#: Labelled URLs that the stand-in counts for.
PRIOR = 4
FEATURES = ["length", "depth", "digit_share", "digits", "first_digit", "entropy", "params", "host_labels", "host_length", "suffix_block", "lead_block", "pair_block"]
#: Trees read a share as more or less than even, so that a suffix without labels is not taken for one of those with.
CUTS = {k: [0.5] for k in SHARES}
#: Folds of the labelled URLs; the last is never fitted on.
FOLDS = 5
#: Rows of one (suffix, lead) that go to a task together, about; a row of the statistics is repeated for each salt, of which there are SALTS at least.
ROWS_A_TASK, SALTS = 200_000, 16


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// in lower case, path up to ? or #; both empty without ://."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    ok = F.coalesce(at > 0, F.lit(False))
    return F.when(ok, host).otherwise(""), F.when(ok, path).otherwise("")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits (host and path together; ties by host); null without one."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def row_hash(pages: DataFrame) -> Column:
    """A hash of all columns of a row that Spark can hash: maps and variants have none."""
    return F.xxhash64(*[c for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind])


def features(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule, ruled, the row's hash (mark) and the lexical features (all but the suffix statistic)."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = split_url(F.col(url))
    a = pages.withColumns({"host": host, "path": path} | ({} if "mark" in pages.columns else {"mark": row_hash(pages)}))
    rule, verdict = rule_for(F.col("host"), F.col("path"))
    n = F.greatest(F.length(u), F.lit(1))
    sorted_chars = F.array_sort(F.split(u, ""))
    # runs of equal characters in the sorted URL give the counts for the entropy
    runs = F.regexp_extract_all(F.array_join(sorted_chars, ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    entropy = F.aggregate(runs, F.lit(0.0), lambda s, r: s - F.length(r) / n * F.log2(F.length(r) / n))
    return a.withColumns({
        "rule": rule, "ruled": verdict,
        "length": F.length(u).cast("double"),
        "depth": F.length(F.regexp_replace("path", "[^/]+", "")).cast("double"),
        "digit_share": F.length(F.regexp_replace(u, "[^0-9]+", "")) / n,
        "entropy": F.round(entropy, 6),
        "params": F.length(F.regexp_replace(F.regexp_extract(u, r"\?([^#]*)", 1), "[^=]+", "")).cast("double"),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "host_length": F.length("host").cast("double"),
        "digits": F.length(F.regexp_replace("path", "[^0-9]+", "")).cast("double"),
        "first_digit": F.coalesce(F.nullif(F.regexp_extract("path", "[0-9]", 0), F.lit("")).cast("double"), F.lit(-1.0)),
        "suffix": F.substring_index("host", ".", -1),
        "lead": F.coalesce(F.regexp_extract("path", "^/([^/]*)/", 1), F.lit("")),
        "fold": F.when(verdict.isNotNull(), F.pmod(F.xxhash64(u), F.lit(FOLDS)).cast("int")).otherwise(-1),
    })


def suffix_statistics(f: DataFrame) -> tuple[DataFrame, int]:
    """(suffix, lead, fold, the shares): blocked among the ruled URLs outside the fold; fold -1 counts all. Beside it the most rows of one of them.

    A row for each suffix and lead that occurs, ruled or not, and each fold:
    counts by both are combined before the shuffle, and the coarser ones are
    sums of those.
    """
    pair = stored(f.groupBy("suffix", "lead", "fold").agg(F.count("*").alias("rows"), F.count("ruled").alias("n"), F.count_if(F.col("ruled") == "block").alias("b")).withColumn("one", F.lit(1)), "suffix-counts")
    cells = pair.select("one", "suffix", "lead").distinct().withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(-1, FOLDS)])))
    for name, (by, coarser) in SHARES.items():
        own = pair.groupBy(*by, "fold").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        whole = own.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
        cells = cells.join(own, [*by, "fold"], "left").join(whole, by)
        rest = lambda c: F.col(f"all_{c}") - F.when(F.col("fold") >= 0, F.coalesce(c, F.lit(0))).otherwise(0)
        prior = sum(F.col(c) for c in coarser) / len(coarser) if coarser else F.lit(0.25)
        cells = cells.withColumn(name, F.round((rest("b") + PRIOR * prior) / (rest("n") + PRIOR), 6)).drop("n", "b", "all_n", "all_b")
    return cells.select("suffix", "lead", "fold", *SHARES), pair.agg(F.max("rows")).first()[0] or 0


def with_statistics(f: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """f with its suffix statistics. Both sides are salted by the rows of the commonest suffix and lead, so that one of them, be it a third of all rows, is spread over tasks."""
    table, most = suffix_statistics(f)
    salts = max(SALTS, -(-most // rows_a_task))
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return f.withColumn("salt", F.pmod(F.xxhash64("mark", F.lit("salt")), F.lit(salts)).cast("int")).join(table, ["suffix", "lead", "fold", "salt"])


def _sample(f: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: block) of min(``bound``, rows of f) rows: those of smallest hash of the whole row, so always the same.

    A cut of the hash leaves about three times as many rows before they are
    sorted, so that few rows travel. Rows that repeat share a hash, so a cut
    may leave too few: it is widened until there are enough.
    """
    n, h = f.count(), F.col("mark")
    width = min(1.0, 3 * bound / max(n, 1))
    while True:
        cut = f if width >= 1 else f.where(h < F.lit(int(-(2**63) + width * 2**64)))
        rows = cut.select(h.alias("h"), *FEATURES, (F.col("ruled") == "block").cast("int").alias("y")).orderBy("h", *FEATURES, "y").limit(bound).collect()
        if width >= 1 or len(rows) == bound:
            return np.array([[float(r[k]) for k in FEATURES] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows])
        width = min(1.0, 8 * width)


def train(f: DataFrame, bound: int = MAX_ROWS) -> Boosted:
    """Trees fitted on at most ``bound`` URLs labelled by a rule, the last fold left out. The threshold is even odds."""
    x, y = _sample(f.where((F.col("fold") >= 0) & (F.col("fold") < FOLDS - 1)), bound)
    model = fit(x, y, FEATURES, rounds=20, cuts=CUTS)
    model.threshold = 0.0
    return model


def held_out(f: DataFrame, trees: Boosted, bound: int = MAX_ROWS) -> dict[str, float]:
    """Accuracy, that of the commoner answer, and precision and recall of block, on at most ``bound`` URLs of the fold that ``train`` leaves out."""
    x, y = _sample(f.where(F.col("fold") == FOLDS - 1), bound)
    said = trees.predict(x) > trees.threshold
    hit = float((said & (y == 1)).sum())
    return {"rows": len(y), "accuracy": float((said == (y == 1)).mean()), "majority": float(max(y.mean(), 1 - y.mean())), "precision": hit / max(1, said.sum()), "recall": hit / max(1, (y == 1).sum())}


def judge(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; columns of those names give way, other columns pass.

    Null URLs and such without :// have empty host and path and are judged by
    the trees like any other. Repeated rows and ties are judged each by
    itself; an empty table gives none.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    own = pages.select(F.struct(*keep).alias("own"), F.col(url).alias("url"), row_hash(pages).alias("mark"))
    f = with_statistics(features(own))
    trees = train(f)
    blocked = trees.column(F.col) > F.lit(trees.threshold)
    verdict = F.coalesce("ruled", F.when(blocked, "block").otherwise("allow"))
    return f.select("own.*", "host", "path", "rule", verdict.alias("verdict"))
