"""Quality rules: a threshold table compiled into one projection (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, words_of

#: Frequent words of the languages that the rules know.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "for", "that", "with", "on",
    "der", "die", "das", "und", "nicht", "mit", "ein", "den", "von", "zu",
    "le", "la", "les", "de", "et", "des", "un", "une", "que", "dans",
    "el", "los", "las", "y", "en", "por", "con", "una", "se", "del",
]

#: (name, measure, lowest kept, highest kept); null means no bound.
RULES = [
    ("word_length", "mean_word", 2.0, 14.0),
    ("symbols", "symbols_per_word", None, 0.5),
    ("dup_lines", "dup_line_share", None, 0.5),
    ("ellipsis", "ellipsis_share", None, 0.5),
    ("stop_words", "n_stop", 1, None),
]


def measures(text: Column) -> Column:
    """The counts of a text as one struct; null counts as empty.

    Only array functions that hash or sort are used, so cost stays near linear
    in the text. 3-word windows are hashed; only where hashes repeat are they
    sorted with their positions, and only repeated ones become strings, which
    decide. Everything
    is bound by ``let``, so that a filter pushed below repeats nothing.
    """

    def counts(t, w, lines, g, at):
        # a window adds three words, less those that the window before it covers
        covered = F.aggregate(
            at,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
            lambda s: s["n"],
        )
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, WS + "+", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        )

    def windows(w):
        """Hashes of the 3-word windows."""
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(F.size(w) >= 3, grams).otherwise(F.array().cast("array<bigint>"))

    def repeats(w, g):
        """Sorted positions of the windows that occur twice or more: those whose hash does, if their words do."""

        def twice(r):
            n = F.size(r)
            return F.filter(r, lambda s, k: ((k > 0) & (F.get(r, k - 1)["x"] == s["x"])) | ((k < n - 1) & (F.get(r, k + 1)["x"] == s["x"])))

        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        words = lambda s: F.struct(F.concat_ws(" ", w[s["i"]], w[s["i"] + 1], w[s["i"] + 2]).alias("x"), s["i"].alias("i"))
        exact = let(F.sort_array(F.transform(let(ranked, twice), words)), twice)
        at = F.sort_array(F.transform(exact, lambda s: s["i"]))
        return F.when(F.size(g) > F.size(F.array_distinct(g)), at).otherwise(F.array().cast("array<int>"))

    def of_text(t):
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(words_of(t), lambda w: let(lines, lambda ls: let(windows(w), lambda g: let(repeats(w, g), lambda at: counts(t, w, ls, g, at)))))

    return let(F.coalesce(text, F.lit("")), of_text)


def verdict(q: Column, rules=RULES) -> Column:
    """The threshold table as one boolean: every bound of every rule holds."""
    words, lines = F.greatest(q["n_words"], F.lit(1)), F.greatest(q["n_lines"], F.lit(1))
    of = {
        "mean_word": q["word_chars"] / words,
        "symbols_per_word": q["n_symbols"] / words,
        "dup_line_share": q["n_dup_lines"] / lines,
        "ellipsis_share": q["n_ellipsis"] / lines,
        "n_stop": q["n_stop"],
        "n_words": q["n_words"],
    }
    ok = F.lit(True)
    for _, m, low, high in rules:
        if low is not None:
            ok &= of[m] >= F.lit(low)
        if high is not None:
            ok &= of[m] <= F.lit(high)
    return ok


def quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with the counts, base_failed and kept; one row out for each row in.

    Null or empty text: all counts 0, base_failed true. Other columns pass
    unless they carry a name that this operator adds, which it replaces.
    """
    name = "_q"
    while name in map(str.lower, docs.columns):
        name += "_"
    q = F.col(name)
    out = docs.withColumn(name, measures(F.col(text))).withColumns({k: q[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")})
    return out.withColumns({"base_failed": base_failed(q), "kept": ~base_failed(q) & verdict(q, rules)}).drop(name)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they were.

    Null and empty texts go, as they have too few words. Rows are judged one
    by one: repeated rows, and rows with tied or null ids, all stay or all go.
    """
    return docs.where(let(measures(F.col("text")), lambda q: ~base_failed(q) & verdict(q)))
