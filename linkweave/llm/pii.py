"""Personal data: candidate spans judged by boosted trees over format and context (native).

Four base kinds follow fixed patterns and stay whatever the trees say. High-
recall generators propose further, possibly overlapping spans (cards and phones
that a base pattern runs into their neighbour, phones without a country code
or in groups of digits, masked addresses, IPv6); trees fitted on generated labelled examples score
them, and a threshold calibrated for each kind selects those to redact.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import MAX_ROWS, Boosted, fit
from .common import joined, of_kind, spans

# The patterns of the contract, written so that Java neither recurses for long
# matches nor starts anew inside a run that has failed: a match may begin only
# at the start of its run or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
BASE_KINDS = ["email", "ip", "card", "phone"]

#: Generators of further candidates: kind, pattern, cheap necessary condition. A number's groups are parted by one sign throughout, so that a number does not run into its neighbour.
GENERATORS = [
    ("number", r"(?<![0-9A-Za-z.+-])(?:[0-9]{12,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4})(?![0-9A-Za-z]|[.,-][0-9])", r"[0-9][0-9 -]{10,}[0-9]"),
    (
        "phone_number",
        r"\+[0-9]{1,3}\x20?\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"  # country and area
        r"|(?<![0-9A-Za-z.+-])\([0-9]{3}\)\x20?[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])"  # area in brackets
        r"|(?<![0-9A-Za-z.+/-])[0-9]{2,4}([./-])[0-9]{2,4}(?:\1[0-9]{2,5}){1,2}(?![0-9A-Za-z]|[./-][0-9])",  # three or four groups
        r"[0-9][0-9 ()./-]{5,}[0-9]",
    ),
    (
        "masked_email",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?:\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]{2,64}){1,4}"
        r"|\x20(?:at|AT)\x20[A-Za-z0-9-]{1,64}(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]{2,64}){1,4})",  # in words
        r"[\[(] ?(?:at|AT) ?[\])]| (?:at|AT) [A-Za-z0-9-]{1,64} (?:dot|DOT) ",
    ),
    (
        "ipv6",
        r"(?<![0-9A-Za-z:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])",  # the second with a gap of zeros
        r":[0-9a-fA-F]{1,4}:[0-9a-fA-F]{1,4}:|[0-9a-fA-F]::[0-9a-fA-F]",
    ),
    ("spaced_phone", r"(?<![0-9A-Za-z.+/,:-])(?<![0-9]\x20)[0-9]{2,5}(?:\x20[0-9]{2,4}){2,4}(?![0-9A-Za-z]|[\x20.,:/-][0-9])", r"[0-9]{2} [0-9]{2,4} [0-9]{2}"),
]
KINDS = BASE_KINDS + [g[0] for g in GENERATORS]

#: Words before a span that speak for or against personal data.
FOR = r"(?i)(?<![A-Za-z])(phone|tel|mobile|call|fax|contact|card|visa|iban|account|ssn|mail|passport|address)[^A-Za-z]{0,6}$"
AGAINST = r"(?i)(?<![A-Za-z])(version|isbn|order|invoice|date|page|pages|rev|build|id|no|issue|chapter|year|since)[^A-Za-z]{0,6}$"
CONTEXT = 24
FEATURES = ["kind", "digits", "length", "groups", "luhn", "brackets", "dots", "slashes", "for", "against", "letters", "isodate", "ssn", "zero", "article"]
#: A word after "at" that begins a place and no address.
ARTICLE = r"(?i)\x20at\x20(?:the|a|an|this|that|one|each|every|any|its|my|our|your|their)\x20"
#: A year with month and day, either way round.
DATE = r"^(?:[12][0-9]{3}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][12][0-9]{3})$"


def luhn(digits: Column) -> Column:
    """Luhn's sum over a string of digits is divisible by ten."""
    ds = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(ds, F.lit(0), lambda a, x: a + x) % 10 == 0


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    n = lambda s: F.length(digits(s["hit"]))
    return {
        "email": spans(text, EMAIL, "email", F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, IP, "ip"), lambda s: s["hit"].rlike("^" + r"\.".join([PART] * 4) + "$")),
        "card": F.filter(spans(text, CARD, "card"), lambda s: n(s).between(14, 19) & F.when(n(s).between(14, 19), luhn(digits(s["hit"]))).otherwise(False)),
        "phone": F.filter(spans(text, PHONE, "phone", F.contains(text, F.lit("+"))), lambda s: n(s).between(10, 15)),
    }


def features(hit: Column, before: Column, kind: Column) -> dict[str, Column]:
    """Format and context features; ``_example_features`` is their model in Python, and a test holds them equal."""
    d = digits(hit)
    count = lambda p: F.length(F.regexp_replace(hit, f"[^{p}]", ""))
    long = F.length(d).between(12, 19)
    return {
        "kind": F.coalesce(*[F.when(kind == g[0], k) for k, g in enumerate(GENERATORS)], F.lit(-1)),
        "digits": F.length(d),
        "length": F.length(hit),
        "groups": F.size(F.split(hit, "[^0-9A-Za-z]+")),
        "luhn": (long & F.when(long, luhn(d)).otherwise(False)).cast("int"),
        "brackets": count(r"()\[\]"),
        "dots": count("."),
        "slashes": count("/"),
        "for": before.rlike(FOR).cast("int"),
        "against": before.rlike(AGAINST).cast("int"),
        "letters": count("A-Za-z"),
        "isodate": hit.rlike(DATE).cast("int"),
        "ssn": hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$").cast("int"),
        "zero": hit.rlike("^0[1-9]").cast("int"),
        "article": hit.rlike(ARTICLE).cast("int"),
    }


def _luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0) for i, c in enumerate(reversed(d))) % 10 == 0


def _example_features(kind: str, hit: str, before: str) -> list[float]:
    d = re.sub("[^0-9]", "", hit)
    count = lambda p: len(re.findall(f"[{p}]", hit))
    test = lambda p, t: int(bool(re.search(p, t)))
    return [
        [g[0] for g in GENERATORS].index(kind), len(d), len(hit), len(re.split("[^0-9A-Za-z]+", hit)), int(12 <= len(d) <= 19 and _luhn(d)), count(r"()\[\]"), count("."), count("/"),
        test(FOR, before), test(AGAINST, before), count("A-Za-z"), test(DATE, hit), test(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", hit),
        test("^0[1-9]", hit), test(ARTICLE, hit),
    ]


def examples(rows: int = 3000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(kind, candidate, text before, personal or not): generated, at most MAX_ROWS; one in fifty labels is turned, as in any labelled set."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    plain = ["the report of ", "und dann ", "les amis de ", "en la casa ", "we saw "]
    good = ["call ", "phone: ", "Tel. ", "fax ", "contact: ", "mobile "]
    bad = ["version ", "order ", "ISBN ", "invoice no. ", "pages ", "build "]

    def card():
        d = num(15)
        return next(d + c for c in "0123456789" if _luhn(d + c))

    def spaced(d, sign):
        return sign.join(d[k : k + 4] for k in range(0, 16, 4))

    def word(letters, least, most):
        return "".join(r.choice(letters) for _ in range(r.randrange(least, most + 1)))

    def groups(sizes, first):
        return " ".join([first + num(sizes[0] - 1), *map(num, sizes[1:])])

    def one():
        match r.randrange(21):
            case 0:
                return "number", card(), r.choice(plain + ["card ", num(4) + " "]), 1
            case 1:
                d = num(16)
                return "number", d, r.choice(plain + bad), int(_luhn(d))
            case 2:
                return "number", spaced(card(), r.choice(" -")), r.choice(plain + ["visa "]), 1
            case 3:
                d = num(r.choice([12, 13, 14, 15, 18]))
                return "number", d, r.choice(plain + bad), 0
            case 4:
                return "phone_number", f"({num(3)}) {num(3)}-{num(4)}", r.choice(plain + good), 1
            case 5:
                return "phone_number", f"{num(3)}-{num(3)}-{num(4)}", r.choice(plain + good), 1
            case 6:
                return "phone_number", f"{num(3)}-{num(2)}-{num(4)}", r.choice(plain + ["SSN "]), 1
            case 7:
                return "phone_number", f"{r.choice('12')}{num(3)}{(s := r.choice('-./'))}{num(2)}{s}{num(2)}", r.choice(plain + ["date ", "since "]), 0
            case 8:
                return "phone_number", f"{num(2)}{(s := r.choice('-./'))}{num(2)}{s}{r.choice('12')}{num(3)}", r.choice(plain + ["date "]), 0
            case 9:
                return "phone_number", f"{num(r.choice([2, 3]))}.{num(2)}.{num(3)}", r.choice(plain + bad), 0
            case 10:
                return "phone_number", f"{num(3)}-{num(4)}-{num(4)}", r.choice(bad), 0
            case 11:
                return "phone_number", f"+{num(r.choice([1, 2]))} ({num(3)}) {num(3)}-{num(4)}", r.choice(plain + good), 1
            case 12:
                return "masked_email", "".join(r.choice("abcdefmnot") for _ in range(6)) + r.choice(["(at)", " [at] "]) + "mail" + r.choice([".org", " [dot] com"]), r.choice(plain + good), 1
            case 13:
                return "ipv6", ":".join("%x" % r.randrange(65536) for _ in range(8)), r.choice(plain), 1
            case 14:
                a, b = r.randrange(2, 4), r.randrange(1, 4)
                return "ipv6", ":".join("%x" % r.randrange(4096, 65536) for _ in range(a)) + "::" + ":".join("%x" % r.randrange(1, 65536) for _ in range(b)), r.choice(plain), 1
            case 15:  # names of code, clock times
                return "ipv6", r.choice(["{}::{}", "{}::{}", "{}:{}::{}"]).format(*(r.choice([word("abcdef", 1, 4), num(2)]) for _ in range(3))), r.choice(plain), 0
            case 16:
                return "masked_email", f"{word('abcdefmnot', 3, 9)} at {word('abcdefmnot', 3, 9)} dot {r.choice(['com', 'org', 'net', 'de'])}", r.choice(plain + good), 1
            case 17:
                return "masked_email", f"{word('abcdefmnot', 3, 9)} at {r.choice(['the', 'a', 'this', 'each', 'one'])} dot {word('abcdefmnot', 2, 9)}", r.choice(plain), 0
            case 18:
                return "spaced_phone", groups(r.choice([(3, 4, 4), (4, 3, 4), (2, 2, 2, 2, 2), (4, 3, 3), (5, 3, 3)]), r.choice("0123456789")), r.choice(good), 1
            case 19:
                d = num(16)
                return "number", spaced(d, r.choice(" -")), r.choice(plain + bad), int(_luhn(d))
            case _:  # rows of tables, years, counted things
                return "spaced_phone", groups(r.choice([(2, 2, 2), (4, 4, 4), (3, 3, 3), (2, 2, 2, 2, 2), (4, 3, 3), (3, 4, 4)]), r.choice("123456789")), r.choice(plain + bad), 0

    return [(k, h, b, y ^ (r.random() < 0.02)) for k, h, b, y in (one() for _ in range(min(rows, MAX_ROWS)))]


@functools.cache
def model() -> Boosted:
    """The trees, fitted on the generated examples (bounded; the same on every driver), with a threshold for each kind."""
    found = examples()
    x, y = np.array([_example_features(k, h, b) for k, h, b, _ in found], dtype=float), np.array([y for *_, y in found])
    return fit(x, y, FEATURES, groups=[k for k, *_ in found], precision=0.9)


def added_spans(text: Column, base: Column, trees: Boosted) -> Column:
    """Proposed spans that the trees select, less those equal to or inside a base span."""
    proposed = F.concat(*[spans(text, p, kind, text.rlike(gate)) for kind, p, gate in GENERATORS])

    def redact(s):
        before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
        f = features(s["hit"], before, s["kind"])
        inside = F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
        least = F.coalesce(*[F.when(s["kind"] == k, F.lit(v)) for k, v in trees.thresholds.items()], F.lit(trees.threshold))
        return ~inside & (trees.column(f.__getitem__) >= least)

    return F.filter(proposed, redact)


def find(docs: DataFrame, text: str = "text", trees: Boosted | None = None) -> DataFrame:
    """docs with ``pii``: array<struct<start,kind,end,hit>> of all spans, and ``pii_base``, the base ones.

    Null text counts as empty. One row out for each row in. Columns of docs
    that are named pii or pii_base give way; all others pass.
    """
    keep = [c for c in docs.columns if c not in ("pii", "pii_base")]
    t = docs.select(F.struct(*keep).alias("own"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.withColumn("base", F.concat(*base_spans(F.col("t")).values()))
    return t.select(*[F.col("own")[c].alias(c) for c in keep], F.concat("base", added_spans(F.col("t"), F.col("base"), trees or model())).alias("pii"), F.col("base").alias("pii_base"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[{}]") -> DataFrame:
    """docs with every span replaced by its kind in brackets; of overlapping spans the earliest, then longest, counts."""
    f = find(docs, text)
    order = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"], (-s["end"]).alias("last"), s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    t = F.col(text)
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct((-s["last"]).alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(mask.split("{")[0]), s["kind"], F.lit(mask.split("}")[1])).alias("out")))
    done = F.aggregate(order, start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return f.withColumn(text, F.when(t.isNull(), t).otherwise(done)).drop("pii", "pii_base")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of find()."""
    f = find(docs.select("doc_id", "text"))
    return f.select(
        "doc_id",
        *[of_kind(F.col("pii_base"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.col("pii_base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("pii"), KINDS).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
    )
