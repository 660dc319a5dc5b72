"""String, hash, URL and formatting expressions; Columns only, null-safe as stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of reference keys, spelled out because Java's \s is ASCII only. Fixed values.
SPACE = r"[\t\n\x0B\f\r\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: Namespaces that are not articles.
PREFIXES = [
    "category", "file", "image", "media", "mediawiki", "module", "portal",
    "special", "template", "talk", "user", "wikipedia", "help", "draft",
    "book", "timedtext", "topic", "gadget", "gadget definition",
]
#: Templates that mark a disambiguation page.
TEMPLATES = ["disambiguation", "disambig", "disamb", "hndis", "geodis", "mathdab", r"number\s+disambiguation", r"letter\s+disambiguation"]
#: Fixed value: the category of disambiguation pages.
DISAMBIGUATION_CATEGORY = r"(?i)\[\[\s*category\s*:\s*(?:all\s+)?disambiguation\s+pages\b"
MONTHS = "(January|February|March|April|May|June|July|August|September|October|November|December)"
DAY = "([1-9]|[12][0-9]|3[01])"
#: A link: target, then an optional fragment and label. Fixed format.
LINK = r"\[\[\s*:?[\t ]*([^\]|#<>]+?)(?:#[^\]|<>]*)?(?:\|[^\]]*)?\]\]"


def squeezed(s: Column) -> Column:
    """Trimmed, runs of white space as one space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), SPACE + "+", " "))


def key(s: Column) -> Column:
    """The form in which references are compared (B2)."""
    return F.lower(squeezed(s))


def title(s: Column) -> Column:
    """Normalised article title, null for empty ones and other namespaces (B1)."""
    t = squeezed(F.replace(F.coalesce(s, F.lit("")), F.lit("_"), F.lit(" ")))
    other = F.contains(t, F.lit(":")) & F.lower(F.trim(F.substring_index(t, ":", 1))).isin(PREFIXES)
    return F.when((t != "") & ~other, F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))


def links(wikitext: Column) -> Column:
    """Targets of [[links]] in order of first occurrence."""
    found = F.transform(F.regexp_extract_all(F.coalesce(wikitext, F.lit("")), F.lit(LINK), F.lit(1)), title)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def stable_hash(s: Column) -> Column:
    """32-bit multiply-xor hash over code points, as an unsigned number."""
    chars = F.filter(F.split(F.coalesce(s, F.lit("")), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def url_path_safe(s: Column) -> Column:
    """Percent-encoded title, spaces as underscores; the signs ()!*'~ are encoded too (B6, first variant)."""
    e = F.url_encode(F.replace(s, F.lit(" "), F.lit("_")))
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def url_component(s: Column) -> Column:
    """As the first variant, but ()!*' stay as they are (B6, second variant)."""
    e = F.url_encode(F.replace(s, F.lit(" "), F.lit("_")))
    for code, sign in (("%28", "("), ("%29", ")"), ("%21", "!"), ("%27", "'"), ("%7E", "~")):
        e = F.replace(e, F.lit(code), F.lit(sign))
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), e)


def is_year(t: Column) -> Column:
    return F.trim(t).rlike("^[0-9]{4}$")


def is_day(t: Column) -> Column:
    return F.trim(t).rlike(f"^({MONTHS} {DAY}|{DAY} {MONTHS})$")


def is_year_or_day(t: Column) -> Column:
    return is_year(t) | is_day(t)


def is_disambiguation_title(t: Column) -> Column:
    return F.trim(t).rlike(r"(?i)\s+\(disambiguation\)$")


def is_disambiguation_text(wikitext: Column) -> Column:
    t = F.coalesce(wikitext, F.lit(""))
    return t.rlike(r"(?i)\{\{\s*(?:" + "|".join(TEMPLATES) + r")\s*(?:\||\}\})") | t.rlike(DISAMBIGUATION_CATEGORY)


def byte_size(n: Column, units=("B", "KiB", "MiB", "GiB", "TiB"), decimals: int = 1) -> Column:
    """Bytes with a binary unit; whole bytes have no decimals."""
    out = F.concat(F.round(n).cast("long").cast("string"), F.lit(f" {units[0]}"))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.{decimals}f {unit}", n / float(1024**k))).otherwise(out)
    return out


def duration(seconds: Column) -> Column:
    """<1s, Ns, Mm SSs, Hh MMm."""
    s = F.floor(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), two(s % 60), F.lit("s"))
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), two(F.floor(s / 60) % 60), F.lit("m"))
    return F.when(seconds < 1, "<1s").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, minutes).otherwise(hours)


def energy(v: Column) -> Column:
    """SI prefix and up to three significant digits, mantissa at most 999."""
    prefixes = ["q", "r", "y", "z", "a", "f", "p", "n", "µ", "m", "", "k", "M", "G", "T", "P", "E", "Z", "Y", "R", "Q"]
    e = F.greatest(F.lit(-10), F.least(F.lit(10), F.floor(F.log10(v) / 3))).cast("int")
    m = F.least(F.lit(999.0), v / F.pow(F.lit(1000.0), e))
    near = lambda k: F.round(m * F.lit(float(k)), 0) / F.lit(float(k))  # noqa: E731  rounds the number that is there, not its shortest decimal
    digits = F.when(m >= 100, near(1)).when(m >= 10, near(10)).otherwise(near(100))
    text = F.regexp_replace(F.format_string("%.2f", digits), r"\.?0+$", "")
    text = F.when(digits >= 100, F.format_string("%.0f", digits)).otherwise(text)
    unit = F.element_at(F.array(*[F.lit(p) for p in prefixes]), e + 11)
    return F.when(v.isNull() | F.isnan(v) | (v <= 0), "0 J").otherwise(F.concat(text, F.lit(" "), unit, F.lit("J")))


_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]


def xml_escape(s: Column) -> Column:
    for sign, entity in _ENTITIES:
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return s


def xml_unescape(s: Column) -> Column:
    for sign, entity in _ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(sign))
    return s


def svg_number(x: Column) -> Column:
    """Three decimals without trailing zeros; what is not finite is 0."""
    t = F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")
    return F.when(x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")) | (t == "-0"), "0").otherwise(t)


def label(t: Column) -> Column:
    """At most 28 characters, the last an ellipsis if cut; line ends as spaces."""
    t = F.regexp_replace(t, "[\\r\\n]", " ")
    return F.when(F.length(t) > 28, F.concat(F.substring(t, 1, 27), F.lit("…"))).otherwise(t)


def iso_time(seconds: Column) -> Column:
    """UTC seconds as ISO-8601."""
    t = F.timestamp_seconds(seconds)  # a pattern's year has a sign beyond 9999
    return F.concat(F.format_string("%04d", F.year(t)), F.date_format(t, "-MM-dd'T'HH:mm:ss'Z'"))


def rate(n: Column, seconds: Column) -> Column:
    """Count per second with thousands separators."""
    return F.concat(F.format_number(n / F.greatest(seconds, F.lit(0.001)), 0), F.lit("/s"))


def has_property(json: Column, name: str) -> Column:
    """The object has a property of that name, whatever its value, null too."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), name), F.lit(False))


def progress_count(n: Column, unit: str) -> Column:
    """A count with thousands separators and its unit; bytes with a binary unit."""
    return byte_size(n) if unit == "bytes" else F.concat(F.format_number(n, 0), F.lit(f" {unit}"))
