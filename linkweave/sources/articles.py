"""Dumps, JSON-lines article records, graph documents, SVG: readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import documents

PAGE = "title string, ns int, id string, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"


def dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML dump, plain or bz2 in one or many streams (A1, A2, A4)."""
    return spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)


def articles_of(pages: DataFrame, *carry: str) -> DataFrame:
    """Kept pages as article records (A5, C1): articles with id and title, no redirects, no disambiguation pages."""
    t = F.coalesce(F.col("revision.text._VALUE"), F.lit(""))
    keep = (F.col("ns") == 0) & (F.trim("title") != "") & F.col("redirect").isNull() & F.col("id").isNotNull() & ~T.is_disambiguation_title(F.col("title")) & ~T.is_disambiguation_text(t)
    return pages.where(keep).select(*carry, "id", "title", T.url_path_safe(F.col("title")).alias("url"), F.octet_length(t).cast("double").alias("byte_length"), T.links(t).alias("links"))


def reference(v: Column) -> Column:
    """A link as text: a string as it is, an object by its id, else its title."""
    kind = F.schema_of_variant(v)
    obj = F.coalesce(F.try_variant_get(v, "$.id", "string"), F.try_variant_get(v, "$.title", "string"), F.lit(""))
    return F.when(kind.startswith("OBJECT"), obj).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))


def read_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Article lines with their state (A6, C2): accepted, malformed, disambiguation or blank; ids must be strings. A url that is no string is made of the title, an extract that is none or empty is null."""
    v = F.try_parse_json(F.col(line))
    has = lambda path: F.try_variant_get(F.col("v"), path, "string")
    text = lambda path: F.schema_of_variant(F.try_variant_get(F.col("v"), path, "variant")) == "STRING"
    flag = lambda path: F.coalesce(F.try_variant_get(F.col("v"), path, "boolean"), F.lit(False))
    a = lines.withColumn("v", v).withColumns({"id": F.when(text("$.id"), has("$.id")), "title": F.when(text("$.title"), has("$.title"))})
    a = a.withColumn("title", F.coalesce("title", "id"))
    dis = flag("$.isDisambiguation") | flag("$.disambiguation") | F.coalesce(T.is_disambiguation_title(F.col("title")), F.lit(False))
    state = F.when(F.trim(line) == "", "blank").when(F.col("v").isNull() | F.col("id").isNull() | (F.col("title") == ""), "malformed").when(dis, "disambiguation").otherwise("accepted")
    url = F.when(text("$.url"), has("$.url")).otherwise(T.url_component(F.col("title")))
    links = F.transform(F.coalesce(F.try_variant_get(F.col("v"), "$.links", "array<variant>"), F.array().cast("array<variant>")), reference)
    return a.select(*[c for c in lines.columns if c not in ("id", "title", "url", "extract")], "id", "title", url.alias("url"), F.when(text("$.extract"), F.nullif(has("$.extract"), F.lit(""))).alias("extract"), F.try_variant_get(F.col("v"), "$.byteLength", "double").alias("byte_length"), F.array_distinct(F.filter(F.transform(links, lambda x: F.trim(x)), lambda x: x != "")).alias("links"), state.alias("state"))


def index_manifest(states: DataFrame) -> DataFrame:
    """Counters of an index run."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.agg(n("accepted"), n("malformed"), n("disambiguation"), n("blank"))


def graph_document(spark: SparkSession, path: str, chunk: int = documents.CHUNK) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a {nodes, links} document."""
    found = documents.elements(spark, path, "nodes", "links", chunk=chunk)
    of = lambda name, schema: found.where(F.col("name") == name).select("pos", F.from_json("value", schema).alias("v")).select("pos", "v.*")
    return of("nodes", "id string, title string"), of("links", "source string, target string")


def svg_elements(lines: DataFrame, *carry: str) -> DataFrame:
    """(kind, attributes, text) of line, circle and text elements, a line of the file each."""
    kind = F.regexp_extract("value", r"^\s*<(line|circle|text) ", 1)
    names, values = F.regexp_extract_all("value", F.lit(r'([A-Za-z0-9-]+)="[^"]*"'), F.lit(1)), F.regexp_extract_all("value", F.lit(r'[A-Za-z0-9-]+="([^"]*)"'), F.lit(1))
    return lines.where(kind != "").select(kind.alias("kind"), F.map_from_arrays(names, values).alias("attributes"), F.regexp_extract("value", ">([^<]*)</text>", 1).alias("text"), *carry)


def known_input(names: list[str]) -> str | None:
    """The first of the usual inputs that is there."""
    return next((n for n in ("index/articles.jsonl", "articles.jsonl", "index/index.json", "index.json") if n in names), None)


def data_root(path: str, system: str = "/") -> str:
    """path if it is absolute and not the system root (A25); of a URI the path within its store counts."""
    import os
    from urllib.parse import urlsplit

    uri = urlsplit(path) if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path) else None
    own = uri.path if uri else path
    if not os.path.isabs(own) or os.path.normpath(own) in (os.path.normpath(system), "/", "//"):
        raise ValueError(f"{path!r} is no data root")
    return path
