"""Secret scan over content-addressed blobs with an incremental ledger.

Every version of a path is a blob, addressed by the SHA-256 of its text. A
ledger in shared storage lists the (blob, rule version) pairs scanned so far
with their findings; only unseen pairs are scanned, each blob once however
many paths hold it, and findings are joined back to all paths.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exists, fresh, joined, of_kind, spans

ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)"
#: Least length of an assigned value.
ASSIGN_LEAST = 6
#: Access keys, and the literal that a text must hold. A maximal run of at least so many signs is what a run with its length test gives.
ACCESS, ACCESS_NEED = "AKIA[A-Z0-9]{16,}", "AKIA"
HEX = "[0-9a-f]{24,}"
BASE_KINDS = ["assign", "access", "hex"]
#: Further rules: kind, pattern, literal that a text must hold.
MORE = [
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", "PRIVATE KEY-----"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36}", "_"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    ("google", r"AIza[A-Za-z0-9_-]{35}", "AIza"),
]
KINDS = BASE_KINDS + [k for k, *_ in MORE]


def version_of_rules() -> str:
    return hashlib.sha256(json.dumps([ASSIGN, ASSIGN_LEAST, ACCESS, ACCESS_NEED, HEX, BASE_KINDS, MORE]).encode()).hexdigest()[:16]


#: Changes whenever a rule does; ledger entries of other versions don't count.
RULE_VERSION = version_of_rules()

FINDINGS = "array<struct<start:int,kind:string,end:int,hit:string>>"
LEDGER = f"blob string, rule_version string, findings {FINDINGS}"


def scan(text: Column) -> Column:
    """All findings of a text that is not null."""
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= ASSIGN_LEAST
    base = [F.filter(spans(text, ASSIGN, "assign"), value), spans(text, ACCESS, "access", F.contains(text, F.lit(ACCESS_NEED))), spans(text, HEX, "hex")]
    return F.concat(*base, *[spans(text, p, k, F.contains(text, F.lit(need))) for k, p, need in MORE])


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update(versions: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(versions' paths with their blob, the ledger after scanning what it lacked).

    ledger: folder of earlier runs, or None for a new one. The new entries are
    written in one append, so a failed run leaves the ledger as it was and a
    repeated one adds nothing. Two runs at once may both write an entry;
    readers take one of each blob.
    """
    spark = versions.sparkSession
    folder = ledger or fresh(spark, "ledger")
    named = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"))
    # one holder of each blob: a row number would need all copies in one task, a minimum is combined before the shuffle
    holders = named.groupBy("blob").agg(F.min("path").alias("path"))
    if exists(spark, folder):
        holders = holders.join(_entries(spark, folder, rule_version).select("blob"), "blob", "left_anti")
    nulls = holders.where(F.col("path").isNull())
    texts = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    unseen = texts.join(holders, "path").where(F.sha2("t", 256) == F.col("blob")).dropDuplicates(["blob"]) if _has_ties(versions, path) else texts.join(holders, "path")
    # blobs that only rows without a path hold
    lost = texts.where(F.col("path").isNull()).withColumn("blob", F.sha2("t", 256)).join(nulls.select("blob"), "blob").select("path", "t", "blob").dropDuplicates(["blob"])
    new = unseen.select("path", "t", "blob").unionByName(lost)
    new.select("blob", F.lit(rule_version).alias("rule_version"), scan(F.col("t")).alias("findings")).write.mode("append").parquet(folder)
    return named, _entries(spark, folder, rule_version)


def _entries(spark, folder: str, rule_version: str) -> DataFrame:
    """What is in the ledger for these rules; entries that two runs both wrote are there twice."""
    return spark.read.schema(LEDGER).parquet(folder).where(F.col("rule_version") == rule_version)


def _has_ties(versions: DataFrame, path: str) -> bool:
    """Some path is held by several rows (historical versions)."""
    return bool(versions.select(path).where(F.col(path).isNotNull()).groupBy(path).count().where("count > 1").limit(1).count())


def findings(versions: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, findings): a row for each row of versions. Null text is the empty blob; null paths stay null."""
    named, entries = update(versions, ledger, path, text)
    some = entries.where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"])
    out = named.join(some, "blob", "left")
    return out.select("path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of findings()."""
    f = findings(docs)
    base = F.filter("findings", lambda s: s["kind"].isin(BASE_KINDS))
    return f.select(
        F.col("path").alias("doc_id"),
        *[of_kind(F.col("findings"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.col("findings"), KINDS).alias("spans"),
        "blob",
    )
