"""The version of the secret rules covers every pattern and threshold of a scan; samples and statistics of URLs."""

import pytest
from pyspark.sql import functions as F

from linkweave.llm import secrets, urls

from .test_llm import docs


@pytest.mark.parametrize("name,value", [("ASSIGN", "x(y)"), ("ASSIGN_LEAST", 7), ("ACCESS", "AKIA[A-Z0-9]{4,}"), ("ACCESS_NEED", "AK"), ("HEX", "[0-9a-f]{8,}"), ("MORE", [])])
def test_version_changes_with_rules(monkeypatch, name, value):
    monkeypatch.setattr(secrets, name, value)
    assert secrets.version_of_rules() != secrets.RULE_VERSION


def test_changed_rule_finds_in_old_ledger(spark, tmp_path, monkeypatch):
    d, ledger = docs(spark, [(1, "deadbeef01")]), str(tmp_path / "ledger")
    assert secrets.update(d, ledger)[1].select(F.size("findings")).first()[0] == 0
    monkeypatch.setattr(secrets, "HEX", "[0-9a-f]{8,}")
    assert secrets.update(d, ledger, rule_version=secrets.version_of_rules())[1].select(F.size("findings")).first()[0] == 1


def test_two_runs_wrote_the_ledger(spark, tmp_path):
    """Entries that are there twice give no second row, and nothing is scanned again."""
    d, ledger = docs(spark, [(1, "token = abcdef1"), (2, "token = abcdef1"), (3, "none")]), str(tmp_path / "ledger")
    _, entries = secrets.update(d, ledger)
    entries.write.mode("append").parquet(ledger)
    assert sorted((r["path"], len(r["findings"])) for r in secrets.findings(d, ledger).collect()) == [(1, 1), (2, 1), (3, 0)]
    assert spark.read.parquet(ledger).count() == 4


def test_paths_with_versions(spark):
    """Every version of a path is a row; a path may be null."""
    d = docs(spark, [(1, "token = abcdef1"), (1, "clean"), (1, "token = abcdef1"), (None, "secret: zzzzzz9"), (None, None)])
    got = sorted((str(r["path"]), len(r["findings"])) for r in secrets.findings(d).collect())
    assert got == [("1", 0), ("1", 1), ("1", 1), ("None", 0), ("None", 1)]


def test_sample_of_urls_that_repeat(spark):
    """Above three times the bound, with paths and whole rows that repeat, the sample has bound rows of both labels, and blocked URLs are still blocked."""
    n = 40_000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("http://a.com/fr/"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("http://b.com/de/x?q="), F.col("id").cast("string"))).alias("url"))
    f = urls.with_statistics(urls.features(pages.unionByName(pages.where("page_id % 10 = 0").limit(1).select("page_id", "url").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(15_000)))).drop("k"))))
    x, y = urls._sample(f, 4000)
    assert len(x) == len(y) == 4000 and 0 < y.sum() < 4000
    some = urls._sample(f, 500)
    assert len(some[1]) == 500
    model = urls.train(f)
    assert model.trees and (model.predict(x) > model.threshold).tolist() == (y == 1).tolist()
    own = urls.judge(pages.limit(20).withColumn("m", F.create_map(F.lit("a"), F.lit("b"))))
    assert own.count() == 20 and own.where("m['a'] = 'b'").count() == 20


def test_statistics_by_any_salts(spark):
    """The statistics do not depend on the number of salts."""
    f = urls.features(spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), F.when(F.col("id") % 3 == 0, "fr").otherwise("de"), F.lit("/"), (F.col("id") % 50).cast("string")).alias("url")))
    rows = lambda most: sorted(map(str, urls.with_statistics(f, most).select("page_id", *urls.SHARES).collect()))
    assert rows(urls.ROWS_A_TASK) == rows(20) and len(rows(20)) == 3000
