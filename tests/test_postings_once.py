"""Postings are many times as many as titles: they are made from stored titles and written once, in order."""

import os

from linkweave import storage
from linkweave.sources import titles


def test_postings_once(spark, tmp_path):
    rows = [("1", "aaa ÄÄ 𝔘x𝔘x"), ("2", "  B "), ("3", None), ("4", ""), ("5", "aaa ÄÄ 𝔘x𝔘x")]
    a = spark.createDataFrame(rows, "id string, title string")
    home = storage.root(spark).removeprefix("file://")
    before = set(os.listdir(home))
    titles.write(a, str(tmp_path / "t"))
    assert set(os.listdir(home)) == before
    got = spark.read.parquet(str(tmp_path / "t" / "postings")).collect()
    want = []
    for i, t in rows:
        k = " ".join((t or "").split()).lower()
        want += [(g, len(t), t, i) for g in {k[p : p + n] for n in (1, 2, 3) for p in range(len(k) - n + 1)}]
    assert sorted(map(tuple, got)) == sorted(want)
