"""Keys that share a hash, positions that differ, and the pipeline on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkweave.llm import common, decontaminate, lines

from ..conftest import SF
from .test_llm import ODD, docs


def test_line_keys_with_equal_first_hashes():
    """Keys are told apart by their second hash, also after a round trip through bytes."""
    a = np.array([5, 5, 5, 7, 8, 8], np.int64)
    b = np.array([1, 2, -3, 1, 2, 9], np.int64)
    first = np.array([10, 20, 30, 40, 50, 60], np.int64)
    for s in (x := lines.LineShard.of(a, b, np.full(6, 2), first), lines.LineShard.load(x.dump())):
        found, got = s.owner(np.append(a, [5, 9]), np.append(b, [4, 1]))
        assert found.tolist() == [True] * 6 + [False] * 2 and got[:6].tolist() == first.tolist()


def test_passage_at_other_places(spark):
    """Texts with the same windows at different places, and once more often, have hits of their own."""
    w = [f"w{i}" for i in range(14)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w))], "item_id long, text string")
    d = docs(spark, [(1, " ".join(w)), (2, "x y z " + " ".join(w)), (3, " ".join(w + ["q"] + w)), (4, "x " * 20000 + " ".join(w[:13]))])
    for bound in (decontaminate.SET_BOUND, 0):
        got = sorted((r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(d, items, set_bound=bound).collect())
        assert got == [(1, 14, 2), (2, 14, 2), (3, 28, 2), (4, 13, 2)]


def test_contained_text_with_clashing_names(spark):
    text = " ".join(f"v{i % 7000}" for i in range(20_000))
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    d = docs(spark, [(1, text), (None, None), (None, text[:200])]).withColumns({c: F.lit("mine") for c in ("own", "row", "nr", "cand", "n_words")})
    got = decontaminate.contamination(d, items, carry=["doc_id", "own", "nr", "cand"]).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"], r["own"], r["nr"]) for r in got) == [("1", 20_000, "mine", "mine"), ("None", 0, "mine", "mine"), ("None", len(text[:200].split()) - 1 + (text[200] == " "), "mine", "mine")]
    assert [r["doc_id"] for r in decontaminate.clean(d, items).collect()] == [None]


STAGE = dict(corpus_pipeline.STAGES)
GOOD = "the report of the day is that " + " ".join(f"word{k} and the other{k}" for k in range(40))


@pytest.mark.parametrize("rows", [[], ODD, [(1, GOOD), (1, GOOD), (None, GOOD + " end"), (2, None), (3, ""), (7, GOOD.replace("and", "or"))]], ids=["empty", "odd", "ties"])
def test_stages_on_odd_tables(spark, rows):
    """Each filtering stage takes and gives the columns of documents, with nulls, ties, repeated rows and none at all; rows are only lost to the stage's rule."""
    d = docs(spark, rows).withColumn("_q", F.lit("clash"))
    for name in ("quality_rules", "line_dedup", "near_dedup", "decontamination"):
        out = STAGE[name](spark, d, SF)
        assert out.columns == d.columns
        got = sorted(str(r["doc_id"]) for r in out.collect())
        if name == "line_dedup":
            assert got == sorted(str(i) for i, _ in rows)
        if name == "decontamination":
            assert got == sorted(str(i) for i, _ in rows)
        if name == "near_dedup" and rows and rows[0][1] == GOOD:
            assert got == ["1", "2", "3", "7"]
        if name == "quality_rules" and rows and rows[0][1] == GOOD:
            assert got == ["1", "1", "7", "None"]
    pieces = STAGE["packing"](spark, d, SF).collect()
    assert sorted(str(p["doc_id"]) for p in pieces if p["start"] == 0) == sorted(str(i) for i, _ in rows)
