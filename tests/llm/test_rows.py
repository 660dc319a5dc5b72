"""One row a component, and sets of short texts."""

import pytest

from linkweave.llm import jaccard

from .test_llm import docs

A, B, C = ("".join(f"{x}{k} " for k in range(30)) for x in "abc")


@pytest.mark.parametrize("again", [False, True])
def test_one_row_of_each_component(spark, again):
    rows = [(3, A), (5, B), (5, A), (6, A), (None, A), (8, C), (9, C), (-1, None), (-2, " "), (None, "no id at all")]
    rows += [(8, C), (8, C)] if again else []
    got = [(r["doc_id"], r["text"]) for r in jaccard.representatives(docs(spark, rows)).collect()]
    want = [(3, A), (5, B), (8, C), (-1, None), (-2, " "), (None, "no id at all")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_names_that_sets_share(spark):
    """Classes whose short names collide are told apart by the other half of their names."""
    rows = [(k, " ".join(f"{w}{k % 40} " for w in "abcdefghij")) for k in range(120)] + [(500, "a0 b0 c0 d0 e0 f0 g0 h0 i0 j0 z"), (501, None)]
    d = docs(spark, rows)
    got = sorted(map(tuple, jaccard.near_duplicates(d, bits=5).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted((k, 6, k % 40) for k in range(120)) + [(500, 7, 0), (501, 0, 501)]
