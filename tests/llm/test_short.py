"""Short texts are not what they would be with their length written behind them."""

import pytest

from linkweave.llm import jaccard


@pytest.mark.parametrize("short,long", [("a b c d", "a b c d 4"), ("a b c", "a b c 3 3"), ("a", "a 1 1 1 1")])
def test_short_texts_are_their_own(short, long):
    assert jaccard.shingles(short).tolist() != jaccard.shingles(long).tolist()
    assert jaccard.shingles(short).tolist() == jaccard.shingles(f" {short.upper()}\n").tolist()
