"""Loops that follow a chain to its end, or say that they did not."""

import pytest

from linkweave.operators import graph

N = 9


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(i, str(i), f"T{i}", 1.0, [str(i + 1)]) for i in range(N)]
    return spark.createDataFrame(rows, "seq long, id string, title string, byte_length double, links array<string>")


def test_tier_passes_bound(chain):
    """One round settles a block, however long its chain; blocks of a link each need a round each."""
    assert graph.tier_passes(chain, max_rounds=1).count() == N
    assert graph.tier_passes(chain, max_rounds=N, edges_a_block=1).count() == N
    with pytest.raises(RuntimeError):
        graph.tier_passes(chain, max_rounds=4, edges_a_block=1)


def test_connected_order_bound(chain):
    e = graph.resolve(chain)
    assert graph.connected_order(e, max_rounds=N).count() == N
    with pytest.raises(RuntimeError):
        graph.connected_order(e, max_rounds=4)


def test_no_bound_unless_asked():
    import inspect

    for f in (graph.tier_passes, graph.connected_order):
        assert inspect.signature(f).parameters["max_rounds"].default is None
