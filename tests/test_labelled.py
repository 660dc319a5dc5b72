"""Labels are chosen from candidates that are made once."""

from linkweave.operators import rank


def test_candidates_are_stored(spark):
    """What is returned reads stored candidates, not the steps that made them, once for each of its parts."""
    c = spark.createDataFrame([(str(k), k, False, k < 2) for k in range(60)], "id string, degree long, active boolean, hub boolean").groupBy("id", "degree", "active", "hub").count().drop("count")
    got = rank.labelled(c, 1.0)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"] for r in got.collect()} == {"0", "1", *(str(k) for k in range(50, 60))}
