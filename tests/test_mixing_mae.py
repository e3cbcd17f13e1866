"""Errors of weights by one dealing of both sides."""

from weftmark.operators import metrics


def test_mixing_mae_deals_both_sides_once(spark):
    """Joined aggregates kept the number of shuffle partitions, so that a task's memory grew with the table."""
    kind = "g long, key long, weight double"
    truth = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.25), (1, 2, 0.5), (2, None, 1.0), (2, 3, None), (None, 4, 0.5)], kind)
    found = spark.createDataFrame([(1, 2, 0.25), (1, 3, 1.0), (2, None, 0.5), (2, None, 0.25), (3, 1, None), (None, 4, 0.25)], kind)
    got = metrics.mixing_mae(truth, found, ["g"])
    assert {r["g"]: r["mae"] for r in got.collect()} == {1: (0.75 + 0.25 + 1.0) / 3, 2: (1.0 + 0.75 + 0.0) / 3, 3: 0.0, None: (0.5 + 0.25) / 2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan
