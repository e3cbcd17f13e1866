"""Steps whose tasks must not grow with the tables."""

import numpy as np
from pyspark.sql import functions as F

from weftmark.operators import export, metrics, selection, simulate
from weftmark.plans.shared import dealt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quotas_are_cut_before_the_shuffle(spark):
    pairs = spark.range(500).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"), F.when(F.col("id") % 2 == 0, "F").otherwise("P").alias("class"))
    got = metrics.balanced_subsample(pairs, {"F": 5, "O": 9})
    assert "WindowGroupLimit" in plan(got) and [r["rank"] for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_tasks_of_a_dealt_table_are_bounded_by_rows(spark):
    assert dealt(spark.range(1000), "id", rows=50).rdd.getNumPartitions() == 20
    ranges = spark.createDataFrame([("f", 0, 5), ("f", 3, 9), ("f", 30, 31), ("g", 2, 1), ("g", 7, 8)], "file string, begin long, end long")
    assert sorted(map(tuple, selection.coalesce_ranges(ranges, 2).collect())) == [("f", 0, 9), ("f", 30, 31), ("g", 7, 8)]
    assert "REPARTITION_BY_NUM" in plan(selection.coalesce_ranges(ranges, 2))


def test_pruned_neurons_are_looked_up_by_place(spark):
    r = np.random.default_rng(1)
    kind = "tensor string, row_idx long, v array<double>"
    gate, up, down = r.normal(size=(40, 4)), r.normal(size=(40, 4)), r.normal(size=(6, 10))
    frames = [spark.createDataFrame([(n, i, row.tolist()) for i, row in enumerate(m)], kind) for n, m in (("g", gate), ("u", up), ("d", down))]
    dead = np.argsort((gate**2).sum(1) + (up**2).sum(1), kind="stable")[:10]
    g, u, d = simulate.structured_prune(*frames, 0.25)
    assert "array_contains" not in plan(d)
    for found, m in ((g, gate), (u, up)):
        m[dead] = 0
        assert np.allclose([x["v"] for x in found.orderBy("row_idx").collect()], m)
    down[:, [i for i in dead if i < 10]] = 0
    assert np.allclose([x["v"] for x in d.orderBy("row_idx").collect()], down)


def test_packages_are_numbered_without_one_window_over_all(spark):
    names = [f"m{i:02d}" for i in range(50)]
    facts = spark.createDataFrame([(n, "mit", "MIT") for n in names], "model string, license string, spdx string")
    none = spark.createDataFrame([], "descendant string, ancestor string")
    rows = export.spdx_packages(facts, none)
    assert {r["model"]: r["spdx_id"] for r in rows.collect()} == {n: f"SPDXRef-Package-{i}-{n}" for i, n in enumerate(names)}
    assert "row_number()" not in plan(rows)


def test_tasks_follow_a_given_bound_without_a_count(spark, monkeypatch):
    """The tasks of j10_j16_outgroup_pool were as many as the session's partitions, whatever its pairs."""
    frame = spark.range(1000)
    monkeypatch.setattr(type(frame), "count", lambda self: 1 / 0)
    assert dealt(frame, "id", rows=50, n=900).rdd.getNumPartitions() == 18
