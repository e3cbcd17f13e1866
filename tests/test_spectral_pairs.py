"""The sample of a large tensor is taken before it meets one task."""

import numpy as np
from pyspark.sql import functions as F

from weftmark.functions import linalg, scalars
from weftmark.operators import sketch


def test_sample_of_rows_and_columns(spark, monkeypatch):
    r = np.random.default_rng(4)
    a = r.standard_normal((50, 30))
    b = a + 0.2 * r.standard_normal(a.shape)
    rows = spark.createDataFrame([(m, "t", 3 * i, row.tolist()) for m, w in (("a", a), ("b", b)) for i, row in enumerate(w)], "model string, tensor string, row_idx long, v array<double>")
    made = sketch.spectral_pairs(rows, spark.createDataFrame([("a", "b")], "a string, b string"), k=3, cap=12)
    at = lambda n: np.unique(np.rint(np.linspace(0, n - 1, 12)).astype(int))
    x, y = a[np.ix_(at(50), at(30))], b[np.ix_(at(50), at(30))]
    got = made.collect()[0]
    assert (got["n_rows"], got["n_cols"]) == (50, 30)
    assert abs(got["energy_a"] - linalg.subspace_energy(y - x, linalg.gram_spectrum(x)[1], 3)) < 1e-9
    assert abs(got["erank_b"] - linalg.effective_rank(linalg.gram_spectrum(y)[0]) / 12) < 1e-9
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan.split("FlatMapGroupsInPandas")[1]


def test_only_sampled_rows_meet_where_all_rows_are_there(spark, monkeypatch):
    """Every row of every pair was met and numbered to find 768 of them: a third of the time of c28_phylogeny."""
    r = np.random.default_rng(5)
    a, b = r.standard_normal((50, 30)), r.standard_normal((40, 30))
    kind = "model string, tensor string, row_idx long, v array<double>"
    table = lambda step: spark.createDataFrame([(m, "t", step * i, row.tolist()) for m, w in (("a", a), ("b", b)) for i, row in enumerate(w)], kind)
    pair = spark.createDataFrame([("a", "b")], "a string, b string")
    met = []
    real = sketch.pairs.aligned
    monkeypatch.setattr(sketch.pairs, "aligned", lambda rows, p: met.append(rows.count()) or real(rows, p))
    got = [sketch.spectral_pairs(table(step), pair, k=3, cap=12).collect() for step in (1, 3)]
    assert met == [0, 90] and got[0] == got[1] and got[0][0]["n_rows"] == 40


def test_places_of_an_even_sample(spark):
    for cap in (1, 2, 12, 768):
        n = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 11, 12, 13, 25, 768, 769, 1000, 2047)], "n long")
        wrong = n.withColumn("i", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("n")))).where(
            scalars.is_even_index(F.col("i"), F.col("n"), cap) != F.array_contains(scalars.even_indices(F.col("n"), cap), F.col("i"))
        )
        assert wrong.isEmpty()
