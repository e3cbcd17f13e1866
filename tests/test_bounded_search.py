"""What a Python task of a vector search holds at once does not grow with the table."""

import numpy as np

from weftmark.operators import sketch


def test_probes_are_one_row_a_query(spark, monkeypatch):
    """A query that opens many lists was repeated with its vector for each of them, ten thousand queries at a time."""
    r = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, r.normal(size=24).tolist()) for i in range(400)], "model long, vector array<double>")
    made = []
    real = sketch.materialize
    monkeypatch.setattr(sketch, "materialize", lambda df, label: made.append((label, real(df, label))) or made[-1][1])
    asked = frame.where("model % 20 = 0")
    got = sketch.pruned_search(asked, frame, 5).collect()
    assert {(x["query"], x["rank"], x["hit"]) for x in got} == {(x["query"], x["rank"], x["hit"]) for x in sketch.search(asked, frame, 5).collect()}
    probes = [df for label, df in made if label == "search-probes"]
    assert [df.count() for df in probes] == [20, 20]
    assert sum(len(x["lists"]) for x in probes[1].collect()) > 20


def test_distances_are_made_in_slices(monkeypatch):
    """Two blocks of 2,048 vectors were multiplied whole, in half a dozen matrices of 34 MB a task."""
    import pandas as pd

    shapes = []
    real = sketch._distances
    monkeypatch.setattr(sketch, "_distances", lambda q, v, metric: shapes.append((len(q), len(v))) or real(q, v, metric))
    r = np.random.default_rng(6)
    q, v = r.normal(size=(700, 8)), r.normal(size=(2000, 8))
    left = pd.DataFrame({"query": np.arange(700), "qv": list(q)})
    got = sketch._nearest(left, pd.DataFrame({"hit": np.arange(2000), "iv": list(v)}), 3, "l2")
    want = np.argsort(((q[:, None, :] - v[None, :, :]) ** 2).sum(2), axis=1)[:, :3]
    assert (got["hit"].to_numpy().reshape(700, 3) == want).all() and (got["query"].to_numpy() == np.repeat(np.arange(700), 3)).all()
    assert sum(n for n, _ in shapes) == 700 and max(n * m for n, m in shapes) <= sketch.CELLS
