"""Merges of many children at once, the low-rank delta, and capped ranges against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftmark.operators import merge, selection, simulate


def model_rows(spark, models):
    made = [(m, "w", i, [float(x) for x in row]) for m, w in models.items() for i, row in enumerate(w)]
    return spark.createDataFrame(made, "model string, tensor string, row_idx long, v array<double>")


def test_every_child_is_decomposed_in_one_run(spark):
    r = np.random.default_rng(3)
    root = r.standard_normal((24, 16))
    a, b, c = (root + 0.1 * r.standard_normal(root.shape) for _ in range(3))
    rows = model_rows(spark, {"root": root, "a": a, "b": b, "c": c, "x": 0.7 * a + 0.3 * b, "y": 0.25 * b + 0.75 * c})
    claims = spark.createDataFrame([(k, p) for k in ("x", "y", "nothing") for p in ("a", "b", "c", "gone")], "child string, candidate string")
    got = {(q["child"], q["candidate"]): q for q in merge.decompose_all(rows, claims, "root").collect()}
    assert len(got) == 12
    for child, want in (("x", {"a": 0.7, "b": 0.3}), ("y", {"b": 0.25, "c": 0.75}), ("nothing", {})):
        for p in ("a", "b", "c", "gone"):
            assert abs(got[child, p]["weight"] - want.get(p, 0.0)) < 1e-2, (child, p)
            assert got[child, p]["selected"] == (p in want)
        assert (got[child, "a"]["residual"] < 0.05) == bool(want)
        one = merge.decompose(rows, child, ["a", "b", "c", "gone"], "root")
        assert all(abs(one["coefficients"][p] - got[child, p]["weight"]) < 1e-9 for p in ("a", "b", "c", "gone"))


def test_claimed_parents_without_weight_go(spark):
    r = np.random.default_rng(4)
    root = r.standard_normal((24, 16))
    a, b, c = (root + 0.1 * r.standard_normal(root.shape) for _ in range(3))
    rows = model_rows(spark, {"a": a, "b": b, "c": c, "x": 0.7 * a + 0.3 * b})
    edges = spark.createDataFrame([("a", "x", "sft", 0.9), ("b", "x", "sft", 0.8), ("c", "x", "sft", 0.7), ("a", "c", "sft", 0.6)], "parent string, child string, relation string, confidence double")
    edges = edges.withColumn("weight", F.lit(None).cast("double"))
    got = {(q["parent"], q["child"]): q for q in merge.resolve_merges(rows, edges, base=None).collect()}
    assert {"a", "b"} <= {p for p, k in got if k == "x"} and got["a", "c"]["relation"] == "sft" and got["a", "c"]["weight"] is None
    assert got["a", "x"]["relation"] == "merge" and abs(got["a", "x"]["weight"] - 0.7) < 0.05 and got["a", "x"]["confidence"] == 0.9


def test_low_rank_delta_has_its_rank_and_size(spark):
    w = np.random.default_rng(5).standard_normal((40, 32))
    rows = model_rows(spark, {"m": w}).drop("model")
    bias = spark.createDataFrame([("bias", 0, [1.0, 2.0])], rows.schema)
    zero = spark.createDataFrame([("zero", i, [0.0, 0.0]) for i in range(3)], rows.schema)
    got = {(q["tensor"], q["row_idx"]): q["v"] for q in simulate.low_rank_delta(rows.union(bias).union(zero)).collect()}
    delta = np.array([got["w", i] for i in range(40)]) - w
    s = np.linalg.svd(delta, compute_uv=False)
    assert (s > 1e-9 * s[0]).sum() == 8
    assert abs(np.linalg.norm(delta) / np.linalg.norm(w) - 0.03) < 1e-12
    assert got["bias", 0] == [1.0, 2.0] and got["zero", 2] == [0.0, 0.0]


def capped(ranges, gap, most):
    out, slack = [], 0
    for begin, end in sorted(ranges):
        hole = begin - out[-1][1] if out else None
        if out and hole <= gap and slack + max(hole, 0) <= most:
            out[-1][1] = max(out[-1][1], end)
            slack += max(hole, 0)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def test_capped_ranges_over_small_batches(spark):
    draw = random.Random(6)
    made = {f: [(s, s + draw.randrange(1, 40)) for s in (draw.randrange(4000) for _ in range(120))] for f in ("a", "b", None)}
    rows = [(f, *x) for f, xs in made.items() for x in xs] + [("a", 9, 9), ("empty", 5, 5)]
    frame = spark.createDataFrame(rows, "file string, begin long, end long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, selection.coalesce_capped(frame, 20, 100).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == sorted([(f, *x) for f, xs in made.items() for x in capped(xs, 20, 100)], key=str)
    assert selection.coalesce_capped(frame.limit(0), 20, 100).collect() == []


def test_exactly_so_many_cells_for_every_model(spark):
    from weftmark.operators import merge

    sizes = [("a", 50, 7), ("b", 1, 3), ("c", 200, 16), ("d", 4, 4)]
    tensors = spark.createDataFrame(sizes, "tensor string, n_rows long, n_cols int")
    whole = sum(n * w for _, n, w in sizes)
    for coords in (1, 37, 500, whole - 1, whole, 10 * whole):
        got = merge.coordinates(tensors, coords).collect()
        cells = {(r["tensor"], r["row_idx"], c) for r in got for c in r["cols"]}
        assert len(cells) == sum(len(r["cols"]) for r in got) == min(coords, whole)
        assert all(0 <= i < dict((t, n) for t, n, _ in sizes)[t] and 0 <= c < dict((t, w) for t, _, w in sizes)[t] for t, i, c in cells)
    assert merge.coordinates(tensors, 500, seed=1).exceptAll(merge.coordinates(tensors, 500)).count() > 0
    rows = [(m, t, i, [100.0 * i + c for c in range(w)]) for m in "xyz" for t, n, w in sizes for i in range(n - (m == "z" and n > 100))]
    cut = merge.sample_coordinates(spark.createDataFrame(rows, "model string, tensor string, row_idx long, v array<double>"), 300).collect()
    held = {m: {(r["tensor"], r["row_idx"], x) for r in cut if r["model"] == m for x in r["v"]} for m in "xyz"}
    assert len(held["x"]) == 300 and held["x"] == held["y"] == held["z"]


def test_overlapping_runs_of_a_cache_count_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftmark.operators import index

    universe = spark.createDataFrame([("m", "r", "main", "1"), ("n", "s", "main", "1")], "model string, ref string, revision string, stamp string")
    path = str(tmp_path / "cache")

    def make(todo):
        if make.calls == 0:  # another run writes the same keys meanwhile
            make.calls += 1
            index.cached(universe, path, make, "p")
        return todo.select("model", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))

    make.calls = 0
    got = index.cached(universe, path, make, "p")
    assert sorted((r["model"], r["x"]) for r in got.collect()) == [("m", 1), ("m", 2), ("n", 1), ("n", 2)]
