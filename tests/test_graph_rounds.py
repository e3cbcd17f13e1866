"""Closures and paths on lineages whose paths are far more than their pairs, and blocked search."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftmark.operators import graph, sketch

LAYERS, WIDTH = 9, 3


def layered(spark):
    """Every model derives from all of the layers before: paths grow exponentially, pairs do not."""
    name = lambda layer, i: f"m{layer}{i}"
    made = [
        (name(a, i), name(b, j), 0.5 + ((a * 7 + i * 5 + b * 3 + j) % 10) / 20)
        for b in range(LAYERS) for a in range(b) for i in range(WIDTH) for j in range(WIDTH)
    ]
    return made, spark.createDataFrame(made, "parent string, child string, confidence double")


def test_closure_and_components_of_a_layered_lineage(spark):
    made, edges = layered(spark)
    up = {(r["ancestor"], r["descendant"]): r["depth"] for r in graph.closure(edges).collect()}
    assert up == {(p, c): 1 for p, c, _ in made}
    nodes = spark.createDataFrame([(n,) for n in sorted({x for e in made for x in e[:2]}) + ["lone"]], "node string")
    got = {r["node"]: r["component"] for r in graph.weak_components(nodes, edges).collect()}
    assert set(got.values()) == {"m00", "lone"} and got["lone"] == "lone"


def test_closure_is_safe_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")], "parent string, child string")
    up = {(r["ancestor"], r["descendant"]): r["depth"] for r in graph.closure(edges).collect()}
    assert up["a", "d"] == 3 and up["b", "a"] == 2 and up["c", "b"] == 2 and ("a", "a") not in up


def test_best_paths_equal_relaxation(spark):
    made, edges = layered(spark)
    best = {(p, c): f for p, c, f in made}
    for _ in range(LAYERS):
        for (p, m), f in list(best.items()):
            for q, c, g in made:
                if q == m:
                    best[p, c] = max(best.get((p, c), 0.0), f * g)
    got = {(r["ancestor"], r["descendant"]): r for r in graph.best_paths(edges).collect()}
    assert set(got) == set(best)
    confidence = {(p, c): f for p, c, f in made}
    for pair, r in got.items():
        steps = [confidence[x, y] for x, y in zip(r["path"], r["path"][1:])]
        assert abs(r["product"] - best[pair]) < 1e-12 and abs(np.prod(steps) - r["product"]) < 1e-12 and min(steps) == r["least"]


def test_blocked_search_equals_brute_force(spark):
    r = np.random.default_rng(3)
    vectors = [(f"v{i:03d}", r.normal(size=8 if i % 7 else 6).round(2).tolist()) for i in range(120)] + [("same", [1.0] * 8), ("twin", [1.0] * 8), ("zero", [0.0] * 8), ("none", None)]
    index = spark.createDataFrame(vectors, "model string, vector array<double>")
    queries = index.where(F.col("model").isin("v001", "v007", "same", "zero", "none"))
    held = {m: v for m, v in vectors if v is not None}
    for metric in ("cosine", "ip", "l2"):
        got = {}
        for x in sketch.search(queries, index, 5, metric, block=random.Random(1).choice((16, 40))).collect():
            got.setdefault(x["query"], {})[x["rank"]] = (x["hit"], x["distance"])
        assert set(got) == {"v001", "v007", "same", "zero"}
        for name, ranks in got.items():
            q = np.array(held[name])
            scored = []
            for m, v in held.items():
                x = np.zeros(len(q))
                x[: min(len(q), len(v))] = v[: len(q)]
                norm = np.sqrt((q @ q) * (x @ x))
                d = {"ip": -(q @ x), "l2": np.linalg.norm(q - x), "cosine": min(2, max(0, 1 - (q @ x / norm if norm else 0)))}[metric]
                scored.append((d, m))
            for rank, (d, m) in enumerate(sorted((round(d, 7), m) for d, m in scored)[:5], 1):
                assert abs(ranks[rank][1] - d) < 1e-6
