"""Comparisons in blocks of models against numpy, with unequal rows, widths, bins and samples."""

import numpy as np
import pytest

from weftmark.operators import baselines, blocks, pairs
from weftmark.sources.safetensors import sampled_runs

ROWS = "model string, tensor string, row_idx long, v array<double>"


def frame(spark, models):
    rows = [(m, t, i, row.tolist()) for m, ts in models.items() for t, x in ts.items() for i, row in enumerate(x)]
    return spark.createDataFrame(rows, ROWS).repartition(5)


def made(n, seed=0):
    r = np.random.default_rng(seed)
    base = {"w": r.normal(size=(40, 6)), "u": r.normal(size=(9, 5)), "only": r.normal(size=(3, 2))}
    out = {}
    for i in range(n):
        m = {t: x + 0.01 * r.normal(size=x.shape) for t, x in base.items()}
        if i % 3 == 1:
            m["w"] = m["w"][: 25 + i % 7]  # fewer rows
        if i % 5 == 2:
            m["u"] = r.normal(size=(9, 4))  # another width
        if i % 4 == 3:
            m["w"][r.random(m["w"].shape) < 0.3] = 0
            del m["only"]
        out[f"m{i:03d}"] = m
    out["m001"] = {t: x.copy() for t, x in out["m000"].items()}  # a copy
    return out


def want(models, a, b, c=None):
    found = {}
    for t in models[a]:
        xs = [models[m].get(t) for m in (a, b, *([c] if c else []))]
        if any(x is None for x in xs) or len({x.shape[1] for x in xs}) > 1:
            continue
        n = min(len(x) for x in xs)
        u, w = xs[0][:n], xs[1][:n]
        d = (u - w) ** 2
        s = [u.size, (u * w).sum(), (u * u).sum(), (w * w).sum(), d.sum(), d[u != 0].sum(), d[w != 0].sum(), (u == 0).sum(), (w == 0).sum(), ((u == 0) & (w == 0)).sum()]
        p, q = (u - xs[2][:n], w - xs[2][:n]) if c else (np.zeros(1), np.zeros(1))
        s += [(p * p).sum(), (q * q).sum(), (p * q).sum(), (xs[2][:n] ** 2).sum() if c else 0.0, float((u == w).all())]
        found[a, b, c, t] = s
    return found


def got(compared):
    return {(r["a"], r["b"], r["c"], r["tensor"]): [r[k] for k in (*blocks.PAIR, *blocks.TRIPLE)] + [float(r["identical"])] for r in compared.collect()}


def close(x, y):
    assert x.keys() == y.keys()
    for k in x:
        assert np.allclose(x[k], y[k], rtol=1e-9, atol=1e-12), k


def test_pairs_and_triples_of_few_models(spark):
    models = made(8)
    asks = [(a, b, None) for a in models for b in models if a < b] + [("m000", "m004", "m007"), ("m003", "m001", "m002"), ("m000", "m001", "m005")]
    expect = {}
    for a, b, c in asks:
        expect |= want(models, a, b, c)
    close(got(blocks.compare(frame(spark, models), spark.createDataFrame(asks, "a string, b string, c string"))), expect)


def test_more_models_than_a_bin_holds(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BIN", 4)
    monkeypatch.setattr(blocks, "CELLS", 60)  # several groups for each tensor
    models = made(30, 1)
    names = sorted(models)
    asks = [(names[i], names[(i + 1) % 30], None) for i in range(30)] + [("m002", "m009", "m017"), ("m028", "m005", "m001")]
    expect = {}
    for a, b, c in asks:
        expect |= want(models, a, b, c)
    bins = blocks.model_bins(spark.createDataFrame(asks, "a string, b string, c string")).groupBy("bin").count().collect()
    assert max(r["count"] for r in bins) == 4
    close(got(blocks.compare(frame(spark, models), spark.createDataFrame(asks, "a string, b string, c string"))), expect)


@pytest.mark.parametrize("n", [10, 16, 17, 255, 256, 300])
def test_sampled_rows_are_those_of_the_reader(spark, n):
    from pyspark.sql import functions as F

    for most in (1, 16, 32, 100):
        rows = spark.range(n + 5).where(blocks.in_sample(F.col("id"), F.lit(n).cast("long"), most))
        assert [r["id"] for r in rows.orderBy("id").collect()] == [i for a, b in sampled_runs(n, most) for i in range(a, b)]


def test_deltas_take_the_largest_shared_matrices_and_their_sampled_rows(spark):
    r = np.random.default_rng(3)
    big, mid, small = r.normal(size=(400, 8)), r.normal(size=(100, 8)), r.normal(size=(5, 2))
    models = {"a": {"big": big, "mid": mid, "small": small}, "b": {"big": big[:390] + 0.1, "mid": mid * 1.5, "small": small + 9}, "c": {"other": big}}
    asked = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "a string, b string")
    found = pairs.relative_deltas(frame(spark, models), asked, None, n_tensors=2, max_rows=32, min_cells=50)
    value = {(x["a"], x["b"]): x["delta"] for x in found.collect()}
    at = [i for f, e in sampled_runs(390, 32) for i in range(f, e)]
    rows = [i for f, e in sampled_runs(100, 32) for i in range(f, e)]
    num = ((models["a"]["big"][at] - models["b"]["big"][at]) ** 2).sum() + ((mid[rows] * 0.5) ** 2).sum()
    assert np.isclose(value["a", "b"], np.sqrt(num / ((models["b"]["big"][at] ** 2).sum() + ((1.5 * mid[rows]) ** 2).sum())))
    assert np.isclose(value["b", "a"], np.sqrt(num / ((big[at] ** 2).sum() + (mid[rows] ** 2).sum()))) and value["a", "c"] == float("inf")


def plain_cka(x, y):
    x, y = x - x.mean(0), y - y.mean(0)
    return np.linalg.norm(y.T @ x) ** 2 / (np.linalg.norm(x.T @ x) * np.linalg.norm(y.T @ y))


def test_cka_of_whole_and_of_drawn_matrices(spark):
    models = made(6, 4)
    asked = spark.createDataFrame([(a, b) for a in models for b in models if a < b], "a string, b string")
    for r in blocks.cka(frame(spark, models), asked).collect():
        x, y = models[r["a"]][r["tensor"]], models[r["b"]][r["tensor"]]
        n = min(len(x), len(y))
        assert r["cells"] == n * x.shape[1] and np.isclose(r["cka"], plain_cka(x[:n], y[:n]))
    one = asked.where("a = 'm000' and b in ('m001', 'm005')")
    drawn = {(r["b"], r["tensor"]): r for r in blocks.cka(frame(spark, models), one, n_rows=8, n_cols=3).collect()}
    assert drawn["m001", "w"]["cells"] == 24 and np.isclose(drawn["m001", "w"]["cka"], 1.0) and 0 <= drawn["m005", "w"]["cka"] <= 1


def test_cka_takes_all_rows_and_columns_of_large_matrices(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 64)
    monkeypatch.setattr(blocks, "FAN", 3)
    monkeypatch.setattr(blocks, "BAND", 4)
    r = np.random.default_rng(9)
    x = r.normal(size=(700, 10)) + 3
    models = {"a": {"w": x}, "b": {"w": x + r.normal(size=x.shape) * np.linspace(0, 2, 700)[:, None]}, "c": {"w": r.normal(size=(650, 10))}}
    asked = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "a string, b string")
    for k in blocks.cka(frame(spark, models), asked).collect():
        p, q = models[k["a"]]["w"], models[k["b"]]["w"]
        n = min(len(p), len(q))
        assert k["cells"] == n * 10 and np.isclose(k["cka"], plain_cka(p[:n], q[:n]), atol=1e-9)


def test_products_of_spread_layers_and_fused_attention(spark):
    r = np.random.default_rng(6)
    names = lambda i: {
        f"model.layers.{i}.self_attn.q_proj.weight": (12, 8), f"model.layers.{i}.self_attn.k_proj.weight": (10, 8),
        f"model.layers.{i}.mlp.up_proj.weight": (7, 8), f"model.layers.{i}.mlp.down_proj.weight": (8, 6),
    }
    base = {t: r.normal(size=s) for i in range(9) for t, s in names(i).items()}
    near = {t: x + 0.3 * r.normal(size=x.shape) for t, x in base.items()}
    fused = {f"transformer.h.{i}.attn.c_attn.weight": r.normal(size=(6, 12)) for i in range(2)}
    models = {"base": base, "near": near, "f1": fused, "f2": {t: x + 0.2 for t, x in fused.items()}}
    asked = spark.createDataFrame([("base", "near"), ("f1", "f2"), ("base", "f1")], "a string, b string")
    score = {(x["a"], x["b"]): x["score"] for x in baselines.huref(frame(spark, models), asked).collect()}
    cos = lambda x, y: (x * y).sum() / np.linalg.norm(x) / np.linalg.norm(y)
    parts = []
    for i in (0, 2, 3, 5, 6, 8):  # six of nine layers
        q, k, up, down = names(i)
        parts.append(cos(base[q] @ base[k].T, near[q] @ near[k].T))
        parts.append(cos(base[down][:, :6] @ base[up][:6], near[down][:, :6] @ near[up][:6]))
    assert np.isclose(score["base", "near"], (1 + np.mean(parts)) / 2)
    own = [cos(x[:, :4] @ x[:, 4:8].T, (x + 0.2)[:, :4] @ (x + 0.2)[:, 4:8].T) for x in fused.values()]
    assert np.isclose(score["f1", "f2"], (1 + np.mean(own)) / 2) and score["base", "f1"] == 0
