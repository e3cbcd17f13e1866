"""Distributed ranks, fits and searches against numpy, with one hot group, ties and nulls."""

import numpy as np
import pytest

from weftmark import schema
from weftmark.functions import linalg
from weftmark.operators import direction, index, metrics, ordered, sketch, stats


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_over_task_borders(spark, many_tasks):
    from pyspark.sql import functions as F

    r = np.random.default_rng(0)
    rows = [("hot", int(v), 1) for v in r.integers(0, 10**6, 3000)] + [(None, i, 2) for i in range(50)] + [("z", 5, 7)]
    rows = list({(g, o): (g, o, v) for g, o, v in rows}.values())
    got = ordered.running_sums(spark.createDataFrame(rows, "g string, o long, v long").repartition(5), ["g"], [F.desc("o")], ["v"])
    parts = got.select(F.col("g"), "o", "v_upto").collect()
    for g in ("hot", None, "z"):
        mine = sorted(((o, v) for h, o, v in rows if h == g), reverse=True)
        want = dict(zip([o for o, _ in mine], np.cumsum([v for _, v in mine]).tolist(), strict=True))
        assert {p["o"]: p["v_upto"] for p in parts if p["g"] == g} == want


def test_ranking_of_one_method_with_ties(spark, many_tasks):
    r = np.random.default_rng(1)
    s, y = r.integers(0, 60, 4000) / 10, (r.random(4000) < 0.3).astype(int)
    rows = [("m", i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y, strict=True))]
    frame = spark.createDataFrame(rows, "method string, pair_no int, score double, label int")
    curve = metrics.roc_curve(frame, ["method"])
    t = np.unique(s)[::-1]
    tpr, fpr = np.array([(y[s >= x].sum()) / y.sum() for x in t]), np.array([((1 - y)[s >= x].sum()) / (1 - y).sum() for x in t])
    got = sorted(((-c["threshold"], c["tpr"], c["fpr"]) for c in curve.collect()))
    assert np.allclose(got, np.column_stack([-t, tpr, fpr]))
    area = np.trapezoid(np.append(0, tpr), np.append(0, fpr))
    assert np.isclose(metrics.roc_auc(curve, ["method"]).collect()[0]["auc"], area)
    order = np.lexsort((np.arange(4000), -s))
    hits = np.cumsum(y[order])
    assert np.isclose(metrics.average_precision(frame, ["method"]).collect()[0]["ap"], (y[order] * hits / np.arange(1, 4001)).sum() / y.sum())
    none = frame.where("label = 0")
    assert metrics.average_precision(none, ["method"]).collect()[0]["ap"] is None and metrics.roc_auc(metrics.roc_curve(none, ["method"]), ["method"]).collect()[0]["auc"] is None
    assert metrics.roc_curve(frame.limit(0), ["method"]).isEmpty()


def test_quantiles_and_gini_of_a_hot_group(spark, many_tasks):
    r = np.random.default_rng(2)
    groups = {"hot": r.gamma(2, size=5000), "two": np.array([1.0, 3.0]), "one": np.array([2.0]), "flat": np.full(30, 4.0)}
    frame = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, x double")
    for row in stats.profile(frame, ["g"], "x").collect():
        v = np.sort(groups[row["g"]])
        q = np.quantile(v, np.linspace(0.05, 0.95, 8)) / v.mean()
        assert np.allclose([row[f"q{i}"] for i in range(8)], q)
        n = len(v)
        assert np.isclose(row["gini"], 2 * (np.arange(1, n + 1) * v).sum() / (n * v.sum()) - (n + 1) / n)


def test_two_samples_of_a_hot_group(spark, many_tasks):
    r = np.random.default_rng(3)
    a, b = np.round(r.normal(size=2000), 2), np.round(r.normal(0.3, 1, size=900), 2)
    rows = [("g", float(x), True) for x in a] + [("g", float(x), False) for x in b]
    t = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in t)
    assert np.isclose(stats.ks_2samp(spark.createDataFrame(rows, "k string, x double, own boolean"), ["k"], "x", "own").collect()[0]["ks"], want)


def labelled(spark, n=400, seed=4):
    r = np.random.default_rng(seed)
    names = list(schema.DIRECTION_WEIGHTS)
    x = r.normal(size=(n, len(names))) * np.linspace(0.1, 2, len(names))
    x[:, 3] = 0.0  # a feature without spread
    y = (1 / (1 + np.exp(-(x[:, 0] * 4 + x[:, 5])))) > r.random(n)
    rows = [(f"a{i}", f"b{i}", ["quant", "sft"][i % 2], "a->b" if t else "b->a", *map(float, v)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    kind = "a string, b string, relation string, truth string, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows + [("p", "q", "none", "none", *[9.0] * len(names))], kind), x, y.astype(float)


def test_fit_on_sums_is_the_fit_on_rows(spark):
    frame, x, y = labelled(spark)
    got = index.fit_direction(frame.repartition(7), l2=0.5)
    assert np.allclose([got[n] for n in schema.DIRECTION_WEIGHTS], linalg.fit_logistic(x, y, 0.5), atol=1e-8)
    assert index.fit_direction(frame.where("truth = 'none'")) == dict(schema.DIRECTION_WEIGHTS)


def test_fit_report_by_relation(spark):
    frame, _, _ = labelled(spark)
    weights, report = index.fit_report(frame.where("truth != 'none'"), test=0.3)
    rows = {(r["part"], r["relation"]): r for r in report.collect()}
    assert set(rows) == {(p, x) for p in ("train", "test") for x in ("quant", "sft", None)}
    assert sum(rows[p, None]["n"] for p in ("train", "test")) == 400 and rows["test", None]["accuracy_answered"] > 0.6 and weights["vocab_delta"] > 0
    assert direction.verdict(frame, weights).count() == 401


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_pruned_search_finds_what_the_full_one_does(spark, metric):
    r = np.random.default_rng(5)
    homes = r.normal(size=(12, 16))
    x = homes[r.integers(0, 12, 900)] + 0.1 * r.normal(size=(900, 16))
    x[5] = x[6] = x[7]  # ties
    x[8] = 0.0
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(2000, None)]
    frame = spark.createDataFrame(rows, "model long, vector array<double>")
    asked = frame.where("model % 45 < 9")
    want = sketch.search(asked, frame, 7, metric).collect()
    got = sketch.pruned_search(asked, frame, 7, metric, block=64).collect()
    # lengths are differences of squares, so that equal vectors lie some 1e-8 apart and their order is left open
    flat = lambda found: sorted((f["query"], f["rank"], f["hit"] if metric == "cosine" else None, round(f["distance"], 6)) for f in found)
    assert flat(got) == flat(want) and len(got) == 7 * 180
    few = sketch.pruned_search(asked, frame.where("model < 4"), 7, metric, lists=3).collect()
    assert flat(few) == flat(sketch.search(asked, frame.where("model < 4"), 7, metric).collect())
    assert sketch.pruned_search(asked, frame.where("model = 2000"), 7, metric).isEmpty()


def test_pruned_candidates_and_widths(spark):
    r = np.random.default_rng(6)
    frame = spark.createDataFrame([(f"m{i}", [float(v) for v in row]) for i, row in enumerate(r.normal(size=(40, 5)) + 2)], "model string, vector array<double>")
    flat = lambda f: sorted((x["query"], x["hit"], x["rank"]) for x in f.collect())
    assert flat(sketch.candidate_parents(frame, frame, 4, lists=5)) == flat(sketch.candidate_parents(frame, frame, 4))
    with pytest.raises(ValueError, match="widths"):
        sketch.pruned_search(frame, spark.createDataFrame([("x", [1.0])], "model string, vector array<double>"))
    with pytest.raises(ValueError, match="metric"):
        sketch.pruned_search(frame, frame, metric="ip")
