"""Small components finished in groups against rounds and plain Python; rounds that broadcast nothing."""

import random

import pytest

from tests.test_graph_tangles import EDGE, broken, reaches
from weftmark.operators import graph


@pytest.fixture(params=[256, 5, 0])
def small(request, monkeypatch):
    """All components small, some, none."""
    monkeypatch.setattr(graph, "SMALL", request.param)
    monkeypatch.setattr(graph, "GROUP", 200)


def tangled(seed, parts=4, nodes=5, edges=8):
    rng = random.Random(seed)
    names = [[f"{i}/{j}" for j in range(nodes)] for i in range(parts)]
    met = {(rng.choice(x), rng.choice(x)) for x in names for _ in range(rng.randint(2, edges))}
    return [(*p, round(rng.random(), 1)) for p in sorted(met)]


def test_groups_and_rounds_agree(spark, small):
    rows = tangled(4)
    edges = spark.createDataFrame(rows, EDGE)
    pairs = {(p, c) for p, c, _ in rows}
    names = sorted({x for p in pairs for x in p})
    far = {(a, b) for a in names for b in names if a != b and reaches(pairs, a, b)}
    up = {(r["ancestor"], r["descendant"]): r["depth"] for r in graph.closure(edges).collect()}
    assert set(up) == far | pairs and all((d == 1) == (x in pairs) for x, d in up.items())
    assert up == {(r["ancestor"], r["descendant"]): r["depth"] for r in graph.reach(edges).collect()}
    want = {a: min([a, *mine]) for a in names if (mine := [b for b in names if (a, b) in far and (b, a) in far])}
    assert {r["node"]: r["component"] for r in graph.strong_components(edges).collect()} == want
    assert {(r["parent"], r["child"]) for r in graph.break_cycles(edges).collect()} == broken(rows)


def test_nulls_and_loops_in_groups(spark, small):
    rows = [("a", "b", None), ("b", "a", float("nan")), ("c", "d", float("nan")), ("d", "c", None), ("x", "x", 0.5), (None, "a", 0.5), ("b", None, 0.5)]
    edges = spark.createDataFrame(rows, EDGE)
    up = {(r["ancestor"], r["descendant"], r["depth"]) for r in graph.closure(edges).collect()}
    assert up == {(r["ancestor"], r["descendant"], r["depth"]) for r in graph.reach(edges).collect()}
    left = {(r["parent"], r["child"]) for r in graph.break_cycles(edges.where("parent is not null and child is not null")).collect()}
    assert left == {("b", "a"), ("c", "d")}
    assert {r["node"]: r["component"] for r in graph.strong_components(edges).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert graph.closure(edges.limit(0)).isEmpty() and graph.strong_components(edges.limit(0)).isEmpty() and graph.break_cycles(edges.limit(0)).isEmpty()


@pytest.mark.parametrize("most", [256, 0])
def test_no_round_broadcasts(spark, monkeypatch, most):
    """Broadcasts of every round went through the driver: 13.9 GB for 120,000 parts."""
    monkeypatch.setattr(graph, "SMALL", most)
    edges = spark.createDataFrame(tangled(1, parts=2), EDGE)
    plans = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    graph.strong_components(edges)
    assert plans and not [x for x in plans if "Broadcast" in x]
    if most:
        assert len(plans) < 20


def test_breaking_cycles_broadcasts_nothing(spark, monkeypatch):
    """Rounds of widest paths joined by broadcasts: 36 of them, 2.4 GB, for 120,000 parts."""
    rows = [(f"n{i}", f"n{(i + 1) % 5}", 0.9 if i != 3 else 0.2) for i in range(5)]
    plans = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    left = graph.break_cycles(spark.createDataFrame(rows, EDGE))
    assert {(r["parent"], r["child"]) for r in left.collect()} == {x[:2] for x in rows} - {("n3", "n4")}
    assert plans and not [x for x in plans if "Broadcast" in x]


def test_cousins_are_met_by_their_topmost_ancestors(spark, monkeypatch):
    """Every pair was sent once for each ancestor of its first end."""
    chain = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n6", "left"), ("n6", "mid"), ("mid", "right"), ("lone", "apart")]
    loops = [("x", "y"), ("y", "x"), ("y", "p"), ("x", "q"), ("q", "q2"), ("z", "z"), ("z", "r"), ("r", "s"), ("z", "t")]
    rows = chain + loops
    names = sorted({n for e in rows for n in e})
    above = {n: {m for m in names if m != n and reaches(set(rows), m, n)} | ({n} if (n, n) in rows else set()) for n in names}
    pairs = [(a, b) for a in names for b in names if a < b]
    met = []
    real = graph._share
    monkeypatch.setattr(graph, "_share", lambda p, up, name: met.append((name, up.count())) or real(p, up, name))
    got = {(r["a"], r["b"]): r["label"] for r in graph.label_pairs(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(rows, "parent string, child string")).collect()}
    parents = {n: {p for p, c in rows if c == n} for n in names}
    for a, b in pairs:
        want = "a->b" if a in above[b] else "b->a" if b in above[a] else "sibling" if parents[a] & parents[b] else "cousin" if above[a] & above[b] else "none"
        assert got[a, b] == want, (a, b)
    assert dict(met)["cou"] < sum(map(len, above.values())) / 2


def test_edges_are_made_once(spark, monkeypatch, tmp_path):
    """The lineage was derived again, with its sums of lines, for the result; node names were told apart twice more for the labels."""
    rows = [(f"n{i}", f"n{(i + 1) % 5}", 0.9 if i != 3 else 0.2) for i in range(5)] + [("n1", "n1", 0.5), ("n0", "far", 0.1), ("n0", "far", 0.1)]
    spark.createDataFrame(rows, EDGE).write.parquet(f"{tmp_path}/edges")
    plans = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: plans.append((label, df.inputFiles(), df._jdf.queryExecution().executedPlan().toString())) or real(df, label))
    left = graph.break_cycles(spark.read.parquet(f"{tmp_path}/edges"))
    assert sorted(tuple(r) for r in left.collect()) == sorted(x for x in rows if x[0] != x[1] and x[:2] != ("n3", "n4"))
    reads = lambda files: any(str(tmp_path) in f for f in files)
    assert not reads(left.inputFiles()) and [label for label, files, _ in plans if reads(files)] == ["graph-kept"]
    assert [plan.count("Aggregate") for label, _, plan in plans if label == "graph-tagged"] == [0]


def plain_closure(rows):
    """(ancestor, descendant): depth, breadth first; a loop is a pair of its own."""
    below = {}
    for p, c in rows:
        below.setdefault(p, set()).add(c)
    up = {}
    for a in below:
        front, depth = below[a], 1
        while front:
            up |= {(a, d): depth for d in front}
            front, depth = {y for x in front for y in below.get(x, ()) if y != a and (a, y) not in up}, depth + 1
    return up


@pytest.mark.parametrize("large, sliced", [(1 << 16, 1 << 12), (1 << 16, 7), (30, 7), (12, 3)])
def test_closures_of_larger_components_in_slices(spark, monkeypatch, large, sliced):
    """Components of more than 256 edges, here one chain of families with cycles, took a round of tables a step."""
    rng = random.Random(5)
    rows = {(f"n{i + rng.randint(1, 5):03d}", f"n{i:03d}") for i in range(24) for _ in range(2)} | {("n004", "n019"), ("n007", "n007")}
    rows |= {(f"t{i}", f"t{i + 1}") for i in range(9)} | {(f"t{i}", f"u{i}") for i in range(9)}
    for name, value in (("SMALL", 8), ("GROUP", 300), ("LARGE", large), ("SLICE", sliced)):
        monkeypatch.setattr(graph, name, value)
    fronts = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: fronts.append(label) or real(df, label))
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(sorted(rows), "parent string, child string")).collect()]
    assert len(got) == len({x[:2] for x in got}) and {(a, d): n for a, d, n in got} == plain_closure(rows)
    assert ("graph-front" in fronts) == (large < len(rows))


def test_whole_slices_are_searched_together(monkeypatch):
    """Lots end where a slice ends, however the batches fall."""
    import pandas as pd

    monkeypatch.setattr(graph, "LARGE", 6)
    rows = [(f"{c}{i}", f"{c}{i + 1}", c, s, 4, i % 2 == s) for c in "abc" for s in (0, 1) for i in range(4)]
    frame = pd.DataFrame(rows, columns=["parent", "child", "component", "slice", "n", "mine"])
    want = plain_closure({r[:2] for r in rows})
    for step in (1, 3, 5, 24):
        out = pd.concat(graph._closures(frame.iloc[i : i + step] for i in range(0, len(frame), step)))
        assert len(out) == len(want) and {(a, d): n for a, d, n in out.itertuples(index=False)} == want


@pytest.mark.parametrize("last", [1 << 18, 40, 0])
def test_components_of_a_path_in_order_take_few_rounds(spark, monkeypatch, last):
    """Hooks were followed twice: a path of n names in order took n / 4 rounds."""
    monkeypatch.setattr(graph, "LAST", last)
    path = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)] + [(f"z{i}", f"z{(i * 7 + 3) % 10}") for i in range(10)]
    names = sorted({x for e in path for x in e})
    tables = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: tables.append(label) or real(df, label))
    edges = spark.createDataFrame(path, "parent string, child string")
    got = {r["node"]: r["component"] for r in graph.weak_components(spark.createDataFrame([(n,) for n in [*names, "lone"]], "node string"), edges).collect()}
    want = {n: n for n in [*names, "lone"]}
    for _ in names:
        for a, b in path:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want and len(tables) < 20


def test_lines_of_a_lineage_are_summed_once(spark, monkeypatch):
    """Scores of a predicted lineage summed all lines for each of its parts and axes."""
    import os

    from weftmark.plans import queries_graphs

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    truth, predicted, nodes = queries_graphs._lineages(spark, "/root/testdata/sf0.001")
    assert not [f for frame in (truth, predicted, nodes) for f in frame.inputFiles() if "lineitem" in f]
