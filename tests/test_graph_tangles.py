"""Cycles, levels, detours and trees on graphs whose paths cannot be listed, against plain Python."""

import random
import time

from pyspark.sql import functions as F

from weftmark.operators import export, graph, rights

EDGE = "parent string, child string, confidence double"


def reaches(edges, a, b):
    out, todo = set(), [a]
    while todo:
        for p, c in edges:
            if p == todo[0] and c not in out:
                out.add(c)
                todo.append(c)
        todo.pop(0)
    return b in out


def broken(rows):
    """The least edge on a cycle goes, one after another."""
    left = {(p, c): w for p, c, w in rows if p != c}
    while True:
        on = [(w, p, c) for (p, c), w in left.items() if reaches(left, c, p)]
        if not on:
            return set(left)
        del left[min(on)[1:]]


def test_cycles_of_random_graphs_lose_the_same_edges(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"n{i}" for i in range(12)]
        rows = [(*p, round(rng.random(), 1)) for p in {(rng.choice(names), rng.choice(names)) for _ in range(30)}]
        left = graph.break_cycles(spark.createDataFrame(rows, EDGE))
        assert {(r["parent"], r["child"]) for r in left.collect()} == broken(rows)


def test_strong_components_of_a_random_graph(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(20)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(34)}
    want = {}
    for a in names:
        mine = [b for b in names if b != a and reaches(pairs, a, b) and reaches(pairs, b, a)]
        if mine:
            want[a] = min([a, *mine])
    got = graph.strong_components(spark.createDataFrame([(*p, 0.5) for p in pairs], EDGE))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    on = {(r["parent"], r["child"]) for r in graph.cycle_edges(spark.createDataFrame([(*p, 0.5) for p in pairs], EDGE)).collect()}
    assert on == {(p, c) for p, c in pairs if reaches(pairs, c, p)}


def test_a_thousand_cycles_take_a_handful_of_rounds(spark, monkeypatch):
    rows = [(f"{i}-{j}", f"{i}-{(j + 1) % 4}", 0.1 + ((i * 7 + j * 3) % 10) / 20) for i in range(1000) for j in range(4)]
    written = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append(label) or real(df, label))
    left = graph.break_cycles(spark.createDataFrame(rows, EDGE))
    least = {i: min((w, p, c) for p, c, w in rows[4 * i : 4 * i + 4])[1:] for i in range(1000)}
    assert {(r["parent"], r["child"]) for r in left.collect()} == {(p, c) for p, c, _ in rows} - set(least.values())
    assert len(written) < 15


def layered(spark, layers, width):
    rows = [(f"l{i:02d}-{a}", f"l{i + 1:02d}-{b}", 0.5) for i in range(layers - 1) for a in range(width) for b in range(width)]
    return spark.createDataFrame(rows, EDGE), rows


def test_fourteen_dense_layers(spark):
    """3 ** 13 paths; levels, detours and the tree do not list them."""
    edges, rows = layered(spark, 14, 3)
    skips = spark.createDataFrame([("l00-0", "l02-1", 0.4), ("l03-2", "l13-0", 0.3)], EDGE)
    every = edges.unionAll(skips)
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child"))
    began = time.monotonic()
    assert {r["node"]: r["level"] for r in graph.topological_levels(every, nodes).collect()} == {f"l{i:02d}-{a}": i for i in range(14) for a in range(3)}
    kept, gone = graph.transitive_reduction(every)
    via = {(r["parent"], r["child"]): r["via"] for r in gone.collect()}
    assert via[("l00-0", "l02-1")] == "l00-0 -> l01-0 -> l02-1" and len(via) == 2
    assert via[("l03-2", "l13-0")].split(" -> ") == ["l03-2", *[f"l{i:02d}-0" for i in range(4, 14)]]
    assert kept.count() == len(rows)
    assert time.monotonic() - began < 120


def test_levels_of_cycles_and_what_lies_below(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("c", "b", 0.5), ("c", "d", 0.5), ("a", "e", 0.5)], EDGE)
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    assert {r["node"]: r["level"] for r in graph.topological_levels(edges, nodes).collect()} == {"a": 0, "f": 0, "e": 1, "b": 2, "c": 2, "d": 2}


def test_reduction_keeps_weighted_edges_if_asked(spark):
    rows = [("a", "b", 0.9, None), ("b", "c", 0.8, None), ("a", "c", 0.7, 0.4)]
    edges = spark.createDataFrame(rows, EDGE + ", weight double")
    assert [r["via"] for r in graph.transitive_reduction(edges)[1].collect()] == ["a -> b -> c"]
    assert graph.transitive_reduction(edges, keep_weighted=True)[1].isEmpty()


def test_tree_with_cycle_weights_and_depth_limit(spark):
    kind = "parent string, child string, relation string, confidence double, weight double"
    edges = spark.createDataFrame([("a", "t", "merge", 0.9, 0.6), ("b", "t", "merge", 0.9, 0.4), ("c", "a", "sft", 0.75, None), ("a", "c", "sft", 0.5, None)], kind)
    text = [r["line"] for r in export.ancestor_tree(edges, "t").orderBy("line_no").collect()]
    assert text == [
        "t", "|-- a: merge at 0.90, weight 0.60", "|   `-- c: sft at 0.75", "|       `-- a: sft at 0.50", "|               (named above, not followed)", "`-- b: merge at 0.90, weight 0.40",
    ]
    assert [r["line"] for r in export.ancestor_tree(edges, "b").collect()] == ["b", "`-- (no parent found)"]
    deep, _ = layered(spark, 6, 1)
    lines = [r["line"] for r in export.ancestor_tree(deep, "l05-0", max_depth=2).orderBy("line_no").collect()]
    assert lines == ["l05-0", "`-- l04-0: derived at 0.50", "    `-- l03-0: derived at 0.50", "        `-- (earlier ancestors left out)"]


def test_report_and_conflict_lines(spark):
    kind = "parent string, child string, relation string, confidence double, weight double"
    edges = spark.createDataFrame([("base", "t", "merge", 0.9, 0.7), ("mit-one", "t", "merge", 0.85, 0.3)], kind)
    facts = rights.facts(spark.createDataFrame([("t", "apache-2.0"), ("base", "cc-by-nc-4.0"), ("mit-one", "mit")], "model string, declared string"))
    found = rights.conflicts(facts, edges)
    lines = [r["line"] for r in export.conflict_lines(found).orderBy("line_no").collect()]
    assert lines[0] == "HIGH: noncommercial_ancestor at 0.90" and lines[-1] == "    along base -> t"
    assert " ".join(x.strip() for x in lines[1:-1]) == found.collect()[0]["message"] and all(len(x) <= 76 for x in lines[1:-1])
    assert [r["line"] for r in export.conflict_lines(found.limit(0)).collect()] == ["no conflict"]
    cost = spark.createDataFrame([(5 << 20, 12, 2.5, 50 << 20)], "bytes long, requests long, seconds double, full_size long")
    text = "\n".join(r["line"] for r in export.report("t", edges, found, cost, 7).orderBy("line_no").collect())
    for part in (
        "# t", "|-- base: merge at 0.90, weight 0.70", "| `t` | `base` | 0.700 | 0.90 |", "| **HIGH** | `noncommercial_ancestor` | 0.90 |",
        "`read 5.0 MiB out of 50.0 MiB (a share of 1 in 10), 2.5 s, 12 requests`", "7 candidates, of which 3 in the lineage, by 2 edges",
    ):
        assert part in text
    none = spark.createDataFrame([(0, 0, 1.0, 0)], "bytes long, requests long, seconds double, full_size long")
    assert none.select(export.transfer_line(*[F.col(c) for c in ("seconds", "bytes", "full_size", "requests")]).alias("x")).collect()[0]["x"] == "bytes not counted, 1.0 s"


def test_wording_of_messages(spark):
    rows = [("a", "violator-base", "may descend from violator-base. Human review required."), ("a", "b", "a violates the terms of b"), ("a", "b", None)]
    got = rights.wording(spark.createDataFrame(rows, "descendant string, ancestor string, message string")).collect()
    assert [(r["accusing"], r["hedged"]) for r in got] == [(False, True), (True, False), (False, False)]
