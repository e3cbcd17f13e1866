"""Evaluation axes: outgroup rerun, merge cases and decoys against written-out answers."""

from weftmark.operators import graph, metrics

EDGES = [("r", "s", "sft"), ("r", "l", "lora"), ("r", "q", "quant"), ("s", "c", "cpt"), ("s", "m", "merge"), ("c", "m", "merge"), ("q", "z", "sft")]


def edges(spark):
    return spark.createDataFrame(EDGES, "parent string, child string, relation string")


def test_sibling_outgroups(spark):
    got = {tuple(r) for r in metrics.sibling_outgroups(edges(spark), graph.closure(edges(spark))).collect()}
    # c's only sibling m descends from it, z has no sibling, q is no edge without a trace
    assert got == {("r", "s", "l"), ("r", "l", "q")}


def test_outgroup_rerun_counts_what_moved(spark):
    shape = "a string, b string, relation string, truth string, predicted string, llr double"
    before = spark.createDataFrame([("r", "s", "sft", "a->b", "unknown", 0.1), ("r", "l", "lora", "a->b", "a->b", 2.0), ("x", "y", "sft", "a->b", "a->b", 5.0)], shape)
    after = spark.createDataFrame([("r", "s", "sft", "a->b", "a->b", 1.1), ("r", "l", "lora", "a->b", "a->b", 2.0)], shape)
    got = {(r["run"], r["relation"]): r for r in metrics.outgroup_rerun(before, after).collect()}
    assert len(got) == 6 and got["without", None]["n"] == got["with", None]["n"] == 2
    assert got["without", "sft"]["abstained"] == 1 and got["with", "sft"]["accuracy"] == 1.0
    assert [got["with", k]["llr_changed"] for k in ("sft", "lora", None)] == [1, 0, 1]


def test_merge_cases_and_decoys(spark):
    truth = spark.createDataFrame([("m", "s", 0.7, "linear"), ("m", "c", 0.3, "linear"), ("n", "r", None, "ties"), ("n", "l", None, "ties")], "child string, parent string, weight double, method string")
    models = spark.createDataFrame([(m,) for m in "rslqczmn"], "model string")
    bases = spark.createDataFrame([("m", "r")], "child string, base string")
    below = spark.createDataFrame([("n", "z")], "ancestor string, descendant string")
    for n, want in ((0, 2), (2, 4), (99, None)):
        made = [tuple(r) for r in metrics.merge_decoys(truth, models, below, bases, n).collect()]
        by = {k: {c for x, c in made if x == k} for k in "mn"}
        assert len(made) == len(set(made)) and {"s", "c"} <= by["m"] and not by["m"] & {"m", "r"} and not by["n"] & {"n", "z"}
        assert want is None or all(len(x) == want for x in by.values())
    assert by["m"] == set("sclqzn") and by["n"] == set("rlsqcm")
    found = spark.createDataFrame([("m", "s", 0.6, True, 0.1, 0.9), ("m", "c", 0.0, False, 0.1, 0.9), ("m", "q", 0.4, True, 0.1, 0.9)], "child string, candidate string, weight double, selected boolean, residual double, r2 double")
    got = {r["child"]: r for r in metrics.merge_cases(truth, found).collect()}
    m, n = got["m"], got["n"]
    assert abs(m["mae"] - (0.1 + 0.3 + 0.4) / 3) < 1e-12 and abs(m["mae_true_parents"] - 0.2) < 1e-12 and m["precision"] == m["recall"] == m["f1"] == 0.5
    assert n["mae"] == 0.5 and n["recall"] == 0.0 and n["residual"] is None and n["n_parents"] == 2
