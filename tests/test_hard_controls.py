"""Hard controls by label and by shape."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from weftmark.operators import meetings, metrics


def test_both_rules(spark):
    label = metrics.CONTROL_RELATIONS[0]
    cases = [("1", "50", False, label, True), ("1", "60", False, "unrelated", True), ("50", "60", False, None, False), ("1", "99", True, label, False), ("1", "98", False, label, True)]
    pairs = spark.createDataFrame([c[:4] for c in cases], "a string, b string, related boolean, relation string")
    shapes = spark.createDataFrame([("1", "s"), ("60", "s"), ("50", "t"), ("99", "s")], "model string, signature string")
    got = {(r["a"], r["b"]): r["hard"] for r in metrics.hard_controls(pairs, shapes).collect()}
    assert got == {(a, b): hard for a, b, _, _, hard in cases}
    assert {(r["model"], r["class_size"]) for r in metrics.signature_classes(shapes).collect()} == {("1", 3), ("60", 3), ("99", 3), ("50", 1)}


def plain_meetings(visits):
    kinds = {w: k for _, w, k in visits}
    met = {(a, b) for p, a, _ in visits for q, b, _ in visits if p == q and a < b}
    return {(a, b, kinds[a] == kinds[b]) for a, b in met}


@pytest.mark.parametrize("lot, piece", [(1 << 20, 1 << 10), (7, 3), (1, 1)])
def test_meetings_are_told_apart_in_lots(spark, monkeypatch, lot, piece):
    """All pairs of each part went through a shuffle, and with their names and shapes through two more."""
    for name, value in (("LOT", lot), ("HELD", 8 * lot), ("PIECE", piece)):
        monkeypatch.setattr(meetings, name, value)
    rng = random.Random(2)
    odd = [-(1 << 63), -5, 0, 1 << 40, (1 << 63) - 1]
    who = [*range(1000, 1030), *odd]
    visits = [(p, w, w % 3) for p in [-7, *range(40), 1 << 50] for w in rng.sample(who, rng.randint(1, 6)) for _ in range(2)] + [(99, w, w % 3) for w in who]
    frame = spark.createDataFrame(visits, "place long, who long, kind long").repartition(3)
    got = [tuple(r) for r in meetings.met_pairs(frame, len(visits)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_meetings(visits)
    few, half = visits, len(visits) // 2
    sent = [b for part in (few[:half], few[half:]) for b in meetings._sent(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part)], ["place", "who", "kind"])]))]
    rows = sorted((r for b in sent for r in b.to_pylist()), key=lambda r: (r["a"], r["same"]))
    back = pa.RecordBatch.from_pylist(rows, sent[0].schema)
    found = [tuple(r.values()) for k in (1, 7, 500) for b in meetings._received(back.slice(i, k) for i in range(0, len(back), k)) for r in b.to_pylist()]
    assert sorted(found) == sorted([*(plain_meetings(few[:half]) | plain_meetings(few[half:]))] * 3)
    assert meetings.met_pairs(frame.limit(0), 0).isEmpty()


def test_gaps_take_few_bytes():
    values = np.array([0, 1, 127, 128, 1 << 14, (1 << 14) - 1, (1 << 63) + 5, (1 << 64) - 1], dtype=np.uint64)
    data, ends = meetings._small(values)
    assert (meetings._large(data) == values).all() and np.diff(np.append(0, ends)).tolist() == [1, 1, 1, 2, 3, 2, 10, 10]


def test_pairs_are_not_joined_with_shapes(spark):
    from weftmark.plans import queries_tables

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    plan = queries_tables.hard_control_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in above and "Aggregate" not in above
