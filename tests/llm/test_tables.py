"""Centroid rounds, the conversation trie and line dedup against plain Python, on awkward and on random tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import floor, inf, isfinite, nan

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftmark.llm import line_dedup as lines
from weftmark.llm.centroids import Exponion, exponion_clusters, squared_distances, with_inertia
from weftmark.llm.conversation_trie import conversation_trie
from weftmark.llm.ordered_runs import numbered

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_rounds(rows, k, rounds, dims, scale, seed):
    kept = [(i, [floor(scale * float(x)) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}"), r[1]))
    centroids = [list(v) for _, v in ranked[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for a, (_, v) in zip(at, kept, strict=True) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [near(v) for _, v in kept]
    sums = Counter()
    for d, j in last:
        sums[j] += d
    return sorted(
        ((i, j, d, sums[j], sum(sums.values()), sha(",".join(map(str, centroids[j])))) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str
    )


def clustered(frame, **how):
    got = with_inertia(exponion_clusters(frame, **how)).drop("scanned")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_centroids_with_ties_repeats_nulls_and_unusable_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(300)]  # a small grid: many equal distances
    rows += [(7, [1.0, 1.0, 1.0, 1.0])] * 5 + [(None, [0.5, 0.25, -0.75, 2.0]), (None, [9.0, 9.0, 9.0, 9.0])]
    bad = [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 1.0, 1.0]), (904, [nan, 0.0, 0.0, 0.0]), (905, [inf, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "clash", 1.5, 3) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, upper double, cluster int")
    for k, rounds, scale in ((9, 5, 1), (3, 2, 256), (1, 2, 1), (400, 1, 1), (6, 0, 3)):
        assert clustered(frame.repartition(3), k=k, rounds=rounds, dims=4, scale=scale) == plain_rounds(rows, k, rounds, 4, scale, "2")
    assert clustered(frame.where("vec_id >= 900"), dims=4) == []


def test_centroid_components_are_held_to_their_range(spark):
    frame = spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0]), (3, [1e300, 4e5])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["distance"] for r in exponion_clusters(frame, k=1, rounds=0, dims=2, seed="2").assigned.collect()}
    top = 1 << 27
    points = {1: (top, -top), 2: (0, 0), 3: (top, 256 * 400000)}
    home = min(points, key=lambda i: sha(f"2:{i}"))
    assert got == {i: sum((a - b) ** 2 for a, b in zip(p, points[home], strict=True)) for i, p in points.items()}


def test_exponion_measures_less_than_everything_and_keeps_ties():
    rng = np.random.default_rng(3)
    homes = rng.integers(-400, 400, (40, 64))
    x = homes[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 64))
    centroids = x[:40].astype(np.int64)
    state = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x))
    before, measured = centroids, []
    for _ in range(5):
        at, upper, lower, scanned = Exponion.of(centroids, before).assign(x, *state)
        assert (at == squared_distances(x, centroids).argmin(1)).all()
        measured.append(int(scanned.sum()))
        state, before = (at, upper, lower), centroids
        centroids = np.array([x[at == j].sum(0) // (at == j).sum() if (at == j).any() else centroids[j] for j in range(40)])
    assert measured[0] == 40 * len(x) and max(measured[3:]) < 2 * len(x)


def plain_trie(rows, group, most):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0, hashlib.sha256((str(len(role.encode())) + ":" + role + text).encode()).digest()), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = turns.get(c - int(np.fmod(c, group)), [])
        built[c] = tuple(base[:h] + own[h:])
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for seq in nodes:
        if seq:
            kids[seq[:-1]] += 1
    for seq, members in nodes.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += kids[seq] == 0
            saved[seq[:d]] += (len(members) - 1) * len(seq[-1][1].encode()) if seq else 0
    return sorted(
        (
            (min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(s))))
            for s, m in nodes.items()
        ),
        key=str,
    )


CONV = "conv_id long, turn long, role string, text string, p int, g string, node string"


def grown(frame, **how):
    return sorted((tuple(r) for r in conversation_trie(frame, **how).collect()), key=str)


def test_trie_against_plain_python(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(-7, 90), 1000, 1003, 10**15 + 2]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "system", None]), rng.choice(["a", "b", "", None, "é\U0001f600"])))
    rows += [(5, 0, "user", "a")] * 3 + [(None, 0, "user", "lost"), (3, 2, "us", "era"), (8, 2, "user", "a")]
    frame = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], CONV).repartition(5)
    assert grown(frame) == plain_trie(rows, 5, 9)
    assert grown(frame, group=3, most=4) == plain_trie(rows, 3, 4)


def test_trie_of_many_copies_one_conversation_or_none(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(200) for t in range(4)] + [(500, 0, "user", "x" * 300_000), (501, 0, "user", "turn 0")]
    frame = spark.createDataFrame([(*r, 1, "", "") for r in rows], CONV)
    assert grown(frame.repartition(7)) == plain_trie(rows, 5, 9)
    one = [(4, t, "user", "again") for t in range(120)]
    assert grown(spark.createDataFrame([(*r, 1, "", "") for r in one], CONV)) == plain_trie(one, 5, 9)
    assert grown(spark.createDataFrame([], CONV)) == []


def test_numbers_go_on_over_tasks(spark):
    rows = [(k, v) for k, n in ((1, 3), (2, 4000), (3, 1), (4, 700)) for v in range(n)]
    frame = spark.createDataFrame(rows, "k long, v long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(frame, "k", [F.col("v").desc()])
        sizes = Counter(k for k, _ in rows)
        assert {(r["k"], r["v"]): r["p"] for r in got.collect()} == {(k, v): sizes[k] - v for k, v in rows}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_lines(rows, documents, min_chars):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    found = defaultdict(set)
    for k, text in rows:
        for line in (text or "").split("\n"):
            found[key(line)].add((k, text or ""))
    gone = {x for x, docs in found.items() if len(x) >= min_chars and len(docs) >= documents}
    out = []
    for k, text in rows:
        all_ = (text or "").split("\n")
        kept = [line for line in all_ if key(line) not in gone]
        out.append((k, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_against_plain_python(spark, docs, rows):
    rng = random.Random(2)
    some = ["Menu", "  menu\t", "HOME | about", "", " ", "\x0bx\x0c", "Été", "été", " menu", "once"]
    made = [(i, "\n".join(rng.choice(some) if rng.random() < 0.8 else f"own {rng.random()}" for _ in range(rng.randint(1, 12)))) for i in range(120)]
    made += [(None, "menu\nmine"), (None, "menu\nours"), (None, None), (200, None), (201, ""), (3, "menu"), (3, "menu")] + [(300, "menu\n" * 30_000 + "end\nmenu")]
    made += [(400 + i, "twin") for i in range(3)] + [(403, "twin")] * 4  # four documents
    frame = spark.createDataFrame([(*r, "clash", 1, True) for r in made], "doc_id long, text string, h string, at int, keep boolean").repartition(9)
    for documents, min_chars in ((10, 1), (5, 1), (4, 1), (2, 4), (1, 0)):
        got = sorted((tuple(r) for r in lines.line_dedup(frame, documents, min_chars).collect()), key=str)
        assert got == plain_lines(made, documents, min_chars)
    mine = [(r[0], r[1]) for r in rows]
    assert sorted((tuple(r) for r in lines.line_dedup(docs, 2, 1).collect()), key=str) == plain_lines(mine, 2, 1)


def test_keep_bitmaps_hold_no_text(spark, empty):
    frame = spark.createDataFrame([(i, f"menu\nbody {i}\n\nfoot") for i in range(12)], "doc_id long, text string")
    got = lines.keep_bitmaps(frame)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "bits", "keep"]
    for r in got.collect():
        assert lines.unpack(r["keep"], r["bits"]).tolist() == [False, True, True, False] and (r["n_lines"], r["n_dropped"]) == (4, 2)
    assert lines.line_dedup(empty).isEmpty() and lines.keep_bitmaps(empty).isEmpty()


def test_runs_across_batches_and_tasks():
    """Every way to cut a sorted stream into tasks and batches finds the same lines."""
    rng = random.Random(9)
    rows = sorted({(bytes([h]) * 16, rng.randint(0, 40), 0, rng.randint(0, 3)) for h in range(6) for _ in range([1, 9, 10, 60, 11, 30][h])})
    docs = defaultdict(set)
    for h, d, k, _ in rows:
        docs[h].add((d, k))
    want = sorted(r for r in rows if len(docs[r[0]]) >= 10)
    for _ in range(200):
        tasks = sorted(rng.sample(range(len(rows)), rng.randint(0, 5)))
        held, known, got = [], set(), []
        for a, b in zip([0, *tasks], [*tasks, len(rows)], strict=True):
            cuts = sorted(rng.sample(range(a, b + 1), min(b - a, rng.randint(0, 6))))
            parts = [rows[x:y] for x, y in zip([a, *cuts], [*cuts, b], strict=True)]
            batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in p], t) for i, t in ((0, pa.binary()), (2, pa.int64()), (1, pa.int64()), (3, pa.int32()))], names=["h", "k", "d", "at"]) for p in parts]
            for out in lines.stream_runs(iter(batches), 10):
                for r in out.to_pylist():
                    row = (r["h"], r["d"], r["k"], r["at"])
                    (got if r["state"] == lines.DROP else held if r["state"] == lines.OPEN else []).append(row)
                    if r["state"] == lines.KNOWN:
                        known.add(r["h"])
        open_ = defaultdict(set)
        for h, d, k, _ in held:
            open_[h].add((d, k))
        got += [r for r in held if r[0] in known or len(open_[r[0]]) >= 10]
        assert sorted(got) == want
