"""Paths that only large groups take: blocks of a trie join, long chains, tries by themselves."""

import random

import numpy as np
import pytest

from weftmark.llm import jaccard_join, tries
from weftmark.llm.components import components


def brute(sets, labels=None, side=None):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if labels is not None and labels[i] == labels[j]:
                up[find(i)] = find(j)
    for i in range(len(sets)):
        for j in range(i):
            if side is not None and side[i] == side[j]:
                continue
            both = len(sets[i] & sets[j])
            if 7 * both >= 3 * (len(sets[i]) + len(sets[j])):
                up[find(i)] = find(j)
    return sorted(sorted(x for x in range(len(sets)) if find(x) == f) for f in {find(x) for x in range(len(sets))})


@pytest.mark.parametrize("seed", range(12))
def test_trie_links_equal_all_pairs(seed):
    r = random.Random(seed)
    base = [[r.randrange(200) for _ in range(r.randint(3, 40))] for _ in range(5)]
    sets = []
    for _ in range(60):
        s = {t for t in r.choice(base) if r.random() > 0.12} | {r.randrange(400) for _ in range(r.randint(0, 6))}
        sets.append(s or {1})
    labels = np.array([i % 50 for i in range(60)]) if seed % 3 == 1 else None
    side = np.array([r.randrange(2) for _ in sets]) if seed % 3 == 2 else None
    links = tries.link(
        np.arange(60), np.array([len(s) for s in sets]), [np.array(sorted(s)) for s in sets], labels, side
    )
    up = list(range(60))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    if labels is not None:
        for i in range(50, 60):
            up[find(i)] = find(i - 50)
    for a, b in links:
        assert 7 * len(sets[a] & sets[b]) >= 3 * (len(sets[a]) + len(sets[b]))
        up[find(a)] = find(b)
    got = sorted(sorted(x for x in range(60) if find(x) == f) for f in {find(x) for x in range(60)})
    assert got == brute(sets, labels, side)


def test_blocks_of_a_large_group(spark, monkeypatch):
    r = random.Random(9)
    text = [f"v{i}" for i in range(80)]
    docs = []
    for i in range(70):
        words = list(text)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(80)] = f"u{r.randrange(9)}"
        docs.append((i, " ".join(words[: r.randint(50, 80)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    whole = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame).collect()}
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 400)
    cut = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in docs]
    want = {x: group[0] for group in brute(sets) for x in group}
    assert whole == want and cut == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
