"""Jaccard links among integer sets by a prefix tree.

Sets are written in one global token order, the most frequent token first, and stored
in a compressed trie: sets with a common prefix share its nodes.  A probe walks the
trie with the overlap found so far, so shared prefixes are compared once.  A subtree is
left when its sizes cannot match the probe's, when the overlap so far plus what can
still come (the shorter of the two remainders) stays below the least overlap needed,
or when all its sets are known to be connected to the probe already.
"""

from __future__ import annotations

import numpy as np


class Unions:
    """Disjoint sets over 0..n-1; the smallest member stands for its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class _Node:
    __slots__ = ("run", "low", "high", "least", "most", "left", "ends", "children", "one")

    def __init__(self, run: np.ndarray, low: int):
        self.run = run  # tokens from the parent's end to this node's end
        self.low = self.high = low  # the sorted sets under it
        self.least = self.most = 0  # their smallest and largest size
        self.left = 0  # the most tokens that one of them has below this node
        self.ends = low  # sets low..ends end at this node
        self.children: list[_Node] = []
        self.one = -1  # a set under it once all are known to be connected


def _build(sets: list[np.ndarray], sizes: list[int]) -> _Node:
    """The compressed trie of sets that are sorted lexicographically."""
    root = _Node(np.empty(0, np.int64), 0)

    def fill(node: _Node, low: int, high: int, depth: int) -> None:
        stack = [(node, low, high, depth)]
        while stack:
            node, low, high, depth = stack.pop()
            node.low, node.high = low, high
            node.least, node.most = min(sizes[low:high]), max(sizes[low:high])
            node.left = max(len(s) for s in sets[low:high]) - depth
            at = low
            while at < high and len(sets[at]) == depth:
                at += 1
            node.ends = at
            while at < high:
                token, stop = sets[at][depth], at + 1
                while stop < high and sets[stop][depth] == token:
                    stop += 1
                first, last = sets[at], sets[stop - 1]
                shared = min(len(first), len(last))
                same = first[depth:shared] == last[depth:shared]
                run = shared - depth if same.all() else int(np.argmin(same))
                child = _Node(first[depth : depth + run], at)
                node.children.append(child)
                stack.append((child, at, stop, depth + run))
                at = stop

    fill(root, 0, len(sets), 0)
    return root


def _unite(root: _Node, unions: Unions) -> None:
    """Note the subtrees whose sets are connected from the start."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.children
    for node in reversed(order):
        roots = {unions.find(i) for i in range(node.low, node.ends)}
        roots |= {unions.find(c.one) if c.one >= 0 else -1 for c in node.children}
        if len(roots) == 1 and -1 not in roots:
            node.one = node.low


def link(
    names: np.ndarray,
    sizes: np.ndarray,
    tokens: list[np.ndarray],
    labels: np.ndarray | None = None,
    side: np.ndarray | None = None,
    share: tuple[int, int] = (3, 4),
) -> list[tuple[int, int]]:
    """Links that connect every pair of sets whose Jaccard similarity is at least ``share``.

    Returned are names (a, b) of verified links, as few as connect the same sets.  Sets
    with equal ``labels`` count as connected from the start.  With ``side``, only pairs of
    a 0 and a 1 are compared.
    """
    n = len(names)
    if n < 2:
        return []
    flat = np.concatenate(tokens)
    distinct, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), dtype=np.int64)
    rank[np.lexsort((distinct, -count))] = np.arange(len(distinct))
    ranks, shared = rank[place], count[place] > 1
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    coded = []
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        coded.append(np.sort(ranks[a:b][shared[a:b]]))  # a token of one set only overlaps nothing
    order = sorted(range(n), key=lambda i: coded[i].astype(">i8").tobytes())
    sets, size = [coded[i] for i in order], [int(sizes[i]) for i in order]
    which = [int(side[i]) for i in order] if side is not None else None
    unions = Unions(n)
    if labels is not None:
        first: dict[int, int] = {}
        for at, i in enumerate(order):
            unions.join(at, first.setdefault(int(labels[i]), at))
    root = _build(sets, size)
    if labels is not None:
        _unite(root, unions)
    mark = np.zeros(len(distinct) + 1, dtype=bool)
    up, down = share[0], share[0] + share[1]  # overlap >= up / down * (size + size)
    found: list[tuple[int, int]] = []
    for x in range(n):
        mine, have = sets[x], size[x]
        mark[mine] = True
        stack: list[tuple[_Node, int, bool]] = [(root, 0, False)]
        while stack:
            node, overlap, after = stack.pop()
            if after:  # all below was walked: is it one set by now?
                if node.high <= x and which is None:
                    mate = unions.find(x)
                    if all(unions.find(i) == mate for i in range(node.low, node.ends)) and all(
                        c.one >= 0 and unions.find(c.one) == mate for c in node.children
                    ):
                        node.one = node.low
                continue
            if node.low >= x:
                continue
            if node.one >= 0 and unions.find(node.one) == unions.find(x):
                continue
            if share[1] * node.most < share[0] * have or share[0] * node.least > share[1] * have:
                continue
            run = node.run
            if len(run):
                overlap += int(np.count_nonzero(mark[run]))
                rest = len(mine) - int(np.searchsorted(mine, run[-1], side="right"))
            else:
                rest = len(mine)
            if down * (overlap + min(rest, node.left)) < up * (have + max(node.least, 0)):
                continue
            for y in range(node.low, min(node.ends, x)):
                if which is not None and which[y] == which[x]:
                    continue
                if down * overlap >= up * (have + size[y]) and unions.join(x, y):
                    found.append((int(names[order[x]]), int(names[order[y]])))
            stack.append((node, overlap, True))
            for child in reversed(node.children):
                stack.append((child, overlap, False))
        mark[mine] = False
    return found
