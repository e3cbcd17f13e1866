"""Graph operators over edge tables (parent, child, confidence).

Closures, best paths, components, cycles, levels and detours go round by round over distinct
pairs or nodes, each round a written table that the next one replaces, so that rows grow with
the pairs of models and never with the paths between them.  Closures and cycles of small weakly
connected components are finished in one pass, a bounded group of components at a time; rounds
are for the others.  Rounds join by shuffles only: a broadcast a round would pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.plans.shared import dealt, discard, materialize


#: Most edges of a weakly connected component that is finished without rounds.
SMALL = 256
#: Sum of the squares of these numbers in one group of components, which bounds its pairs and steps.
GROUP = 1 << 20
#: Most edges of a weakly connected component whose closure is made without rounds, and the edges to each slice of its parents.
LARGE = 1 << 16
SLICE = 1 << 12
#: Most edges whose weak components one task finds.
LAST = 1 << 18


def parents_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("child") == node)


def children_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("parent") == node)


def _stacked(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionAll(table)
    return out


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffles, however small a side is."""
    return left.join(right.hint("merge"), on, how)


def _tagged(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with their weak ``component``, components with ``n``, their edges), both written, of a written table of distinct edges."""
    ends = edges.select(F.col("parent").alias("node")).union(edges.select("child"))
    labels = _weak_labels(ends.distinct(), edges).select(F.col("node").alias("parent"), "component")
    tagged = materialize(_met(edges, labels, "parent", "left").select(*edges.columns, "component"), "graph-tagged")
    sizes = materialize(tagged.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("n")), "graph-sizes")
    return tagged, sizes


def _parted(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(edges of small components with ``group``, all other edges, the number of groups) of a written table of distinct edges.

    Components are weak ones.  Those of ``SMALL`` edges or fewer are dealt to groups by their
    hash.  Edges with a null end are among the others.  Both tables are written.
    """
    tagged, sizes = _tagged(edges)
    total = sizes.where(F.col("n") <= SMALL).agg(F.sum(F.col("n") * F.col("n"))).collect()[0][0] or 0
    groups = -(-total // GROUP) or 1
    group = F.pmod(F.xxhash64("component"), F.lit(groups)).cast("int")
    sized = _met(tagged, sizes, "component", "left")
    fits = F.coalesce(F.col("n") <= SMALL, F.lit(False)) & F.col("child").isNotNull()
    small = materialize(sized.where(fits).select(*edges.columns, group.alias("group")), "graph-small")
    rest = materialize(sized.where(~fits).select(*edges.columns), "graph-rest")
    for done in (tagged, sizes):
        discard(done)
    return small, rest, groups


def _finished(small: DataFrame, groups: int, one, kind: str) -> DataFrame:
    """``one`` of each group; a group is GROUP pairs or so, and a task of its own whatever the size of its edges."""
    return small.repartition(groups, "group").groupBy("group").applyInPandas(one, kind)


def _coded(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parents, children, names): a group's edges by the places of their ends in the sorted names."""
    codes, names = pd.factorize(np.concatenate([pdf["parent"].to_numpy(object), pdf["child"].to_numpy(object)]), sort=True)
    return codes[: len(pdf)].astype(np.int64), codes[len(pdf) :].astype(np.int64), names


def _steps(p: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(children by parent, each parent's first place among them)."""
    order = np.argsort(p, kind="stable")
    return c[order], np.searchsorted(p[order], np.arange(n + 1))


def _fronts(pairs: np.ndarray, below: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """What the steps make of the given pairs, as ancestor * n + descendant, sorted, by the length of their shortest path."""
    n = len(first) - 1
    fronts = [np.unique(pairs)]
    seen = fronts[0]
    while len(fronts[-1]):
        a, d = fronts[-1] // n, fronts[-1] % n
        many = first[d + 1] - first[d]
        at = np.repeat(first[d] - np.cumsum(many) + many, many) + np.arange(many.sum())
        a, d = np.repeat(a, many), below[at]
        met = np.unique((a * n + d)[a != d])
        place = np.searchsorted(seen, met)
        new = seen[np.minimum(place, len(seen) - 1)] != met
        fronts.append(met[new])
        seen = np.insert(seen, place[new], met[new])
    return fronts


def _closure_of(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The pairs of ``mine`` parents, some GROUP pairs at a time if all reach the ``n`` edges of their component."""
    p, c, names = _coded(pdf)
    many = len(names)
    pairs = np.unique(p * many + c)
    steps = _steps(pairs // many, pairs % many, many)
    cost = np.zeros(many, dtype=np.int64)
    mine = pdf["mine"].to_numpy(bool)
    cost[p[mine]] = pdf["n"].to_numpy(np.int64)[mine] + 1
    part = np.cumsum(cost)[pairs // many] // GROUP
    asked = cost[pairs // many] > 0
    for first in np.split(pairs[asked], np.flatnonzero(np.diff(part[asked])) + 1):
        if len(first):
            fronts = _fronts(first, *steps)
            met = np.concatenate(fronts)
            depth = np.repeat(np.arange(1, len(fronts) + 1, dtype=np.int32), [len(x) for x in fronts])
            yield pd.DataFrame({"ancestor": names[met // many], "descendant": names[met % many], "depth": depth})


def _closures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The closures of whole slices that follow each other, at most LARGE edges and a batch at once."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= LARGE:
            lot = pd.concat(held, ignore_index=True)
            last = ((lot["component"] == lot["component"].iloc[-1]) & (lot["slice"] == lot["slice"].iloc[-1])).to_numpy()
            if not last.all():
                yield from _closure_of(lot[~last])
            held = [lot[last]]
    if held:
        yield from _closure_of(pd.concat(held, ignore_index=True))


def _components_of(p: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The least node that each node of a group shares cycles with; nodes on no cycle have themselves."""
    pairs = np.concatenate(_fronts(p * n + c, *_steps(p, c, n)))
    both = np.intersect1d(pairs, pairs % n * n + pairs // n)
    least = np.arange(n)
    np.minimum.at(least, both // n, both % n)
    return least


def _strong_of(pdf: pd.DataFrame) -> pd.DataFrame:
    p, c, names = _coded(pdf)
    least = _components_of(p, c, len(names))
    on = np.unique(np.concatenate([x[(p != c) & (least[p] == least[c])] for x in (p, c)]))
    return pd.DataFrame({"node": names[on], "component": names[least[on]]})


def _dropped_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges of a group whose child reaches the parent over edges that outrank them."""
    p, c, names = _coded(pdf)
    least = _components_of(p, c, len(names))
    place = np.empty(len(pdf), dtype=np.int64)
    place[np.lexsort((c, p, pdf["confidence"].to_numpy(float), pdf["kind"].to_numpy()))] = np.arange(len(pdf))
    on = np.flatnonzero(least[p] == least[c])
    below: dict[int, list[tuple[int, int]]] = {}
    for a, b, r in zip(p[on].tolist(), c[on].tolist(), place[on].tolist()):
        below.setdefault(a, []).append((r, b))
    gone = []
    for i, a, b, r in zip(on.tolist(), p[on].tolist(), c[on].tolist(), place[on].tolist()):
        seen, todo = {b}, [b]
        while todo and a not in seen:
            new = [y for k, y in below[todo.pop()] if k > r and y not in seen]
            seen.update(new)
            todo += new
        if a in seen:
            gone.append(i)
    return pdf.iloc[gone][["parent", "child"]]


def reach(edges: DataFrame, starts: DataFrame | None = None, paths: bool = False) -> DataFrame:
    """(ancestor, descendant, depth[, path]): every pair with the length of its shortest path; safe on cycles.

    Breadth first from ``starts`` (column ``node``), or from all parents, at once: a round
    extends the pairs that the round before found first, and keeps those that no round had.
    With ``paths`` the least shortest path by its names comes along.  A table of its own.
    """
    step = materialize(edges.select("parent", "child").distinct(), "graph-edges")
    first = step if starts is None else _met(step, starts.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi")
    keys = ["ancestor", "descendant"]
    trail = [F.array("parent", "child").alias("path")] if paths else []
    fronts = [materialize(first.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth"), *trail), "graph-front")]
    while not fronts[-1].isEmpty():
        met = _met(fronts[-1], step, F.col("descendant") == F.col("parent")).where(F.col("ancestor") != F.col("child"))
        if paths:
            met = met.select("ancestor", F.col("child").alias("descendant"), F.array_append("path", F.col("child")).alias("path"))
            reached = met.groupBy(*keys).agg(F.min("path").alias("path"))
        else:
            reached = met.select("ancestor", F.col("child").alias("descendant")).distinct()
        new = _met(reached, _stacked(fronts).select(*keys), keys, "left_anti").withColumn("depth", F.lit(len(fronts) + 1))
        fronts.append(materialize(new.select(*fronts[0].columns), "graph-front"))
    out = materialize(_stacked(fronts), "graph-closure")
    for done in (step, *fronts):
        discard(done)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) of all pairs as :func:`reach` has them; components of ``LARGE`` edges or fewer take no rounds.

    A slice of such a component has all its edges and one in so many of its parents, as many
    as keep ``SLICE`` edges to a slice.  A task searches from a bounded number of them at a time.
    """
    step = materialize(edges.select("parent", "child").distinct(), "graph-edges")
    tagged, sizes = _tagged(step)
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    total = sizes.where(F.col("n") <= LARGE).agg(F.sum(F.col("n") * slices)).collect()[0][0] or 0
    sized = _met(tagged, sizes, "component", "left")
    fits = F.coalesce(F.col("n") <= LARGE, F.lit(False)) & F.col("child").isNotNull()
    mine = F.pmod(F.xxhash64("parent"), slices) == F.col("slice")
    near = sized.where(fits).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select("parent", "child", "component", "slice", "n", mine.alias("mine"))
    near = dealt(near, "component", "slice", rows=LARGE, n=total).sortWithinPartitions("component", "slice")
    rest = materialize(sized.where(~fits).select("parent", "child"), "graph-rest")
    far = None if rest.isEmpty() else reach(rest)
    out = near.mapInPandas(_closures, "ancestor string, descendant string, depth int")
    out = materialize(out if far is None else out.unionAll(far), "graph-closure")
    for done in (step, tagged, sizes, rest, *([far] if far else [])):
        discard(done)
    return out


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))


def _single(edges: DataFrame, node: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(node,)], "node string")


def ancestors_of(edges: DataFrame, node: str) -> DataFrame:
    """(node, depth), by rounds from the one node."""
    return reach(_turned(edges), _single(edges, node)).select(F.col("descendant").alias("node"), "depth")


def descendants_of(edges: DataFrame, node: str) -> DataFrame:
    return reach(edges, _single(edges, node)).select(F.col("descendant").alias("node"), "depth")


def nearest_common_ancestor(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor): the common ancestor nearest to a, then to b, then by name; a node is its own at depth 0."""
    nodes = edges.select(F.col("parent").alias("n")).union(edges.select("child")).distinct()
    up = closure(edges).unionByName(nodes.select(F.col("n").alias("ancestor"), F.col("n").alias("descendant"), F.lit(0).alias("depth")))
    a = up.select(F.col("descendant").alias("a"), "ancestor", F.col("depth").alias("da"))
    b = up.select(F.col("descendant").alias("b"), "ancestor", F.col("depth").alias("db"))
    met = pairs.select("a", "b").join(a, "a").join(b, ["b", "ancestor"])
    return met.groupBy("a", "b").agg(F.min_by("ancestor", F.struct("da", "db", "ancestor")).alias("ancestor"))


def _trimmed(live: DataFrame) -> DataFrame:
    """Edges left when nodes without a parent or without a child are taken away again and again."""
    count = live.count()
    while count:
        open_ = _met(live, live.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        open_ = _met(open_, live.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select(*live.columns)
        less = materialize(open_, "graph-trimmed")
        discard(live)
        live, before, count = less, count, less.count()
        if count == before:
            break
    return live


def _coloured(live: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each node of ``live``, itself included."""
    step = live.select("parent", "child")
    nodes = step.select(F.col("parent").alias("node")).union(step.select("child")).distinct()
    colours = materialize(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")), "graph-colours")
    while not colours.where("fresh").isEmpty():
        offered = _met(colours.where("fresh"), step, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), "colour", F.lit(True).alias("fresh"))
        both = offered.unionAll(colours.select("node", "colour", F.lit(False).alias("fresh")))
        least = both.groupBy("node").agg(F.min(F.struct("colour", "fresh")).alias("c")).select("node", "c.*")  # of equal colours the old one
        merged = materialize(least, "graph-colours")
        discard(colours)
        colours = merged
    return colours


def _component_pass(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges inside a colour with both ends' marks, members) of one forward and backward search.

    Forward, a node takes the colour of the least node that reaches it; backward, each such
    node collects whoever of its colour reaches it, which is its strongly connected
    component.  ``members`` is (node, colour).  Edges between colours lie on no cycle.
    """
    colours = _coloured(live)
    a, b = (colours.select(F.col("node").alias(x), F.col("colour").alias(f"{x}_colour")) for x in ("parent", "child"))
    inside = _met(_met(live, a, "parent"), b, "child").where("parent_colour = child_colour").select(*live.columns, F.col("child_colour").alias("colour"))
    inside = materialize(inside, "graph-inside")
    fronts = [materialize(colours.where("node = colour").select("node", "colour"), "graph-members")]
    while not fronts[-1].isEmpty():
        back = _met(fronts[-1].select(F.col("node").alias("child")), inside, "child").select(F.col("parent").alias("node"), "colour").distinct()
        fronts.append(materialize(_met(back, _stacked(fronts).select("node"), "node", "left_anti"), "graph-members"))
    members = materialize(_stacked(fronts), "graph-members")
    ends = [members.select(F.col("node").alias(x), F.lit(True).alias(f"{x}_in")) for x in ("parent", "child")]
    marked = _met(_met(inside, ends[0], "parent", "left"), ends[1], "child", "left")
    marked = materialize(marked.select(*inside.columns, *[F.coalesce(f"{x}_in", F.lit(False)).alias(f"{x}_in") for x in ("parent", "child")]), "graph-marked")
    for done in (colours, inside, *fronts):
        discard(done)
    return marked, members


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that lie on a cycle of two or more nodes, with the least node they share cycles with."""
    pairs = materialize(edges.select("parent", "child").where("parent != child").distinct(), "graph-pairs")
    small, live, groups = _parted(pairs)
    found = materialize(_finished(small, groups, _strong_of, "node string, component string"), "graph-components")
    for done in (pairs, small):
        discard(done)
    while True:
        live = _trimmed(live)
        if live.isEmpty():
            discard(live)
            return found
        marked, members = _component_pass(live)
        cyclic = marked.where("parent_in and child_in").select(F.col("parent").alias("node"), F.col("colour").alias("component")).distinct()
        found = found.unionAll(materialize(cyclic, "graph-components"))
        rest = materialize(marked.where("not parent_in and not child_in").select(*live.columns), "graph-live")
        for done in (live, marked, members):
            discard(done)
        live = rest


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges that lie on a cycle: both ends in one strongly connected component, or a loop."""
    c = strong_components(edges)
    a, b = (c.select(F.col("node").alias(x), F.col("component").alias(f"{x}_c")) for x in ("parent", "child"))
    met = edges.where("parent != child").join(a, "parent").join(b, "child").where("parent_c = child_c").select(*edges.columns)
    return met.unionByName(edges.where("parent = child"))


def break_cycles(edges: DataFrame) -> DataFrame:
    """Drop the least edge on any cycle by (confidence, parent, child) until no cycle is left; loops go first.

    That drops an edge exactly if its child reaches its parent over edges that all outrank
    it.  Small components are searched edge by edge.  In the others, after trimming, every pair
    of nodes gets the path whose least edge is greatest: each round extends the pairs that the last one improved by one edge, and in the end each
    edge is held against the pair that leads back.  Rows grow with the pairs of nodes on or
    between cycles, rounds with the longest such path, whatever the number of cycles.
    Of rows that repeat a pair the least confident one counts, and all of them go.
    """
    kept = materialize(edges.where("parent != child"), "graph-kept")
    least = materialize(kept.groupBy("parent", "child").agg(F.min("confidence").alias("confidence")), "graph-least")
    small, live, groups = _parted(least)
    kind = F.when(F.col("confidence").isNull(), 0).when(F.isnan("confidence"), 2).otherwise(1)  # pandas tells no null from NaN
    gone = materialize(_finished(small.withColumn("kind", kind), groups, _dropped_of, "parent string, child string"), "graph-dropped")
    for done in (least, small):
        discard(done)
    live = _trimmed(live)
    if live.isEmpty():
        discard(live)
    else:
        gone = gone.unionAll(_widest_dropped(live))
    return _met(kept, gone, ["parent", "child"], "left_anti").select(*edges.columns)


def _widest_dropped(live: DataFrame) -> DataFrame:
    """(parent, child) of the edges in ``live``, which it deletes, that a path of edges that outrank them leads back over."""
    rank = F.struct("confidence", "parent", "child")
    step = materialize(live.select("parent", "child", rank.alias("rank")), "graph-steps")
    best = materialize(step.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.col("rank").alias("low"), F.lit(True).alias("fresh")), "graph-widest")
    while not best.where("fresh").isEmpty():
        longer = _met(best.where("fresh"), step, F.col("b") == F.col("parent")).where(F.col("a") != F.col("child"))
        longer = longer.select("a", F.col("child").alias("b"), F.least("low", "rank").alias("low"), F.lit(True).alias("fresh"))
        both = longer.unionAll(best.withColumn("fresh", F.lit(False)))
        top = both.groupBy("a", "b").agg(F.max(F.struct("low", (~F.col("fresh")).alias("old"))).alias("w"))  # of equal paths the old one
        better = materialize(top.select("a", "b", F.col("w.low").alias("low"), (~F.col("w.old")).alias("fresh")), "graph-widest")
        discard(best)
        best = better
    back = best.select(F.col("a").alias("child"), F.col("b").alias("parent"), "low")
    gone = materialize(_met(step, back, ["parent", "child"]).where("low > rank").select("parent", "child"), "graph-dropped")
    for done in (live, step, best):
        discard(done)
    return gone


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): length of the longest path that ends at the node; roots have 0.

    Round by round the nodes without an open parent take the number of the round and leave
    with their edges.  Nodes on a cycle, and those below one, come one level after the last.
    """
    names = nodes.select("node").distinct()
    left = materialize(edges.select("parent", "child").distinct(), "graph-left")
    ends = left.select(F.col("parent").alias("node")).union(left.select("child"))
    waiting = materialize(names.union(ends).distinct(), "graph-waiting")
    levels = []
    while True:
        held = left.select(F.col("child").alias("node")).distinct()
        free = materialize(waiting.join(held, "node", "left_anti"), "graph-free")
        blocked = free.isEmpty()
        levels.append((waiting if blocked else free).withColumn("level", F.lit(len(levels))))
        if blocked:
            break
        rest = materialize(waiting.join(held, "node", "left_semi"), "graph-waiting")
        less = materialize(left.join(free.withColumnRenamed("node", "parent"), "parent", "left_anti").select("parent", "child"), "graph-left")
        discard(left)
        discard(waiting)
        left, waiting = less, rest
    return names.join(_stacked(levels), "node")


def transitive_reduction(edges: DataFrame, keep_weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept edges, dropped edges with ``via``): an edge goes if another path of two or more hops joins its ends.

    ``keep_weighted`` keeps edges with a merge weight even so.  ``via`` is the shortest such
    path, the least by its names of several.  Only parents with two children or more can
    have a detour to a child with two parents or more; from those a closure with paths is
    built, and its pairs meet the last hop.  The edges should have no cycle; on one, a
    detour must not pass its own ends.
    """
    pairs = materialize(edges.select("parent", "child").distinct(), "graph-pairs")
    several = lambda c: pairs.groupBy(c).count().where("count > 1").select(c)
    asked = materialize(pairs.join(several("parent"), "parent", "left_semi").join(several("child"), "child", "left_semi"), "graph-asked")
    up = reach(pairs, asked.select(F.col("parent").alias("node")), paths=True)
    last = pairs.select(F.col("parent").alias("descendant"), "child")
    met = up.join(last, "descendant").where(~F.array_contains("path", F.col("child"))).withColumnRenamed("ancestor", "parent")
    met = met.join(asked, ["parent", "child"], "left_semi")
    detour = met.groupBy("parent", "child").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("b"))
    via = materialize(detour.select("parent", "child", F.array_join(F.array_append("b.path", F.col("child")), " -> ").alias("via")), "graph-detours")
    for done in (pairs, asked, up):
        discard(done)
    marked = edges.join(via, ["parent", "child"], "left")
    redundant = F.col("via").isNotNull()
    if keep_weighted:
        redundant = redundant & F.col("weight").isNull()
    return marked.where(~redundant).drop("via"), marked.where(redundant)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node").distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable when direction is ignored."""
    names = nodes.select("node").union(edges.select("parent")).union(edges.select("child")).distinct()
    return _met(nodes.select("node").distinct(), _weak_labels(names, edges), "node")


def _weak_labels(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of all ``names``, which are distinct and have every end of an edge among them.

    Every round hooks each node to its least neighbour, follows the hooks to their ends and
    contracts the edges, which leaves half of the nodes or fewer whatever the order of their
    names.  The last ``LAST`` edges are finished by one task.
    """
    left = materialize(
        edges.select(F.least("parent", "child").alias("u"), F.greatest("parent", "child").alias("v")).where("u != v").distinct(), "graph-pairs"
    )
    written = None
    labels = names.withColumn("component", F.col("node"))
    while n := left.count():
        if n <= LAST:
            hooks = materialize(left.coalesce(1).mapInPandas(_hooks_of, "node string, to string"), "graph-jumps")
        else:
            both = left.unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
            hooks = _followed(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to")))
        moved = hooks.select(F.col("node").alias("component"), "to")
        labels = materialize(_met(labels, moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "graph-labels")
        ends = [hooks.select(F.col("node").alias(x), F.col("to").alias(f"{x}2")) for x in ("u", "v")]
        met = _met(_met(left, ends[0], "u"), ends[1], "v").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
        less = materialize(left.limit(0) if n <= LAST else met.where("u != v").distinct(), "graph-pairs")
        for done in (left, hooks, *([written] if written else [])):
            discard(done)
        left, written = less, labels
    discard(left)
    return labels


def _followed(hooks: DataFrame) -> DataFrame:
    """(node, to) with every hook followed to the node that hooks to itself; each pass follows four times as far.  A written table."""
    hooks = materialize(hooks.withColumn("open", F.col("node") != F.col("to")), "graph-hooks")
    while not hooks.where("open").isEmpty():
        far = hooks
        for _ in range(2):
            on = far.select(F.col("node").alias("to"), F.col("to").alias("far"))
            far = _met(far.select("node", "to"), on, "to").select("node", F.col("far").alias("to"), (F.col("to") != F.col("far")).alias("open"))
        far = materialize(far, "graph-hooks")
        discard(hooks)
        hooks = far
    return hooks


def _hooks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, to): the least node of the weak component of every end of the pairs (u, v)."""
    pairs = list(batches)
    if not pairs:
        return
    u, v, names = _coded(pd.concat(pairs, ignore_index=True).rename(columns={"u": "parent", "v": "child"}))
    least = np.arange(len(names))
    while len(u):
        hook = np.arange(len(names))
        np.minimum.at(hook, u, v)
        np.minimum.at(hook, v, u)
        while (hook[hook] != hook).any():
            hook = hook[hook]
        least = hook[least]
        u, v = hook[u], hook[v]
        u, v = u[u != v], v[u != v]
    yield pd.DataFrame({"node": names, "to": names[least]})


def _share(pairs: DataFrame, up: DataFrame, name: str) -> DataFrame:
    """(a, b, name) of the given pairs that have a common node in ``up`` (ancestor, descendant)."""
    left = pairs.join(up.select(F.col("descendant").alias("a"), "ancestor"), "a")
    met = left.join(up.select(F.col("descendant").alias("b"), "ancestor"), ["b", "ancestor"], "left_semi")
    return met.select("a", "b", F.lit(True).alias(name)).distinct()


def _tops(up: DataFrame, edges: DataFrame) -> DataFrame:
    """``up`` with those ancestors only that no other stands for: two nodes share one of these exactly if they share any.

    They are the nodes without parents, and, above and on cycles that none of these reaches, all.
    """
    held = edges.where("parent is not null").select(F.col("parent").alias("ancestor")).distinct()
    top = held.join(edges.select(F.col("child").alias("ancestor")), "ancestor", "left_anti")
    under = up.join(top, "ancestor", "left_semi").select(F.col("descendant").alias("ancestor"))
    return up.join(held.join(under, "ancestor", "left_anti"), "ancestor", "left_semi")


def label_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, label) of the given distinct pairs: a->b, b->a, sibling (a shared parent), cousin (a shared ancestor) or none."""
    up = closure(edges)
    pairs = pairs.select("a", "b")
    down = up.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b"), F.lit(True).alias("fwd"))
    back = up.select(F.col("ancestor").alias("b"), F.col("descendant").alias("a"), F.lit(True).alias("rev"))
    direct = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct()
    met = pairs.join(down, ["a", "b"], "left").join(back, ["a", "b"], "left")
    met = met.join(_share(pairs, direct, "sib"), ["a", "b"], "left").join(_share(pairs, _tops(up, edges), "cou"), ["a", "b"], "left")
    label = F.when(F.col("fwd"), "a->b").when(F.col("rev"), "b->a").when(F.col("sib"), "sibling").when(F.col("cou"), "cousin").otherwise("none")
    return met.select("a", "b", label.alias("label"))


def classify_wrong_edges(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(parent, child, kind) of predicted edges that are not true: reversed, ancestor-not-parent, cousin, unrelated."""
    wrong = predicted.select("parent", "child").distinct().join(truth, ["parent", "child"], "left_anti")
    up = closure(truth)
    rev = up.select(F.col("ancestor").alias("child"), F.col("descendant").alias("parent"), F.lit(True).alias("rev"))
    anc = up.select(F.col("ancestor").alias("parent"), F.col("descendant").alias("child"), F.lit(True).alias("anc"))
    cou = _share(wrong.select(F.col("parent").alias("a"), F.col("child").alias("b")), _tops(up, truth), "cou").withColumnsRenamed({"a": "parent", "b": "child"})
    keys = ["parent", "child"]
    direct = truth.select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.lit(True).alias("flip")).distinct()
    met = wrong.join(direct, keys, "left").join(anc, keys, "left").join(rev, keys, "left").join(cou, keys, "left")
    kind = (
        F.when(F.col("flip"), "reversed").when(F.col("anc"), "ancestor-not-parent").when(F.col("rev"), "reversed").when(F.col("cou"), "cousin").otherwise("unrelated")
    )
    return met.select(*keys, kind.alias("kind"))


def set_prf(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true positives, precision, recall, F1 of two key sets; empty against empty scores 1."""
    t = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    n = t.join(p, keys, "full_outer").agg(
        F.coalesce(F.sum(F.col("t") * F.col("p")), F.lit(0)).alias("tp"), F.count("t").alias("nt"), F.count("p").alias("np")
    )
    none = (F.col("nt") == 0) & (F.col("np") == 0)
    ratio = lambda a, b: F.when(none, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    n = n.withColumn("precision", ratio("tp", "np")).withColumn("recall", ratio("tp", "nt"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return n.withColumn("f1", f1).select("tp", "precision", "recall", "f1")


def score_dag(truth: DataFrame, predicted: DataFrame, nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """(axis, tp, precision, recall, f1) for edges, closure and roots; ``above`` is the closure of the truth, if known."""
    up = lambda e: closure(e).select("ancestor", "descendant")
    above = up(truth) if above is None else above
    parts = [
        set_prf(truth, predicted, ["parent", "child"]).withColumn("axis", F.lit("edges")),
        set_prf(above.select("ancestor", "descendant"), up(predicted), ["ancestor", "descendant"]).withColumn("axis", F.lit("closure")),
        set_prf(roots(nodes, truth), roots(nodes, predicted), ["node"]).withColumn("axis", F.lit("roots")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def dag_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each axis between two runs of :func:`score_dag`."""
    b = before.select("axis", F.col("precision").alias("p0"), F.col("recall").alias("r0"), F.col("f1").alias("f0"))
    return after.join(b, "axis").select(
        "axis", (F.col("precision") - F.col("p0")).alias("d_precision"), (F.col("recall") - F.col("r0")).alias("d_recall"), (F.col("f1") - F.col("f0")).alias("d_f1")
    )


def best_claims(edges: DataFrame) -> DataFrame:
    """One edge per (parent, child): the most confident, with its place among the child's edges."""
    best = edges.groupBy("parent", "child").agg(F.max("confidence").alias("confidence"))
    order = Window.partitionBy("child").orderBy(F.desc("confidence"), "parent")
    return best.withColumn("rank", F.row_number().over(order))


def best_paths(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, path, product, least): the path of greatest confidence product per pair.

    Of equal products the shorter path, then the first by its names.  Confidences are at most
    1, so a longer walk never gains: each round extends the pairs that the last one
    improved by one edge and keeps the best path of every pair.
    """
    step = edges.where("parent != child").groupBy("parent", "child").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("confidence"))).alias("c"))
    step = materialize(step, "graph-steps")
    best = front = materialize(
        step.select(
            F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.array("parent", "child").alias("path"),
            F.col("c").alias("product"), F.col("c").alias("least"),
        ),
        "graph-paths",
    )
    written = best
    rank = F.struct(-F.col("product"), F.size("path"), "path")
    keys = ["ancestor", "descendant"]
    while not front.isEmpty():
        longer = front.join(step, F.col("descendant") == F.col("parent")).where(~F.array_contains("path", F.col("child")))
        longer = longer.select(
            "ancestor", F.col("child").alias("descendant"), F.array_append("path", F.col("child")).alias("path"),
            (F.col("product") * F.col("c")).alias("product"), F.least("least", "c").alias("least"),
        )
        tried = longer.withColumn("fresh", F.lit(True)).unionByName(best.withColumn("fresh", F.lit(False)))
        chosen = tried.groupBy(*keys).agg(F.min_by(F.struct("path", "product", "least", "fresh"), rank).alias("b"))
        chosen = materialize(chosen.select(*keys, "b.*"), "graph-paths")
        discard(written)
        written = chosen
        best, front = chosen.drop("fresh"), chosen.where("fresh").drop("fresh")
    discard(step)
    return best


def trace(edges: DataFrame, target: str) -> DataFrame:
    """Edges among the target, its ancestors and its direct children."""
    keep = ancestors_of(edges, target).select("node")
    keep = keep.union(children_of(edges, target).select("child")).union(_single(edges, target)).distinct()
    out = edges.join(keep.select(F.col("node").alias("parent")), "parent", "left_semi")
    return out.join(keep.select(F.col("node").alias("child")), "child", "left_semi").select(*edges.columns)


def validate(models: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(problem, what): duplicate ids, unknown ids and labels that the edges contradict."""
    ids = models.select("node").distinct()
    dup = models.groupBy("node").count().where("count > 1").select(F.lit("duplicate id").alias("problem"), F.col("node").alias("what"))
    ends = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    unknown = ends.join(ids, "node", "left_anti").select(F.lit("unknown id in edges").alias("problem"), F.col("node").alias("what"))
    in_pairs = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    unknown2 = in_pairs.join(ids, "node", "left_anti").select(F.lit("unknown id in pairs").alias("problem"), F.col("node").alias("what"))
    known = pairs.select("a", "b").where("a < b").distinct()
    for x in ("a", "b"):
        known = known.join(ids.withColumnRenamed("node", x), x, "left_semi")
    labels = label_pairs(known, edges).withColumnRenamed("label", "want")
    claim = F.when(F.col("direction").isin("a->b", "b->a"), F.col("direction") != F.col("want")).otherwise(F.col("want").isin("a->b", "b->a"))
    off = pairs.join(labels, ["a", "b"]).where(claim).select(F.lit("label contradicts edges").alias("problem"), F.concat_ws(",", "a", "b").alias("what"))
    return dup.union(unknown).union(unknown2).union(off)
