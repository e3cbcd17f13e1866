"""Merge decomposition: which candidates a model mixes, and by what weights.

Spark aggregates the inner products of every child's models in one pass; everything after
works on a child's small matrix, since norms and products of differences follow from it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.functions import linalg
from weftmark.operators import pairs as geometry
from weftmark.operators import selection
from weftmark.plans.shared import materialize

SUPPORT, DEGENERATE, L1 = 0.05, 1e-6, 1e-3


def coordinates(tensors: DataFrame, coords: int, seed: int = 0) -> DataFrame:
    """(tensor, n_cols, row_idx, cols): exactly ``coords`` cells of all tensors (tensor, n_rows, n_cols), all if there are no more.

    A tensor gets its share by size, to the cell.  Its flat places are cut into as many equal
    stretches as it has cells to give, and a hash of seed, tensor and stretch picks one place
    of each, so that nothing is sorted or held to avoid picking a place twice.
    """
    size = (F.col("n_rows") * F.col("n_cols")).cast("long")
    upto = Window.orderBy("tensor", "n_cols").rowsBetween(Window.unboundedPreceding, 0)  # a row for each tensor of the universe
    t = tensors.select("tensor", "n_cols", size.alias("size")).distinct().withColumn("upto", F.sum("size").over(upto))
    total = F.max("upto").over(Window.partitionBy())
    part = lambda x: F.floor(x.cast("decimal(38,0)") * F.least(F.lit(coords).cast("long"), F.col("total")).cast("decimal(20,0)") / F.col("total")).cast("long")
    t = t.withColumn("total", total).withColumn("m", part(F.col("upto")) - part(F.col("upto") - F.col("size"))).where("m > 0")
    edge = lambda i: F.floor(i.cast("decimal(38,0)") * F.col("size") / F.col("m")).cast("long")
    cut = t.select("tensor", "n_cols", "size", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
    low, high = edge(F.col("i")), edge(F.col("i") + 1)
    place = low + F.pmod(F.xxhash64(F.lit(seed), "tensor", "i"), high - low)
    flat = cut.select("tensor", "n_cols", place.alias("at"))
    return flat.groupBy("tensor", "n_cols", F.floor(F.col("at") / F.col("n_cols")).alias("row_idx")).agg(
        F.array_sort(F.collect_list((F.col("at") % F.col("n_cols")).cast("int"))).alias("cols")
    )


def sample_coordinates(rows: DataFrame, coords: int | None, seed: int = 0) -> DataFrame:
    """Rows cut to ``coords`` sampled cells in all (:func:`coordinates`), the same cells for every model; all without ``coords``.

    The places of a tensor are those of the rows that all models with one width of it have.
    """
    if not coords:
        return rows
    sizes = rows.groupBy("model", "tensor", F.size("v").alias("n_cols")).agg((F.max("row_idx") + 1).alias("n"))
    places = coordinates(sizes.groupBy("tensor", "n_cols").agg(F.min("n").alias("n_rows")), coords, seed)
    met = rows.withColumn("n_cols", F.size("v")).join(places, ["tensor", "n_cols", "row_idx"])
    return met.withColumn("v", F.transform("cols", lambda c: F.get("v", c))).select(*rows.columns)


def gram(rows: DataFrame, models: list[str], min_numel: int = 0) -> DataFrame:
    """(a, b, ab): inner products of every two models over tensors that all of them have."""
    mine = rows.where(F.col("model").isin(models))
    shared = selection.common_tensors(geometry.tensors_of(mine), min_numel, len(models))
    mine = mine.join(shared.select("tensor"), "tensor", "left_semi")
    a = mine.select(F.col("model").alias("a"), "tensor", "row_idx", F.col("v").alias("va"))
    b = mine.select(F.col("model").alias("b"), "tensor", "row_idx", F.col("v").alias("vb"))
    met = a.join(b, ["tensor", "row_idx"]).where("a <= b")
    return met.groupBy("a", "b").agg(F.sum(geometry.dot("va", "vb")).alias("ab"))


def _solve(
    child: str, candidates: list[str], usable: set[str], table: dict[tuple[str, str], float], base: str | None,
    l1: float, sum_to_one: bool, support: float,
) -> dict:
    """Weights from the inner products of the child, its usable candidates and the base."""
    open_ = [c for c in candidates if c in usable and c != child]
    out = {"child": child, "coefficients": {c: 0.0 for c in candidates}, "selected": [], "residual": 1.0, "r2": 0.0, "base": base}
    if not open_ or (child, child) not in table:
        return out
    ip = lambda a, b: table.get((a, b), 0.0)
    gap = lambda a, b: max(ip(a, a) + ip(b, b) - 2 * ip(a, b), 0.0) ** 0.5
    if base is None and len(open_) >= 2:
        spread = lambda a, b: gap(a, b) / max((ip(a, a) ** 0.5 + ip(b, b) ** 0.5) / 2, 1e-300)
        mean = {c: np.mean([spread(c, d) for d in open_ if d != c]) for c in open_}
        if max(spread(a, b) for a in open_ for b in open_) > 1e-9:
            base = min(open_, key=lambda c: (mean[c], c))
    zero = lambda a, b: ip(a, b)
    shifted = lambda a, b: ip(a, b) - ip(a, base) - ip(base, b) + ip(base, base)
    product = shifted if base else zero
    yy = product(child, child)
    live = [c for c in open_ if c != base and product(c, c) ** 0.5 >= DEGENERATE * max(yy, 0.0) ** 0.5]
    if not live or yy <= 0:
        product, live, yy, base = zero, open_, zero(child, child), None
        sum_to_one = True
    g = lambda names: np.array([[product(a, b) for b in names] for a in names])
    c = lambda names: np.array([product(a, child) for a in names])
    w = linalg.nnls_l1(g(live), c(live), yy, l1, sum_to_one)
    floor = support if sum_to_one else support * max(w.max(), 1e-300)
    chosen = [n for n, x in zip(live, w, strict=True) if x >= floor] or [live[int(w.argmax())]]
    w = linalg.nnls_l1(g(chosen), c(chosen), yy, l1, sum_to_one)  # once more on the support, to undo shrinkage
    rest = max(yy - 2 * w @ c(chosen) + w @ g(chosen) @ w, 0.0)
    out["coefficients"] |= {n: float(x) for n, x in zip(chosen, w, strict=True)}
    out |= {"selected": chosen, "residual": float((rest / yy) ** 0.5), "r2": float(1 - rest / yy), "base": base}
    return out


def grams(rows: DataFrame, members: DataFrame, min_numel: int = 0) -> DataFrame:
    """(child, a, b, ab), a <= b: inner products within each child's members (child, model).

    Per child over the 2-D tensors that all its members with any tensor of the child have in one shape.
    """
    shapes = geometry.tensors_of(rows.join(members.select("model").distinct(), "model", "left_semi"))
    held = materialize(members.join(shapes, "model"), "merge-shapes")  # headers only
    own = held.where(F.col("model") == F.col("child")).select("child", "tensor")
    usable = held.join(own, ["child", "tensor"], "left_semi").select("child", "model").distinct()
    count = usable.groupBy("child").agg(F.count(F.lit(1)).alias("members"))
    wide = held.join(usable, ["child", "model"], "left_semi").where((F.col("numel") >= min_numel) & (F.least("n_rows", "n_cols") >= 2))
    seen = wide.groupBy("child", "tensor").agg(F.count_distinct("model").alias("n"), F.count_distinct("n_rows", "n_cols").alias("shapes"))
    shared = seen.join(count, "child").where("n = members and shapes = 1").select("child", "tensor")
    wanted = materialize(usable.join(shared, "child"), "merge-tensors")
    met = rows.select("model", "tensor", "row_idx", "v").join(wanted, ["model", "tensor"])
    # one row of every member of the child, so a list is as long as its claims
    lists = met.groupBy("child", "tensor", "row_idx").agg(F.collect_list(F.struct("model", "v")).alias("ms"))
    left = lists.select("child", "ms", F.explode("ms").alias("x"))
    both = left.select("child", F.col("x.model").alias("a"), F.col("x.v").alias("va"), F.explode("ms").alias("y"))
    cells = both.where("a <= y.model").select("child", "a", F.col("y.model").alias("b"), "va", F.col("y.v").alias("vb"))
    return cells.groupBy("child", "a", "b").agg(F.sum(geometry.dot("va", "vb")).alias("ab"))


def decompose_all(
    rows: DataFrame, claims: DataFrame, base: str | None = None, *, l1: float = L1, sum_to_one: bool = True,
    support: float = SUPPORT, coords: int | None = None, min_numel: int = 0, seed: int = 0,
) -> DataFrame:
    """(child, candidate, weight, selected, residual, r2, base) for all claims (child, candidate) at once.

    One aggregation gives every child's inner products; a group of the solver is one child's
    matrix, as large as the square of its claimed parents.  Children or candidates without rows
    keep weight 0.
    """
    claims = claims.select("child", "candidate").distinct()
    members = claims.select("child", F.col("candidate").alias("model")).unionByName(claims.select("child", F.col("child").alias("model")))
    if base is not None:
        members = members.unionByName(claims.select("child", F.lit(base).alias("model")))
    products = grams(sample_coordinates(rows, coords, seed), members.distinct(), min_numel)

    def one(key: tuple, claimed: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        table = {}
        for a, b, ab in zip(found["a"], found["b"], found["ab"], strict=True):
            table[a, b] = table[b, a] = ab
        names = sorted(claimed["candidate"])
        if base is not None and (base, base) not in table:
            table = {}
        r = _solve(key[0], names, {a for a, _ in table}, table, base, l1, sum_to_one, support)
        return pd.DataFrame({
            "child": key[0], "candidate": names, "weight": [r["coefficients"][n] for n in names],
            "selected": [n in r["selected"] for n in names], "residual": r["residual"], "r2": r["r2"], "base": r["base"],
        })

    schema = "child string, candidate string, weight double, selected boolean, residual double, r2 double, base string"
    asked = claims.select(F.col("child").alias("of"), "candidate")
    return asked.groupBy("of").cogroup(products.groupBy("child")).applyInPandas(one, schema)


def decompose(
    rows: DataFrame, child: str, candidates: list[str], base: str | None = None, *, l1: float = L1,
    sum_to_one: bool = True, support: float = SUPPORT, coords: int | None = None, min_numel: int = 0, seed: int = 0,
) -> dict:
    """Weights of the candidates in one child: coefficients, selected, residual, r2, base.

    The aggregation has one row per pair of models involved; it is all that reaches the driver.
    For many children use :func:`decompose_all`.
    """
    mine = rows.where(F.col("model").isin([child, *candidates, *([base] if base else [])]))
    own = mine.where(F.col("model") == child).select("tensor").distinct()
    usable = {r["model"] for r in mine.join(own, "tensor", "left_semi").select("model").distinct().collect()}
    models = list(dict.fromkeys([child, *(c for c in candidates if c in usable), *([base] if base else [])]))
    table = {}
    if child in usable:
        for r in gram(sample_coordinates(mine, coords, seed), models, min_numel).collect():
            table[r["a"], r["b"]] = table[r["b"], r["a"]] = r["ab"]
    return _solve(child, candidates, usable, table, base, l1, sum_to_one, support)


def two_parent_weight(rows: DataFrame, child: str, a: str, b: str) -> DataFrame:
    """Closed form for two parents on the simplex: (weight_a, residual)."""
    m = gram(rows, [child, a, b])
    pick = lambda x, y: F.sum(F.when((F.col("a") == min(x, y)) & (F.col("b") == max(x, y)), F.col("ab")))
    one = m.agg(pick(child, child).alias("yy"), pick(a, a).alias("aa"), pick(b, b).alias("bb"), pick(child, a).alias("ya"), pick(child, b).alias("yb"), pick(a, b).alias("ab"))
    w = F.try_divide(F.col("ya") - F.col("ab") - F.col("yb") + F.col("bb"), F.col("aa") - 2 * F.col("ab") + F.col("bb"))
    one = one.withColumn("w", F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)))
    v = 1 - F.col("w")
    rest = (
        F.col("yy") - 2 * (F.col("w") * F.col("ya") + v * F.col("yb")) + F.col("w") * F.col("w") * F.col("aa") + v * v * F.col("bb") + 2 * F.col("w") * v * F.col("ab")
    )
    return one.select(F.col("w").alias("weight_a"), F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("yy")).alias("residual"))


def resolve_merges(rows: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """Decompose every child with two parents or more; keep the selected, with weight and relation merge."""
    several = edges.groupBy("child").agg(F.count_distinct("parent").alias("n")).where("n >= 2").select("child")
    claims = edges.join(several, "child", "left_semi").select("child", F.col("parent").alias("candidate"))
    found = materialize(decompose_all(rows, claims, **options).where("selected"), "merge-weights")
    weights = found.select(F.col("candidate").alias("parent"), "child", F.col("weight").alias("w"))
    solved = weights.select("child").distinct().withColumn("solved", F.lit(True))
    met = edges.join(weights, ["parent", "child"], "left").join(solved, "child", "left")
    kept = met.where(F.col("solved").isNull() | F.col("w").isNotNull()).select(*edges.columns, "w")
    return kept.withColumn("weight", F.coalesce("w", "weight")).withColumn("relation", F.when(F.col("w").isNotNull(), "merge").otherwise(F.col("relation"))).drop("w")
