"""Geometry of model pairs: aligned rows, distances, cousin tests, baselines.

Rows meet in one equi-join on (tensor, row_idx) per side of a pair.  Inner products
are taken row by row inside the array and added up by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark import schema
from weftmark.operators import blocks


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_difference(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unordered_pairs(models: DataFrame, name: str = "model") -> DataFrame:
    """All pairs a < b of a (small) model dimension."""
    a, b = models.select(F.col(name).alias("a")), models.select(F.col(name).alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


def ordered_pairs(models: DataFrame, name: str = "model") -> DataFrame:
    a, b = models.select(F.col(name).alias("a")), models.select(F.col(name).alias("b"))
    return a.join(b, F.col("a") != F.col("b"))


def aligned(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, tensor, row_idx, va, vb): rows that both models of a pair have with one width."""
    left = rows.select(F.col("model").alias("a"), "tensor", "row_idx", F.col("v").alias("va"))
    right = rows.select(F.col("model").alias("b"), "tensor", "row_idx", F.col("v").alias("vb"))
    return pairs.select("a", "b").join(left, "a").join(right, ["b", "tensor", "row_idx"]).where(F.size("va") == F.size("vb"))


def tensors_of(rows: DataFrame) -> DataFrame:
    """(model, tensor, n_rows, n_cols, numel) from the rows themselves."""
    return rows.groupBy("model", "tensor").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("v")).cast("long").alias("n_cols"), F.sum(F.size("v")).alias("numel")
    )


def shared_tensors(tensors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tensors of both models with the same width, and the rows they share."""
    a = tensors.select(F.col("model").alias("a"), "tensor", F.col("n_rows").alias("ra"), F.col("n_cols").alias("ca"))
    b = tensors.select(F.col("model").alias("b"), "tensor", F.col("n_rows").alias("rb"), F.col("n_cols").alias("cb"))
    both = pairs.select("a", "b").join(a, "a").join(b, ["b", "tensor"]).where("ca = cb")
    return both.select("a", "b", "tensor", F.least("ra", "rb").alias("n_rows"), F.col("ca").alias("n_cols"))


def only_in_one(tensors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tensors that only the first (side a) or only the second (side b) model of a pair has."""
    a = pairs.select("a", "b").join(tensors.select(F.col("model").alias("a"), "tensor"), "a")
    b = pairs.select("a", "b").join(tensors.select(F.col("model").alias("b"), "tensor"), "b")
    keys = ["a", "b", "tensor"]
    left = a.join(b, keys, "left_anti").select(*keys, F.lit("a").alias("side"))
    return left.unionByName(b.join(a, keys, "left_anti").select(*keys, F.lit("b").alias("side")))


def pair_tensor_stats(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (a, b, tensor): inner products, squared differences (whole, and where a side is not zero), zeros, cells, bit identity."""
    return blocks.compare(rows, pairs.select("a", "b")).select("a", "b", "tensor", *blocks.PAIR, "identical")


def relative_deltas(rows: DataFrame, pairs: DataFrame, tensors: DataFrame | None = None, n_tensors: int = 10, max_rows: int = 256, min_cells: int = 65536) -> DataFrame:
    """(a, b, delta): norm of the difference by that of b over the largest shared matrices, sampled rows only; infinite without any.

    ``tensors`` is (model, tensor, n_rows, n_cols), from the headers; else sizes come from the rows.
    """
    if tensors is None:
        tensors = rows.groupBy("model", "tensor").agg((F.max("row_idx") + 1).alias("n_rows"), F.max(F.size("v")).cast("long").alias("n_cols"))
    asks = blocks.largest_shared(tensors, pairs, n_tensors, min_cells)
    s = blocks.compare(rows, asks, max_rows).groupBy("a", "b").agg(F.sum("dd").alias("dd"), F.sum("bb").alias("bb"))
    delta = F.coalesce(F.try_divide(F.sqrt("dd"), F.sqrt("bb")), F.lit(float("inf")))
    return pairs.select("a", "b").distinct().join(s, ["a", "b"], "left").select("a", "b", delta.alias("delta"))


def pooled(stats: DataFrame) -> DataFrame:
    """Pair statistics over all shared tensors: cosine, relative delta (by the second norm), identity share."""
    return stats.groupBy("a", "b").agg(
        F.sum("ab").alias("ab"), F.sum("aa").alias("aa"), F.sum("bb").alias("bb"), F.sum("dd").alias("dd"),
        F.avg(F.col("identical").cast("double")).alias("identical_share"), F.count(F.lit(1)).alias("n_tensors"),
    ).select(
        "a", "b", "n_tensors", "identical_share",
        F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("cosine"),
        F.try_divide(F.sqrt("dd"), F.sqrt("bb")).alias("relative_delta"),
        F.try_divide(F.sqrt("dd"), (F.sqrt("aa") + F.sqrt("bb")) / 2).alias("scaled_distance"),
    )


def relatedness(pairs: DataFrame, sketch_similarity: Column) -> DataFrame:
    """Symmetric relatedness from pooled statistics; without shared tensors only the sketch counts, capped."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    direct = 0.5 * unit(F.col("cosine")) + 0.5 * unit(1 - F.col("scaled_distance") / F.sqrt(F.lit(2.0)))
    full = 0.30 * sketch_similarity + 0.55 * direct + 0.15 * F.col("identical_share")
    bare = F.greatest(F.lit(0.0), F.least(F.lit(0.45), 0.8 * sketch_similarity))
    return pairs.withColumn("relatedness", F.coalesce(full, bare))


def proximity_gate(deltas: DataFrame, factor: float | None = 10.0) -> DataFrame:
    """Candidates (child, candidate, delta) within ``factor`` times the child's best; 0 or None keeps all finite."""
    finite = deltas.where(F.col("delta").isNotNull() & ~F.isnan("delta") & (F.col("delta") != float("inf")))
    if not factor:
        return finite
    best = finite.groupBy("child").agg(F.min("delta").alias("best"))
    return finite.join(best, "child").where(F.col("delta") <= F.greatest(F.col("best") * factor, F.lit(1e-12))).drop("best")


def reconstruction_residual(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (a = candidate, b = child): relative difference where the child is not zero."""
    return residuals(pair_tensor_stats(rows, pairs))


def residuals(stats: DataFrame) -> DataFrame:
    """(a, b, residual) from the sums of :func:`pair_tensor_stats`."""
    s = stats.groupBy("a", "b").agg(F.sum("on_b").alias("dd"), F.sum("bb").alias("yy"))
    return s.select("a", "b", F.try_divide(F.sqrt("dd"), F.sqrt("yy")).alias("residual"))


def cousin_scores(rows: DataFrame, triples: DataFrame) -> DataFrame:
    """Cosine of (a - r) and (b - r) for triples (a, b, r); null where a difference is zero."""
    met = blocks.compare(rows, triples.select("a", "b", F.col("r").alias("c")))
    sums = met.groupBy("a", "b", F.col("c").alias("r")).agg(*[F.sum(c).alias(c) for c in ("xy", "ac", "bc")])
    return sums.select("a", "b", "r", F.try_divide("xy", F.sqrt(F.col("ac") * F.col("bc"))).alias("cousin"))


def plausible_ancestors(deltas: DataFrame) -> DataFrame:
    """Triples (a, b, r): r nearer to a and to b than these to each other (deltas: a, b, delta by b's norm)."""
    ab = deltas.where("a < b").select("a", "b", F.col("delta").alias("d"))
    ar = deltas.select("a", F.col("b").alias("r"), F.col("delta").alias("dar"))
    br = deltas.select(F.col("a").alias("b"), F.col("b").alias("r"), F.col("delta").alias("dbr"))
    met = ab.join(ar, "a").join(br, ["b", "r"]).where("r != a and r != b")
    return met.where("isnull(d) or d = double('infinity') or (dar < d and dbr < d)").select("a", "b", "r")


def cousin_veto(rows: DataFrame, deltas: DataFrame, pairs: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(a, b, vetoed, via): pairs that look like cousins of a third model.

    A pair that reconstructs one way to RECONSTRUCTED is never vetoed.  Of the models
    that veto, the one with the least score is named.  ``stats`` may hold the pairs' sums already.
    """
    stats = pair_tensor_stats(rows, pairs) if stats is None else stats
    turned = stats.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("on_a").alias("on_b"), F.col("aa").alias("bb"))
    residual = residuals(stats.select("a", "b", "on_b", "bb").unionAll(turned))
    best = residual.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("residual").alias("residual"))
    open_ = pairs.select("a", "b").join(best, ["a", "b"], "left").where(f"residual is null or residual > {schema.RECONSTRUCTED}")
    triples = plausible_ancestors(deltas).join(open_.select("a", "b"), ["a", "b"], "left_semi")
    scores = cousin_scores(rows, triples).where(F.col("cousin") < schema.COUSIN_FLOOR)
    veto = scores.groupBy("a", "b").agg(F.min_by("r", F.struct("cousin", "r")).alias("via"))
    return pairs.select("a", "b").join(veto, ["a", "b"], "left").select("a", "b", F.col("via").isNotNull().alias("vetoed"), "via")


def outgroup_statistic(rows: DataFrame, triples: DataFrame) -> DataFrame:
    """Rooting by an outgroup c: mean over (c, tensor) of (d(b,c) - d(a,c)) / sum, distances by c's norm."""
    sums = blocks.compare(rows, triples.select("a", "b", "c")).where("cc > 0")
    dac, dbc = F.sqrt(F.col("ac") / F.col("cc")), F.sqrt(F.col("bc") / F.col("cc"))
    gap = F.try_divide(dbc - dac, dac + dbc)
    raw = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg(gap)))
    out = sums.groupBy("a", "b").agg(raw.alias("gap"))
    scaled = F.col("gap") / F.lit(schema.OUTGROUP_CANONICAL)
    return out.withColumn("outgroup", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), scaled)))


def pick_outgroups(deltas: DataFrame, pairs: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` models nearest to both sides of a pair."""
    from pyspark.sql.window import Window

    ca = deltas.select(F.col("a").alias("c"), F.col("b").alias("a"), F.col("delta").alias("da"))
    cb = deltas.select(F.col("a").alias("c"), F.col("b").alias("b"), F.col("delta").alias("db"))
    met = pairs.select("a", "b").join(ca, "a").join(cb, ["b", "c"]).where("c != a and c != b")
    total = met.withColumn("total", F.col("da") + F.col("db"))
    order = Window.partitionBy("a", "b").orderBy("total", "c")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("a", "b", "c", "total", "rank")
