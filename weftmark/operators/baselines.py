"""Baselines by name: DataFrame functions of tensor rows and pairs that give a score, and a constant direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.functions import names
from weftmark.operators import blocks, pairs, selection
from weftmark.plans.shared import materialize


def cosine(rows: DataFrame, pair_list: DataFrame) -> DataFrame:
    """(1 + cosine) / 2 over all shared cells."""
    p = pairs.pooled(pairs.pair_tensor_stats(rows, pair_list))
    return p.select("a", "b", ((1 + F.col("cosine")) / 2).alias("score"))


def cka(rows: DataFrame, pair_list: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """Linear CKA of the shared tensors, weighted by the cells that took part."""
    met = blocks.cka(rows, pair_list, n_rows, n_cols)
    return met.groupBy("a", "b").agg((F.sum(F.col("cka") * F.col("cells")) / F.sum("cells")).alias("score"))


def probed_layers(tensors: DataFrame, pair_list: DataFrame, n_layers: int = 6) -> DataFrame:
    """(a, b, layer, role, tensor, n): the probed tensors of each pair, by evenly spread layers that both models have.

    ``tensors`` is (model, tensor, n_rows, n_cols).  Of several tensors of a role the first by
    name counts, and a role counts where both models have it with one shape.
    """
    t = tensors.where("n_rows >= 1 and n_cols > 1").select("model", "tensor", "n_rows", "n_cols", names.role(F.col("tensor")).alias("role"), names.layer_index(F.col("tensor")).alias("layer"))
    t = t.where(F.col("role").isin("attn_q", "attn_k", "mlp_in", "mlp_out") & F.col("layer").isNotNull())
    first = t.groupBy("model", "layer", "role").agg(F.min(F.struct("tensor", "n_rows", "n_cols")).alias("t"))
    side = lambda s: first.select(F.col("model").alias(s), "layer", "role", F.col("t").alias(f"t{s}"))
    layers = lambda s: first.select(F.col("model").alias(s), "layer").distinct()
    shared = pair_list.select("a", "b").join(layers("a"), "a").join(layers("b"), ["b", "layer"])
    spread = selection.spread_layers(shared.select(F.struct("a", "b").alias("model"), "layer"), n_layers)
    met = spread.select("model.a", "model.b", "layer").join(side("a"), ["a", "layer"]).join(side("b"), ["b", "layer", "role"])
    same = met.where("ta.n_rows = tb.n_rows and ta.n_cols = tb.n_cols")
    return same.select("a", "b", "layer", "role", F.col("ta.tensor").alias("tensor_a"), F.col("tb.tensor").alias("tensor_b"), F.col("ta.n_rows").alias("n"))


def huref(rows: DataFrame, pair_list: DataFrame, tensors: DataFrame | None = None, n_layers: int = 6, max_rows: int = 256) -> DataFrame:
    """(1 + cosine) / 2 of products of adjacent matrices, every product scaled to norm 1; 0 without a common one.

    A product is made once for each model and set of roles, whatever the number of pairs.
    """
    if tensors is None:
        tensors = rows.groupBy("model", "tensor").agg((F.max("row_idx") + 1).alias("n_rows"), F.max(F.size("v")).cast("long").alias("n_cols"))
    probes = materialize(probed_layers(tensors, pair_list, n_layers), "huref-probes")
    # pairs of a model may differ in the roles that they share: each set of them is a model of its own
    roles = probes.groupBy("a", "b", "layer").agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("roles"))
    tagged = probes.join(roles, ["a", "b", "layer"])
    side = lambda s: tagged.select(F.col(s).alias("model"), "layer", "roles", "role", F.col(f"tensor_{s}").alias("tensor"), "n")
    wanted = side("a").unionAll(side("b")).distinct().withColumn("layer", F.concat_ws("/", F.col("layer").cast("string"), "roles")).drop("roles")
    made = materialize(blocks.invariants(rows, wanted, max_rows), "huref-products")
    asks = roles.select("a", "b", F.explode(F.array(*[F.concat(F.lit(f"{k}/"), F.col("layer").cast("string"), F.lit("/"), F.col("roles")) for k in ("attn", "mlp")])).alias("tensor"))
    s = blocks.compare(made, asks)
    cosine = F.coalesce(F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0))
    score = s.groupBy("a", "b").agg(((1 + F.avg(cosine)) / 2).alias("score"))
    return pair_list.select("a", "b").distinct().join(score, ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"))


def no_direction(pair_list: DataFrame) -> DataFrame:
    """Symmetric scores cannot orient a pair."""
    return pair_list.select("a", "b", F.lit("unknown").alias("direction"))


BASELINES = {"cosine": cosine, "cka": cka, "huref": huref}
