"""The whole pipeline over a universe of models, as tables between stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark import schema
from weftmark.operators import direction, graph, merge, pairs, sketch
from weftmark.plans.shared import materialize


@dataclass
class Phylogeny:
    nodes: DataFrame
    edges: DataFrame
    verdicts: DataFrame
    reduced: DataFrame


def neighbourhood(found: DataFrame) -> DataFrame:
    """Ordered pairs (a, b) of candidates and of models with a common candidate.

    The veto and the outgroups compare a pair with models that are near to both of its
    sides, so no other distances are asked for: about k * k pairs a model, not one for
    every other model.
    """
    one = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    two = one.join(one.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
    return materialize(one.unionByName(two).where("a != b").distinct(), "phylo-near-pairs")


def build(
    rows: DataFrame, *, k: int = 10, max_distance: float = schema.MAX_DISTANCE, relatedness: float = schema.MIN_RELATEDNESS,
    abstain: float = schema.ABSTAIN, proximity: float = 0.0, veto: bool = True, outgroups: int = 0, merge_check: bool = True,
    reduce: bool = True, keep_weighted: bool = False, index: DataFrame | None = None, headers: DataFrame | None = None,
    delta_tensors: int = 10, delta_rows: int = 256, delta_cells: int = 0,
) -> Phylogeny:
    """Edges of the lineage of all models in ``rows``.

    Candidates by nearest sketches, the relatedness gate, the optional proximity gate, the
    cousin veto, direction with optional outgroups, merge weights, and clean-up of the
    graph.  Each stage is one set-oriented job over the candidates' neighbourhood: pairs, and pairs with a third
    model, meet in blocks of models (``blocks.compare``).  Distances among neighbours take the ``delta_tensors``
    largest matrices of ``delta_cells`` shared cells or more, ``delta_rows`` rows of each.  ``headers`` (model,
    tensor, dtype, shape) lets direction see precision and true shapes.
    """
    nodes = rows.select(F.col("model").alias("node")).distinct()
    index = index if index is not None else materialize(sketch.sketch(rows).select("model", "vector"), "phylo-index")
    found = materialize(sketch.pair_candidates(sketch.candidate_parents(index, index, k, max_distance)), "phylo-pairs")
    sums = materialize(pairs.pair_tensor_stats(rows, found), "phylo-sums")
    pooled = pairs.pooled(sums).join(found, ["a", "b"], "right")
    gate = pairs.relatedness(pooled, sketch.sketch_similarity(F.col("distance"))).where(F.col("relatedness") >= relatedness)
    related = materialize(gate.select("a", "b"), "phylo-related")
    deltas = materialize(pairs.relative_deltas(rows, neighbourhood(found), None, delta_tensors, delta_rows, delta_cells), "phylo-deltas")
    if proximity:
        both = deltas.join(related.unionByName(related.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_semi")
        near = pairs.proximity_gate(both.select(F.col("a").alias("child"), F.col("b").alias("candidate"), "delta"), proximity)
        kept = near.select(F.least("child", "candidate").alias("a"), F.greatest("child", "candidate").alias("b")).distinct()
        related = materialize(related.join(kept, ["a", "b"], "left_semi"), "phylo-near")
    if veto and related.count() > 1:
        open_ = pairs.cousin_veto(rows, deltas, related, sums.join(related, ["a", "b"], "left_semi")).where("not vetoed").select("a", "b")
        related = materialize(open_, "phylo-open")
    evidence = direction.features(direction.collect_evidence(rows, related, headers))
    name = None
    if outgroups:
        chosen = pairs.pick_outgroups(deltas, related, outgroups).select("a", "b", "c")
        evidence = evidence.join(pairs.outgroup_statistic(rows, chosen).select("a", "b", "outgroup"), ["a", "b"], "left")
        name = "outgroup"
    verdicts = materialize(direction.verdict(evidence, abstain=abstain, outgroup=name).drop("contributions"), "phylo-verdicts")
    named = verdicts.withColumn("relation", direction.relation(F.col("direction"))).where("direction != 'unknown'")
    flip = F.col("direction") == "b->a"
    edges = named.select(
        F.when(flip, F.col("b")).otherwise(F.col("a")).alias("parent"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("child"),
        "relation", F.lit(None).cast("double").alias("weight"), "confidence",
    )
    edges = materialize(edges, "phylo-edges")
    if merge_check:
        edges = materialize(merge.resolve_merges(rows, edges), "phylo-merged")
    edges = graph.break_cycles(edges)
    gone = edges.limit(0).withColumn("via", F.lit(None).cast("string"))
    if reduce:
        edges, gone = graph.transitive_reduction(edges, keep_weighted)
    return Phylogeny(nodes, edges, verdicts, gone)
