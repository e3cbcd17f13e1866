"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.plans.shared import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge, label being the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows those hooks twice,
    and contracts the edges; paths shorten at least by half, so rounds grow with the
    logarithm of the longest path.  Hot nodes only meet in partial aggregates and in
    joins that adaptive execution can split.  Each round is a written table, deleted once
    the next one is written.  The result is a written table too, unless there is no edge.
    """
    left = materialize(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct(), "cc-edges"
    )
    labels = None
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = materialize(
            both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to")),
            "cc-hooks",
        )
        jumps = hooks
        for _ in range(2):
            nxt = jumps.select(F.col("node").alias("to"), F.col("to").alias("further"))
            jumps = jumps.join(nxt, "to").select("node", F.col("further").alias("to"))
        jumps = materialize(jumps, "cc-jumps")
        if labels is None:
            renamed = jumps.withColumnRenamed("to", "label")
        else:
            step = jumps.select(F.col("node").alias("label"), "to")
            renamed = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        renamed = materialize(renamed, "cc-labels")
        hu = jumps.select(F.col("node").alias("u"), F.col("to").alias("tu"))
        hv = jumps.select(F.col("node").alias("v"), F.col("to").alias("tv"))
        moved = left.join(hu, "u").join(hv, "v")
        moved = materialize(
            moved.select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).where("u != v").distinct(),
            "cc-edges",
        )
        for done in (left, hooks, jumps, labels):
            if done is not None:
                discard(done)
        left, labels = moved, renamed
    discard(left)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, label long")
    return labels
