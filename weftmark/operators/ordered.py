"""Running sums and quantiles over sorted rows, for groups of any size.

Rows are dealt by ranges of (group, order), so one group may fill every task.  A task sums
its own rows in order; the totals of the tasks before it, a row for each task and group, are
added by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.plans.shared import materialize


def same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Equality of keys (left name to right name) in which null equals null."""
    return reduce(lambda x, y: x & y, [left[a].eqNullSafe(right[b]) for a, b in keys.items()])


def running_sums(df: DataFrame, by: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """``df`` with ``<value>_upto``: the sum of a value over the rows of its group up to and with its own.

    Rows that are equal in ``order`` are summed as they come, so these should be summed
    beforehand or told apart by a further column.
    """
    placed = materialize(df.repartitionByRange(*by, *order).withColumn("__task", F.spark_partition_id()), "ordered")
    upto = Window.partitionBy("__task", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(v).over(upto).alias(f"__{v}") for v in values])
    parts = placed.groupBy("__task", *by).agg(*[F.sum(v).alias(f"__own_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.select(
        F.col("__task").alias("__at"), *[F.col(b).alias(f"__by_{b}") for b in by],
        *[F.coalesce(F.sum(f"__own_{v}").over(before), F.lit(0)).alias(f"__start_{v}") for v in values],
    )
    met = local.join(start, (local["__task"] == start["__at"]) & same(local, start, {b: f"__by_{b}" for b in by}))
    return met.select(*[local[c] for c in df.columns], *[(F.col(f"__{v}") + F.col(f"__start_{v}")).alias(f"{v}_upto") for v in values])


def with_totals(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``<value>_total``: the sum of a value over its group."""
    totals = df.groupBy(*by).agg(*[F.sum(v).alias(f"{v}_total") for v in values]).withColumnsRenamed({b: f"__by_{b}" for b in by})
    met = df.join(totals, same(df, totals, {b: f"__by_{b}" for b in by}))
    return met.select(*[df[c] for c in df.columns], *[f"{v}_total" for v in values])


def quantile_columns(rank: str, count: str, x: str, at: list[float]) -> list[Column]:
    """Aggregates for each quantile, interpolated between the two ranks (from 1) around it."""
    out = []
    for q in at:
        place = (F.col(count) - 1) * F.lit(float(q))
        low, high = (F.max(F.when(F.col(rank) - 1 == f(place), F.col(x))) for f in (F.floor, F.ceil))
        share = F.max(place - F.floor(place))
        out.append(low + (high - low) * share)
    return out
