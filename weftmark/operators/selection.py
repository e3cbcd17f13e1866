"""Which rows, tensors and byte ranges to read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark import schema
from weftmark.functions import names
from weftmark.plans.shared import dealt


def select_rows(
    tensors: DataFrame, max_rows: int | None = None, stride: int | None = None, blocks: int = schema.SAMPLE_BLOCKS
) -> DataFrame:
    """Explode (…, n_rows) into the sampled ``row_idx``: evenly placed blocks of contiguous rows.

    The sample depends on the shape and the arguments only, so models of one shape are
    compared row by row.  All rows are taken where ``max_rows`` is absent or not smaller.
    """
    step = stride if stride and stride > 1 else 1
    size = F.floor((F.col("n_rows") + step - 1) / step).cast("long")
    rows = tensors.withColumn("__n", F.greatest(size, F.lit(0).cast("long"))).where("__n > 0")
    every = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)
    if max_rows:
        count = max(1, min(blocks, max_rows))
        per = max(1, max_rows // count)
        gap = F.lit(float(max(count - 1, 1)))
        starts = F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (F.col("__n") - per) / gap).cast("long")
        )
        runs = F.transform(starts, lambda s: F.sequence(s, F.least(s + per, F.col("__n")) - 1))
        picked = F.slice(F.array_sort(F.array_distinct(F.flatten(runs))), 1, max_rows)
        chosen = F.when(F.col("__n") <= max_rows, every).otherwise(picked)
    else:
        chosen = every
    return rows.withColumn("row_idx", F.explode(chosen)).withColumn("row_idx", F.col("row_idx") * step).drop("__n")


def coalesce_ranges(ranges: DataFrame, gap: int = schema.COALESCE_GAP, by: str = "file") -> DataFrame:
    """Merge half-open ranges (by, begin, end) with holes of at most ``gap`` bytes: islands by a running maximum."""
    order = Window.partitionBy(by).orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = dealt(ranges.where("end > begin").select(by, "begin", "end"), by).withColumn("__new", (reach.isNull() | (F.col("begin") - reach > gap)).cast("int"))
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("__i", island).groupBy(by, "__i").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("__i")
    )


def coalesce_capped(ranges: DataFrame, gap: int, max_slack: int, by: str = "file") -> DataFrame:
    """As :func:`coalesce_ranges` with a limit on all hole bytes taken, decided in order within a file.

    The order matters, so each task walks its files' sorted ranges once and holds one open range.
    """
    placed = ranges.where("end > begin").select(by, F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))

    def walk(batches):
        current = None
        for batch in batches:
            done = []
            for f, first, last in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if current is not None and current[0] == f:
                    hole = first - current[2]
                    if hole <= gap and current[3] + max(hole, 0) <= max_slack:
                        current = (f, current[1], max(current[2], last), current[3] + max(hole, 0))
                        continue
                    done.append(current[:3])
                    current = (f, first, last, current[3])
                else:
                    if current is not None:
                        done.append(current[:3])
                    current = (f, first, last, 0)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], batch.schema.field(i).type) for i in range(3)], batch.schema.names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], batch.schema.field(i).type) for i, x in enumerate(current[:3])], batch.schema.names)

    return dealt(placed, by).sortWithinPartitions(by, "begin", "end").mapInArrow(walk, placed.schema)


def common_tensors(tensors: DataFrame, min_numel: int, models: int | None = None) -> DataFrame:
    """2-D tensors of ``min_numel`` cells that every model has with one shape (n-ary intersection by counting)."""
    total = F.lit(models) if models is not None else None
    wide = tensors.where((F.col("numel") >= min_numel) & (F.least("n_rows", "n_cols") >= 2))
    agg = wide.groupBy("tensor").agg(
        F.count_distinct("model").alias("models"), F.count_distinct(F.struct("n_rows", "n_cols")).alias("shapes"),
        F.max("numel").alias("numel"),
    )
    if total is None:
        n = tensors.agg(F.count_distinct("model").alias("n"))
        agg = agg.join(F.broadcast(n))  # one row
        total = F.col("n")
    return agg.where((F.col("models") == total) & (F.col("shapes") == 1)).select("tensor", "numel")


def round_robin(tensors: DataFrame, limit: int = 8) -> DataFrame:
    """Largest tensors taken in turn from the roles in alphabetical order."""
    turn = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("numel"), "tensor"))
    return tensors.withColumn("turn", turn).orderBy("turn", "role").limit(limit)


def capped_pick(tensors: DataFrame, n: int, prefer: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` first tensors by (preferred, size, name) with at most ceil(n / 3) a role, then the rest to fill up."""
    cap = -(-n // 3)
    first = (F.col("tensor") != prefer).cast("int") if prefer else F.lit(0)
    order = [first, F.desc("numel"), F.col("tensor")]
    in_role = F.row_number().over(Window.partitionBy(*by, "role").orderBy(*order))
    ranked = tensors.withColumn("__over", (in_role > cap).cast("int"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy("__over", *order))
    return ranked.withColumn("pick", at).where(F.col("pick") <= n).drop("__over")


def largest(tensors: DataFrame, n: int) -> DataFrame:
    return tensors.orderBy(F.desc("numel"), "tensor").limit(n)


def first_by_name(tensors: DataFrame, n: int = 8) -> DataFrame:
    return tensors.orderBy("tensor").limit(n)


def spread_layers(layers: DataFrame, n: int = 6) -> DataFrame:
    """Evenly spread layers of each model: positions rint(linspace(0, count - 1, n))."""
    at = F.row_number().over(Window.partitionBy("model").orderBy("layer")) - 1
    count = F.count(F.lit(1)).over(Window.partitionBy("model"))
    placed = layers.select("model", "layer", at.alias("at"), count.alias("count"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("count") - 1) / F.lit(float(n - 1))).cast("int"))
    return placed.where(F.array_contains(wanted, F.col("at"))).select("model", "layer")


def sketch_tensors(tensors: DataFrame) -> DataFrame:
    """One tensor per model, role and depth bucket: 2-D first, then the largest, then by name."""
    role, layer = names.role(F.col("tensor")), names.layer_index(F.col("tensor"))
    t = tensors.withColumn("role", role).withColumn("layer", layer).where("role is not null")
    count = F.coalesce(F.max("layer").over(Window.partitionBy("model")) + 1, F.lit(1))
    bucket = F.when(F.col("layer").isNull(), names.layerless_bucket(F.col("role"))).otherwise(
        names.depth_bucket(names.relative_depth(F.col("layer"), count))
    )
    t = t.withColumn("bucket", bucket)
    best = Window.partitionBy("model", "role", "bucket").orderBy(F.desc(F.col("n_cols") > 1), F.desc("numel"), "tensor")
    t = t.withColumn("__at", F.row_number().over(best)).where("__at = 1").drop("__at")
    return t.withColumn("slot", names.slot(F.col("role"), F.col("bucket")))
