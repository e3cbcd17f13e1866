"""Position of each row within its key, for keys of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.plans.shared import materialize


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; null equals null, and the first always differs."""
    n = len(column)
    out = np.ones(n, bool)
    if n > 1:
        a, b = column.slice(1), column.slice(0, n - 1)
        known = pc.and_(pc.is_valid(a), pc.is_valid(b))
        differ = pc.if_else(known, pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_valid(a), pc.is_valid(b)))
        out[1:] = differ.to_numpy(zero_copy_only=False)
    return out


def numbered(df: DataFrame, key: str, order: list, name: str = "p") -> DataFrame:
    """``df`` with the place, from 1, of each row among those of its key in the given order.

    Rows are dealt by ranges of (key, order), so one key may fill many tasks.  A task
    numbers its sorted rows as they pass; only its first key can have begun in an earlier
    task, so the table of such beginnings has one row for each task at most.  Rows that are
    equal in key and order are numbered as they come.  ``key`` must not be null.
    """
    dealt = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    names = [*df.columns, name, "task"]
    types = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key)
            start = changes(keys)
            goes_on = last is not None and keys[0].as_py() == last
            place = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0)) + 1
            if goes_on:
                rest = np.flatnonzero(start[1:])
                place[: rest[0] + 1 if len(rest) else n] += seen
            last, seen = keys[n - 1].as_py(), int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(n, task, np.int32))], names=names)

    local = materialize(dealt.mapInArrow(number, f"{types}, {name} long, task int"), "numbered")
    ends = local.groupBy("task").agg(F.min(key).alias("first"), F.max(F.struct(key, name)).alias("end"))
    held = {r["task"]: r for r in ends.collect()}  # a row for each task
    moved, last, reached = [], None, 0
    for task in sorted(held):
        first, (end, place) = held[task]["first"], held[task]["end"]
        more = reached if first == last else 0
        if more:
            moved.append((task, first, more))
        last, reached = end, place + (more if end == first else 0)
    shift = df.sparkSession.createDataFrame(moved, f"task int, first {dict(df.dtypes)[key]}, more long")
    met = local.join(F.broadcast(shift), (local["task"] == shift["task"]) & (local[key] == shift["first"]), "left")
    out = met.select(*[local[c] for c in df.columns], (local[name] + F.coalesce(shift["more"], F.lit(0))).alias(name))
    out.weftmark_path = local.weftmark_path
    return out
