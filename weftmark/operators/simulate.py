"""Lineage-simulating transforms of tensor rows (tensor, row_idx, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.operators.ordered import running_sums
from weftmark.plans.shared import materialize


def _clamped(x: Column, levels: int) -> Column:
    return F.greatest(F.lit(-float(levels)), F.least(F.lit(float(levels)), F.rint(x)))


def int8_round_trip(rows: DataFrame) -> DataFrame:
    """Per-row absmax quantisation to 127 levels and back; zero rows stay."""
    step = F.array_max(F.transform("v", F.abs)) / F.lit(127.0)
    made = rows.withColumn("__s", step)
    back = F.transform("v", lambda x: F.when(F.col("__s") > 0, _clamped(x / F.col("__s"), 127) * F.col("__s")).otherwise(x))
    return made.withColumn("v", back).drop("__s")


def int4_groupwise(rows: DataFrame, width: int = 64) -> DataFrame:
    """Absmax quantisation to 7 levels in groups of ``width`` columns."""
    groups = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("v") / F.lit(width)).cast("int") - 1),
        lambda g: F.slice("v", g * width + 1, F.lit(width)),
    )

    def snapped(g: Column) -> Column:
        step = F.array_max(F.transform(g, F.abs)) / F.lit(7.0)
        return F.transform(g, lambda x: F.when(step > 0, _clamped(x / step, 7) * step).otherwise(x))

    return rows.withColumn("v", F.flatten(F.transform(groups, snapped)))


def magnitude_prune(rows: DataFrame, fraction: float, by: tuple[str, ...] = ("tensor",)) -> DataFrame:
    """Zero the values whose magnitude is below the ``fraction`` quantile of their tensor (or of all)."""
    cells = rows.select(*by, F.explode("v").alias("x"))
    cut = cells.groupBy(*by).agg(F.percentile(F.abs("x"), fraction).alias("__q"))
    joined = rows.join(cut, list(by)) if by else rows.join(F.broadcast(cut))  # one row without keys
    return joined.withColumn(
        "v", F.transform("v", lambda x: F.when(F.abs(x) >= F.col("__q"), x).otherwise(F.lit(0.0)))
    ).drop("__q")


def structured_prune(gate: DataFrame, up: DataFrame, down: DataFrame, fraction: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Zero the neurons (rows of gate and up, columns of down) with the least joint norm."""
    square = lambda: F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    norms = gate.select("row_idx", square().alias("s")).unionAll(up.select("row_idx", square().alias("s")))
    score = norms.groupBy("row_idx").agg(F.sum("s").alias("s"))
    ranked = materialize(running_sums(score.withColumns({"all": F.lit(0), "n": F.lit(1)}), ["all"], [F.col("s"), F.col("row_idx")], ["n"]), "neurons")
    count = ranked.agg(F.count(F.lit(1)).alias("count"))
    dead = ranked.join(F.broadcast(count)).where(F.col("n_upto") <= F.round(F.lit(fraction) * F.col("count"))).select("row_idx")  # one row
    zero = F.transform("v", lambda x: F.lit(0.0))
    gone = dead.withColumn("__dead", F.lit(True))

    def rows_zeroed(t: DataFrame) -> DataFrame:
        joined = t.join(gone, "row_idx", "left")
        return joined.withColumn("v", F.when(F.col("__dead"), zero).otherwise(F.col("v"))).drop("__dead")

    # the mask is as wide as a row of down, however many neurons there are, and looked up by place
    width = down.agg(F.max(F.size("v")).alias("w"))
    places = width.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("w").cast("long") - 1)).alias("row_idx")).join(gone, "row_idx", "left")
    mask = places.agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.col("__dead").isNotNull().alias("d")))), lambda p: p["d"]).alias("__mask"))
    masked = down.join(F.broadcast(mask))  # one row
    masked = masked.withColumn(
        "v", F.transform("v", lambda x, i: F.when(F.get("__mask", i), F.lit(0.0)).otherwise(x))
    ).drop("__mask")
    return rows_zeroed(gate), rows_zeroed(up), masked


def extend_vocab(rows: DataFrame, tensor: str, extra: int, scale: float = 0.02) -> DataFrame:
    """Append ``extra`` deterministic rows of size about ``scale`` to one tensor."""
    shape = rows.where(F.col("tensor") == tensor).agg(F.max("row_idx").alias("last"), F.first(F.size("v")).alias("d"))
    new = shape.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(extra).cast("long"))).alias("i"), "last", "d")
    made = new.select(
        F.lit(tensor).alias("tensor"),
        (F.col("last") + F.col("i")).alias("row_idx"),
        F.transform(
            F.sequence(F.lit(0), F.col("d") - 1), lambda j: F.lit(scale) * F.sin(F.col("i") * F.lit(12.9898) + j * F.lit(78.233))
        ).alias("v"),
    )
    return rows.select("tensor", "row_idx", "v").unionByName(made)


def low_rank_delta(rows: DataFrame, rank: int = 8, relative: float = 0.03) -> DataFrame:
    """Add to every matrix a delta of the given rank whose norm is ``relative`` of the matrix's own.

    The factors are waves of the row and of the column, one frequency for each rank, so nothing is
    drawn and no factor is stored.  Single rows stay as they are.
    """
    left = lambda k: F.sin((F.col("row_idx") + 1) * F.lit(12.9898) * k)
    factors = rows.select("tensor", "row_idx", "v", F.transform(F.sequence(F.lit(1), F.lit(rank)), left).alias("u"))
    cell = lambda c: F.aggregate(
        F.transform("u", lambda x, k: x * F.cos((c + 1) * F.lit(78.233) * (k + 1))), F.lit(0.0), lambda s, x: s + x
    )
    made = factors.select("tensor", "row_idx", "v", F.transform("v", lambda x, c: cell(c)).alias("d"))
    square = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    norms = made.groupBy("tensor").agg(square("v").alias("vv"), square("d").alias("dd"), F.count(F.lit(1)).alias("n"))
    size = F.when(F.col("n") >= 2, F.coalesce(F.try_divide(F.lit(relative) * F.sqrt("vv"), F.sqrt("dd")), F.lit(0.0))).otherwise(0.0)
    met = made.join(norms.select("tensor", size.alias("__s")), "tensor")
    return met.select("tensor", "row_idx", F.zip_with("v", "d", lambda x, d: x + F.col("__s") * d).alias("v"))


def halve_depth(tensors: DataFrame, name: str = "tensor") -> DataFrame:
    """Keep even layers and renumber them; tensors outside layers stay."""
    layer = F.regexp_extract(name, r"\.layers\.(\d+)\.", 1)
    number = F.when(layer == "", None).otherwise(layer.cast("int"))
    kept = tensors.withColumn("__l", number).where("__l is null or __l % 2 = 0")
    new = F.regexp_replace(F.col(name), F.lit(r"\.layers\.\d+\."), F.concat(F.lit(".layers."), (F.col("__l") / 2).cast("int").cast("string"), F.lit(".")))
    return kept.withColumn(name, F.when(F.col("__l").isNull(), F.col(name)).otherwise(new)).drop("__l")


def _deltas(base: DataFrame, *children: DataFrame) -> DataFrame:
    """Rows of the base with the task vectors t0, t1, ... of its children."""
    out = base.select("tensor", "row_idx", F.col("v").alias("b"))
    for i, child in enumerate(children):
        out = out.join(child.select("tensor", "row_idx", F.col("v").alias(f"c{i}")), ["tensor", "row_idx"])
    made = [F.zip_with(f"c{i}", "b", lambda x, y: x - y).alias(f"t{i}") for i in range(len(children))]
    return out.select("tensor", "row_idx", "b", *made)


def merge_linear(base: DataFrame, a: DataFrame, b: DataFrame, wa: float, wb: float) -> DataFrame:
    """Base plus weighted task vectors."""
    d = _deltas(base, a, b)
    mixed = F.zip_with("t0", "t1", lambda x, y: F.lit(wa) * x + F.lit(wb) * y)
    return d.select("tensor", "row_idx", F.zip_with("b", mixed, lambda x, y: x + y).alias("v"))


def merge_slerp(base: DataFrame, a: DataFrame, b: DataFrame, at: float) -> DataFrame:
    """Spherical interpolation of two task vectors per tensor, linear if they are nearly parallel or zero."""
    d = _deltas(base, a, b)
    total = lambda x, y: F.sum(F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p))
    geo = d.groupBy("tensor").agg(total("t0", "t0").alias("aa"), total("t1", "t1").alias("bb"), total("t0", "t1").alias("ab"))
    cos = F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))
    geo = geo.withColumn("cos", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    omega = F.acos("cos")
    flat = F.col("cos").isNull() | (F.abs("cos") > 1 - 5e-4)
    geo = geo.select(
        "tensor",
        F.when(flat, F.lit(1 - at)).otherwise(F.sin(F.lit(1 - at) * omega) / F.sin(omega)).alias("wa"),
        F.when(flat, F.lit(at)).otherwise(F.sin(F.lit(at) * omega) / F.sin(omega)).alias("wb"),
    )
    mixed = F.zip_with("t0", "t1", lambda x, y: F.col("wa") * x + F.col("wb") * y)
    return d.join(geo, "tensor").select("tensor", "row_idx", F.zip_with("b", mixed, lambda x, y: x + y).alias("v"))


def merge_ties(base: DataFrame, children: list[DataFrame], weights: list[float], density: float = 0.2) -> DataFrame:
    """Trim each task vector to its largest values, elect a sign, average the agreeing weighted entries."""
    d = _deltas(base, *children)
    cells = d.select(
        "tensor", "row_idx", F.posexplode(F.arrays_zip("b", *[f"t{i}" for i in range(len(children))])).alias("c", "z")
    ).select("tensor", "row_idx", "c", "z.*")
    cuts = cells.groupBy("tensor").agg(*[F.percentile(F.abs(f"t{i}"), 1 - density).alias(f"q{i}") for i in range(len(children))])
    cells = cells.join(cuts, "tensor")
    kept = [F.when(F.abs(f"t{i}") >= F.col(f"q{i}"), F.col(f"t{i}") * w).otherwise(0.0) for i, w in enumerate(weights)]
    cells = cells.select("tensor", "row_idx", "c", "b", *[k.alias(f"k{i}") for i, k in enumerate(kept)])
    total = sum((F.col(f"k{i}") for i in range(1, len(children))), F.col("k0"))
    sign = F.signum(total)
    agree = [(F.signum(f"k{i}") == sign) & (F.col(f"k{i}") != 0) for i in range(len(children))]
    s = sum((F.when(a, F.col(f"k{i}")).otherwise(0.0) for i, a in enumerate(agree)), F.lit(0.0))
    n = sum((a.cast("int") for a in agree), F.lit(0))
    cells = cells.withColumn("x", F.col("b") + F.when(n > 0, s / n).otherwise(0.0))
    return cells.groupBy("tensor", "row_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda p: p["x"]).alias("v")
    )


def merge_dare(base: DataFrame, a: DataFrame, b: DataFrame, wa: float, wb: float, drop: float = 0.5, seed: int = 0) -> DataFrame:
    """Drop task-vector entries by a hash of their place, rescale the rest, add them weighted."""
    d = _deltas(base, a, b)

    def thinned(t: str, which: int) -> Column:
        at = lambda i: F.pmod(F.xxhash64("tensor", "row_idx", i, F.lit(seed), F.lit(which)), F.lit(1000))
        return F.transform(t, lambda x, i: F.when(at(i) >= int(drop * 1000), x / F.lit(1 - drop)).otherwise(F.lit(0.0)))

    mixed = F.zip_with(thinned("t0", 0), thinned("t1", 1), lambda x, y: F.lit(wa) * x + F.lit(wb) * y)
    return d.select("tensor", "row_idx", F.zip_with("b", mixed, lambda x, y: x + y).alias("v"))
