"""Statistics of tensor rows (model, tensor, row_idx, v)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark import schema
from weftmark.operators import ordered

KEYS = ["model", "tensor"]


def total(v: str, f=lambda x: x) -> Column:
    """Sum of f over an array."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))


def row_norms(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, "row_idx", F.sqrt(total("v", lambda x: x * x)).alias("norm"))


def fossils(norms: DataFrame) -> DataFrame:
    """Row norms with the flags dead and outlier, relative to the tensor's median norm."""
    medians = norms.groupBy(*KEYS).agg(F.percentile("norm", 0.5).alias("median"))
    dead = F.col("norm") <= F.greatest(F.lit(schema.DEAD_ABS), F.col("median") * schema.DEAD_REL)
    outlier = (F.col("median") > 0) & (F.col("norm") > F.col("median") * schema.OUTLIER_MULT)
    return norms.join(medians, KEYS).select(*KEYS, "row_idx", "norm", "median", dead.alias("dead"), outlier.alias("outlier"))


def tensor_stats(rows: DataFrame) -> DataFrame:
    """Norm, zero share, dead and outlier shares and outlier sharpness per tensor."""
    cells = rows.groupBy(*KEYS).agg(
        F.sqrt(F.sum(total("v", lambda x: x * x))).alias("norm"),
        (F.sum(F.size(F.filter("v", lambda x: x == 0))) / F.sum(F.size("v"))).alias("zero_frac"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    flags = fossils(row_norms(rows)).groupBy(*KEYS).agg(
        F.avg(F.col("dead").cast("double")).alias("dead_frac"),
        F.avg(F.col("outlier").cast("double")).alias("outlier_frac"),
        F.coalesce(F.try_divide(F.avg(F.when(F.col("outlier"), F.col("norm"))), F.max("median")), F.lit(0.0)).alias("sharpness"),
    )
    return cells.join(flags, KEYS)


def containment(masks: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Share of the cells of x that are also in y, 1 where x is empty."""
    both, own = F.sum((F.col(x) & F.col(y)).cast("int")), F.sum(F.col(x).cast("int"))
    return masks.groupBy(*by).agg(F.coalesce(F.try_divide(both, own), F.lit(1.0)).alias("containment"))


def zero_containment(sums: DataFrame) -> DataFrame:
    """Per (a, b, tensor): zero shares of both sides and containment of zeros both ways, from the sums of a pair."""
    return sums.select(
        "a", "b", "tensor", "cells",
        (F.col("za") / F.col("cells")).alias("zero_a"), (F.col("zb") / F.col("cells")).alias("zero_b"),
        F.coalesce(F.try_divide("zz", "za"), F.lit(1.0)).alias("h_ab"), F.coalesce(F.try_divide("zz", "zb"), F.lit(1.0)).alias("h_ba"),
    )


def profile(values: DataFrame, by: list[str], x: str) -> DataFrame:
    """Eight quantiles of x over its mean, Gini coefficient, excess kurtosis and skewness (population moments).

    Ranks come from one distributed sort, which serves all quantiles and the coefficient.
    """
    at = [0.05 + i * 0.9 / 7 for i in range(8)]
    flat = values.select(*by, F.col(x).alias("x"), F.greatest(F.col(x), F.lit(0.0)).alias("p"), F.lit(1).cast("long").alias("one")).where("x is not null")
    ranked = ordered.with_totals(ordered.running_sums(flat, by, [F.col("x")], ["one"]), by, ["one"])
    n, s = F.count(F.lit(1)), F.sum("p")
    gini = F.try_divide(2 * F.sum(F.col("one_upto") * F.col("p")), n * s) - (n + 1) / n
    level = F.stddev_pop("x") <= 1e-12
    out = ranked.groupBy(*by).agg(
        *[c.alias(f"__q{i}") for i, c in enumerate(ordered.quantile_columns("one_upto", "one_total", "x", at))], F.avg("x").alias("__m"),
        F.coalesce(gini, F.lit(0.0)).alias("gini"),
        F.when(level, F.lit(0.0)).otherwise(F.kurtosis("x")).alias("kurtosis"),
        F.when(level, F.lit(0.0)).otherwise(F.skewness("x")).alias("skewness"),
    )
    quantiles = [F.try_divide(F.col(f"__q{i}"), F.col("__m")).alias(f"q{i}") for i in range(8)]
    return out.select(*by, *quantiles, "gini", "kurtosis", "skewness")


def ks_2samp(values: DataFrame, by: list[str], x: str, group: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of x between the rows where ``group`` is true and false: one distributed sort of the distinct values."""
    per = values.groupBy(*by, x).agg(F.sum(F.col(group).cast("long")).alias("c1"), F.sum((~F.col(group)).cast("long")).alias("c0"))
    steps = ordered.with_totals(ordered.running_sums(per, by, [F.col(x)], ["c1", "c0"]), by, ["c1", "c0"])
    gap = F.abs(F.try_divide("c1_upto", "c1_total") - F.try_divide("c0_upto", "c0_total"))
    return steps.groupBy(*by).agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def orphan_stats(orphans: DataFrame, shared_norms: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """How untrained the rows look that only one model has (rows by ``keys``), against the norms of shared rows."""
    norms = orphans.select(*keys, "v", F.size("v").alias("d"), F.sqrt(total("v", lambda x: x * x)).alias("norm"))
    medians = norms.groupBy(*keys).agg(F.percentile("norm", 0.5).alias("median"))
    band = 3 * F.col("median") / F.sqrt(F.greatest(2.0 * F.col("d"), F.lit(2.0)))
    tight = (F.abs(F.col("norm") - F.col("median")) <= band) | (F.col("norm") <= schema.DEAD_ABS)
    stats = norms.join(medians, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.col("norm") <= schema.DEAD_ABS).cast("double")).alias("zero_frac"),
        ((F.count(F.lit(1)) - F.count_distinct("v")) / F.count(F.lit(1))).alias("dup_frac"),
        F.coalesce(F.try_divide(F.stddev_pop("norm"), F.avg("norm")), F.lit(0.0)).alias("cv"),
        F.avg(tight.cast("double")).alias("__tight"),
        F.max("median").alias("__median"),
    )
    enough = F.col("n_rows") >= schema.MIN_ORPHAN_ROWS
    both = norms.select(*keys, "norm", F.lit(True).alias("own")).unionByName(shared_norms.select(*keys, "norm", F.lit(False).alias("own")))
    out = stats.join(ks_2samp(both, keys, "norm", "own"), keys, "left").withColumn("ks", F.coalesce("ks", F.lit(0.0)))
    out = out.withColumn("untrained_frac", F.when(enough & (F.col("__median") > 0), F.col("__tight")).otherwise(F.lit(0.0)))
    blend = F.greatest(0.5 * F.col("untrained_frac") + 0.5 * F.col("ks"), F.col("zero_frac"), F.col("dup_frac"))
    score = F.when(enough, F.least(F.lit(1.0), blend)).otherwise(F.lit(0.0))
    return out.withColumn("score", score).drop("__tight", "__median")


#: Cells of the matrices that the lattice search of a task works on at once.
CELLS = 1 << 16


def _on_lattice(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(known, fit, levels, distinct) of the rows of a finite matrix; NaN where a row has no fit or levels."""
    low, high = schema.LATTICE_LEVELS
    n, width = x.shape
    u = np.sort(np.abs(x), axis=1)
    own = width - (u > 0).sum(1)  # where the magnitudes begin, after the zeros
    gaps = np.diff(u, axis=1)
    gaps[(u[:, :-1] == 0) | (gaps == 0)] = np.inf
    gaps.sort(axis=1)
    many = np.isfinite(gaps).sum(1)  # one less than the distinct magnitudes
    amax, line = u[:, -1:], np.arange(n)
    place = lambda at: gaps[line, np.clip(at, 0, None)]
    steps = [u[line, np.minimum(own, width - 1)], place(np.zeros(n, int))]
    for q in (0.05, 0.25, 0.5):
        at = np.maximum(many - 1, 0) * q
        down = np.floor(at).astype(int)
        a, b = place(down), place(np.ceil(at).astype(int))
        steps.append(a + (b - a) * (at - down))
    steps = np.array(steps).T
    steps[many == 0, 1:] = np.nan
    steps[(steps < amax / high) | (steps > amax / low)] = np.nan
    steps = np.round(steps, 18)
    fit, least = np.full(n, -1.0), np.full(n, np.nan)
    for s in steps.T:
        y = x / s[:, None]
        share = ((np.abs(y - np.rint(y)) <= schema.LATTICE_TOLERANCE).sum(1) - own) / (width - own)
        better = ~np.isnan(s) & ((share > fit) | ((share == fit) & (s < least)))
        fit[better], least[better] = share[better], s[better]
    known = width - own >= 8
    return known, np.where(many < 2, np.nan, np.maximum(fit, 0.0)), np.where((many >= 2) & (fit > 0), amax[:, 0] / least, np.nan), (many + 1) / (width - own)


def _lattices(batches):
    """(model, tensor, f, l, d, v) of the rows in the batches: fit, levels and distinct ratio; ``v`` stays where a value is null or not finite."""
    for batch in batches:
        v = batch.column("v")
        sizes = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        first = np.cumsum(sizes) - sizes
        done, odd = np.zeros((3, len(v))), np.zeros(len(v), bool)
        known = np.zeros(len(v), bool)
        with np.errstate(all="ignore"):
            for width in np.unique(sizes[sizes >= 8]).tolist():
                mine = np.flatnonzero(sizes == width)
                for at in np.split(mine, range(max(1, CELLS // width), len(mine), max(1, CELLS // width))):
                    x = flat[first[at][:, None] + np.arange(width)]
                    fine = np.isfinite(x).all(1)
                    odd[at[~fine]] = True
                    known[at[fine]], *found = _on_lattice(x[fine])
                    done[:, at[fine]] = found
        keep = pa.array(known | odd)
        numbers = [pa.array(c, pa.float64(), mask=odd | np.isnan(c)) for c in done]
        left = pa.compute.if_else(pa.array(odd), v, pa.scalar(None, v.type))
        yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column("tensor"), *numbers, left], names=[*KEYS, "f", "l", "d", "v"]).filter(keep)


def lattice_fit(rows: DataFrame) -> DataFrame:
    """Mean share of non-zero values that sit on a per-row lattice, mean levels and mean distinct ratio.

    Candidate steps of a row are its least magnitude, its least gap between magnitudes and
    low quantiles of the gaps, kept between amax / 4096 and amax / 3.  Tasks search matrices of
    rows; the few rows with values that are null or not finite are searched by expressions.
    """
    low, high = schema.LATTICE_LEVELS
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in KEYS)
    found = rows.where("v is not null").select(*KEYS, F.col("v").cast("array<double>").alias("v")).mapInArrow(_lattices, f"{kinds}, f double, l double, d double, v array<double>")
    r = found.select(*KEYS, "f", "l", "d", F.filter("v", lambda x: x != 0).alias("v")).where("v is null or size(v) >= 8")
    r = r.withColumn("u", F.array_sort(F.array_distinct(F.transform("v", F.abs))))
    r = r.withColumn("amax", F.element_at("u", -1)).withColumn("distinct", F.size("u") / F.size("v"))
    gaps = F.zip_with(F.slice("u", 2, F.greatest(F.size("u") - 1, F.lit(0))), F.slice("u", 1, F.greatest(F.size("u") - 1, F.lit(0))), lambda a, b: a - b)
    r = r.withColumn("g", F.array_sort(F.filter(gaps, lambda x: x > 0)))

    def quantile(q: float) -> Column:
        at = (F.size("g") - 1) * F.lit(q)
        a, b = F.get("g", F.floor(at).cast("int")), F.get("g", F.ceil(at).cast("int"))
        return a + (b - a) * (at - F.floor(at))

    steps = F.array(F.get("u", 0), F.get("g", 0), *[F.when(F.size("g") > 0, quantile(q)) for q in (0.05, 0.25, 0.5)])
    kept = F.filter(steps, lambda s: s.isNotNull() & (s >= F.col("amax") / high) & (s <= F.col("amax") / low))
    r = r.withColumn("s", F.array_sort(F.array_distinct(F.transform(kept, lambda s: F.round(s, 18)))))
    share = lambda s: F.size(
        F.filter("v", lambda x: F.abs(x / s - F.rint(x / s)) <= schema.LATTICE_TOLERANCE)
    ) / F.size("v")
    r = r.withColumn("fits", F.transform("s", lambda s: F.struct(share(s).alias("f"), (-s).alias("m"))))
    best = F.array_max("fits")
    fit = F.when(F.size("u") < 3, F.lit(None).cast("double")).otherwise(F.coalesce(best["f"], F.lit(0.0)))
    levels = F.when((F.size("u") >= 3) & (best["f"] > 0), F.col("amax") / -best["m"])
    either = lambda c, searched: F.avg(F.when(F.col("v").isNull(), F.col(c)).otherwise(searched)).alias(c)
    out = rows.select(*KEYS).distinct().join(
        r.groupBy(*KEYS).agg(either("f", fit), either("l", levels), either("d", F.col("distinct"))), KEYS, "left"
    )
    zero = F.lit(0.0)
    return out.select(*KEYS, F.coalesce("f", zero).alias("lattice_frac"), F.coalesce("l", zero).alias("levels"), F.coalesce("d", zero).alias("distinct_ratio"))
