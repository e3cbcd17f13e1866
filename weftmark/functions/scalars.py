"""Scalar functions as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """Bytes in steps of 1024: 5 B, 1.5 KiB, 3.0 PiB."""
    n = n.cast("double")
    tenths = lambda x: F.rint(x * 10) / 10  # noqa: E731  ties to even, where the formatter would round up
    out = F.when(F.abs(n) < 1024, F.concat(F.floor(n).cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = out.when(F.abs(n) < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", tenths(n / 1024.0**i)))
    return out.otherwise(F.format_string("%.1f PiB", tenths(n / 1024.0**5)))


def fixed(x: Column, digits: int) -> Column:
    """Text of x with this many decimals, ties away from zero, by its value to 17 decimals.

    The formatter would round the shortest text of x instead, so that 0.695, which is a little
    less, became 0.70.
    """
    units = F.rint(x.cast("double") * F.lit(1e17))
    whole = F.when(F.abs(units) < 9e18, units).cast("long").cast("decimal(20,0)")
    return F.coalesce(F.round(whole / F.lit(Decimal(10**17)), digits).cast("string"), F.format_string(f"%.{digits}f", x.cast("double")))


def round_scaled(x: Column, digits: int) -> Column:
    """x rounded by way of its multiple, as SQL engines do that keep no decimal text of a double."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale


def stable_hash(*columns: Column) -> Column:
    """First 16 hex digits of SHA-256 over name-free, tab-joined text of the values; null as \\N."""
    return F.substring(F.sha2(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]), 256), 1, 16)


def short_id(text: Column, width: int = 34) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 3), F.lit("...")))


def sigmoid(x: Column) -> Column:
    """Stable on both sides: no exponent of a positive number."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def odd_tanh(x: Column) -> Column:
    return F.signum(x) * F.tanh(F.abs(x))


def finite(x: Column, default: float = 0.0) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sanitize(x: Column, limit: float = 10.0) -> Column:
    return clip(finite(x), -limit, limit)


def antisym(x: Column, y: Column, normalise: bool = False, scale: float = 0.0) -> Column:
    """(x - y), over |x| + |y| + scale if normalised: swapping the arguments flips the sign exactly."""
    gap = x - y
    return gap / (F.abs(x) + F.abs(y) + F.lit(scale + 1e-12)) if normalise else gap


def even_indices(n: Column, cap: int) -> Column:
    """Distinct evenly spaced indices of 0..n-1, all of them up to ``cap``."""
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(max(cap - 1, 1))),
        lambda i: F.rint(i * (n - 1) / F.lit(float(max(cap - 1, 1)))).cast("long"),
    )
    every = F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long")))
    none = F.array().cast("array<bigint>")
    return F.when(n <= 0, none).when(n <= cap, every).otherwise(F.array_distinct(steps))


def is_even_index(i: Column, n: Column, cap: int) -> Column:
    """Whether :func:`even_indices` has i: only the two steps around it can lead there."""
    last = float(max(cap - 1, 1))
    at = i * F.lit(last) / F.greatest(n - 1, F.lit(1).cast("long"))
    hit = lambda step: F.rint(step * (n - 1) / F.lit(last)).cast("long") == i
    return (i >= 0) & (i < n) & ((n <= cap) | hit(F.floor(at)) | hit(F.ceil(at)))


def sanitize_id(text: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(text, "[^A-Za-z0-9_]", "_"))


def escape_label(text: Column) -> Column:
    return F.translate(text, '\\"[]', "/'()")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
