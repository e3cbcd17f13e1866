"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source size copies.  Documents are
put in one order, their expected copies are summed up along it from one random
offset, and a document is emitted once per integer boundary that its interval
crosses.  Ordered by size, the taken words of a source stay within about one
largest document of its target.

Prefix sums are distributed: rows are range partitioned and sorted, numbered inside their
partition, and shifted by the totals of the partitions before.  A hot source spreads over
many partitions.  Only (source, size, key, hashes) of a row is ordered; the mixed corpus
joins the rows back by two hashes of the whole row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftmark.plans.shared import discard, materialize

#: Bits of monotonically_increasing_id that number the rows of a partition.
_PLACE_BITS = 33
#: Copies that one task makes of one row at most before they are dealt out.
COPIES_AT_ONCE = 1 << 16
SPACE = r"[\x20\x09-\x0D]"


def word_count(text):
    """Number of words of a text column; null counts as empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE + "+"))).cast("long")


def _row_hashes(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of a whole row."""

    def has_map(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(has_map(f.dataType) for f in kind.fields)
        return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)

    values = [F.to_json(F.struct(F.col(f.name))) if has_map(f.dataType) else F.col(f.name) for f in df.schema.fields]
    # a null adds nothing to a hash, so which columns are null is hashed too
    gaps = F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values])
    return [F.xxhash64(F.lit(seed), *values, gaps) for seed in (1, 2)]


def _running(df: DataFrame, order: Sequence[str], sums: dict[str, str], label: str) -> DataFrame:
    """Add running totals before each row, in a total order, of some columns (name -> column or number)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), label)
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(*[F.sum(F.expr(x)).alias(f"{n}_all") for n, x in sums.items()])
    # one row per partition: as many as the session's shuffle partitions at most
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("part", *[F.coalesce(F.sum(f"{n}_all").over(before), F.lit(0)).alias(f"{n}_shift") for n in sums])
    joined = dealt.join(shifts, "part")
    made = [(F.coalesce(F.sum(F.expr(x)).over(here), F.lit(0)) + F.col(f"{n}_shift")).alias(n) for n, x in sums.items()]
    return joined.select(*df.columns, *made)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0
) -> DataFrame:
    """Targets per source of a table (src, source_size).

    Sources by code point, null last, take the weights in turn and share ``share``
    times all words.  No target exceeds ``limit`` times its source's size; the
    excess is shared again by weight until none is above.  That water level has a
    closed form: with sources sorted by limit / weight, the first one that its
    share of what is left does not fill sets the level for it and all after it.
    A source without words has target 0.  There may be any number of sources.
    """
    names = sizes.select("src", "source_size", F.col("src").isNull().alias("z"))
    turned = _running(names, ("z", "src"), {"turn": "1"}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int"))
    weighed = turned.select("src", "z", "source_size", weight.alias("w"), (F.lit(float(limit)) * F.col("source_size")).alias("cap"))
    weighed = weighed.withColumn("level", F.col("cap") / F.col("w"))
    filled = materialize(_running(weighed, ("level", "z", "src"), {"filled": "cap", "used": "w"}, "mix-weights"), "mix-levels")
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("w").alias("all_w")).first()
    left = F.lit(float(share)) * F.lit(float(whole["words"] or 0)) - F.col("filled")
    levels = filled.withColumn("share", left / (F.lit(float(whole["all_w"] or 0)) - F.col("used")))
    first = levels.where("share < level").agg(F.min(F.struct("level", "z", "src", "share"))["share"].alias("water")).first()
    water = F.lit(first["water"]).cast("double")
    return filled.select(
        "src", "z", "source_size", F.least(F.col("cap"), F.coalesce(F.col("w") * water, F.col("cap"))).alias("target")
    )


def _mixed(
    df: DataFrame, weights: Sequence[float], share: float, limit: float, seed: int, text: str, source: str, key: str, carry: bool
) -> DataFrame:
    """(k, src, size, h1, h2, source_size, target, copies) of every row; hashes are of the whole row only to ``carry``."""
    hashes = _row_hashes(df) if carry else [F.xxhash64(F.lit(seed), F.coalesce(F.col(text), F.lit(""))) for seed in (1, 2)]
    rows = df.select(
        F.col(key).alias("k"), F.col(source).cast("string").alias("src"), word_count(F.col(text)).alias("size"),
        hashes[0].alias("h1"), hashes[1].alias("h2"),
    )
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("src").isNull(), "src", "size", F.col("k").isNull(), "k", "h1", "h2"]
    narrow = materialize(rows, "mix-sizes")
    ordered = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "mix-places")
    placed = numbered.withColumn("part", F.shiftright("at", _PLACE_BITS)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    discard(narrow)

    # one row per (partition, source): a source is contiguous, so no more than partitions + sources
    per_part = placed.groupBy("part", "src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("at").alias("first"))
    per_part = materialize(per_part, "mix-parts")
    targets = source_targets(per_part.groupBy("src").agg(F.sum("words").alias("source_size")), weights, share, limit)
    up_to = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_part.select("part", "src", (F.coalesce(F.sum("n").over(up_to), F.lit(0)) - F.col("first") + 1).alias("shift"))
    plan = shifts.join(targets, shifts["src"].eqNullSafe(targets["src"])).select(
        shifts["part"], shifts["src"].alias("psrc"), "shift", "source_size", "target"
    )
    same = (placed["part"] == plan["part"]) & placed["src"].eqNullSafe(plan["psrc"])
    planned = placed.join(plan, same).drop(plan["part"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("src", F.lit("")))), 1, 8), 16, 10)
    offset = offset.cast("double") / F.lit(float(1 << 32))
    rank = (F.col("shift") + F.col("at")).cast("double")
    copies = F.floor(rank * ratio + offset) - F.floor((rank - 1) * ratio + offset)
    return planned.select("k", "src", "size", "h1", "h2", "source_size", "target", copies.cast("long").alias("copies"))


def mix(
    df: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """One row per document: ``key``, size, source_size, target, copies, taken.

    Null text has size 0; a null source is a source of its own, after all others.  A null
    key sorts after the others of its size; rows that tie in source, size and key are
    ordered by hashes of their text, so that reruns take the same texts whatever the
    partitions.  A text is counted whole, however long.  Extra columns are ignored
    whatever their names; an empty table gives an empty result.  Copies never exceed
    ceil(limit).  The offset of a source is a fixed function of ``seed`` and its name.
    """
    return _mixed(df, weights, share, limit, seed, text, source, key, carry=False).select(
        F.col("k").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def take_mix(
    df: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """The mixed corpus itself: each input row, with all its columns, as often as :func:`mix` takes it.

    Rows that are equal in every column share their copies: each is given as often as
    all of them surely are, and what remains is given out by itself.  Nulls, very long
    texts and clashing names are as in :func:`mix`; an empty table gives an empty result.
    """
    mixed = _mixed(df, weights, share, limit, seed, text, source, key, carry=True)
    groups = mixed.groupBy("h1", "h2").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n")).where("c > 0")
    groups = materialize(groups.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.expr("c div n").alias("each"), F.expr("c % n").alias("more")), "mix-copies")
    h1, h2 = _row_hashes(df)
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("r"), h1.alias("h1"), h2.alias("h2"))
    met = rows.join(groups, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    evenly = met.where("each > 0").select("r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("each")))).select("r.*")
    odd = groups.where("more > 0")
    if odd.isEmpty():
        return evenly
    # remainders of equal rows: one row of each group, and as many numbers as copies, dealt out in bounded runs
    one = met.where("more > 0").groupBy("g1", "g2").agg(F.first("r").alias("r"))
    runs = odd.select("g1", "g2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more") - 1, F.lit(COPIES_AT_ONCE).cast("long"))).alias("low"), "more")
    runs = runs.repartition("g1", "g2", "low")
    last = F.least(F.col("more"), F.col("low") + COPIES_AT_ONCE) - 1
    numbers = runs.select("g1", "g2", F.explode(F.sequence(F.col("low"), last)).alias("number"))
    return evenly.unionAll(numbers.join(one, ["g1", "g2"]).select("r.*"))
