"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each level groups only what the level before left in groups of two or more:

1. one pass over the texts counts rows by (length, prefix hash) with map-side
   combine, which makes a narrow table; lengths that occur once are settled;
2. of the remaining lengths, prefix hashes that occur once are settled;
3. a second pass digests the whole content of the rows still in a group.

No text is ever shuffled, and groups meet only as partial aggregates and through
a skew-splittable join, so one group may hold a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.plans.shared import materialize

#: Surviving (length, prefix) pairs are announced to the second pass as at most so
#: many slot numbers, whatever the input: the broadcast is bounded by this.
SLOTS = 1 << 18


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _refine(
    df: DataFrame, text: str, key: str, prefix_chars: int, fingerprint_all: bool, carry: bool
) -> tuple[DataFrame, DataFrame]:
    """(rows with hit, full_hash and row number; groups of two or more by hash)."""
    whole = [F.struct(*[F.col(c) for c in df.columns]).alias("r")] if carry else []
    carried = ["r"] if carry else []
    rows = df.select(F.col(key).alias("k"), normalised(F.col(text)).alias("t"), *whole)
    rows = rows.select(
        "k", "t", *carried, F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("p")
    )

    counts = materialize(rows.groupBy("n", "p").agg(F.count(F.lit(1)).alias("c")), "dedup-prefix")
    lengths = counts.groupBy("n").agg(F.sum("c").alias("c")).where("c > 1").select("n")
    prefixes = counts.where("c > 1").join(lengths, "n", "left_semi").select("n", "p")

    slot = F.pmod(F.xxhash64("n", "p"), F.lit(SLOTS))
    slots = prefixes.select(slot.alias("slot")).distinct().withColumn("hit", F.lit(True))
    marked = rows.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left")
    digest = F.sha2(F.col("t"), 256)
    hashed = materialize(
        marked.select(
            "k",
            *carried,
            F.coalesce("hit", F.lit(False)).alias("hit"),
            (digest if fingerprint_all else F.when(F.col("hit"), digest)).alias("full_hash"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "dedup-hash",
    )

    first = F.min(F.struct(F.col("k").isNull().alias("z"), "k", "row"))
    groups = materialize(
        hashed.where("hit")
        .groupBy(F.col("full_hash").alias("h"))
        .agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        .where("group_size > 1"),
        "dedup-groups",
    )
    return hashed, groups


def exact_dedup(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    prefix_chars: int = 64,
    fingerprint_all: bool = False,
) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, full_hash.

    Rows are equal when their normalised texts are; the row with the smallest key
    stays.  ``full_hash`` (SHA-256, hex) is null where no second row shared length
    and prefix, unless ``fingerprint_all`` asks for the digest of those as well.

    Null text counts as empty, so null and empty texts form one group.  A null key
    sorts after every other; a group with null keys only has a null keep_id.  Of
    rows that repeat the smallest key exactly one is kept (ties fall to the row
    read first).  Other columns, whatever their names, are ignored.  An empty
    table gives an empty result.
    """
    hashed, groups = _refine(df, text, key, prefix_chars, fingerprint_all, carry=False)
    joined = hashed.withColumn("h", F.when(F.col("hit"), F.col("full_hash"))).join(groups, "h", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("k").alias(key),
        F.when(alone, F.col("k")).otherwise(F.col("first.k")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        "full_hash",
    )


def drop_exact_duplicates(
    df: DataFrame, text: str = "text", key: str = "doc_id", prefix_chars: int = 64
) -> DataFrame:
    """The input rows that :func:`exact_dedup` keeps, with all their columns.

    Rows are carried as one struct, so clashing column names do no harm.  Only rows
    that share length and prefix with another are joined, the rest pass straight
    through.  Nulls, ties and empty tables as in :func:`exact_dedup`.
    """
    hashed, groups = _refine(df, text, key, prefix_chars, fingerprint_all=False, carry=True)
    single = hashed.where("not hit").select("r.*")
    grouped = hashed.where("hit").withColumn("h", F.col("full_hash")).join(groups, "h", "left")
    kept = grouped.where(F.col("group_size").isNull() | (F.col("row") == F.col("first.row")))
    return single.unionAll(kept.select("r.*"))
