"""Sharding by extendible hashing.

A directory of hash-prefix bits starts as one bucket; only buckets over the byte
limit split on the next bit, until each fits.  Splitting bit by bit is the same as
giving each row the shallowest prefix whose bucket fits, so a round aggregates
bytes at ``ROUND_BITS`` bits below every open bucket at once and reads the depths
off that small histogram.  Only open buckets go on to another round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.plans.shared import materialize

#: Bits resolved a round: an open bucket adds at most 2**ROUND_BITS directory cells.
ROUND_BITS = 12
#: Bits of the key's hash, then of the row number's for rows that repeat a key.
KEY_BITS = 60
ALL_BITS = 2 * KEY_BITS
#: A directory round is broadcast up to so many cells, else joined by shuffle.
BROADCAST_CELLS = 200_000


def _hash60(text):
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _bits(n):
    return F.lpad(F.bin(n), KEY_BITS, "0")


def shard(df: DataFrame, limit_bytes: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, doc_bytes, shard, depth, shard_bytes, shard_docs.

    ``shard`` is the bucket's hash prefix as a string of bits ('' if all fit one).
    Every shard holds at most ``limit_bytes`` of UTF-8 text, unless it is a single
    document above the limit, which cannot be split.  The key decides the first 60
    bits, so a key stays together as long as it fits; a key that repeats beyond the
    limit is split on the bits of its rows' numbers.  Null text has 0 bytes, a null
    key hashes as the word null, other columns are ignored whatever their names,
    and an empty table gives an empty result.
    """
    rows = df.select(
        F.col(key).alias("k"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("b"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(
        rows.select(
            "k",
            "b",
            F.concat(
                _bits(_hash60(F.coalesce(F.col("k").cast("string"), F.lit("null")))),
                _bits(_hash60(F.col("row").cast("string"))),
            ).alias("h"),
        ),
        "shard-rows",
    )
    open_rows = rows.withColumn("parent", F.lit(""))
    done: list[DataFrame] = []
    for start in range(0, ALL_BITS, ROUND_BITS):
        end = start + ROUND_BITS
        open_rows = open_rows.withColumn("cell", F.substring("h", 1, end))
        cells = open_rows.groupBy("parent", "cell").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
        directory = materialize(_directory(cells, start, end, limit_bytes), f"shard-directory-{start}")
        size = directory.count()
        found = F.broadcast(directory) if size <= BROADCAST_CELLS else directory
        joined = open_rows.join(found.drop("parent"), "cell")
        done.append(
            joined.where("shard is not null").select(
                "k", F.col("b").alias("doc_bytes"), "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs"
            )
        )
        if directory.where("shard is null").isEmpty():
            break
        open_rows = materialize(
            joined.where("shard is null").select("k", "b", "h", F.col("cell").alias("parent")), f"shard-open-{end}"
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("k", key)


def _directory(cells: DataFrame, start: int, end: int, limit_bytes: int) -> DataFrame:
    """Cells with the shallowest prefix that fits, or a null shard where none does."""
    fits, size, docs = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long")
    depths = range(start + (start > 0), end + 1)
    for d in depths:
        bucket = Window.partitionBy("parent", F.substring("cell", 1, d))
        cells = cells.withColumn(f"b{d}", F.sum("b").over(bucket)).withColumn(f"n{d}", F.sum("n").over(bucket))
    for d in reversed(depths):
        last = end == ALL_BITS and d == end
        ok = (F.col(f"b{d}") <= limit_bytes) | (F.col(f"n{d}") == 1) | F.lit(last)
        fits = F.when(ok, F.substring("cell", 1, d)).otherwise(fits)
        size = F.when(ok, F.col(f"b{d}")).otherwise(size)
        docs = F.when(ok, F.col(f"n{d}")).otherwise(docs)
    return cells.select("parent", "cell", fits.alias("shard"), size.alias("shard_bytes"), docs.alias("shard_docs"))
