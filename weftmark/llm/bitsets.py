"""Bit sets of 64-bit hashes of a bounded size, built by Spark and read by Python workers."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash (so about one in sixteen others passes), and the least and largest size as powers of two.
BITS_PER_HASH, LEAST_BITS, MOST_BITS = 16, 16, 31


def bits_for(count: int) -> int:
    """Size of a set of ``count`` hashes as a power of two: 256 MB at most, which is one bit for each of 2**31 hashes."""
    return min(MOST_BITS, max(LEAST_BITS, (count * BITS_PER_HASH - 1).bit_length() if count else 0))


def broadcast_bits(hashes: DataFrame, column: str, bits: int | None = None) -> Broadcast:
    """The set of the top ``bits`` bits of a long column, as a broadcast of 2**bits / 8 bytes.

    Without ``bits`` the column is counted first and the size follows from that; the table
    should then be a written one.  Partial bitmaps of 4 KB are built where the rows are and
    merged by position, so at most 2**bits / 8 bytes reach the driver.  A set that
    has more hashes than bits passes more than it should, and never drops one.
    """
    spark = hashes.sparkSession
    bits = bits_for(hashes.count()) if bits is None else bits
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    marked = hashes.select(place.alias("place"))
    parts = marked.groupBy(F.shiftright("place", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("b")
    )
    data = bytearray(max(4096, 1 << (bits - 3)))
    for row in parts.toLocalIterator():
        data[row["part"] * 4096 : row["part"] * 4096 + len(row["b"])] = row["b"]
    return spark.sparkContext.broadcast(bytes(data))
