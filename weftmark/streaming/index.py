"""Upkeep of an index of sketches from a stream of new models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def add_new(index: DataFrame, batch: DataFrame, key: str = "model") -> DataFrame:
    """Rows of a batch whose key the index has not, one per key."""
    return batch.dropDuplicates([key]).join(index.select(key), key, "left_anti")


def maintain(stream: DataFrame, path: str, checkpoint: str, key: str = "model") -> StreamingQuery:
    """Append models that the Parquet index at ``path`` has not, once each, from a streaming frame.

    A batch that is run again after a failure finds its rows in the index and adds none.
    """

    def upkeep(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            have = spark.read.schema(batch.schema).parquet(path)
            have.isEmpty()
        except Exception as e:  # the first batch finds no index
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = batch.limit(0)
        add_new(have, batch, key).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(upkeep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_transfers(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Bytes and requests per event-time window of a stream of transfers (ts, bytes), with a watermark."""
    return (
        stream.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("requests"))
    )
