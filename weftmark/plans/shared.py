"""Tables written to the folder that every executor shares, used to cut lineage.

A written table survives the loss of an executor, unlike a cached or locally
checkpointed one.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only a session on a local master may fall back to a
folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="weftmark-")
    return _own[app]


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of that table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftmark-{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weftmark_path = path
    return out


def dealt(df: DataFrame, *keys: str, rows: int = 1 << 20, n: int | None = None) -> DataFrame:
    """``df`` dealt by hashes of ``keys`` to as many tasks as keep their shares near ``rows`` rows.

    The number of shuffle partitions is fixed in a session, so that without this a task's
    memory grows with the input.  Without ``n``, a number that its rows do not exceed, ``df`` is
    counted first and should be cheap to read twice.
    """
    return df.repartition(shares(df.sparkSession, df.count() if n is None else n, rows), *keys)


def shares(spark: SparkSession, n: int, rows: int = 1 << 20) -> int:
    """As many tasks as keep ``n`` rows near ``rows`` a task, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`materialize` returned, once nothing that is still to run reads it."""
    path = getattr(table, "weftmark_path", None)
    if path is None or "/weftmark-" not in path:
        raise ValueError("not a table of materialize()")
    spark = table.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
