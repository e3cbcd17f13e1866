"""Stored indexes of sketches and stored direction models."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark import schema
from weftmark.operators import direction, export, metrics, sketch
from weftmark.plans.shared import discard, materialize
from weftmark.sources import safetensors


def save(index: DataFrame, path: str) -> None:
    """Write an index (model, vector, …) as Parquet with its version in every row."""
    index.withColumn("index_version", F.lit(schema.INDEX_VERSION)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read an index; rows of another version are an error."""
    found = spark.read.parquet(path)
    other = found.where(F.col("index_version") != schema.INDEX_VERSION).limit(1).collect()
    if other:
        raise ValueError(f"{path}: index version {other[0]['index_version']}, not {schema.INDEX_VERSION}")
    return found.drop("index_version")


def missing(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Models that are wanted and not in the index: what is left to sketch."""
    return wanted.select("model").distinct().join(index.select("model"), "model", "left_anti")


def keyed(universe: DataFrame, *parameters) -> DataFrame:
    """Add ``key`` to (model, ref, revision, stamp): a digest of what a stored result depends on."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("ref", "revision", "stamp")] + [F.lit(str(p)) for p in parameters]
    return universe.withColumn("key", F.sha2(F.to_json(F.array(*parts)), 256))


def cached(universe: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], *parameters) -> DataFrame:
    """Rows of ``make`` for every model of the universe (model, ref, revision, stamp), made once per key.

    ``path`` holds a Parquet table of earlier results by key.  Only models whose key it lacks are
    passed to ``make``, whose rows (model, ...) are appended; a changed stamp, revision, reference or
    parameter is another key.  Two models of one key are made once.  Results carry the universe's names.
    Of runs that overlap each may write a key; every run marks its rows, and the first mark counts.
    """
    spark = universe.sparkSession
    asked = materialize(keyed(universe, *parameters).select("model", "ref", "revision", "stamp", "key"), "cache-asked")
    first = asked.groupBy("key").agg(F.min_by(F.struct("model", "ref", "revision", "stamp"), "model").alias("m")).select("key", "m.*")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
    todo = first.join(spark.read.parquet(path).select("key").distinct(), "key", "left_anti") if there else first
    todo = materialize(todo, "cache-todo")
    if not there or not todo.isEmpty():
        made = make(todo.drop("key"))
        marked = made.join(todo.select("model", "key"), "model").drop("model").withColumn("run", F.lit(uuid.uuid4().hex))
        marked.write.mode("append").parquet(path)
    held = spark.read.option("mergeSchema", "true").parquet(path)
    # tables from before runs were marked have no such column
    held = held.withColumn("run", F.coalesce("run", F.lit("")) if "run" in held.columns else F.lit(""))
    held = held.join(asked.select("key").distinct(), "key", "left_semi")
    first = held.groupBy("key").agg(F.min("run").alias("run"))
    return asked.select("model", "key").join(held.join(first, ["key", "run"], "left_semi"), "key").drop("key", "run")


def universe_of(spark: SparkSession, refs: dict[str, str], revision: str = "main") -> DataFrame:
    """(model, ref, revision, stamp): the stamp is the latest change of a local checkpoint's files, null for others."""
    def stamp(ref: str) -> int | None:
        if safetensors.is_url(ref) or not os.path.exists(ref):
            return None
        return max((os.stat(f).st_mtime_ns for f in safetensors.shards(ref)), default=0)

    made = [(m, r, revision, stamp(r)) for m, r in sorted(refs.items())]
    return spark.createDataFrame(made, "model string, ref string, revision string, stamp long")


def _scan(todo: DataFrame, **options) -> DataFrame:
    refs = {r["model"]: r["ref"] for r in todo.select("model", "ref").collect()}  # names of checkpoints, given by the caller
    return safetensors.scan(todo.sparkSession, refs, **options)


def headers(universe: DataFrame, path: str, **options) -> DataFrame:
    """Headers of a universe with ``error`` for what cannot be read, from the cache where the key is known.

    Failures are cached too, under the stamp they were seen with.
    """
    return cached(universe, path, lambda todo: _scan(todo, mode="metadata", on_error="record", **options), "headers", sorted(options.items()))


def build(universe: DataFrame, path: str, *, k: int = 64, max_rows: int = 2048, **options) -> tuple[DataFrame, DataFrame]:
    """(index, failures) of a universe: sketches by key from the cache, and (model, error) of what cannot be read."""
    found = headers(universe, f"{path}/headers", **options)
    failures = found.where("error is not null").select("model", "error")
    good = universe.join(failures, "model", "left_anti")

    def make(todo: DataFrame) -> DataFrame:
        rows = materialize(_scan(todo, max_rows=max_rows, on_error="record", **options), "index-rows")
        return sketch.sketch(rows, k, max_rows)

    return cached(good, f"{path}/sketches", make, "sketch", schema.INDEX_VERSION, k, max_rows, sorted(options.items())), failures


def save_weights(path: str, weights: dict[str, float]) -> None:
    export.write_json(path, {"version": schema.DIRECTION_VERSION, "weights": weights})


def load_weights(path: str) -> dict[str, float]:
    """Weights by feature: unknown names are dropped, absent ones are 0."""
    with open(os.fspath(path), encoding="utf-8") as f:
        doc = json.load(f)
    return {n: float(doc.get("weights", {}).get(n, 0.0)) for n in schema.DIRECTION_WEIGHTS}


def split_pairs(pairs: DataFrame, test: float = 0.25, seed: int = 0) -> DataFrame:
    """Mark pairs for the test part by a hash of the unordered pair, so that mirrors stay together."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.least("a", "b"), F.greatest("a", "b")), F.lit(10_000))
    return pairs.withColumn("test", at < int(test * 10_000))


def fit_direction(features: DataFrame, l2: float = 1.0, steps: int = 50) -> dict[str, float]:
    """Weights from labelled pairs (features, truth), as ``linalg.fit_logistic`` finds them; no pair reaches the driver.

    Every Newton step sums gradient and Hessian where the pairs are; the mirror of a pair,
    with its features turned and its label swapped, doubles both sums and is not written out.
    A null feature counts as 0.
    """
    names = list(schema.DIRECTION_WEIGHTS)
    labelled = features.where(F.col("truth").isin("a->b", "b->a"))
    rows = materialize(labelled.select(*[F.coalesce(n, F.lit(0.0)).cast("double").alias(n) for n in names], (F.col("truth") == "a->b").cast("double").alias("y")), "fit-pairs")
    spread = rows.agg(F.count(F.lit(1)).alias("count"), *[F.stddev_pop(n).alias(n) for n in names]).collect()[0]
    if not spread["count"]:
        discard(rows)
        return dict(schema.DIRECTION_WEIGHTS)
    scale = np.array([spread[n] if spread[n] is not None and spread[n] > 1e-12 else 1.0 for n in names])
    w, size = np.zeros(len(names)), len(names)

    def sums(w: np.ndarray) -> np.ndarray:
        def part(batches):
            total = np.zeros((size + 1, size))
            for batch in batches:
                z = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(size)]) / scale
                p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
                total[:size] += 2 * (z * (p * (1 - p))[:, None]).T @ z
                total[size] += 2 * (batch.column(size).to_numpy(zero_copy_only=False) - p) @ z
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

        cells = rows.mapInArrow(part, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        out = np.zeros((size + 1) * size)
        for r in cells.collect():  # features squared and features
            out[r["i"]] = r["v"]
        return out.reshape(size + 1, size)

    for _ in range(steps):
        total = sums(w)
        step = np.linalg.solve(total[:size] + l2 * np.eye(size), total[size] - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    discard(rows)
    return dict(zip(names, map(float, w / scale), strict=True))


def fit_report(features: DataFrame, l2: float = 1.0, test: float = 0.25, seed: int = 0) -> tuple[dict[str, float], DataFrame]:
    """(weights, scores per relation and part) of labelled pairs (a, b, relation, truth, features).

    Pairs are split with their mirrors; the weights come from the training part, and both
    parts are judged by them: counts, accuracy with and without abstentions (``metrics.direction_scores``).
    """
    marked = materialize(split_pairs(features, test, seed), "fit-split")
    weights = fit_direction(marked.where("not test"), l2)
    judged = direction.verdict(marked, weights).select("relation", "truth", "llr", "test", F.col("direction").alias("predicted"))
    parts = [metrics.direction_scores(judged.where(F.col("test") == t)).withColumn("part", F.lit(name)) for t, name in ((False, "train"), (True, "test"))]
    return weights, parts[0].unionByName(parts[1])
