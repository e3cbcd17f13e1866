"""Exact Lloyd rounds with exponion search over integer vectors.

Every vector keeps its centroid, an upper bound of the distance to it and a lower bound of
the distance to every other one, from round to round in a written table.  A vector whose
bounds cannot prove its centroid alone nearest is measured again against the centroids in a
ball around its current one; the ball is a prefix of that centroid's sorted list of
distances to the others.  Its radius is inclusive and rounding always widens it, so equal
distances are always among the measured ones and the smaller number wins by exact integers.

The driver and every task hold the centroids and their distances to each other: k times
``dims`` and k times k numbers, both parameters.  Tasks reduce their vectors to one partial
sum for each centroid before anything is shuffled, so a cluster may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.plans.shared import discard, materialize

#: Components are held to this range, so that sums of 64 squared differences are exact longs.
WIDEST = 1 << 27
#: Up to this many dimensions WIDEST keeps a squared distance below 2**63.
MOST_DIMS = 64
#: Matrix products in doubles are exact while dims * 4 * largest**2 stays below 2**53.
_EXACT = 1 << 53
#: Share by which rounding may have moved a distance taken from a square root, many times over.
_SLACK = 1e-9


@dataclass
class Clusters:
    """Assigned vectors (key, cluster, distance, scanned) and the final integer centroids, one row each."""

    assigned: DataFrame
    centroids: np.ndarray


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as integers, held to WIDEST on either side."""
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(WIDEST))), F.lit(float(-WIDEST))))
    return F.transform(vector, lambda x: whole(x).cast("int"))


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none of them null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: finite(x.cast("double"))), F.lit(False))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids, as int64."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    top = max(int(np.abs(x).max()), int(np.abs(c).max()))
    if 4 * x.shape[1] * top * top < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    a, out = x.astype(np.int64), np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c.astype(np.int64)):
        out[:, j] = ((a - row) ** 2).sum(1)
    return out


@dataclass
class Exponion:
    """What a task needs to reassign vectors: centroids, sorted distance lists, and how far each has moved."""

    centroids: np.ndarray
    order: np.ndarray  # per centroid all centroids by distance, itself first
    reach: np.ndarray  # those distances, rounded down
    half: np.ndarray  # half the distance to the nearest other centroid, rounded down
    moved: np.ndarray
    others: np.ndarray  # per centroid the longest move of any other

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray) -> Exponion:
        k = len(centroids)
        apart = np.sqrt(squared_distances(centroids, centroids).astype(np.float64)) * (1 - _SLACK)
        np.fill_diagonal(apart, -1.0)  # a centroid leads its own list, whatever equals it
        order = np.argsort(apart, axis=1, kind="stable")
        reach = np.take_along_axis(apart, order, axis=1)
        half = reach[:, 1] / 2 if k > 1 else np.full(k, np.inf)
        gone = [np.sqrt(float(sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)))) for p, q in zip(centroids, before, strict=True)]
        moved = np.array(gone) * (1 + _SLACK)
        others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])
        return cls(centroids, order, reach, half, moved, others)

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """(cluster, upper, lower, scanned) of integer rows ``x`` whose last cluster is ``at``, or -1 for none yet."""
        at, upper, lower = at.copy(), upper.copy(), lower.copy()
        scanned = np.zeros(len(x), np.int64)
        fresh = at < 0
        if fresh.any():
            self._scan(x, np.flatnonzero(fresh), np.arange(len(self.centroids)), at, upper, lower, scanned)
        old = np.flatnonzero(~fresh)
        if len(old):
            upper[old] += self.moved[at[old]]
            lower[old] -= self.others[at[old]]
            bound = np.maximum(lower[old], self.half[at[old]])
            open_ = old[upper[old] * (1 + _SLACK) >= bound]
            exact = ((x[open_].astype(np.int64) - self.centroids[at[open_]].astype(np.int64)) ** 2).sum(1)
            upper[open_] = np.sqrt(exact.astype(np.float64)) * (1 + _SLACK)
            scanned[open_] += 1
            open_ = open_[upper[open_] * (1 + _SLACK) >= np.maximum(lower[open_], self.half[at[open_]])]
            self._search(x, open_, at, upper, lower, scanned)
        return at, upper, lower, scanned

    def _search(self, x: np.ndarray, rows: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: np.ndarray) -> None:
        """Measure ``rows`` against the ball around their centroid, those with balls of like size together."""
        k = len(self.centroids)
        if k == 1:
            return
        radius = (2 * upper[rows] + 2 * self.half[at[rows]]) * (1 + 4 * _SLACK)
        home = at[rows].copy()
        for a in np.unique(home):
            mine = np.flatnonzero(home == a)
            inside = np.searchsorted(self.reach[a], radius[mine], side="right")
            ring = np.ceil(np.log2(np.maximum(inside, 2))).astype(np.int64)
            for level in np.unique(ring):
                near = np.sort(self.order[a][: min(k, 1 << int(level))])
                self._scan(x, rows[mine[ring == level]], near, at, upper, lower, scanned)

    def _scan(self, x: np.ndarray, rows: np.ndarray, near: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: np.ndarray) -> None:
        """Nearest of the centroids ``near``, which are in ascending order, so that the first least is the smallest number."""
        d = squared_distances(x[rows], self.centroids[near])
        best = d.argmin(1)
        at[rows] = near[best]
        upper[rows] = np.sqrt(d[np.arange(len(rows)), best].astype(np.float64)) * (1 + _SLACK)
        if len(near) > 1:
            lower[rows] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - _SLACK)
        else:
            lower[rows] = np.inf
        scanned[rows] += len(near)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _reassign(table: DataFrame, search: Exponion, dims: int) -> DataFrame:
    """The table of (id, x, cluster, upper, lower, scanned) after one search."""
    schema = table.schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            state = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")]
            at, upper, lower, scanned = search.assign(_matrix(batch.column("x"), dims), state[0].astype(np.int64), *state[1:])
            kept = [batch.column("id"), batch.column("x"), pa.array(at, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scanned)], names=schema.names)

    return table.mapInArrow(step, schema)


def _sums(table: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, exact component sums) of each cluster: partial sums by task, then by Spark; k * dims rows in the end."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                at = batch.column("cluster").to_numpy(zero_copy_only=False)
                order = np.argsort(at, kind="stable")
                found, first = np.unique(at[order], return_index=True)
                sums[found] += np.add.reduceat(_matrix(batch.column("x"), dims)[order].astype(np.int64), first, axis=0)
                counts[found] += np.diff(np.append(first, len(at)))
        live = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(live.astype(np.int32)), pa.array(counts[live]), pa.array(list(sums[live]), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = table.select("cluster", "x").mapInArrow(partial, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", F.posexplode(F.array_append("sums", F.col("n"))).alias("i", "v"))
    counts, sums = np.zeros(k, object), np.zeros((k, dims), object)
    for row in cells.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        if row["i"] == dims:
            counts[row["cluster"]] = int(row["v"])
        else:
            sums[row["cluster"], row["i"]] = int(row["v"])
    return counts, sums


def _first_centroids(rows: DataFrame, k: int, seed: str, dims: int) -> np.ndarray:
    """The vectors of the ``k`` rows whose ids have the smallest SHA-256 after ``seed:``; null ids come last."""
    drawn = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "x")
    first = drawn.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64).reshape(-1, dims)


def exponion_clusters(
    df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2",
    vector: str = "embedding", key: str = "vec_id",
) -> Clusters:
    """Exact k-means of integer vectors floor(scale * x): ``rounds`` rounds, then a last assignment.

    A vector takes part if it has ``dims`` components, none null, NaN or infinite; a null or
    shorter one is left out.  Components beyond 2**27 after scaling count as 2**27 with their
    sign, as squared distances would not fit a long.  The first centroids are the vectors of
    the ``k`` ids with the smallest SHA-256 of ``seed:id``, of all ids if there are fewer; ids
    that are null come last and ids that repeat are ordered by their vectors.  A vector goes
    to the nearest centroid, of equal ones to the smaller number.  A round moves every
    centroid with vectors to floor(sum / count) in each component and leaves the others.
    Repeated rows are rows of their own, other columns are ignored whatever their names, and
    an empty table gives an empty result.  ``scanned`` says how many distances the last
    assignment measured for a row.
    """
    if not 0 < dims <= MOST_DIMS or k < 1 or rounds < 0:
        raise ValueError(f"1 to {MOST_DIMS} dimensions, one centroid and no negative rounds")
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(usable(F.col("v"), dims))
    rows = rows.select("id", quantised(F.col("v"), scale).alias("x"))
    fresh = rows.select(
        "id", "x", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("scanned")
    )
    table = materialize(fresh, "centroid-vectors")
    centroids = before = _first_centroids(table, k, seed, dims)
    k = len(centroids)
    if not k:
        return Clusters(table.select("id", "cluster", F.lit(0).cast("long").alias("distance"), "scanned").withColumnRenamed("id", key), centroids)
    for turn in range(rounds + 1):
        last, table = table, materialize(_reassign(table, Exponion.of(centroids, before), dims), "centroid-round")
        discard(last)
        if turn < rounds:
            counts, sums = _sums(table, k, dims)
            before = centroids
            centroids = np.array([[int(s) // int(n) for s in row] if n else list(old) for n, row, old in zip(counts, sums, before, strict=True)], np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("cluster").to_numpy(zero_copy_only=False)
            d = ((_matrix(batch.column("x"), dims).astype(np.int64) - centroids[at]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(d), batch.column("scanned")], names=["id", "cluster", "distance", "scanned"])

    types = dict(table.dtypes)
    measured = table.mapInArrow(measure, f"id {types['id']}, cluster int, distance long, scanned long")
    return Clusters(measured.withColumnRenamed("id", key), centroids)


def with_inertia(clusters: Clusters, key: str = "vec_id") -> DataFrame:
    """Assigned vectors with cluster_inertia, inertia and the SHA-256 of their centroid's components.

    The joined table has a row for each centroid.  A sum of distances that does not fit a
    long is null.  Nulls, ties and empty tables as in :func:`exponion_clusters`.
    """
    spark = clusters.assigned.sparkSession
    rows = materialize(clusters.assigned, "centroid-distances")
    digests = [(j, hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()) for j, c in enumerate(clusters.centroids)]
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    total = {r["cluster"]: int(r["s"]) for r in sums.collect()}  # k rows at most
    fits = lambda n: n if n < 1 << 63 else None
    whole = fits(sum(total.values()))
    named = [(j, fits(total.get(j, 0)), whole, digest) for j, digest in digests]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned"
    )
