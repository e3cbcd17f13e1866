"""Sketches of models and the index over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark import schema
from weftmark.functions import linalg
from weftmark.functions.scalars import even_indices, is_even_index
from weftmark.operators import blocks, metadata, pairs, selection
from weftmark.plans.shared import materialize

SLOTS = len(schema.ROLES) * len(schema.DEPTH_BUCKETS)


def invariants(rows: DataFrame, chosen: DataFrame, k: int = 64, max_rows: int = 2048) -> DataFrame:
    """(model, slot, features): invariants of each chosen tensor (model, tensor, slot, n_rows) from its sampled rows."""
    wanted = chosen.select("model", "tensor", "slot", "n_rows")
    block = rows.join(wanted, ["model", "tensor"]).where(blocks.in_sample(F.col("row_idx"), F.col("n_rows"), max_rows)).select("model", "slot", "row_idx", "v")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.vstack(pdf.sort_values("row_idx")["v"].to_numpy())
        f = linalg.tensor_invariants(w if w.shape[0] > 1 else w[0], k)
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "slot": [int(pdf["slot"].iloc[0])], "features": [f.tolist()]})

    # a group is one tensor's sample: at most max_rows rows
    return block.groupBy("model", "slot").applyInPandas(one, "model string, slot int, features array<float>")


def sketch(rows: DataFrame, k: int = 64, max_rows: int = 2048, dtype: str = "F32") -> DataFrame:
    """(model, vector, present): the whole sketch of every model at once."""
    shapes = pairs.tensors_of(rows)
    chosen = selection.sketch_tensors(shapes)
    found = invariants(rows, chosen, k, max_rows).groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("slot", "features"))).alias("m"))
    header = shapes.select("model", "tensor", F.lit(dtype).alias("dtype"), F.array("n_rows", "n_cols").alias("shape"))
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    out = found.withColumn("present", F.transform(slots, lambda s: F.map_contains_key("m", s)))
    share = F.size(F.filter("present", lambda p: p)) / F.lit(float(SLOTS))
    out = out.withColumn("share", share)
    meta = metadata.model_meta(header).join(out.select("model", "share"), "model")
    globals_ = metadata.global_features(meta, F.col("share"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), schema.SLOT_FEATURES)
    flat = F.flatten(F.transform(slots, lambda s: F.coalesce(F.try_element_at("m", s), zero)))
    joined = out.join(globals_, "model")
    return joined.select("model", F.concat(flat, F.transform("globals", lambda x: x.cast("float"))).alias("vector"), "present", F.lit(schema.SKETCH_VERSION).alias("version"))


def cosine(a: Column | str, b: Column | str) -> Column:
    inner = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(inner(a, b), F.sqrt(inner(a, a) * inner(b, b)))


def sketch_distance(va: str, pa: str, vb: str, pb: str) -> Column:
    """Cosine distance over slots that both have, plus a quarter of the presence sets' Jaccard distance, in 0..2."""
    n = schema.SLOT_FEATURES
    both = F.zip_with(pa, pb, lambda p, q: p & q)
    width = F.sequence(F.lit(0), F.lit(SLOTS * n - 1))
    held = lambda v: F.transform(width, lambda i: F.when(F.get(both, F.floor(i / n).cast("int")), F.get(v, i).cast("double")).otherwise(F.lit(0.0)))
    shared, either = F.size(F.filter(both, lambda x: x)), F.size(F.filter(F.zip_with(pa, pb, lambda p, q: p | q), lambda x: x))
    base = F.coalesce(1 - cosine(held(va), held(vb)), F.lit(1.0))
    jaccard = F.coalesce(F.try_divide(shared, either), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), base + 0.25 * (1 - jaccard)))


def sketch_similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of query vectors (rows) and index vectors (columns)."""
    inner = q @ v.T
    if metric == "ip":
        return -inner
    qq, vv = (q * q).sum(1)[:, None], (v * v).sum(1)[None, :]
    if metric == "l2":
        return np.sqrt(np.maximum(qq + vv - 2 * inner, 0.0))
    norm = np.sqrt(qq * vv)
    return np.clip(1 - np.divide(inner, norm, out=np.zeros_like(inner), where=norm > 0), 0.0, 2.0)


#: Cells of the largest matrix of distances that a Python task holds.
CELLS = 1 << 18


def _slices(n: int, width: int) -> list[slice]:
    """``n`` rows in slices of ``CELLS`` cells or fewer (but a row at least)."""
    step = max(1, CELLS // max(1, width))
    return [slice(at, at + step) for at in range(0, n, step)]


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """(query, hit, distance): the k best of ``right`` for each of ``left``, index vectors cut or padded to each query's width."""
    if left.empty or right.empty:
        return pd.DataFrame({"query": left["query"][:0], "hit": right["hit"][:0], "distance": np.empty(0)})
    right = right.sort_values("hit", kind="stable")
    hits, best = right["hit"].to_numpy(), []
    for width, mine in left.groupby(left["qv"].map(len).to_numpy(), sort=False):
        v = np.zeros((len(right), width))
        for j, x in enumerate(right["iv"]):
            n = min(width, len(x))
            v[j, :n] = x[:n]
        for some in _slices(len(mine), len(right)):
            asked = mine.iloc[some]
            d = np.round(_distances(np.array(asked["qv"].tolist(), dtype=np.float64).reshape(len(asked), width), v, metric), 12)
            at = np.argsort(d, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(asked)), at.shape[1])
            best.append(pd.DataFrame({"query": asked["query"].to_numpy()[rows], "hit": hits[at.ravel()], "distance": d[rows, at.ravel()]}))
    return pd.concat(best)


def search(queries: DataFrame, index: DataFrame, k: int = 10, metric: str = "cosine", block: int = 2048) -> DataFrame:
    """(query, hit, distance, rank): the k nearest of an index (model, vector), ties by id; exact.

    Both sides are dealt into blocks of about ``block`` vectors by a hash of their ids.  A
    task meets one block of queries with one of the index, multiplies the two
    matrices, and keeps each query's k best; only these are ranked.  Distances are told
    apart to twelve decimals.  Index vectors of another width are cut or padded to the
    query's; null vectors are left out.
    """
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"unknown metric {metric}")
    q = queries.where("vector is not null").select(F.col("model").alias("query"), F.col("vector").alias("qv"))
    i = index.where("vector is not null").select(F.col("model").alias("hit"), F.col("vector").alias("iv"))
    of = lambda frame: -(-max(1, frame.count()) // block)
    nq, ni = of(q), of(i)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(nq)).cast("int")).withColumn("ib", every(ni))
    i = i.withColumn("ib", F.pmod(F.xxhash64("hit"), F.lit(ni)).cast("int")).withColumn("qb", every(nq))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, k, metric)

    kind = f"query {dict(q.dtypes)['query']}, hit {dict(i.dtypes)['hit']}, distance double"
    # a group is one block of each side: about block vectors
    met = q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib")).applyInPandas(best, kind)
    order = Window.partitionBy("query").orderBy("distance", "hit")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0.0))


def pruned_search(queries: DataFrame, index: DataFrame, k: int = 10, metric: str = "cosine", lists: int | None = None, block: int = 2048) -> DataFrame:
    """(query, hit, distance, rank) as :func:`search` finds them, by inverted lists that bounds let it skip; exact.

    ``lists`` vectors with the smallest hashes (a thousand at most, the root of the count by
    default) are centres; every index vector goes to its nearest, and a list knows its radius.
    A query first meets the nearest lists that hold k vectors, which bounds its k-th
    distance, and then only lists whose ball comes within that bound.  Lists are cut into
    parts of ``block`` vectors and their queries likewise.  Cosine distances are compared as
    lengths between unit vectors; zero vectors have no direction and are met by every query.
    All vectors must have one width.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"no bounds for metric {metric}")
    i = index.where("vector is not null").select(F.col("model").alias("hit"), F.transform("vector", lambda x: x.cast("double")).alias("iv"))
    q = queries.where("vector is not null").select(F.col("model").alias("query"), F.transform("vector", lambda x: x.cast("double")).alias("qv"))
    sizes = i.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("iv")).alias("least"), F.max(F.size("iv")).alias("most")).collect()[0]
    widths = q.agg(F.min(F.size("qv")).alias("least"), F.max(F.size("qv")).alias("most")).collect()[0]
    seen = {w for w in (*sizes[1:], *widths) if w is not None}
    if len(seen) > 1:
        raise ValueError(f"vectors of several widths: {sorted(seen)}")
    n_lists = max(1, min(1000, lists or int(sizes["n"] ** 0.5)))
    drawn = i.select("iv", F.xxhash64("hit").alias("h")).where(F.exists("iv", lambda x: x != 0)).orderBy("h", "iv").limit(n_lists).collect()
    if not drawn:  # nothing but zero vectors, or nothing
        return search(queries, index, k, metric, block)
    centres = _unit(np.array([r["iv"] for r in drawn]), metric)
    nowhere = len(centres)  # the list of zero vectors

    def assign(batches):
        for f in batches:
            if len(f):
                x = np.array(f["iv"].tolist())
                at, r = np.empty(len(x), np.int64), np.empty(len(x))
                for some in _slices(len(x), nowhere):
                    d = _apart(_unit(x[some], metric), centres)
                    at[some] = d.argmin(1)
                    r[some] = d[np.arange(len(d)), at[some]]
                if metric == "cosine":
                    zero = ~(x != 0).any(1)
                    at[zero], r[zero] = nowhere, 0.0
                yield f.assign(list=at.astype(np.int32), r=r)

    kinds = dict(i.dtypes), dict(q.dtypes)
    placed = materialize(i.mapInPandas(assign, f"hit {kinds[0]['hit']}, iv array<double>, list int, r double"), "search-lists")
    held = {r["list"]: (r["n"], r["r"]) for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r")).collect()}
    counts = np.array([held.get(j, (0, 0.0))[0] for j in range(nowhere + 1)])
    radius = np.array([held.get(j, (0, -np.inf))[1] for j in range(nowhere)]) * (1 + 1e-9) + 1e-9

    def probes(first: bool):
        def open_lists(f: pd.DataFrame) -> list[np.ndarray]:
            d = _apart(_unit(np.array(f["qv"].tolist()), metric), centres)
            order = np.argsort(d, axis=1, kind="stable")
            enough = np.take_along_axis(np.broadcast_to(counts[:nowhere], d.shape), order, axis=1).cumsum(1) < k
            near = np.zeros(d.shape, bool)
            np.put_along_axis(near, order, np.pad(enough, ((0, 0), (1, 0)), constant_values=True)[:, :-1], axis=1)
            if first:
                open_ = near
            else:
                bound = f["bound"].to_numpy(float)
                bound = np.sqrt(2 * np.maximum(bound, 0)) if metric == "cosine" else bound
                open_ = ~near & (d - radius[None, :] <= np.where(np.isnan(bound), np.inf, bound)[:, None] * (1 + 1e-9) + 1e-9)
            zeros = np.full((len(f), 1), first)
            return [np.flatnonzero(x).astype(np.int32) for x in np.hstack([open_, zeros]) & (counts > 0)]

        def choose(batches):
            for f in batches:
                for some in _slices(len(f), nowhere):
                    part = f.iloc[some]
                    yield part[["query", "qv"]].assign(lists=open_lists(part))

        return choose

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, k, metric)

    order = Window.partitionBy("query").orderBy("distance", "hit")
    spark = index.sparkSession

    def meet(asked: DataFrame) -> DataFrame:
        """The k best of each query among the lists it asks for; a group is a part of a list with a part of its queries."""
        asked = materialize(asked, "search-probes").select("query", "qv", F.explode("lists").alias("list"))  # a row for each list
        many = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
        parts = spark.createDataFrame([(j, max(1, -(-int(counts[j]) // block)), max(1, -(-c // block))) for j, c in many.items()] or [], "list int, np int, nq int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = asked.join(F.broadcast(parts), "list").select("query", "qv", "list", F.pmod(F.xxhash64("query"), F.col("nq")).cast("int").alias("b"), every("np").alias("a"))
        right = placed.join(F.broadcast(parts), "list").select("hit", "iv", "list", F.pmod(F.xxhash64("hit"), F.col("np")).cast("int").alias("a"), every("nq").alias("b"))
        kind = f"query {kinds[1]['query']}, hit {kinds[0]['hit']}, distance double"
        keys = ["list", "a", "b"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, kind)
        return materialize(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "search-met")

    kind = f"query {kinds[1]['query']}, qv array<double>, lists array<int>"
    one = meet(q.mapInPandas(probes(True), kind))
    bounds = one.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("bound")).select("query", F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
    two = meet(q.join(bounds, "query", "left").mapInPandas(probes(False), kind))
    return one.unionByName(two).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_parents(queries: DataFrame, index: DataFrame, k: int = 10, max_distance: float = schema.MAX_DISTANCE, lists: int | None = None) -> DataFrame:
    """The nearest k other models within a distance; with ``lists`` by :func:`pruned_search`, which finds the same."""
    found = search(queries, index, k + 1) if lists is None else pruned_search(queries, index, k + 1, lists=lists)
    found = found.where("query != hit").where(F.col("distance") <= max_distance)
    order = Window.partitionBy("query").orderBy("distance", "hit")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pair_candidates(found: DataFrame) -> DataFrame:
    """Unordered pairs of hits with their least distance."""
    return found.groupBy(F.least("query", "hit").alias("a"), F.greatest("query", "hit").alias("b")).agg(F.min("distance").alias("distance"))


def mean_vectors(rows: DataFrame) -> DataFrame:
    """(model, vector): column means of every tensor in order of names, a cheap index vector."""
    cells = rows.select("model", "tensor", F.posexplode("v").alias("c", "x"))
    means = cells.groupBy("model", "tensor", "c").agg(F.avg("x").alias("x"))
    return means.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("tensor", "c", "x"))), lambda p: p["x"]).alias("vector"))


def spectral_pairs(rows: DataFrame, pair_list: DataFrame, k: int = 48, cap: int = 768) -> DataFrame:
    """Per (a, b, tensor): subspace energy, effective rank of the difference over the side's, and top mass of each side.

    Also the effective ranks over the shorter side and the mass of the k leading directions,
    which direction weighs by the tensor's size (n_rows, n_cols: aligned rows, width).
    Blocks with values that are not finite have no spectrum: all zero.  The evenly spaced
    rows and columns are picked before the grouping, so that a task holds at most cap x cap
    cells of each side, whatever the tensor.  Where both sides have all rows from 0 on in one
    width, the places of the sample follow from their number and no other row leaves its
    task; elsewhere the rows that both have are met and numbered first.
    """
    keys = ["a", "b", "tensor"]
    size, n = F.size("v"), F.count(F.lit(1))
    whole = (F.count(F.when(F.col("row_idx").isNotNull() & size.isNotNull(), 1)) == n) & (F.min("row_idx") == 0) & (F.max("row_idx") == n - 1) & (F.min(size) == F.max(size))
    shapes = rows.groupBy("model", "tensor").agg(n.alias("n"), F.max(size).cast("long").alias("w"), whole.alias("whole"))
    a, b = (shapes.select(F.col("model").alias(s), "tensor", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "w", "whole")]) for s in "ab")
    both = pair_list.select("a", "b").distinct().join(a, "a").join(b, ["b", "tensor"])
    regular = F.coalesce(F.col("whole_a") & F.col("whole_b"), F.lit(False))
    both = materialize(both.select(*keys, F.least("n_a", "n_b").alias("n_rows"), F.col("w_a").alias("n_cols"), (F.col("w_a") == F.col("w_b")).alias("same"), regular.alias("regular")), "spectral-pairs")
    even, odd = both.where("regular and same").select(*keys, "n_rows", "n_cols"), both.where("not regular").select(*keys)
    ends = lambda frame, n: frame.select(F.col("a").alias("model"), "tensor", n.alias("n")).union(frame.select("b", "tensor", n))

    loose = rows.select("model", "tensor", "row_idx", F.array(size).alias("v")).join(ends(odd, F.lit(0)).select("model", "tensor").distinct(), ["model", "tensor"], "left_semi")
    ids = pairs.aligned(loose, odd.select("a", "b").distinct()).join(odd, keys, "left_semi")
    ids = ids.select(*keys, "row_idx", F.get("va", 0).alias("wa"), F.get("vb", 0).alias("wb"))
    ids = ids.where("wa = wb").withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("row_idx")).cast("long") - 1)
    sizes = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.first("wa").cast("long").alias("n_cols"))
    wanted = sizes.select(*keys, "n_rows", "n_cols", F.explode(even_indices(F.col("n_rows"), cap)).alias("i"))
    chosen = ids.join(wanted, [*keys, "i"]).select(*keys, "row_idx", "n_rows", "n_cols")
    chosen = chosen.unionAll(even.select(*keys, F.explode(even_indices(F.col("n_rows"), cap)).alias("row_idx"), "n_rows", "n_cols"))

    columns = lambda v: F.transform(even_indices(F.size(v), cap), lambda c: F.get(v, c.cast("int")))
    asked = ends(even, F.col("n_rows")).union(ends(odd, F.lit(None).cast("long"))).groupBy("model", "tensor").agg(F.collect_set("n").alias("ns"), F.max(F.col("n").isNull()).alias("every"))
    held = rows.join(asked, ["model", "tensor"]).where(F.col("every") | F.exists("ns", lambda n: is_even_index(F.col("row_idx"), n, cap)))
    side = lambda m, v: held.select(F.col("model").alias(m), "tensor", "row_idx", columns("v").alias(v))
    met = chosen.join(side("a", "va"), ["a", "tensor", "row_idx"]).join(side("b", "vb"), ["b", "tensor", "row_idx"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n_rows, n_cols = int(pdf["n_rows"].iloc[0]), int(pdf["n_cols"].iloc[0])
        pdf = pdf.sort_values("row_idx")
        a, b = np.vstack(pdf["va"].to_numpy()), np.vstack(pdf["vb"].to_numpy())
        if not (np.isfinite(a).all() and np.isfinite(b).all()):
            a, b = np.zeros_like(a), np.zeros_like(b)
        d = b - a
        (la, va), (lb, vb), (ld, _) = linalg.gram_spectrum(a), linalg.gram_spectrum(b), linalg.gram_spectrum(d)
        rank, short = linalg.effective_rank(ld), max(1, min(a.shape))
        row = {
            "energy_a": linalg.subspace_energy(d, va, k), "energy_b": linalg.subspace_energy(d, vb, k),
            "rank_a": rank / max(linalg.effective_rank(la), 1e-12), "rank_b": rank / max(linalg.effective_rank(lb), 1e-12),
            "mass_a": linalg.top_mass(la, 8), "mass_b": linalg.top_mass(lb, 8),
            "erank_a": linalg.effective_rank(la) / short, "erank_b": linalg.effective_rank(lb) / short, "erank_d": rank / short,
            "top_a": linalg.top_mass(la, k), "top_b": linalg.top_mass(lb, k), "n_rows": n_rows, "n_cols": n_cols,
        }
        return pd.DataFrame([{"a": pdf["a"].iloc[0], "b": pdf["b"].iloc[0], "tensor": pdf["tensor"].iloc[0], **row}])

    numbers = ("energy_a", "energy_b", "rank_a", "rank_b", "mass_a", "mass_b", "erank_a", "erank_b", "erank_d", "top_a", "top_b")
    fields = f"a string, b string, tensor string, {', '.join(f'{n} double' for n in numbers)}, n_rows long, n_cols long"
    # a group is one tensor's sample: at most cap rows of cap columns
    return met.groupBy(*keys).applyInPandas(one, fields)
