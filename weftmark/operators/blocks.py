"""Comparisons of many models at once: rows meet in blocks of models, numbers leave.

A comparison asks for two models, or for two against a third.  Models are dealt to bins of
BIN, neighbours in the graph of comparisons together; a comparison belongs to the block of
its two or three bins.  Each row is sent once to every block that needs it (once in all if
a family fits a bin), where all rows of a tensor at the same places lie in one group of a
few million cells at most.  A group is turned into matrices and every comparison becomes a
handful of sums; only these are shuffled again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark import schema
from weftmark.operators import graph
from weftmark.plans.shared import materialize
from weftmark.sources.safetensors import sampled_runs

#: Models of a bin, and cells of one model in a group.
BIN, CELLS = 32, 1 << 17
#: Columns of a band of products, and groups whose products are added at once.
BAND, FAN = 128, 32
#: Sums of a comparison of a with b; ``on_b`` is the squared difference where b is not zero.
PAIR = ("cells", "ab", "aa", "bb", "dd", "on_a", "on_b", "za", "zb", "zz")
#: Sums of a and b against c: squared differences, their inner product, and the square of c.
TRIPLE = ("ac", "bc", "xy", "cc")
_COUNTS = ("cells", "za", "zb", "zz")


def in_sample(row: Column, n: Column, max_rows: int) -> Column:
    """Whether the block-stratified sample of ``max_rows`` of n rows holds a row."""
    count = max(1, min(schema.SAMPLE_BLOCKS, max_rows))
    per = max(1, max_rows // count)
    starts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (n - per) / F.lit(float(max(count - 1, 1)))).cast("long"))
    return (row < n) & ((n <= max_rows) | F.exists(starts, lambda s: (row >= s) & (row < s + per)))


def _sampled(rows: np.ndarray, n: int, max_rows: int | None) -> np.ndarray:
    keep = np.zeros(len(rows), bool)
    for first, last in sampled_runs(n, max_rows):
        keep |= (rows >= first) & (rows < last)
    return keep


def model_bins(asks: DataFrame) -> DataFrame:
    """(model, bin): at most BIN models each, those of one family of comparisons side by side."""
    models = asks.select(F.explode(F.array("a", "b", "c")).alias("node")).where("node is not null").distinct()
    if models.count() <= BIN:
        return models.select(F.col("node").alias("model"), F.lit(0).cast("long").alias("bin"))
    edges = asks.select(F.col("a").alias("parent"), F.col("b").alias("child")).unionAll(asks.where("c is not null").select("a", "c")).distinct()
    placed = graph.weak_components(models, edges)
    at = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    return placed.select(F.col("node").alias("model"), F.xxhash64("component", F.floor(at / BIN)).alias("bin"))


def _compare(width: int, max_rows: int | None, table: pa.Table) -> dict[str, list]:
    """Sums of every comparison of one group."""
    codes = table.column("model").combine_chunks().dictionary_encode()
    at, row = codes.indices.to_numpy(), table.column("row_idx").to_numpy()
    x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    asks: dict[str, list[dict]] = {}
    for i, name in enumerate(codes.dictionary.to_pylist()):
        mine = np.flatnonzero(at == i)
        mine = mine[np.argsort(row[mine], kind="stable")]
        held[name] = row[mine], x[mine]
        asks[name] = table.column("asks")[int(mine[0])].as_py() or []
    out: dict[str, list] = {c: [] for c in ("a", "b", "c", "identical", *PAIR, *TRIPLE)}
    for a, wanted in asks.items():
        for ask in wanted:
            names = [a, ask["b"], *([ask["c"]] if ask["c"] is not None else [])]
            if any(m not in held for m in names):
                continue
            rows = held[a][0]
            for m in names[1:]:
                if not np.array_equal(rows, held[m][0]):
                    rows = np.intersect1d(rows, held[m][0], assume_unique=True)
            if ask["n"] is not None:
                rows = rows[_sampled(rows, ask["n"], max_rows)]
            if not len(rows):
                continue
            parts = [held[m][1] if len(rows) == len(held[m][0]) else held[m][1][np.searchsorted(held[m][0], rows)] for m in names]
            u, w = parts[:2]
            d = u - w
            d *= d
            zu, zw = u == 0, w == 0
            found = {
                "cells": u.size, "ab": np.vdot(u, w), "aa": np.vdot(u, u), "bb": np.vdot(w, w), "dd": d.sum(), "on_a": d[~zu].sum() if zu.any() else d.sum(),
                "on_b": d[~zw].sum() if zw.any() else d.sum(), "za": zu.sum(), "zb": zw.sum(), "zz": (zu & zw).sum(), "identical": bool((u == w).all()),
            }
            if len(parts) == 3:
                p, q = u - parts[2], w - parts[2]
                found |= {"ac": np.vdot(p, p), "bc": np.vdot(q, q), "xy": np.vdot(p, q), "cc": np.vdot(parts[2], parts[2])}
            found |= {"a": a, "b": ask["b"], "c": ask["c"]}
            for c, kept in out.items():
                kept.append(found.get(c, 0.0))
    return out


def compare(rows: DataFrame, asks: DataFrame, max_rows: int | None = None) -> DataFrame:
    """(a, b, c, tensor, identical, sums) of all comparisons over the rows that their models share.

    ``rows`` is (model, tensor, row_idx, v), a row of a tensor once; ``asks`` (a, b[, c][, tensor, n]).
    Rows of different width do not meet.  With ``tensor`` only that tensor is compared and
    with ``n`` only the sample of ``max_rows`` of its first n rows.  Without common rows
    there is no result.  Nulls inside a row count as NaN.
    """
    every = ["a", "b", "c", "tensor", "n"]
    kinds = {"c": "string", "tensor": "string", "n": "long"}
    named = "tensor" in asks.columns
    asks = materialize(asks.select(*[F.col(c) if c in asks.columns else F.lit(None).cast(kinds[c]).alias(c) for c in every]).distinct(), "asks")
    bins = model_bins(asks)
    placed = asks
    for side in ("a", "b", "c"):
        placed = placed.join(bins.select(F.col("model").alias(side), F.col("bin").alias(f"bin_{side}")), side, "left")
    block = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array("bin_a", "bin_b", "bin_c")))), ",")
    ask = F.struct("b", "c", "n")
    placed = placed.select("a", "b", "c", "tensor", "n", block.alias("block"), ask.alias("ask"))
    none = F.lit(None).cast(placed.schema["ask"].dataType)
    long = placed.select("block", F.col("a").alias("model"), "tensor", "n", "ask")
    for side in ("b", "c"):
        long = long.unionAll(placed.where(f"{side} is not null").select("block", side, "tensor", "n", none))
    keys = ["model", "tensor"] if named else ["model"]
    needed = long.groupBy("block", *keys).agg(F.collect_list("ask").alias("asks"), F.collect_set("n").alias("ns"))
    met = rows.select("model", "tensor", "row_idx", "v").where(F.size("v") > 0).join(needed, keys)
    if max_rows:
        met = met.where((F.size("ns") == 0) | F.exists("ns", lambda n: in_sample(F.col("row_idx"), n, max_rows)))
    width = F.size("v")
    chunk = F.floor(F.col("row_idx") / F.greatest(F.lit(1), F.floor(F.lit(CELLS) / width)))
    met = met.select("block", "tensor", width.alias("width"), chunk.alias("chunk"), "model", "row_idx", "v", "asks")

    def group(key: tuple, table: pa.Table) -> pa.Table:
        found = _compare(key[2].as_py(), max_rows, table)
        kinds = {"a": pa.string(), "b": pa.string(), "c": pa.string(), "identical": pa.bool_()} | {c: pa.int64() for c in _COUNTS}
        made = {c: pa.array(v, kinds.get(c, pa.float64())) for c, v in found.items()}
        made["tensor"] = pa.array([key[1].as_py()] * len(found["a"]), pa.string())
        return pa.table(made)

    kind = "a string, b string, c string, identical boolean, " + ", ".join(f"{c} {'long' if c in _COUNTS else 'double'}" for c in (*PAIR, *TRIPLE)) + ", tensor string"
    parts = met.groupBy("block", "tensor", "width", "chunk").applyInArrow(group, kind)
    return parts.groupBy("a", "b", "c", "tensor").agg(F.bool_and("identical").alias("identical"), *[F.sum(c).alias(c) for c in (*PAIR, *TRIPLE)])


def largest_shared(tensors: DataFrame, pairs: DataFrame, n_tensors: int = 10, min_cells: int = 65536) -> DataFrame:
    """(a, b, tensor, n): the ``n_tensors`` largest matrices that both models have with one width, and the rows of the smaller."""
    sizes = [tensors.select(F.col("model").alias(s), "tensor", F.col("n_rows").alias(f"r{s}"), F.col("n_cols").alias(f"w{s}")) for s in "ab"]
    both = pairs.select("a", "b").join(sizes[0], "a").join(sizes[1], ["b", "tensor"]).where("wa = wb")
    n = F.least("ra", "rb")
    wide = both.select("a", "b", "tensor", n.cast("long").alias("n"), (n * F.col("wa")).alias("cells")).where(f"n >= 2 and cells >= greatest({int(min_cells)}, 2 * n)")
    order = Window.partitionBy("a", "b").orderBy(F.desc("cells"), "tensor")
    return wide.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n_tensors).select("a", "b", "tensor", "n")


def _products(table: pa.Table) -> dict[str, list]:
    """Products and column sums of every pair of models of one group, over the rows both have."""
    codes = table.column("model").combine_chunks().dictionary_encode()
    at, row = codes.indices.to_numpy(), table.column("row_idx").to_numpy()
    x, y = (np.nan_to_num(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(row), -1) for c in ("vi", "vj"))
    x_only = y.shape[1] == 0
    held, own, asks = {}, {}, {}
    for i, name in enumerate(codes.dictionary.to_pylist()):
        mine = np.flatnonzero(at == i)
        mine = mine[np.argsort(row[mine], kind="stable")]
        held[name], asks[name] = (row[mine], x[mine], y[mine]), table.column("asks")[int(mine[0])].as_py() or []

    def gram(name: str, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        if len(p) < len(held[name][0]):
            return p.T @ q
        if name not in own:
            own[name] = p.T @ q
        return own[name]

    out: dict[str, list] = {c: [] for c in ("a", "b", "n", "sums")}
    for a, wanted in asks.items():
        for b in wanted:
            if b not in held:
                continue
            rows = np.intersect1d(held[a][0], held[b][0], assume_unique=True)
            if not len(rows):
                continue
            (ai, aj), (bi, bj) = ([m if len(rows) == len(m) else m[np.searchsorted(held[k][0], rows)] for m in held[k][1:]] for k in (a, b))
            if x_only:
                parts = [ai.T @ bi, gram(a, ai, ai), gram(b, bi, bi), ai.sum(0), bi.sum(0)]
            else:
                parts = [ai.T @ bj, aj.T @ bi, gram(a, ai, aj), gram(b, bi, bj), ai.sum(0), bi.sum(0), aj.sum(0), bj.sum(0)]
            for c, v in zip(out, (a, b, len(rows), np.concatenate([p.ravel() for p in parts])), strict=True):
                out[c].append(v)
    return out


def _norms(n: int, wi: int, wj: int, sums: np.ndarray) -> tuple[float, float, float]:
    """Squared norms of the centred cross products of a and b, a and a, b and b, in a pair of column bands."""
    squared = lambda g, p, q: float(((g.reshape(len(p), len(q)) - np.outer(p, q) / n) ** 2).sum())
    if wj == 0:
        ab, aa, bb, a, b = np.split(sums, np.cumsum([wi * wi] * 3 + [wi]))
        return squared(ab, a, b), squared(aa, a, a), squared(bb, b, b)
    ab, ba, aa, bb, ai, bi, aj, bj = np.split(sums, np.cumsum([wi * wj] * 4 + [wi, wi, wj]))
    return squared(ab, ai, bj) + squared(ba, aj, bi), 2 * squared(aa, ai, aj), 2 * squared(bb, bi, bj)


def cka(rows: DataFrame, pairs: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """(a, b, tensor, cells, cka): linear CKA of the rows both models have, of column-centred matrices.

    Groups of rows, as in :func:`compare`, give the products of two bands of BAND columns
    and their column sums; these are added over the groups of a tensor, by FAN at a time,
    centred with the whole sums, and squared.  Rows leave once for each pair of bands, sums
    are of BAND by BAND cells.  With ``n_rows`` or ``n_cols`` only so many rows and columns of
    a tensor take part, drawn by their smallest hashes with its name.
    """
    asks = materialize(pairs.select("a", "b", F.lit(None).cast("string").alias("c")).distinct(), "asks")
    bins = model_bins(asks).withColumnRenamed("bin", "n")
    placed = asks.join(bins.select(F.col("model").alias("a"), F.col("n").alias("p")), "a").join(bins.select(F.col("model").alias("b"), F.col("n").alias("q")), "b")
    placed = placed.select("a", "b", F.concat_ws(",", F.least("p", "q").cast("string"), F.greatest("p", "q").cast("string")).alias("block"))
    long = placed.select("block", F.col("a").alias("model"), "b").unionAll(placed.select("block", "b", F.lit(None).cast("string")))
    needed = long.groupBy("block", "model").agg(F.collect_list("b").alias("asks"))
    met = rows.select("model", "tensor", "row_idx", "v", F.size("v").alias("width")).where("width > 1")
    if n_rows:
        # the rows of a tensor are known by its places, which models share: the narrow table of places is ranked, not the rows
        order = Window.partitionBy("tensor", "width").orderBy(F.xxhash64("tensor", "row_idx"), "row_idx")
        chosen = met.select("tensor", "width", "row_idx").distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= n_rows).drop("at")
        met = met.join(chosen, ["tensor", "width", "row_idx"], "left_semi")
    if n_cols:
        ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.struct(F.xxhash64("tensor", i).alias("h"), i.alias("i"))))
        drawn = F.transform(F.slice(ranked, 1, n_cols), lambda c: F.get("v", c["i"]))
        met = met.withColumn("v", F.when(F.col("width") > n_cols, drawn).otherwise(F.col("v")))
    used = F.size("v")
    chunk = F.floor(F.col("row_idx") / F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.least(used, F.lit(BAND)))))
    last = F.floor((used - 1) / F.lit(BAND)).cast("int")
    bands = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    met = met.join(needed, "model").select("block", "tensor", "width", chunk.alias("chunk"), "model", "row_idx", "v", "asks", F.explode(bands).alias("band"))
    cut = lambda k: F.slice("v", F.col(f"band.{k}") * BAND + 1, F.lit(BAND))
    of = ["block", "tensor", "width", "i", "j", "chunk"]
    other = F.when(F.col("band.i") < F.col("band.j"), cut("j")).otherwise(F.array().cast("array<double>"))
    met = met.select("block", "tensor", "width", "band.i", "band.j", "chunk", "model", "row_idx", cut("i").alias("vi"), other.alias("vj"), "asks")

    def group(key: tuple, table: pa.Table) -> pa.Table:
        out = _products(table)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()))
        made = {c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)}
        size = len(out["n"])
        fixed = {"tensor": (key[1], pa.string()), "width": (key[2], pa.int32()), "i": (key[3], pa.int32()), "j": (key[4], pa.int32()), "chunk": (key[5], pa.int64())}
        return pa.table(made | {c: pa.array([v.as_py()] * size, k) for c, (v, k) in fixed.items()})

    def total(table: pa.Table) -> tuple[int, np.ndarray]:
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
        return pa.compute.sum(table.column("n")).as_py(), sums

    def add(table: pa.Table) -> pa.Table:
        n, sums = total(table)
        one = table.slice(0, 1)
        return one.set_column(one.schema.get_field_index("n"), "n", pa.array([n], pa.int64())).set_column(one.schema.get_field_index("sums"), "sums", pa.array([sums], pa.list_(pa.float64())))

    def finish(table: pa.Table) -> pa.Table:
        n, sums = total(table)
        i, j, width = (table.column(c)[0].as_py() for c in ("i", "j", "width"))
        size = [min(BAND, (min(width, n_cols) if n_cols else width) - k * BAND) for k in (i, j)]
        xy, xx, yy = _norms(n, size[0], size[1] if i < j else 0, sums)
        one = table.select(["a", "b", "tensor", "width"]).slice(0, 1)
        for c, v, k in (("n", n, pa.int64()), ("xy", xy, pa.float64()), ("xx", xx, pa.float64()), ("yy", yy, pa.float64())):
            one = one.append_column(c, pa.array([v], k))
        return one

    parts = met.groupBy(*of).applyInArrow(group, "a string, b string, n long, sums array<double>, tensor string, width int, i int, j int, chunk long")
    same = ["a", "b", "tensor", "width", "i", "j"]
    few = parts.groupBy(*same, F.floor(F.col("chunk") / FAN).alias("part")).applyInArrow(lambda table: add(table), parts.schema)
    made = few.groupBy(*same).applyInArrow(lambda table: finish(table), "a string, b string, tensor string, width int, n long, xy double, xx double, yy double")
    met = made.groupBy("a", "b", "tensor", "width").agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in ("xy", "xx", "yy")]).where("n > 1")
    columns = F.least("width", F.lit(n_cols)) if n_cols else F.col("width")
    value = F.coalesce(F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")), F.lit(0.0))
    return met.select("a", "b", "tensor", (F.col("n") * columns).alias("cells"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("cka"))


def invariants(rows: DataFrame, wanted: DataFrame, max_rows: int = 256) -> DataFrame:
    """(model, tensor, row_idx, v): rows of products of adjacent matrices, as tensors attn/<layer> and mlp/<layer>.

    ``wanted`` is (model, layer, role, tensor, n) for the roles attn_q, attn_k, mlp_in and
    mlp_out; of each matrix the sample of ``max_rows`` of its n rows takes part.  Attention is
    Q times K transposed, K being the middle third of a fused Q where there is none; the
    MLP is out times in over the inner places both have, else in times out.  A task holds
    the matrices of one model's layer.
    """
    met = rows.select("model", "tensor", "row_idx", "v").join(wanted, ["model", "tensor"]).where(in_sample(F.col("row_idx"), F.col("n"), max_rows))

    def group(key: tuple, table: pa.Table) -> pa.Table:
        held = {}
        for role in set(table.column("role").to_pylist()):
            part = table.filter(pa.compute.equal(table.column("role"), role)).sort_by("row_idx")
            held[role] = np.nan_to_num(np.array(part.column("v").to_pylist(), float))
        made = {}
        q, k = held.get("attn_q"), held.get("attn_k")
        if q is not None and k is None and q.shape[1] % 3 == 0 and q.shape[1] >= 6:
            third = q.shape[1] // 3
            q, k = q[:, :third], q[:, third : 2 * third]
        if q is not None and k is not None and q.shape[1] == k.shape[1]:
            made["attn"] = q @ k.T
        if "mlp_in" in held and "mlp_out" in held:
            for left, right in ((held["mlp_out"], held["mlp_in"]), (held["mlp_in"], held["mlp_out"])):
                inner = min(left.shape[1], right.shape[0])
                if inner >= 2:
                    made["mlp"] = left[:, :inner] @ right[:inner]
                    break
        flat = [(f"{kind}/{key[1].as_py()}", i, row.tolist()) for kind, x in made.items() for i, row in enumerate(x)]
        tensor, at, v = zip(*flat, strict=True) if flat else ((), (), ())
        return pa.table({
            "model": pa.array([key[0].as_py()] * len(flat), pa.string()), "tensor": pa.array(tensor, pa.string()), "row_idx": pa.array(at, pa.int64()),
            "v": pa.array(v, pa.list_(pa.float64())),
        })

    return met.groupBy("model", "layer").applyInArrow(group, "model string, tensor string, row_idx long, v array<double>")
