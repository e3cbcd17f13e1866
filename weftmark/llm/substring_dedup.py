"""Substring dedup: word windows that also start in an earlier document are removed.

Every window of ``width`` words gets a Rabin-Karp hash, and Spark finds the windows of two
documents and the first document of each, by partial minima:

* equal windows have equal anchors (the smallest hash among their ``anchor``-word
  parts), so only windows whose anchor occurs in two documents can repeat.  A fifth
  of the positions are anchors; they are counted first, and those that repeat go
  into a bit set sized by their number, whose false positives only cost rows;
* windows that pass are reduced to the least and the largest key, in every part of a
  map task, in the map task and then by hash; those with two keys are written;
* their documents are then looked up.  A map task posts a window once for its first
  document there: later documents of the task are known to repeat it, so a
  passage in a third of all documents posts one row a task, not one a document.

Repeated windows are sent to their documents (a key and a hash of the text, so that no
list outgrows a text) and merged into maximal removal intervals.  Documents without
any are rewritten where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.bitsets import broadcast_bits
from weftmark.llm.texts import Bits, Words, bounded_batches, slices, words_of
from weftmark.plans.shared import discard, materialize

#: Stands for a null key: after every other.
LAST = (1 << 63) - 1
#: Windows of two documents that a map task remembers at a time; what it forgets is joined instead.
REMEMBERED = 1 << 18


def _anchors(words: Words, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, window hash, valid) for the window that starts at each word."""
    parts, _ = words.windows(anchor)
    hashes, valid = words.windows(width)
    least = parts.copy()
    n = len(least)
    for j in range(1, width - anchor + 1):
        if n > j:
            np.minimum(least[: n - j], parts[j:], out=least[: n - j])
    return least, hashes, valid


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("k").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ordered by a then b."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _rewrite(words: Words, bounds: np.ndarray, removed: np.ndarray) -> list[bytes]:
    """Kept words of each document joined by single spaces."""
    n = len(words.data)
    change = np.zeros(n + 1, dtype=np.int8)
    kept = ~removed
    # a word's end may be the start of the next document's first word; starts and ends are distinct among themselves
    change[words.start[kept]] += 1
    change[words.end[kept]] -= 1
    chosen = np.cumsum(change[:n]) > 0
    data = words.data.copy()
    gap = np.zeros(n, dtype=bool)
    ends = words.end[kept]
    owner = np.searchsorted(bounds, words.start[kept], side="right")
    ends = ends[ends < bounds[owner]]
    gap[ends] = True
    data[gap] = 0x20
    chosen |= gap
    total = np.concatenate([[0], np.cumsum(chosen)])[bounds]
    flat, spaces = data[chosen].tobytes(), gap[chosen]
    out = []
    for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True):
        out.append(flat[a : b - 1] if b > a and spaces[b - 1] else flat[a:b])
    return out


def substring_dedup(
    df: DataFrame, width: int = 13, anchor: int = 5, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per document: ``key``, n_words, n_removed, removed, kept_text.

    ``removed`` lists the maximal intervals of removed words (start, end exclusive);
    ``kept_text`` has the other words joined by one space.  A word goes if a window
    of ``width`` words that covers it also starts in a document with a smaller key;
    windows are judged on the input.  Rows with the same key never make each other
    lose words.  A null key sorts after every other, so its row loses what any keyed
    row has, and null-keyed rows keep what only they share.  Null text and texts
    shorter than the window lose nothing; a very long text is hashed and rewritten whole.
    The key is an integer column; other columns are ignored whatever their names; an
    empty table gives an empty result.
    """
    if not 0 < anchor <= width:
        raise ValueError("the anchor must not be longer than the window")
    bounded_batches(df.sparkSession)
    rows = df.select(
        F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(text).cast("string")).alias("g")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                words = words_of(batch.column("t"), lower=False)
                least, _, valid = _anchors(words, width, anchor)
                owner = np.repeat(_keys(batch), np.diff(words.first))
                hashes, _ = _pairs(least[valid].view(np.int64), owner[valid])
                hashes, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array(np.minimum(n, 2).astype(np.int64))], names=["h", "n"]
                )

    counted = rows.select("k", "t").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    anchors = materialize(counted.where("n > 1").select("h"), "substring-anchors")
    repeated = broadcast_bits(anchors, "h")
    discard(anchors)

    def range_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(repeated.value)
        for whole in batches:
            for batch in slices(whole, "t"):
                words = words_of(batch.column("t"), lower=False)
                least, hashes, valid = _anchors(words, width, anchor)
                valid = valid & bits.has(least)
                h, k = _pairs(hashes[valid].view(np.int64), np.repeat(_keys(batch), np.diff(words.first))[valid])
                first, last = np.ones(len(h), dtype=bool), np.ones(len(h), dtype=bool)
                first[1:] = last[:-1] = h[1:] != h[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(k[first]), pa.array(k[last])], names=["h", "low", "high"])

    ranges = rows.select("k", "t").mapInArrow(range_of_keys, "h long, low long, high long")
    ranges = ranges.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = materialize(ranges.where("low < high").select(F.col("h").alias("w"), "low"), "substring-windows")
    shared_bits = broadcast_bits(shared, "w")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(shared_bits.value)
        seen, least_of = np.empty(0, np.int64), np.empty(0, np.int64)
        for whole in batches:
            for batch in slices(whole, "t"):
                words = words_of(batch.column("t"), lower=False)
                hashes, valid = words.windows(width)
                valid = valid & bits.has(hashes)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
                h, row = _pairs(hashes[valid].view(np.int64), owner[valid])
                k = _keys(batch)[row]
                order = np.lexsort((k, h))
                h, row, k = h[order], row[order], k[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = h[1:] != h[:-1]
                at = np.flatnonzero(new)
                later = k > np.repeat(k[at], np.diff(np.append(at, len(h)))) if len(h) else np.zeros(0, dtype=bool)
                if len(seen) and len(h):
                    place = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
                    later |= (seen[place] == h) & (least_of[place] < k)
                # windows of two documents in this part, by their first
                hot = at[np.diff(np.append(at, len(h))) > 1]
                hot = hot[~np.isin(h[hot], seen)][:REMEMBERED]
                if len(seen) + len(hot) > REMEMBERED:
                    seen, least_of = seen[:0], least_of[:0]
                seen, least_of = np.concatenate([seen, h[hot]]), np.concatenate([least_of, k[hot]])
                order = np.argsort(seen, kind="stable")
                seen, least_of = seen[order], least_of[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(k), batch.column("g").take(pa.array(row)), pa.array(later)], names=["h", "k", "g", "later"]
                )

    posted = rows.mapInArrow(post, "h long, k long, g long, later boolean")
    # what a task has settled already needs no company; the rest meets the window's first document
    settled = posted.where("later").select("k", "g", "h")
    met = posted.where("not later").join(shared, F.col("h") == F.col("w")).where("k > low").select("k", "g", "h")
    flagged = settled.unionAll(met)
    flags = materialize(flagged.groupBy("k", "g").agg(F.collect_set("h").alias("hs")), "substring-flags")
    discard(shared)
    touched = broadcast_bits(flags.select(F.xxhash64("k", "g").alias("x")), "x")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                words = words_of(batch.column("t"), lower=False)
                hashes, valid = words.windows(width)
                removed = np.zeros(len(hashes), dtype=bool)
                spans: list[list[dict[str, int]]] = []
                for row, flags_of in enumerate(batch.column("hs")):
                    a, b = int(words.first[row]), int(words.first[row + 1])
                    if not flags_of.is_valid or b - a < width:
                        spans.append([])
                        continue
                    wanted = np.sort(flags_of.values.to_numpy(zero_copy_only=False)).view(np.int64)
                    mine = hashes[a:b].view(np.int64)
                    at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                    hit = (wanted[at] == mine) & valid[a:b]
                    change = np.zeros(b - a + 1, dtype=np.int32)
                    starts = np.flatnonzero(hit)
                    change[starts] += 1
                    change[starts + width] -= 1
                    covered = np.cumsum(change[:-1]) > 0
                    removed[a:b] = covered
                    edges = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                    spans.append(
                        [
                            {"start": s, "end": e}
                            for s, e in zip(
                                np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True
                            )
                        ]
                    )
                lengths = pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                texts = _rewrite(words, bounds, removed)
                total = np.concatenate([[0], np.cumsum(removed)])[words.first]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k"),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(np.diff(total).astype(np.int64)),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=["k", "n_words", "n_removed", "removed", "kept_text"],
                )

    def pick(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = Bits(touched.value)
            for batch in batches:
                x = batch.column("x").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                yield batch.filter(pa.array(bits.has(x) == inside))

        return run

    keyed = rows.select("k", "t", "g", F.xxhash64(F.coalesce("k", F.lit(LAST)), "g").alias("x"))
    same = "k long, t string, g long, x long"
    clean = keyed.mapInArrow(pick(False), same).withColumn("hs", F.lit(None).cast("array<long>"))
    hit = keyed.mapInArrow(pick(True), same)
    fk = flags.select(F.col("k").alias("fk"), F.col("g").alias("fg"), "hs")
    hit = hit.join(fk, (F.coalesce(hit["k"], F.lit(LAST)) == fk["fk"]) & (hit["g"] == fk["fg"]), "left").select("k", "t", "g", "x", "hs")
    result = "k long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
    out = clean.mapInArrow(rewrite, result).unionAll(hit.mapInArrow(rewrite, result))
    return out.withColumnRenamed("k", key)
