"""Lines found in many documents, by one sorted stream of hashes; the result is a keep bitmap per document.

1. every line becomes a narrow row: the first 128 bits of its key's SHA-256, its document and position;
2. rows are dealt by ranges of (hash, document, position) and sorted, so that one frequent
   line may fill many tasks; each task streams its rows, counts the first occurrence of each
   document, and lets go of a hash's rows once enough documents have it, holding those of
   ``documents - 1`` at most;
3. the first and the last hash of a task may go on in its neighbours.  What a task could not
   decide of these is counted again together, at most ``documents - 1`` documents for each end;
4. dropped positions meet by document and become a compressed bitmap.

No text is shuffled up to here; it meets the bitmaps only when it is rewritten.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.llm.ordered_runs import changes
from weftmark.plans.shared import discard, materialize

#: ASCII white space.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: States of a streamed row: to drop, undecided at a task's end, or a note that a task's end is decided.
DROP, OPEN, KNOWN = 0, 1, 2


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _identified(df: DataFrame, text: str, key: str) -> DataFrame:
    """(k, t, d): key, text with null as empty, and a hash of both that tells apart rows of one key."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(key).alias("k"), whole.alias("t"), F.xxhash64(F.col(key), whole).alias("d"))


def line_rows(rows: DataFrame, min_chars: int) -> DataFrame:
    """(h, k, d, at) for every line whose key has ``min_chars`` code points or more."""
    lines = rows.select("k", "d", F.posexplode(F.split("t", "\n", -1)).alias("at", "line"))
    keyed = lines.select("k", "d", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("h"), "k", "d", "at")


class _Run:
    """The rows of the hash that a task is at, as far as they are undecided."""

    def __init__(self, first: bool):
        self.first, self.held, self.documents, self.closed, self.last = first, [], 0, False, None


def stream_runs(batches: Iterator[pa.RecordBatch], documents: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, k, d, at, state) of one task from its rows in the order of (h, d, k, at)."""
    run: _Run | None = None

    def out(rows: pa.RecordBatch, state: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, state, np.int8))], names=["h", "k", "d", "at", "state"])

    def end(run: _Run, edge: bool) -> Iterator[pa.RecordBatch]:
        """What is left to say of a run that stops here: nothing unless it touches an end of the task."""
        if edge:
            if run.closed:
                yield out(run.last, KNOWN)
            else:
                yield from (out(rows, OPEN) for rows in run.held)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fresh_hash = changes(batch.column("h"))
        if run is not None and batch.column("h")[0].as_py() == run.last.column("h")[0].as_py():
            fresh_hash[0] = False
        fresh_doc = fresh_hash | changes(batch.column("d")) | changes(batch.column("k"))
        if not fresh_hash[0]:
            fresh_doc[0] = any(batch.column(c)[0].as_py() != run.last.column(c)[0].as_py() for c in ("d", "k"))
        starts = np.flatnonzero(fresh_hash)
        counts = np.concatenate([[0], np.cumsum(fresh_doc)])
        stop = int(starts[0]) if len(starts) else n
        if stop:  # the run of the batch before goes on
            head = batch.slice(0, stop)
            run.documents += int(counts[stop])
            run.last = head.slice(stop - 1)
            run.held.append(head)
            if run.closed or run.documents >= documents:
                run.closed = True
                yield from (out(rows, DROP) for rows in run.held)
                run.held = []
        if not len(starts):
            continue
        if run is not None:
            yield from end(run, run.first)
        ends = np.append(starts[1:], n)
        found = counts[ends] - counts[starts]
        first, last = run is None, len(starts) - 1
        inner = np.repeat((found >= documents) & (np.arange(len(starts)) < last), ends - starts)
        if inner.any():
            yield out(batch.slice(int(starts[0])).filter(pa.array(inner)), DROP)
        if first and last:
            run = _Run(True)
            run.closed, run.last = bool(found[0] >= documents), batch.slice(int(ends[0]) - 1, 1)
            run.held = [] if run.closed else [batch.slice(0, int(ends[0]))]
            yield from end(run, True)
        run = _Run(first and not last)
        tail = batch.slice(int(starts[last]))
        run.documents, run.last, run.held = int(found[last]), tail.slice(tail.num_rows - 1), [tail]
        if run.documents >= documents:
            run.closed, run.held = True, []
            yield out(tail, DROP)
    if run is not None:
        yield from end(run, True)


def _dropped(rows: DataFrame, documents: int, min_chars: int) -> DataFrame:
    """(k, d, at) of every line that goes."""
    lines = materialize(line_rows(rows, min_chars), "line-hashes")
    order = ["h", "d", "k", "at"]
    types = dict(lines.dtypes)
    streamed = lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda batches: stream_runs(batches, documents), f"h binary, k {types['k']}, d long, at int, state tinyint"
    )
    streamed = materialize(streamed, "line-stream")
    discard(lines)
    open_ = streamed.where(F.col("state") == OPEN)
    counted = open_.select("h", "k", "d").distinct().groupBy("h").count().where(F.col("count") >= documents).select("h")
    known = streamed.where(F.col("state") == KNOWN).select("h")
    # two hashes for each task of the stream at most
    verdict = F.broadcast(counted.unionAll(known).distinct())
    return streamed.where(F.col("state") == DROP).select("k", "d", "at").unionAll(open_.join(verdict, "h", "left_semi").select("k", "d", "at"))


def pack(places: np.ndarray, n: int) -> bytes:
    """A compressed bitmap of ``n`` lines in which those at ``places`` are 0."""
    keep = np.ones(n, bool)
    keep[places] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack(keep: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n).astype(bool)


def _bitmaps(rows: DataFrame, documents: int, min_chars: int) -> DataFrame:
    """(k, d, n_dropped, keep) of the documents that lose lines; bits end at the last lost line."""
    met = _dropped(rows, documents, min_chars).groupBy("k", "d").agg(F.collect_set("at").alias("places"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("places")
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            lists = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            sizes = np.array([int(x.max()) + 1 for x in lists], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("d"), pa.array(np.array([len(x) for x in lists], np.int64)), pa.array(sizes), pa.array([pack(x, n) for x, n in zip(lists, sizes, strict=True)], pa.binary())],
                names=["k", "d", "n_dropped", "bits", "keep"],
            )

    return met.mapInArrow(packed, f"k {dict(rows.dtypes)['k']}, d long, n_dropped long, bits long, keep binary")


def keep_bitmaps(df: DataFrame, documents: int = 10, min_chars: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, n_lines, n_dropped, keep.

    A line goes, in every document, if its key (:func:`line_key`) has ``min_chars`` code points
    and is found in ``documents`` documents.  ``keep`` is a compressed bitmap (:func:`unpack`
    it with the number of ``bits``) up to the last line that goes, null where none does.
    Null or empty text is one empty line.  A document is a row; rows that repeat both key and
    text count as one document, rows that share only the key (null keys too) as several.
    Very long texts are split whole.  Other columns are ignored whatever their names; an
    empty table gives an empty result.
    """
    rows = _identified(df, text, key)
    return _met(rows, _bitmaps(rows, documents, min_chars)).drop("t").withColumnRenamed("k", key)


def _met(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents with their bitmaps; null keys meet through the hash."""
    lost = materialize(bitmaps, "line-bitmaps").withColumnRenamed("k", "k2").withColumnRenamed("d", "d2")
    met = rows.join(lost, (F.col("d") == F.col("d2")) & F.col("k").eqNullSafe(F.col("k2")), "left")
    breaks = F.length("t") - F.length(F.replace(F.col("t"), F.lit("\n"), F.lit(""))) + 1
    return met.select("k", "t", breaks.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "bits", "keep")


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, bits, keep in zip(*(batch.column(c).to_pylist() for c in ("t", "bits", "keep")), strict=True):
            if keep is None:
                texts.append(text)
            else:
                lines = text.split("\n")
                kept = unpack(keep, bits)
                texts.append("\n".join([line for line, stays in zip(lines, kept, strict=False) if stays] + lines[bits:]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], names=[*batch.schema.names[:3], "kept_text"])


def line_dedup(df: DataFrame, documents: int = 10, min_chars: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, n_lines, n_dropped, kept_text, by the bitmaps of :func:`keep_bitmaps`.

    Texts without a dropped line pass as they are, null as empty; of a text that loses all
    its lines nothing is left.  Nulls, ties, very long texts and empty tables as there.
    """
    rows = _identified(df, text, key)
    met = _met(rows, _bitmaps(rows, documents, min_chars)).select("k", "n_lines", "n_dropped", "t", "bits", "keep")
    out = met.mapInArrow(_rewritten, f"k {dict(rows.dtypes)['k']}, n_lines long, n_dropped long, kept_text string")
    return out.select(F.col("k").alias(key), "n_lines", "n_dropped", "kept_text")
