"""Distinct pairs of visitors that met in a place.

A place of k visitors has k (k - 1) / 2 pairs, most of them met elsewhere too, and a shuffle of
plain pairs takes some fifteen bytes for each.  Places are dealt by ranges; a task tells its pairs apart,
a bounded number at a time, and sends each visitor once with the gaps between those it met,
which take a byte or two each.  Who is equal in kind is told before pairs are made, so that no pair is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.plans.shared import dealt, shares

#: Pairs made or unpacked at once.
LOT = 1 << 20
#: Distinct pairs that a task holds before it sends them.
HELD = 8 * LOT
#: Most visitors met in one row.
PIECE = 1 << 10


def met_pairs(visits: DataFrame, n: int) -> DataFrame:
    """(a, b, same): pairs of ``who``, a < b, that share a ``place`` in ``visits``, and whether they share a ``kind``.

    ``visits`` has (place, who, kind) as longs without nulls, with one kind for each ``who``; ``n``, which its rows do not exceed,
    gives the number of tasks.  A visitor that met many is in one task, which holds no more than the visitors.
    """
    sent = visits.select("place", "who", "kind").repartitionByRange(shares(visits.sparkSession, n), "place").mapInArrow(_sent, "a long, same boolean, n int, met binary")
    sent = dealt(sent, "a", "same", rows=1 << 19, n=n).sortWithinPartitions("a", "same")
    return sent.mapInArrow(_received, "a long, b long, same boolean")


def _visits(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The rows (place, who, kind) of all batches, each once and in order; repeats go before many are held."""
    held, many, most = [np.empty((0, 3), dtype=np.int64)], 0, 2 * LOT
    for batch in batches:
        held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
        many += len(held[-1])
        if many >= most:
            held = [_each_once(np.concatenate(held))]
            many = len(held[0])
            most = max(most, 2 * many)
    return _each_once(np.concatenate(held))


def _each_once(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[: len(rows)]]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, who, kind = _visits(batches).T
    if not len(place):
        return
    names, code = np.unique(who, return_inverse=True)
    n = len(names)
    kinds = np.empty(n, dtype=np.int64)
    kinds[code] = kind
    begin = _runs(place)
    end = np.append(begin[1:], len(place))
    many = np.repeat(end, end - begin) - np.arange(len(place)) - 1  # those after each visitor of a place
    held, size = [], 0
    for rows in np.split(np.arange(len(place)), np.flatnonzero(np.diff(np.cumsum(many) // LOT)) + 1):
        m = many[rows]
        b = code[np.repeat(rows + 1 - np.cumsum(m) + m, m) + np.arange(m.sum())]
        a = np.repeat(code[rows], m)
        held.append(np.unique(((kinds[a] == kinds[b]) * n + a) * n + b))
        size += len(held[-1])
        if size >= HELD:
            held = [_merged(held)]
            size = len(held[0])
            if size >= HELD // 2:
                yield from _packed(held.pop(), names)
                size = 0
    if size:
        yield from _packed(_merged(held), names)


def _merged(held: list[np.ndarray]) -> np.ndarray:
    """The distinct values of the arrays, which are let go."""
    all_ = np.concatenate(held)
    held.clear()
    all_.sort()
    return all_[_runs(all_)]


def _packed(pairs: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the sorted pairs (same * n + a) * n + b, LOT pairs at a time: the gaps from a to the first b and from one to the next."""
    for i in range(0, len(pairs), LOT):
        yield _rows(pairs[i : i + LOT], names)


def _rows(pairs: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    first, b = pairs // len(names), names[pairs % len(names)]
    a = names[first % len(names)]
    begin = _runs(first)
    place = np.arange(len(pairs)) - np.repeat(begin, np.diff(np.append(begin, len(pairs))))
    begin = np.flatnonzero(place % PIECE == 0)
    gap = b.copy()
    gap[1:] -= b[:-1]
    gap[begin] = b[begin] - a[begin]
    data, ends = _small(gap.view(np.uint64))
    offsets = np.append(0, ends[np.append(begin[1:], len(pairs)) - 1]).astype(np.int32)
    met = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    counts = np.diff(np.append(begin, len(pairs))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(a[begin]), pa.array(first[begin] >= len(names)), pa.array(counts), met], ["a", "same", "n", "met"])


def _small(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value ends): seven bits a byte, lowest first; the eighth says that more follow."""
    width = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        width += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(width)
    data = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint8)
    for k in range(width.max(initial=0)):
        on = width > k
        data[ends[on] - width[on] + k] = ((values[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((width[on] > k + 1) * 128).astype(np.uint8)
    return data, ends


def _large(data: np.ndarray) -> np.ndarray:
    """The values of :func:`_small`."""
    ends = np.flatnonzero(data < 128) + 1
    begin = np.append(0, ends[:-1])
    values = np.zeros(len(ends), dtype=np.uint64)
    for k in range((ends - begin).max(initial=0)):
        on = ends - begin > k
        values[on] |= (data[begin[on] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return values


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, same, b) of the rows, some LOT pairs at a time."""
    a, same, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    met = batch.column(3).cast(pa.binary())
    offsets = np.frombuffer(met.buffers()[1], dtype=np.int32)[met.offset : met.offset + len(met) + 1]
    data = np.frombuffer(met.buffers()[2], dtype=np.uint8)
    for rows in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(n, dtype=np.int64) // LOT)) + 1):
        if len(rows):
            gaps, m = _large(data[offsets[rows[0]] : offsets[rows[-1] + 1]]), n[rows]
            far, begin = np.cumsum(gaps), np.cumsum(m) - m
            b = np.repeat(a[rows].view(np.uint64) - far[begin] + gaps[begin], m) + far
            yield np.repeat(a[rows], m), np.repeat(same[rows], m), b.view(np.int64)


def _told(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in the order of (a, same) that they come in, and of b, each once."""
    a, same, b = (np.concatenate(x) for x in zip(*held))
    run = np.zeros(len(a), dtype=np.int64)
    run[_runs(a, same)[1:]] = 1
    run = np.cumsum(run)
    low, span = int(b.min()), int(b.max()) - int(b.min()) + 1
    if (int(run[-1]) + 1) * span < 1 << 63:
        _, at = np.unique(run * span + (b - low), return_index=True)
    else:
        at = np.lexsort((b, run))
        at = at[_runs(run[at], b[at])]
    return a[at], same[at], b[at]


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, many, most = [], 0, LOT
    for batch in batches:
        for part in _unpacked(batch):
            held.append(part)
            many += len(part[0])
            if many >= most:
                a, same, b = _told(held)
                last = _runs(a, same)[-1]  # more of its pairs may follow
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array(x[:last]) for x in (a, b, same)], ["a", "b", "same"])
                held = [(a[last:], same[last:], b[last:])]
                many = len(held[0][0])
                most = max(LOT, 2 * many)
    if many:
        a, same, b = _told(held)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, same)], ["a", "b", "same"])
