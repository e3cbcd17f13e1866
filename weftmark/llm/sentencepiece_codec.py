"""SentencePiece encoding and decoding by a streaming Viterbi search.

Every character of every text goes through one search.  At each boundary it keeps one
backpointer: the last piece of the best path that ends there.  Only boundaries
within the longest piece's length can be reached from, so the backpointers of that
window decide the future; whenever all of them lead back to one boundary, the ids
before it are final, are committed, and only the window behind it is kept until more
of the text comes.

Many streams are searched in step: a text is fed in parts, the parts of a batch's texts
are laid side by side, and one array operation settles the next character of all of
them.  No piece of the usual models has a word mark after another character, so
all paths meet before a word; the words of a part are then lanes of the same step.

A path's score is the sum of its pieces' scores for unigram models.  For BPE models
a path scores 0 if every pair of neighbours is one that merging leaves alone and
minus infinity otherwise; exactly one path per boundary scores 0, and it is the
merge result, since a sequence is stable if all its neighbouring pairs are.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmark.llm.texts import bounded_batches, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A model that is sent to executors has so many bytes at most.
MAX_MODEL_BYTES = 64 << 20
#: Pairs of symbols that a worker remembers: as a table that is emptied when full, and as a table by hash before it.
MAX_PAIRS, FRONT_BITS, SYMBOL_BITS = 400_000, 20, 22
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Characters of one text fed at a time, characters of all texts searched at a time, bytes of text in Python at a time.
PART_CHARS, ROUND_CHARS, CHUNK_BYTES = 1 << 15, 1 << 18, 4 << 20


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value, at
            shift += 7

    at = 0
    while at < len(buf):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = buf[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = buf[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces and settings of a SentencePiece model file."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback, self.unk_id = UNIGRAM, False, 0
        self.dummy_prefix, self.squeeze, self.escape, charsmap = True, True, True, b""
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(kind)
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
                    elif n == 40:
                        self.unk_id = v
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if charsmap:
            raise ValueError("models with a character map are not supported: normalise first")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is not supported")
        if USER_DEFINED in self.types:
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.lines_apart = not any("\n" in p for p in self.ids)
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        if len(self.pieces) + 1 + 0x110000 >= 1 << SYMBOL_BITS:
            raise ValueError(f"models of {len(self.pieces)} pieces are not supported")


class Stream:
    """One text on its way through the search: what is not committed yet, and the piece before it."""

    __slots__ = ("before", "last", "score", "size", "tail")

    def __init__(self, start: int):
        self.tail = ""  # characters since the last committed boundary
        self.before = start  # the symbol of the last committed piece
        self.last = np.empty(0, np.int64)  # for each of these characters the best path's piece that ends with it,
        self.size = np.empty(0, np.int32)  # the length of that piece
        self.score = np.empty(0)  # and the path's score

    def meeting(self, size: list[int], longest: int) -> int:
        """The last boundary that every surviving path passes: the one where all backpointers of the window lead."""
        end = len(size)
        live = set(range(max(0, end - longest + 1), end + 1))
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(far - size[far - 1])
        return live.pop()


class Codec:
    """Encoder and decoder of one model.

    A symbol is the id of a piece, ``start`` (nothing stands before), or ``start`` + 1 +
    the code point of a character that is no piece.
    """

    def __init__(self, raw: bytes):
        self.model = model = Model(raw)
        self.start = len(model.pieces)
        #: characters that searches have passed, each once
        self.searched = 0
        #: pairs of symbols found stable (1) or not (0): all of them, emptied when full, and a table by hash
        self.known: dict[int, int] = {}
        self.front = np.full(1 << FRONT_BITS, -1, dtype=np.int64)
        self._build_trie()
        self._weights = np.array([*model.scores, model.floor])
        self._sizes = np.array([*map(len, model.pieces), 1], dtype=np.int32)
        #: what each id adds to a decoded text; bytes and specials apart
        self._plain = [
            p.replace(MARK, " ") if t in (NORMAL, USER_DEFINED, UNUSED) else " ⁇ " if t == UNKNOWN else ""
            for p, t in zip(model.pieces, model.types, strict=True)
        ]
        self._byte = {i: b for b, i in model.byte_ids.items()}
        self._byte_ids = np.array([model.byte_ids.get(b, model.unk_id) for b in range(256)], dtype=np.int32)

    def _build_trie(self) -> None:
        """Edges (node, character) -> node of the pieces' trie as a table by hash, and each node's piece or -1."""
        edges: dict[int, int] = {}
        ends = [-1]
        for piece, i in self.model.ids.items():
            node = 0
            for c in piece:
                edge = node << 21 | ord(c)
                if edge not in edges:
                    edges[edge] = len(ends)
                    ends.append(-1)
                node = edges[edge]
            ends[node] = i
        bits = max(4, len(edges).bit_length() + 2)
        self._edge, self._next = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        self._edge_shift, self._ends = np.uint64(64 - bits), np.array(ends, dtype=np.int32)
        keys, nodes = np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges))
        slots = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # linear probing, all edges at a time: the first to claim a free slot has it
            free = left[self._edge[slots[left]] == -1]
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self._edge[slots[won]], self._next[slots[won]] = keys[won], nodes[won]
            left = left[self._edge[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & (len(self._edge) - 1)

    def _slot(self, edges: np.ndarray) -> np.ndarray:
        return ((edges.view(np.uint64) * SPREAD) >> self._edge_shift).astype(np.int64)

    def _step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Trie nodes after one more character; -1 where none is."""
        edges = nodes.astype(np.int64) << 21 | chars
        slots = self._slot(edges)
        found = self._edge[slots]
        open_ = np.flatnonzero((found != edges) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self._edge) - 1)
            found[open_] = self._edge[slots[open_]]
            open_ = open_[(found[open_] != edges[open_]) & (found[open_] != -1)]
        return np.where(found == edges, self._next[slots], -1)

    def _name(self, symbol: int) -> str:
        return self.model.pieces[symbol] if symbol < self.start else chr(symbol - self.start - 1) if symbol > self.start else ""

    def stable(self, left: str, right: str) -> bool:
        """Merging ``left + right`` gives just these two; with no left, just ``right``."""
        return self._merge(left + right) == ([left, right] if left else [right])

    def _merge(self, text: str) -> list[str]:
        """Merge neighbours, best score first, leftmost among equals; for short strings."""
        parts, ids, scores = list(text), self.model.ids, self.model.scores
        while True:
            best, where = -np.inf, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and scores[i] > best:
                    best, where = scores[i], k
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _stable_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (left symbol, then SYMBOL_BITS of the right one) is one that merging leaves alone."""
        slots = ((pairs.view(np.uint64) * SPREAD) >> np.uint64(64 - FRONT_BITS)).astype(np.int64)
        held = self.front[slots]
        new = np.flatnonzero(held >> 1 != pairs)
        if len(new):
            asked, place = np.unique(pairs[new], return_inverse=True)
            answers = np.empty(len(asked), dtype=np.int64)
            for n, pair in enumerate(asked.tolist()):
                answer = self.known.get(pair)
                if answer is None:
                    if len(self.known) >= MAX_PAIRS:
                        self.known.clear()
                    answer = self.known[pair] = int(self.stable(self._name(pair >> SYMBOL_BITS), self._name(pair & (1 << SYMBOL_BITS) - 1)))
                answers[n] = answer
            held[new] = pairs[new] << 1 | answers[place]
            self.front[slots[new]] = held[new]
        return (held & 1).astype(bool)

    def _candidates(self, chars: np.ndarray, lane: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, last character, symbol) of every piece that stands within a lane.

        ``lane`` has for each character the first one of its lane, ``room`` the
        characters of the lane from it on.
        """
        starts, nodes, firsts, lasts, symbols = np.arange(len(chars)), np.zeros(len(chars), np.int32), [], [], []
        for length in range(1, self.model.longest + 1):
            nodes = self._step(nodes, chars[starts + (length - 1)])
            live = nodes >= 0
            piece = np.where(live, self._ends[nodes], -1)
            hit = piece >= 0
            if length == 1:  # a character that is no piece stands for itself
                symbols.append(np.where(hit, piece, self.start + 1 + chars).astype(np.int64))
                firsts.append(starts)
                lasts.append(starts)
            else:
                symbols.append(piece[hit].astype(np.int64))
                firsts.append(starts[hit])
                lasts.append(starts[hit] + (length - 1))
            live &= room[starts] > length
            starts, nodes = starts[live], nodes[live]
            if not len(starts):
                break
        return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(symbols)

    def feed(self, streams: list[Stream], parts: list[str], final: list[bool]) -> list[np.ndarray]:
        """Send a part of text through each stream; the ids that become final (symbols to be exact).

        All streams advance together: the n-th step settles the n-th character of every
        lane.  A lane is a stream's text, or where the model has all paths meet before a
        word, a word.  After the last step each stream is committed as far as the
        backpointers of its window meet, or to its end if the part is ``final``.
        """
        model = self.model
        texts = [s.tail + p for s, p in zip(streams, parts, strict=True)]
        done = np.array([len(s.tail) for s in streams])
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        n = len(chars)
        if not n:
            return [np.empty(0, np.int64) for _ in streams]
        some = [k for k, t in enumerate(texts) if t]
        opens = np.zeros(n, dtype=bool)
        if model.words_apart:
            mark = chars == ord(MARK)
            opens[1:] = mark[1:] & ~mark[:-1]
            if model.lines_apart:
                line = chars == 10
                opens[1:] |= line[1:] != line[:-1]
        heads = bounds[some]
        opens[heads] = True
        before = np.full(n, self.start, dtype=np.int64)
        before[heads] = [streams[k].before for k in some]
        ends = np.append(np.flatnonzero(opens)[1:], n) - 1  # last characters of the lanes
        widths = np.diff(ends, prepend=-1)
        lane = np.repeat(ends - widths + 1, widths)
        room = np.repeat(ends, widths) - np.arange(n) + 1

        last, size, score = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int32), np.zeros(n)
        settled = np.zeros(n, dtype=bool)
        for k in np.flatnonzero(done).tolist():
            at = slice(bounds[k], bounds[k] + done[k])
            last[at], size[at], score[at], settled[at] = streams[k].last, streams[k].size, streams[k].score, True
        self.searched += int(n - settled.sum())

        first, end, symbol = self._candidates(chars, lane, room)
        if settled.any():
            new = ~settled[end]
            first, end, symbol = first[new], end[new], symbol[new]
        self._settle(first, end, symbol, opens, before, lane, last, size, score)
        if (last < 0).any():
            raise ValueError("the model has no path to some boundary")

        until = np.diff(bounds)
        for k in some:
            if not final[k]:
                until[k] = streams[k].meeting(size[bounds[k] : bounds[k + 1]].tolist(), model.longest)
        stop = bounds[:-1] + until
        marked = np.zeros(n, dtype=bool)
        owner = np.repeat(np.arange(len(streams)), np.diff(bounds))
        at = np.unique(np.concatenate([ends[ends < stop[owner[ends]]], stop[until > 0] - 1]))
        while len(at):  # back along the pieces of all lanes at once
            marked[at] = True
            back = at - size[at]
            at = back[back >= lane[at]]
        out = []
        for k, s in enumerate(streams):
            low, mid, high = bounds[k], stop[k], bounds[k + 1]
            out.append(last[low:mid][marked[low:mid]])
            if mid > low:
                s.before = int(last[mid - 1])
            s.tail, s.last, s.size = texts[k][until[k] :], last[mid:high].copy(), size[mid:high].copy()
            s.score = score[mid:high] - np.where(lane[mid:high] < mid, score[mid - 1], 0.0)
        return out

    def _settle(self, first, end, symbol, opens, before, lane, last, size, score) -> None:
        """Choose for every character the last piece of the best path to it, step by step along the lanes."""
        bpe, fresh = self.model.kind == BPE, opens[first]
        place = end - lane[end]
        if bpe:
            order = np.argsort(place.astype(np.uint16), kind="stable") if len(place) and place.max() < 1 << 16 else np.argsort(place, kind="stable")
        else:  # by step and character, and of equal paths that with the longest last piece
            order = np.lexsort((first, end, place))
        first, end, symbol, fresh, place = first[order], end[order], symbol[order], fresh[order], place[order]
        cuts = np.flatnonzero(np.diff(place)) + 1
        length = (end - first + 1).astype(np.int32)
        if not bpe:
            worth = self._weights[np.minimum(symbol, self.start)]
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
            f, e = first[low:high], end[low:high]
            if bpe:
                left = np.where(fresh[low:high], before[f], last[f - 1])
                take = self._stable_pairs(left << SYMBOL_BITS | symbol[low:high])
            else:
                total = np.where(fresh[low:high], 0.0, score[f - 1]) + worth[low:high]
                group = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
                best = np.repeat(np.maximum.reduceat(total, group), np.diff(np.append(group, len(e))))
                take = total == best
                take[1:] &= ~(take[:-1] & (e[1:] == e[:-1]))
                score[e[take]] = total[take]
            last[e[take]], size[e[take]] = symbol[low:high][take], length[low:high][take]

    def ids_of(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of committed symbols: characters that are no pieces become bytes, or one unknown id a run."""
        odd = symbols > self.start
        if not odd.any():
            return symbols.astype(np.int32)
        if not self.model.byte_fallback:
            keep = ~odd
            keep[0] = True
            keep[1:] |= ~odd[:-1]
            return np.where(odd, self.model.unk_id, symbols)[keep].astype(np.int32)
        points = symbols[odd] - self.start - 1
        raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        sizes = np.ones(len(symbols), dtype=np.int64)
        sizes[odd] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        out = np.repeat(symbols, sizes).astype(np.int32)
        out[np.repeat(odd, sizes)] = self._byte_ids[raw]
        return out

    def normal(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as int32."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; about ROUND_CHARS characters, PART_CHARS of a text at most, are searched at a time."""
        found: list[list[np.ndarray] | None] = [None if t is None else [] for t in texts]
        running: list[tuple[int, Stream, str, int]] = []  # number, stream, text, characters sent
        number = 0
        while number < len(texts) or running:
            width = sum(min(PART_CHARS, len(text) - sent) for _, _, text, sent in running)
            while number < len(texts) and width < ROUND_CHARS:
                if texts[number] is not None:
                    text = self.normal(texts[number])
                    running.append((number, Stream(self.start), text, 0))
                    width += min(PART_CHARS, len(text))
                number += 1
            final = [sent + PART_CHARS >= len(text) for _, _, text, sent in running]
            parts = [text[sent : sent + PART_CHARS] for _, _, text, sent in running]
            for (at, *_), symbols in zip(running, self.feed([s for _, s, _, _ in running], parts, final), strict=True):
                found[at].append(symbols)
            running = [(k, s, t, sent + PART_CHARS) for (k, s, t, sent), f in zip(running, final, strict=True) if not f]
        return [None if symbols is None else self.ids_of(np.concatenate(symbols)) for symbols in found]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8."""
        ids = list(ids)
        plain, byte = self._plain, self._byte
        if byte.keys().isdisjoint(ids):
            text = "".join(map(plain.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in byte:
                    run.append(byte[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(plain[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_codecs: dict[bytes, Codec] = {}


def codec_of(raw: bytes) -> Codec:
    """The codec of a model, made once a process."""
    name = hashlib.sha256(raw).digest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(raw)
    return _codecs[name]


def read_model(path: str) -> bytes:
    """A model file as bytes, read by the driver; bounded, since it goes to every executor."""
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return raw


def _id_lists(made: list[np.ndarray | None]) -> tuple[pa.ListArray, np.ndarray]:
    """Arrow lists of ids, null for None, and their lengths."""
    counts = np.array([0 if ids is None else len(ids) for ids in made], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    flat = np.concatenate([ids for ids in made if ids is not None] or [np.empty(0, np.int32)])
    missing = pa.array([ids is None for ids in made])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=missing), counts


def _with_key(rows: DataFrame, more: str) -> T.StructType:
    """A schema of the key column k and the columns of a DDL string."""
    return T.StructType([*rows.select("k").schema.fields, *T.StructType.fromDDL(more).fields])


def encode(df: DataFrame, model: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ids (array of int), n_ids.

    Null text gives null ids and n_ids 0, an empty text an empty array.  A very long text
    is fed to its stream in parts, all of it.  Rows are encoded on their own: repeated
    rows and null keys pass through, other columns are ignored whatever their names, and
    an empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = _with_key(rows, "ids array<int>, n_ids long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for whole in batches:
            for batch in slices(whole, "t", CHUNK_BYTES):
                texts = batch.column("t").to_pylist()
                made = codec.encode_all(texts)
                arrays, counts = _id_lists(made)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), arrays, pa.array(counts)], names=["k", "ids", "n_ids"]
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def decode(df: DataFrame, model: bytes, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """One row per sequence: ``key`` and its text.

    Null ids give a null text, no ids an empty one, however long the list.  Null and
    repeated keys pass through, other columns are ignored, empty in, empty out.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.col(ids).cast("array<int>").alias("ids"))
    schema = _with_key(rows, "text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            column = batch.column("ids")
            texts = [codec.decode(v.values.to_numpy(zero_copy_only=False).tolist()) if v.is_valid else None for v in column]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string())], names=["k", "text"])

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def round_trip(df: DataFrame, model: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass: ``key``, ids, n_ids, same (the decoded text is the input).

    A literal word mark (U+2581) in a text decodes to a space, as the format has it.
    Null text gives null ids and a null ``same``; else as :func:`encode` and :func:`decode`.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = _with_key(rows, "ids array<int>, n_ids long, same boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for whole in batches:
            for batch in slices(whole, "t", CHUNK_BYTES):
                texts = batch.column("t").to_pylist()
                made = codec.encode_all(texts)
                same = [None if t is None else codec.decode(m.tolist()) == t for t, m in zip(texts, made, strict=True)]
                arrays, counts = _id_lists(made)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k"), arrays, pa.array(counts), pa.array(same)],
                    names=["k", "ids", "n_ids", "same"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
