"""N-gram Jaccard join: prefix filters find what may link, tries find what links.

Texts become sets of 64-bit hashes of word shingles; equal sets are one class.  A pair
of similarity s shares a token among the first size - ceil(s * size) + 1 of each set, in
any global order.  The order here takes tokens that no other set has first:

1. tokens in the lower part of the hash space are counted; a set with enough tokens
   that nothing else has can link with nothing and leaves (most sets do);
2. all tokens of the remaining classes are counted among themselves, and each set
   posts its prefix: tokens of its own (not posted), then ever more frequent ones, so
   that passages which many documents share do not join their groups;
3. sets that share a posted token form coarse groups (a superset of the answer);
   each class goes once to the task of its group, where a trie joins the sets.  Only
   the sets that step 1 left are ever written or shuffled;
4. a group over the token limit is cut by size class and hash into blocks.  Each block
   is joined with a few sets of the whole group first, which connects groups of near
   copies; only if more than one component is left are pairs of blocks compared.

Components need no pair inside a component twice, so no group's pairs are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmark.llm.bitsets import broadcast_bits
from weftmark.llm.components import components
from weftmark.llm.texts import Bits, Words, bounded_batches, slices, words_of
from weftmark.llm.tries import link
from weftmark.plans.shared import discard, materialize

#: Part of the hash space counted in step 1, for all documents.
COUNTED = 0.4
COUNTED_BELOW = np.uint64(int(COUNTED * 2**64))
#: The order of tokens: by how many of these counts they reach (then by hash), each told by a bit set.
GRADES = (2, 3, 5, 9, 33, 129)
#: Tokens that one task joins at a time, and sets of a large group that visit all its blocks.
BLOCK_TOKENS, LEADERS = 1_500_000, 8
#: Classes and tokens that a map task remembers having posted.
REMEMBERED = 1 << 18


def prefix_length(size: np.ndarray, share: tuple[int, int] = (3, 4)) -> np.ndarray:
    """Tokens of a set of which a set at similarity ``share`` must have one."""
    return size - (size * share[0] + share[1] - 1) // share[1] + 1


class Sets:
    """Token sets of consecutive documents: tokens in order, their documents, and bounds."""

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, docs: int):
        self.tokens, self.owner = tokens, owner
        self.first = np.searchsorted(owner, np.arange(docs + 1))
        self.size = np.diff(self.first)

    @classmethod
    def of_words(cls, words: Words, n: int) -> Sets:
        """Distinct shingle hashes of each document."""
        docs = len(words.first) - 1
        hashes, valid = words.windows(n)
        counts = np.diff(words.first)
        owner = np.repeat(np.arange(docs), counts)[valid]
        hashes = hashes[valid]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):  # fewer words than a shingle: the whole sequence is one
            whole = [
                hashlib.blake2b(words.hashes[words.first[d] : words.first[d + 1]].tobytes(), digest_size=8, person=b"short")
                for d in short
            ]
            hashes = np.concatenate([hashes, np.frombuffer(b"".join(w.digest() for w in whole), dtype=np.uint64)])
            owner = np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
        ends = np.searchsorted(owner, np.arange(docs + 1)).tolist()
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            hashes[low:high].sort()
        keep = np.ones(len(hashes), dtype=bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        return cls(hashes[keep], owner[keep], docs)

    @classmethod
    def of_lists(cls, lists: pa.ListArray) -> Sets:
        """Sets that were written as lists of sorted tokens."""
        lists = pa.array(lists) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return cls(tokens, np.repeat(np.arange(len(lists)), sizes), len(lists))

    def of(self, d: int) -> np.ndarray:
        return self.tokens[self.first[d] : self.first[d + 1]]

    def classes(self) -> np.ndarray:
        """A 64-bit name of each document's set."""
        names = [hashlib.blake2b(self.of(d).tobytes(), digest_size=8).digest() for d in range(len(self.size))]
        return np.frombuffer(b"".join(names), dtype=np.int64)

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Number of true flags (one per token) in each document."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.first[1:]] - total[self.first[:-1]]


def _batches(
    batches: Iterator[pa.RecordBatch], n: int, field: str | None = None
) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    """Parts of batches with their sets; the text is column t, or a field of the struct r."""
    for whole in batches:
        if field is not None:
            whole = whole.append_column("t", pc.struct_field(whole.column("r"), field))
        for batch in slices(whole, "t"):
            yield batch, Sets.of_words(words_of(batch.column("t"), lower=True), n)


def _new_only(names: np.ndarray, seen: set[int]) -> np.ndarray:
    """Mask of the first document of each class in this task, as far as it remembers."""
    keep = np.zeros(len(names), dtype=bool)
    for d, name in enumerate(names.tolist()):
        if name not in seen:
            keep[d] = True
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(name)
    return keep


def _count(batch_sets: Sets, chosen: np.ndarray) -> pa.RecordBatch:
    """Chosen tokens of a part with the number of sets that have them, 1 or many."""
    tokens, n = np.unique(batch_sets.tokens[chosen], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _blocks(schema_batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """Rows of each task key of a partition that is sorted by it."""
    key, rows = None, {"c": [], "n": [], "s": [], "label": [], "side": []}
    for batch in schema_batches:
        keys = batch.column("task").to_numpy(zero_copy_only=False)
        offsets = batch.column("s").offsets.to_numpy()
        flat = batch.column("s").values.to_numpy(zero_copy_only=False)
        columns = {x: batch.column(x).to_pylist() for x in ("c", "n", "label", "side")}
        for i in range(batch.num_rows):
            if key is not None and keys[i] != key:
                yield key, rows
                rows = {x: [] for x in rows}
            key = keys[i]
            if not (rows["c"] and rows["c"][-1] == columns["c"][i]):  # copies come next to each other
                for x, values in columns.items():
                    rows[x].append(values[i])
                rows["s"].append(flat[offsets[i] : offsets[i + 1]].copy())
    if key is not None:
        yield key, rows


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _blocks(batches):
        sides = np.array(rows["side"])
        found = link(
            np.array(rows["c"], dtype=np.int64),
            np.array(rows["n"], dtype=np.int64),
            rows["s"],
            np.array(rows["label"], dtype=np.int64) if rows["label"][0] is not None else None,
            sides if (sides == 1).any() else None,
        )
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _low_bits(rows: DataFrame, width: int):
    """Step 1: tokens of the lower part of the hash space that more than one set has."""

    def count(batches):
        seen: set[int] = set()
        for _, sets in _batches(batches, width):
            new = _new_only(sets.classes(), seen)
            yield _count(sets, (sets.tokens < COUNTED_BELOW) & new[sets.owner])

    counts = rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    shared = materialize(counts.where("n > 1").select("h"), "jaccard-counted")
    bits = broadcast_bits(shared, "h")
    discard(shared)
    return bits


def _distinct_sets(sets: DataFrame) -> DataFrame:
    """One row per class of (c, n, s); a class comes at most once from each map task before."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def first_of_each(batches):
        seen: set[int] = set()
        for batch in batches:
            names = batch.column("c").to_pylist()
            keep = [name not in seen and not seen.add(name) for name in names]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return materialize(sets.repartition(parts, "c").mapInArrow(first_of_each, sets.schema), "jaccard-open")


def _edges(sets: DataFrame) -> DataFrame:
    """Steps 2 and 3: pairs (a, b) of classes of the table (c, s) that put all that may link in one group."""

    def count(batches):
        for batch in batches:
            part = Sets.of_lists(batch.column("s"))
            yield _count(part, np.ones(len(part.tokens), dtype=bool))

    counts = sets.select("s").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    counts = materialize(counts, "jaccard-repeated")
    grades = [broadcast_bits(counts.where(F.col("n") >= least).select("h"), "h") for least in GRADES]
    discard(counts)

    def prefixes(batches):
        """(h, c, hub, edge): a posting, or an edge that this task knows already."""
        posted: dict[int, int] = {}
        levels = [Bits(g.value) for g in grades]
        for batch in batches:
            part = Sets.of_lists(batch.column("s"))
            names = batch.column("c").to_numpy(zero_copy_only=False)
            tokens, owner = part.tokens, part.owner
            grade = levels[0].has(tokens).astype(np.int8)
            for level in levels[1:]:
                grade += grade.astype(bool) & level.has(tokens)
            order = np.lexsort((tokens, grade, owner))
            tokens, owner, grade = tokens[order], owner[order], grade[order]
            inside = np.arange(len(owner)) - part.first[owner] < prefix_length(part.size[owner])
            take = inside & (grade > 0)
            h, c = tokens[take].view(np.int64), names[owner[take]]
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            first = np.ones(len(h), dtype=bool)
            first[1:] = h[1:] != h[:-1]
            hub = c[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))] if len(h) else c.copy()
            settled = ~first
            twice = np.zeros(len(h), dtype=bool)
            twice[:-1] = first[:-1] & ~first[1:]
            if posted:
                for i in np.flatnonzero(first).tolist():
                    known = posted.get(int(h[i]))
                    if known is not None:
                        settled[i], hub[i] = True, known
            if len(posted) < REMEMBERED:
                for i in np.flatnonzero(twice & ~settled).tolist():
                    posted[int(h[i])] = int(c[i])
            a, b = c[settled], hub[settled]
            pair = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            pair = pair[pair[:, 0] != pair[:, 1]]
            left = ~settled
            edge = np.repeat([False, True], [left.sum(), len(pair)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h[left], pair[:, 1]])),  # an edge is dealt out by its hub
                    pa.array(np.concatenate([c[left], pair[:, 0]])),
                    pa.array(np.concatenate([c[left], pair[:, 1]])),
                    pa.array(edge),
                ],
                names=["h", "c", "hub", "edge"],
            )

    posts = materialize(sets.select("c", "s").mapInArrow(prefixes, "h long, c long, hub long, edge boolean"), "jaccard-posts")
    known = posts.where("edge").select(F.col("c").alias("a"), F.col("hub").alias("b"))
    # a token's classes all meet its least one, which partial minima find
    open_ = posts.where("not edge")
    least = open_.groupBy("h").agg(F.min("c").alias("b"), F.max("c").alias("most")).where("b < most").select("h", "b")
    met = open_.join(least, "h").select(F.col("c").alias("a"), "b").where("a != b")
    edges = materialize(known.unionAll(met).distinct(), "jaccard-edges")
    discard(posts)
    return edges


def _tries(sets: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the sets (c, n, s) that a plan (task, c, label, side) sends to each task."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = sets.join(plan, "c").select("task", "c", "n", "s", "label", "side").repartition(parts, "task")
    links = tasks.sortWithinPartitions("task", "c").mapInArrow(_join_blocks, "a long, b long")
    return materialize(links, "jaccard-links")


def _links(sets: DataFrame) -> DataFrame:
    """Verified links (a, b) between the classes of (c, n, s) that connect all similar ones."""
    edges = _edges(sets)
    groups = components(edges).select(F.col("node").alias("c"), F.col("label").alias("g"))
    discard(edges)
    members = materialize(sets.select("c", "n").join(groups, "c"), "jaccard-members")
    wanted = broadcast_bits(members, "c")

    def pick(batches):
        bits = Bits(wanted.value)
        for batch in batches:
            c = batch.column("c").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(bits.has(c)))

    sets = sets.mapInArrow(pick, sets.schema)
    none, left_side = F.lit(None).cast("long").alias("label"), F.lit(0).alias("side")
    total = members.groupBy("g").agg(F.sum("n").alias("tokens"))
    large = materialize(total.where(F.col("tokens") > BLOCK_TOKENS).select("g"), "jaccard-large")
    whole = members.join(large, "g", "left_anti").select(F.col("g").alias("task"), "c", none, left_side)
    if large.isEmpty():
        return _tries(sets, whole)

    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(4 / 3))) + 1e-9).cast("int")
    big = members.join(large, "g", "left_semi").withColumn("z", size_class)
    shape = big.groupBy("g", "z").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS / 2)).cast("long").alias("blocks"))
    blocks = materialize(shape, "jaccard-blocks")
    big = big.join(blocks, ["g", "z"]).withColumn("r", F.pmod(F.xxhash64("c"), F.col("blocks")))
    big = materialize(big.drop("blocks"), "jaccard-big")
    own = big.select(F.xxhash64("g", "z", "r").alias("task"), "c", none, left_side)
    # leaders: the classes with the least hash under each of a few seeds, found by partial minima
    least = [F.min(F.struct(F.xxhash64("c", F.lit(i)), "c"))["c"] for i in range(LEADERS)]
    lead = big.groupBy("g", "z").agg(F.array_distinct(F.array(*least)).alias("cs"))
    lead = lead.select("g", F.col("z").alias("z1"), F.explode("cs").alias("c")).join(blocks, "g")
    lead = lead.where("z between z1 - 1 and z1 + 1").withColumn(
        "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    visit = lead.select(F.xxhash64("g", "z", "r").alias("task"), "c", none, left_side)
    first = _tries(sets, whole.unionAll(own.unionAll(visit).distinct()))

    labels = components(first).select(F.col("node").alias("c"), "label")
    marked = big.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    marked = materialize(marked, "jaccard-marked")
    apart = marked.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("g")
    apart = materialize(apart, "jaccard-apart")
    if apart.isEmpty():
        return first
    rest = marked.join(apart, "g", "left_semi")
    # block (z, r) meets every later block of its size class and every block of the next
    mate = blocks.select("g", F.col("z").alias("z2"), F.col("blocks").alias("blocks2"))
    pairs = blocks.join(mate, "g").where("z2 = z or z2 = z + 1")
    pairs = pairs.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumn("r2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks2") - 1)))
    pairs = pairs.where("z2 > z or r2 > r").select("g", "z", "r", "z2", "r2", F.xxhash64("g", "z", "r", "z2", "r2").alias("task"))
    here = rest.join(pairs, ["g", "z", "r"]).select("task", "c", "label", left_side)
    there = rest.select("g", F.col("z").alias("z2"), F.col("r").alias("r2"), "c", "label").join(pairs, ["g", "z2", "r2"])
    there = there.select("task", "c", "label", F.lit(1).alias("side"))
    return first.unionAll(_tries(sets, here.unionAll(there)))


def _classified(df: DataFrame, n: int, text: str, key: str, carry: bool) -> tuple[DataFrame, DataFrame]:
    """(rows k, row, n_shingles, c and the carried r; classes with their component)."""
    bounded_batches(df.sparkSession)
    whole = [F.struct(*[F.col(c) for c in df.columns]).alias("r")] if carry else []
    texts = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    low = _low_bits(texts.select("t"), n)
    # a carried row has its text in it: the text does not travel beside it
    inside = carry and dict(df.dtypes)[text] == "string"
    rows = df.select(F.col(key).alias("k"), *([] if inside else [F.col(text).cast("string").alias("t")]), *whole)
    kept = [x for x in rows.columns if x != "t"]
    made = T.StructType.fromDDL("n_shingles long, c long, s array<long>")
    kind = T.StructType([*rows.select(*kept).schema.fields, *made.fields])

    def describe(batches):
        """Every row with its class, and with its set where a class first comes up that may link."""
        seen: set[int] = set()
        bits = Bits(low.value)
        for batch, sets in _batches(batches, n, text if inside else None):
            names = sets.classes()
            counted = sets.tokens < COUNTED_BELOW
            alone = np.zeros(len(counted), dtype=bool)
            alone[counted] = ~bits.has(sets.tokens[counted])
            left = (sets.size > 0) & (sets.per_document(alone) < prefix_length(sets.size))
            left &= _new_only(names, seen)
            tokens = sets.tokens[left[sets.owner]].view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(left, sets.size, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens), mask=pa.array(~left))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in kept], pa.array(sets.size.astype(np.int64)), pa.array(names, mask=sets.size == 0), lists],
                names=[*kept, "n_shingles", "c", "s"],
            )

    described = materialize(
        rows.mapInArrow(describe, kind).withColumn("row", F.monotonically_increasing_id()), "jaccard-documents"
    )
    sets = _distinct_sets(described.where("s is not null").select("c", F.col("n_shingles").alias("n"), "s"))
    labels = components(_links(sets))
    first = F.min(F.struct(F.col("k").isNull().alias("z"), "k", "row")).alias("first")
    classes = described.where("c is not null").groupBy("c").agg(first, F.count(F.lit(1)).alias("copies"))
    labelled = classes.join(labels.select(F.col("node").alias("c"), "label"), "c", "left").withColumn(
        "label", F.coalesce("label", "c")
    )
    labelled = materialize(labelled, "jaccard-classes")
    tops = labelled.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("members"))
    # classes that stand alone with one document need no row
    found = labelled.drop("first").join(tops.where("members > 1"), "label").select("c", "first", "members")
    found = materialize(found, "jaccard-components")
    discard(sets)  # the components are written; no plan that is left reads the sets
    return described.drop("s"), found


def jaccard_components(
    df: DataFrame, n: int = 5, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id, component_size, kept.

    Words are lower-cased (A-Z).  Documents link when the Jaccard similarity of their
    sets of ``n``-word shingles is at least 0.75; ``component_id`` is the smallest key
    reachable by links.  A text with fewer words than ``n`` is one shingle as a whole.
    Null, empty and blank texts have no shingles and link with nothing, not even each
    other.  A null key sorts after every other (a component of null keys has a null
    id).  One row per component is ``kept``: its smallest key, and of rows that repeat
    that key the one read first.  Other columns are ignored whatever their names; an
    empty table gives an empty result.
    """
    described, found = _classified(df, n, text, key, carry=False)
    joined = described.join(found, "c", "left")
    alone = F.col("members").isNull()
    return joined.select(
        F.col("k").alias(key),
        "n_shingles",
        F.when(alone, F.col("k")).otherwise(F.col("first.k")).alias("component_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("component_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
    )


def drop_near_duplicates(df: DataFrame, n: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The input rows that :func:`jaccard_components` keeps, with all their columns.

    Only rows whose class is in a component of two or more are joined; which these may
    be is told by a bit set of fixed size.
    """
    described, found = _classified(df, n, text, key, carry=True)
    touched = broadcast_bits(found, "c")
    bits_of = described.schema

    def pick(inside: bool):
        def run(batches):
            bits = Bits(touched.value)
            for batch in batches:
                c = batch.column("c").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                some = batch.column("c").is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array((bits.has(c.view(np.uint64)) & some) == inside))

        return run

    alone = described.mapInArrow(pick(False), bits_of).select("r.*")
    joined = described.mapInArrow(pick(True), bits_of).join(found, "c", "left")
    kept = joined.where(F.col("members").isNull() | (F.col("row") == F.col("first.row"))).select("r.*")
    return alone.unionAll(kept)
