"""A prefix trie of conversations, built level by level and rolled up in reverse.

A depth groups the conversations that are still live by (node, digest of the next turn):
one partial aggregate names the child by its smallest conversation and counts its members,
and a join hands that name to them.  A conversation lives while it shares its node; what is
left of one that is alone is a chain that needs no further round, so rounds grow with the
longest shared prefix and not with the longest conversation.  The way back joins each
level's children to their parents, sums what lies below, and writes a table for each level.

Digests are SHA-256 of role and text, so no text is shuffled.  A popular turn or node only
meets in partial aggregates and in joins against a table with one row for each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.llm.ordered_runs import changes, numbered
from weftmark.plans.shared import discard, materialize

#: Bytes of joined ids in one row between the two passes of a digest over all members.
PIECE_BYTES = 64 << 10
NOBODY = hashlib.sha256(b"").hexdigest()


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, p, g, bytes): turns numbered from 1 within their conversation, as digest and UTF-8 size of the text.

    Turns are ordered by ``turn``, null first, and equal ones by their digest; null role or
    text becomes empty; rows without a conversation are left out.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("o"), F.unhex(F.sha2(whole, 256)).alias("g"), F.octet_length(text_).cast("long").alias("bytes")
    )
    return numbered(rows, "c", [F.col("o").asc_nulls_first(), F.col("g")]).select("c", "p", "g", "bytes")


def rebuilt_turns(turns: DataFrame, convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Turns of every conversation c after its first h were exchanged for those of c - c % ``group``.

    h is crc32 of the decimal c modulo ``most``.  The head has fewer turns if the other
    conversation has, none if there is none; the tail begins after c's own first h.
    """
    head = (F.crc32(F.col("c").cast("string").cast("binary")) % most).alias("h")
    heads = convs.select("c", (F.col("c") - F.col("c") % group).alias("b"), head).where("h > 0")
    lent = turns.where((F.col("p") < most) & (F.col("c") % group == 0)).withColumnRenamed("c", "b")
    front = heads.join(lent, "b").where("p <= h").select("c", "p", "g", "bytes")
    own = turns.select("*", head)
    long_ = lent.groupBy("b").agg(F.max("p").alias("m"))
    tail = own.where("p > h").withColumn("b", F.col("c") - F.col("c") % group).join(long_, "b", "left")
    place = F.least("h", F.coalesce("m", F.lit(0))) + F.col("p") - F.col("h")
    return front.unionAll(tail.select("c", place.alias("p"), "g", "bytes"))


def _joined_digest(members: DataFrame) -> DataFrame:
    """(depth, node, ends): SHA-256 of each node's ids, ascending and joined by commas.

    Ids are sorted by ranges of (depth, node, id), so that many tasks share the members of a
    popular node, and each task joins its ids to pieces of 64 KB.  The second pass feeds the
    pieces of a node in order to one running digest, a batch at a time.
    """
    order = ["depth", "node", "c"]
    dealt = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = (changes(batch.column("depth")) | changes(batch.column("node"))).nonzero()[0].tolist()
            ids = [str(v) for v in batch.column("c").to_pylist()]
            rows: list[tuple] = []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                depth, node = batch.column("depth")[a].as_py(), batch.column("node")[a].as_py()
                step = max(1, PIECE_BYTES // 20)
                rows += [(depth, node, int(ids[i]), ",".join(ids[i : min(b, i + step)])) for i in range(a, b, step)]
            depth, node, first, piece = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(depth, pa.int32()), pa.array(node, pa.int64()), pa.array(first, pa.int64()), pa.array(piece)],
                names=["depth", "node", "first", "piece"],
            )

    cut = dealt.mapInArrow(pieces, "depth int, node long, first long, piece string")
    met = cut.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for batch in batches:
            done = []
            for depth, node, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "piece")), strict=True):
                if (depth, node) != at:
                    if at is not None:
                        done.append((*at, running.hexdigest()))
                    at, running = (depth, node), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(piece.encode())
            yield _digests(done)
        if at is not None:
            yield _digests([(*at, running.hexdigest())])

    return met.mapInArrow(digest, "depth int, node long, ends string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    depth, node, ends = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(depth, pa.int32()), pa.array(node, pa.int64()), pa.array(ends, pa.string())], names=["depth", "node", "ends"]
    )


def _id_digest(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations, the textless root included.

    ``turns`` has (c, p, g, bytes), p from 1 without gaps; ``convs`` every c once, also
    those without turns.  Columns: conv_id (smallest member), depth, parent_conv_id (null at
    the root), n_convs, n_children, n_leaves (childless nodes of the subtree),
    saved_tokens ((n_convs - 1) * bytes of a node's last text, over the subtree) and
    ends_sha256 (of the ids of members that end there).  Without conversations there is no row.
    """
    spark = turns.sparkSession
    turns = materialize(turns.repartitionByRange("p", "c").sortWithinPartitions("p", "c"), "trie-turns")
    top = convs.agg(F.min("c").alias("node"), F.count(F.lit(1)).alias("n")).collect()[0]
    schema = "node long, parent long, n long, bytes long"
    levels = [spark.createDataFrame([(top["node"], None, top["n"], 0)] if top["n"] else [], schema)]
    live = convs.select("c", F.lit(top["node"]).cast("long").alias("node")) if top["n"] > 1 else convs.select("c", F.lit(0).cast("long").alias("node")).limit(0)
    live = materialize(live, "trie-live")
    ended, steps, names = [], [], []
    while not live.isEmpty():
        depth = len(levels)
        ahead = turns.where(F.col("p") == depth).select("c", "g", "bytes")
        step = materialize(live.join(ahead, "c", "left").select("c", "node", "g", "bytes"), "trie-step")
        discard(live)
        ended.append(step.where("g is null").select(F.lit(depth - 1).alias("depth"), "node", "c"))
        named = step.where("g is not null").groupBy("node", "g").agg(F.min("c").alias("child"), F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"))
        named = materialize(named, "trie-named")
        steps.append(step)
        names.append(named)
        levels.append(named.select(F.col("child").alias("node"), F.col("node").alias("parent"), "n", "bytes"))
        shared = named.where("n > 1").select("node", "g", "child")
        live = materialize(step.join(shared, ["node", "g"]).select("c", F.col("child").alias("node")), "trie-live")

    discard(live)

    shapes = ["leaves", "saved", "children"]
    below = None
    rolled = []
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth].where("n > 1")
        if below is None:
            here = here.select("*", *[F.lit(None).cast("long").alias(c) for c in shapes])
        else:
            here = here.join(below, "node", "left")
        own = (F.col("n") - 1) * F.col("bytes")
        full = here.select(
            "node", "parent", "n", F.lit(depth).alias("depth"), F.coalesce("children", F.lit(0)).alias("children"),
            F.coalesce("leaves", F.lit(1)).alias("leaves"), (own + F.coalesce("saved", F.lit(0))).alias("saved"),
        )
        full = materialize(full, "trie-rolled")
        rolled.append(full)
        if depth:
            alone = levels[depth].where("n = 1").select("parent", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
            both = full.select("parent", "leaves", "saved").unionAll(alone)
            below = both.groupBy(F.col("parent").alias("node")).agg(
                F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("children")
            )

    shared = rolled[0]
    for full in rolled[1:]:
        shared = shared.unionAll(full)
    ends = ended[0] if ended else spark.createDataFrame([], "depth int, node long, c long")
    for more in ended[1:]:
        ends = ends.unionAll(more)
    digests = materialize(_joined_digest(ends), "trie-ends")
    for step in steps:
        discard(step)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    popular = shared.join(digests, ["depth", "node"], "left").select(
        F.col("node").alias("conv_id"), F.col("depth").cast("long"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )
    popular = materialize(popular.select(*columns), "trie-popular")

    starts = None
    for depth, level in enumerate(levels):
        single = level.where("n = 1").select(F.col("node").alias("c"), F.lit(depth).cast("long").alias("s"), "parent")
        starts = single if starts is None else starts.unionAll(single)
    sizes = turns.groupBy("c").agg(F.max("p").alias("len"))
    starts = materialize(starts.join(sizes, "c", "left").select("c", "s", "parent", F.coalesce("len", F.lit(0)).alias("len")), "trie-alone")
    for done in (*names, *rolled, digests):
        discard(done)
    places = turns.select("c", "p").unionAll(starts.where("s = 0").select("c", F.lit(0).cast("long").alias("p")))
    chain = places.join(starts, "c").where("p >= s").select(
        F.col("c").alias("conv_id"), F.col("p").alias("depth"), F.when(F.col("p") == F.col("s"), F.col("parent")).otherwise(F.col("c")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(F.col("p") < F.col("len"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("p") == F.col("len"), _id_digest(F.col("c"))).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
    )
    return popular.unionAll(chain.select(*columns))


def conversation_trie(df: DataFrame, group: int = 5, most: int = 9, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of all conversations after :func:`rebuilt_turns`, one row per node as in :func:`prefix_trie`.

    Null role or text becomes empty, a null turn comes first, and of turns with the same
    number (repeated rows among them) the smaller SHA-256 of role and text is first.  Rows
    with a null conversation are left out.  Very long texts are digested whole; a very long
    conversation may fill many tasks.  Other columns are ignored whatever their names; an
    empty table gives an empty result.
    """
    turns = turns_of(df, conv, turn, role, text)
    convs = materialize(turns.where("p = 1").select("c"), "trie-convs")
    return prefix_trie(rebuilt_turns(turns, convs, group, most), convs)
