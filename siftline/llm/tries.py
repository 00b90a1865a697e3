"""Prefix tries of conversations, built as burst tries.

A conversation is the sequence of its turns; a *node* is a sequence of first turns that some conversation has.
All conversations begin in one container under the root.  A container of too many conversations or turns
*bursts*: its first node becomes a head of the trie, and its conversations go on to containers by their next
turn.  One aggregate bursts several levels at once, so that even long conversations with thousands of copies take few
jobs.  What remains are containers small enough for a task: their conversations are sorted by turns and
one sweep over neighbours opens and closes the nodes.  A container of one conversation is a mere chain and
needs no task at all.

Turns are told apart by 128-bit digests of role and text and nodes by 128-bit digests of their turns, so
no text is moved; a conversation of any length is read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import saved, table, tuned
from siftline.session import stored

#: Conversations and turns of a container at most, if it has more than one conversation.
MOST_CONVERSATIONS = 1000
MOST_TURNS = 50_000
#: Turns that the containers of one task have, roughly.
SHARD_TURNS = 200_000
#: Levels that the first aggregate bursts; each one after bursts twice as many.
LEVELS = 8
#: Conversation numbers hashed at a time where many end in one node.
CHUNK = 50_000

ROOT = bytes(16)
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """The digest of a turn, 16 bytes."""
    return F.unhex(F.md5(F.concat_ws(":", F.char_length(role).cast("string"), role, text)))


def numbered_turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, pos, tid, length): turns in order, numbered from 1, without their texts."""
    role_, text_ = (F.coalesce(F.col(f"`{name}`"), F.lit("")) for name in (role, text))
    rows = turns.select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), turn_digest(role_, text_).alias("tid"),
        F.char_length(text_).cast("bigint").alias("length"),
    ).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "tid")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "tid", "length")


def with_borrowed_heads(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of another one: that of the last multiple of ``every``.

    ``turns`` is (conv_id, pos, tid, length).  h is the crc32 of the decimal number modulo ``most``.  The result has a row
    of position 0 for each conversation, which holds the number of its turns in ``length``.
    """
    borrowed = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(every))
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("size")).withColumn("h", borrowed).withColumn("base", base)
    donors = turns.filter((F.col("conv_id") == base) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    lent = sizes.filter("h > 0").select("conv_id", "h", "base").join(donors, "base").filter("pos <= h").select(
        "conv_id", F.lit(1).alias("part"), "pos", "tid", "length",
    )
    kept = turns.filter(F.col("pos") > borrowed).select("conv_id", F.lit(2).alias("part"), "pos", "tid", "length")
    given = donors.groupBy("base").agg(F.max("pos").alias("given"))
    starts = sizes.join(given, "base", "left").select(
        "conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(ROOT).alias("tid"),
        (F.least("h", F.coalesce("given", F.lit(0))) + F.greatest(F.col("size") - F.col("h"), F.lit(0))).cast("bigint").alias("length"),
    )
    return starts.union(lent).union(kept)


def paths(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, tid, length, left): every node on every conversation's way; ``left`` turns follow."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, depth, total = None, ROOT, 0, 0
        for batch in batches:
            nodes, parents, depths, lengths, left = [], [], [], [], []
            for own, part, tid, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "tid", "length")), strict=True):
                if part == 0:
                    conv, node, depth, total, length, parent = own, ROOT, 0, length, 0, None
                else:
                    parent, depth = node, depth + 1
                    node = hashlib.blake2b(parent + tid, digest_size=16).digest()
                if own != conv:
                    raise RuntimeError("a conversation came without its start")
                nodes.append(node)
                parents.append(parent)
                depths.append(depth)
                lengths.append(length)
                left.append(total - depth)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(depths, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()),
                 batch.column("tid"), pa.array(lengths, pa.int64()), pa.array(left, pa.int64())],
                ["conv_id", "depth", "node", "parent", "tid", "length", "left"],
            )

    ordered = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return ordered.mapInArrow(walk, "conv_id bigint, depth bigint, node binary, parent binary, tid binary, length bigint, left bigint")


def burst(ways: DataFrame, conversations: int, turns: int) -> tuple[DataFrame, DataFrame]:
    """The heads of the trie and the containers under them.

    Heads are (node, parent, depth, length, conv_id, n_convs, n_children); containers are a row for each
    conversation that lies in one, (conv_id, node, depth, parent, n_convs, held), ``held`` being the turns of the container.
    """
    counted, placed = [], []
    low, width, active = -1, LEVELS, ways
    while True:
        level = active.filter((F.col("depth") > low) & (F.col("depth") <= low + width))
        sums = stored(level.groupBy("node").agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("first"), F.first("depth").alias("depth"),
            F.first("parent").alias("parent"), F.first("length").alias("length"), F.sum(F.col("left") + 1).alias("held"),
        ).withColumn("is_head", (F.col("depth") == 0) | ((F.col("n_convs") > 1) & (
            (F.col("n_convs") > conversations) | (F.col("held") > turns)
        ))))
        counted.append(sums)
        small = sums.filter("NOT is_head").select("node", "n_convs", "held", "parent")
        # The first node of a conversation's way that is no head is its container.
        found = stored(level.select("conv_id", "depth", "node").join(small, "node").groupBy("conv_id").agg(
            F.min_by(F.struct("node", "depth", "parent", "n_convs", "held"), "depth").alias("at"),
        ).select("conv_id", "at.*"))
        placed.append(found)
        low, width = low + width, 2 * width
        active = active.filter(F.col("depth") > low).join(found.select("conv_id"), "conv_id", "left_anti")
        if active.isEmpty():
            break
        active = stored(active)
    nodes, containers = counted[0], placed[0]
    for more in counted[1:]:
        nodes = nodes.union(more)
    for more in placed[1:]:
        containers = containers.union(more)
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    heads = saved(nodes.filter("is_head").join(children, "node", "left").select(
        "node", "parent", "depth", "length", F.col("first").alias("conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
    ))
    return heads, containers


def sweep(convs: list[tuple[tuple[bytes, ...], int, list[int]]], top: int) -> list[list]:
    """The nodes of a container, whose conversations are (turns from the container's own on, number, lengths of the turns).

    Sorted by turns, neighbours share their first ones; the open nodes are those on the way to the last conversation.  A row
    is [smallest member, depth, parent's smallest member, members, children, leaves, saved, hash of the ends]; the parent of the top
    node is None.
    """
    convs = sorted(convs)
    rows: list[list] = []
    # Of each open node: smallest member, members, children, leaves, saved, ends, rows of children that wait for the parent's number.
    open_: list[list] = []

    def close(lengths: list[int]) -> None:
        first, members, children, leaves, spared, ends, waiting = open_.pop()
        depth = len(open_)
        spared += (members - 1) * lengths[depth]
        leaves = leaves if children else 1
        ends_hash = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest() if ends else _EMPTY
        row = [first, top + depth, None, members, children, leaves, spared, ends_hash]
        rows.append(row)
        for child in waiting:
            child[2] = first
        if open_:
            above = open_[-1]
            above[0], above[1], above[2] = min(above[0], first), above[1] + members, above[2] + 1
            above[3], above[4] = above[3] + leaves, above[4] + spared
            above[6].append(row)

    last: tuple[bytes, ...] = ()
    last_lengths: list[int] = []
    for turns, number, lengths in convs:
        shared = 0
        while shared < len(last) and shared < len(turns) and last[shared] == turns[shared]:
            shared += 1
        while len(open_) > shared:
            close(last_lengths)
        for _ in range(shared, len(turns)):
            open_.append([number, 0, 0, 0, 0, [], []])
        here = open_[-1]
        here[0], here[1] = min(here[0], number), here[1] + 1
        here[5].append(number)
        last, last_lengths = turns, lengths
    while open_:
        close(last_lengths)
    return rows


def _swept(ways: DataFrame, containers: DataFrame) -> DataFrame:
    """Nodes of the containers of several conversations, with the container's ``parent`` on its top node."""
    several = containers.filter("n_convs > 1")
    total = several.agg(F.sum(F.col("held") / F.col("n_convs"))).first()[0] or 0
    shards = max(1, int(total // SHARD_TURNS) + 1)
    own = several.select("conv_id", F.col("node").alias("container"), F.col("depth").alias("top"), F.col("parent").alias("above"))
    rows = ways.select("conv_id", "depth", "tid", "length").join(own, "conv_id").filter("depth >= top").withColumn(
        "shard", F.pmod(F.xxhash64("container"), F.lit(shards)),
    )

    def nodes(found: pa.Table) -> pa.Table:
        found = found.sort_by([("container", "ascending"), ("conv_id", "ascending"), ("depth", "ascending")])
        columns = [found.column(c).to_pylist() for c in ("container", "conv_id", "depth", "tid", "length", "top", "above")]
        out, parents = [], []
        container, convs, turns, lengths = None, [], [], []
        before = top = above = None

        def finish() -> None:
            if convs:
                rows_ = sweep([(tuple(t), c, n) for t, c, n in convs], top)
                out.extend(rows_)
                parents.extend(above if row[1] == top else None for row in rows_)

        for box, conv, depth, tid, length, top_, above_ in zip(*columns, strict=True):
            if box != container:
                finish()
                container, top, above, convs, before = box, top_, above_, [], None
            if conv != before:
                turns, lengths = [], []
                convs.append((turns, conv, lengths))
                before = conv
            turns.append(tid)
            lengths.append(length)
        finish()
        names = [part.split()[0] for part in _NODE.split(", ")]
        kinds = [pa.string() if n == "ends_sha256" else pa.int64() for n in names]
        arrays = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
        return pa.table([*arrays, pa.array(parents, pa.binary())], [*names, "parent"])

    return rows.groupBy("shard").applyInArrow(nodes, f"{_NODE}, parent binary")


def _ends_of_heads(ways: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, ends_sha256) of heads in which conversations end, however many do."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held = None, None, []

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], ["node", "first", "names"],
            )

        for batch in batches:
            for own, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if own != node or len(held) >= CHUNK:
                    if held:
                        yield chunk()
                    node, first, held = own, conv, []
                held.append(str(conv))
        if held:
            yield chunk()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

        for batch in batches:
            for own, names in zip(batch.column("node").to_pylist(), batch.column("names").to_pylist(), strict=True):
                if own == node:
                    digest.update(b",")
                else:
                    if digest:
                        yield done()
                    node, digest = own, hashlib.sha256()
                digest.update(names.encode())
        if digest:
            yield done()

    ends = ways.filter(F.col("left") == 0).select("node", "conv_id").join(heads.select("node"), "node", "left_semi")
    parts = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        chunks, "node binary, first bigint, names string",
    )
    return parts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashes, "node binary, ends_sha256 string")


def trie_nodes(ways: DataFrame, most_conversations: int = MOST_CONVERSATIONS, most_turns: int = MOST_TURNS) -> DataFrame:
    """All nodes of the conversations in ``ways`` (see ``paths``); see ``prefix_trie`` for the columns."""
    heads, containers = burst(ways, most_conversations, most_turns)
    containers = stored(containers)
    swept = saved(_swept(ways, containers))
    alone = ways.join(
        containers.filter("n_convs = 1").select("conv_id", F.col("depth").alias("top")), "conv_id",
    ).filter("depth >= top").select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        (F.col("left") > 0).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("left") == 0, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
        F.when(F.col("depth") == F.col("top"), F.col("parent")).alias("parent"),
    )
    # What a head has below it: each container, as a whole, and each head, by its own turn, summed up the way of a member.
    whole = swept.filter("parent IS NOT NULL").select("conv_id", "depth", "n_leaves", "saved_tokens").union(
        alone.filter("parent IS NOT NULL").select("conv_id", "depth", "n_leaves", "saved_tokens"),
    ).union(heads.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("bigint"), (F.col("n_convs") - 1) * F.col("length"),
    )).withColumn("node", F.lit(None).cast("binary"))
    nothing = F.lit(0).cast("bigint")
    on_way = ways.join(heads.select("node"), "node", "left_semi").select("conv_id", "depth", nothing, nothing, "node")
    upward = Window.partitionBy("conv_id").orderBy(F.col("depth").desc(), F.col("node").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    below = whole.union(on_way).select(
        "node", F.sum("n_leaves").over(upward).alias("n_leaves"), F.sum("saved_tokens").over(upward).alias("saved_tokens"),
    ).filter("node IS NOT NULL").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    trunk = heads.join(below, "node").join(_ends_of_heads(ways, heads), "node", "left").select(
        "conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), "parent",
    )
    tops = swept.union(alone).union(trunk)
    above = heads.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    names = [part.split()[0] for part in _NODE.split(", ")]
    return tops.join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*names)


def prefix_trie(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuilt: bool = True, **limits: int,
) -> DataFrame:
    """The nodes of the trie of conversations.

    A node is named by its smallest member and its depth: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code
    points that need not be stored twice in its subtree), ends_sha256.  With ``rebuilt`` conversations take over the first turns of others, see
    ``with_borrowed_heads``.

    Turns are ordered by ``turn``, null first; equal ones by the digest of role and text, so repeated rows are turns of their own.
    Null roles and texts are empty, rows without a conversation number belong to none and are left out, other columns are
    ignored.  An empty table has no nodes, not even a root.  ``limits`` are ``most_conversations`` and ``most_turns`` of a container.
    """
    tuned(turns.sparkSession)
    rows = stored(numbered_turns(turns, conv_id, turn, role, text))
    if rebuilt:
        whole = with_borrowed_heads(rows)
    else:
        starts = rows.groupBy("conv_id").agg(F.max("pos").alias("size")).select(
            "conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(ROOT).alias("tid"), F.col("size").cast("bigint").alias("length"),
        )
        whole = starts.union(rows.select("conv_id", F.lit(1).alias("part"), "pos", "tid", "length"))
    return trie_nodes(stored(paths(whole)), **limits)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
