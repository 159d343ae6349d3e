"""The trie of conversations that share first turns, from radix trees over fixed-width turn ids.

A turn's id is the 16-byte digest of its role and text, and a conversation is the string of its turns' ids.  The strings are range
partitioned and sorted, so a task reads neighbours; it builds an adaptive radix tree for each chunk of CHUNK of them and emits a trie node at every
depth that is a multiple of the width.  A node can reach into other chunks only if the first or the last string of its chunk begins
with it.  Those border nodes, two paths a chunk, are summed over all chunks; all others are final where they were made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occura.llm.common import Workspace, lookup, materialize, small_batches, task
from occura.llm.radix import Tree

#: Bytes of a turn's id; conversations of one radix tree, and bytes of their ids.
WIDTH, CHUNK, CHUNK_BYTES = 16, 20_000, 16 << 20
#: Conversations that borrow from one, and first turns that are borrowed at most, less one.
FAMILY, BORROWED = 100, 6

_NODE = "chunk bigint, side int, depth int, node binary, parent binary, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, tokens bigint, once bigint, own bigint, ends string, parent_conv_id bigint"


class Frame:
    """An open trie node: what is known of its subtree so far."""

    __slots__ = ("children", "depth", "ends", "first", "leaves", "least", "once", "own", "tokens")

    def __init__(self, depth: int, first: int, own: int):
        self.depth, self.first, self.own = depth, first, own
        self.least, self.ends, self.children, self.leaves, self.tokens, self.once = None, [], 0, 0, 0, 0


def chunk_nodes(keys: list[bytes], ids: list[int], sizes: list[list[int]]) -> Iterator[tuple]:
    """(frame, members, is on the first path, is on the last path, parent) of every node of sorted keys, children first.

    ``tokens`` of a frame sums members times code points over its subtree, ``once`` the code points of nodes that are no border nodes; ``children``
    and ``leaves`` count no border nodes either.
    """
    tree = Tree()
    for k, key in enumerate(keys):
        tree.insert(key, k)
    n, done = len(keys), 0
    frames = [Frame(0, 0, 0)]

    def close() -> tuple:
        frame = frames.pop()
        members = done - frame.first
        start, end = frame.first == 0, done == n
        border = start or end
        frame.tokens += members * frame.own
        if not border:
            frame.once += frame.own
            frame.leaves += not frame.children
        if frames:
            above = frames[-1]
            above.least = frame.least if above.least is None else min(above.least, frame.least)
            above.children += not border
            above.leaves, above.tokens, above.once = above.leaves + frame.leaves, above.tokens + frame.tokens, above.once + frame.once
        return frame, members, start, end, frames[-1] if frames else None

    for node, depth, down in tree.walk():
        if down:
            while (frames[-1].depth + 1) * WIDTH <= depth:
                d = frames[-1].depth + 1
                frames.append(Frame(d, done, sizes[done][d - 1]))  # the next key in order has this path
            for k in node.values:
                frame = frames[-1]
                frame.ends.append(ids[k])
                frame.least = ids[k] if frame.least is None else min(frame.least, ids[k])
                done += 1
        else:
            # nodes that end within this radix node's path, deepest first
            upper = depth - len(node.prefix) - (node is not tree.root)
            while frames[-1].depth and frames[-1].depth * WIDTH > upper:
                yield close()
    yield close()


def _paths(key: bytes) -> list[bytes]:
    """A digest of every whole-turn beginning of a key, the empty one included."""
    running = hashlib.blake2b(digest_size=16)
    found = [running.digest()]
    for at in range(0, len(key), WIDTH):
        running.update(key[at : at + WIDTH])
        found.append(running.copy().digest())
    return found


def sha_of(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def _grown(convs: DataFrame, most: int) -> DataFrame:
    """Rows of all trie nodes of sorted (key, conv_id, sizes) rows: final ones (side null) and parts of border nodes by chunk and side.

    A border node of both sides has its numbers on side 0 and only its place on side 1.
    """

    def chunk(keys: list[bytes], ids: list[int], sizes: list[list[int]], number: int) -> pa.RecordBatch:
        paths = {0: _paths(keys[0]), 1: _paths(keys[-1])}
        rows: list[tuple] = []
        waiting: dict[int, list[int]] = {}  # final nodes by the depth of their open parent
        for frame, members, start, end, parent in chunk_nodes(keys, ids, sizes):
            mine = waiting.pop(frame.depth, [])
            up = None if parent is None else frame.depth - 1
            if not (start or end):
                for at in mine:
                    rows[at][13] = frame.least
                waiting.setdefault(up, []).append(len(rows))
                rows.append([None, None, frame.depth, None, None, frame.least, members, frame.children, frame.leaves, frame.tokens, frame.once, None, sha_of(frame.ends), None])
                continue
            side = 0 if start else 1
            own = paths[side]
            for at in mine:
                rows[at][4] = own[frame.depth]
            ends = ",".join(map(str, sorted(frame.ends))) if frame.ends else None
            rows.append([number, side, frame.depth, own[frame.depth], own[up] if up is not None else None, frame.least, members, frame.children, frame.leaves, frame.tokens, frame.once, frame.own, ends, None])
            if start and end:
                rows.append([number, 1, *rows[-1][2:5], frame.least, 0, 0, 0, 0, 0, frame.own, None, None])
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    fields = [f.split() for f in _NODE.split(", ")]
    names, kinds = [f[0] for f in fields], [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[f[1]] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, sizes, room, number = [], [], [], CHUNK_BYTES, None
        for batch in batches:
            for key, conv, size, part in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "sizes", "part")), strict=True):
                if number is None:
                    number = part << 32
                keys.append(key)
                ids.append(conv)
                sizes.append(size)
                room -= len(key)
                if len(keys) == most or room <= 0:
                    yield chunk(keys, ids, sizes, number)
                    keys, ids, sizes, room, number = [], [], [], CHUNK_BYTES, number + 1
        if keys:
            yield chunk(keys, ids, sizes, number)

    return convs.mapInArrow(task(run), _NODE)


def _hashed(ends: DataFrame) -> DataFrame:
    """(node, sha) of rows (node, first, ends): the texts of a node in the order of ``first``, joined by commas and hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            found = []
            for own, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if own != node:
                    if node is not None:
                        found.append((node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], ["node", "sha"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["node", "sha"])

    return ends.repartition("node").sortWithinPartitions("node", "first").select("node", "ends").mapInArrow(task(run), "node binary, sha string")


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with each conversation's (turn, id, size) in order; null role and text count as empty ones."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("id"), F.char_length(text).cast("int").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def borrowed(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % BORROWED).cast("int")


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, turns) with the first turns of each conversation taken from the first conversation of its family."""
    heads = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, BORROWED - 1).alias("lent"))
    h = borrowed(F.col("conv_id"))
    rows = convs.withColumns({"head": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": h})
    lent = F.coalesce(F.filter(F.col("lent"), lambda _, k: k < F.col("h")), F.filter(F.col("turns"), lambda _, k: k < 0))
    own = F.filter(F.col("turns"), lambda _, k: k >= F.col("h"))
    return rows.join(heads, "head", "left").select("conv_id", F.concat(lent, own).alias("turns"))


def conversation_trie(conversations: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """A row for every node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first; of turns that tie, and of repeated rows, each stays, in the order of their ids (digests of role and
    text).  A null role or text is empty.  Rows without a conv_id belong to no conversation.  The first h turns of conversation c come from c - c % 100, h = crc32(c) % 6;
    conversations left without a turn end at the root.  An empty table has no nodes, not even a root.  Other columns are not read.

    Turn ids are 128-bit digests.  Conversations of any number can be equal or share first turns: they are dealt by (key, conv_id), and meet again
    as one row a chunk.  The ids, not the texts, of one conversation, 20 bytes a turn, are one value in a task; the ids of one node's ends stream through the
    task that hashes them, one text for each chunk.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    work = Workspace(spark, "prefixes")
    convs = work.materialize(turn_ids(conversations), "turns")
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    keyed = work.materialize(rebuilt(convs).select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "keys")
    placed = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    nodes = work.materialize(_grown(placed, chunk), "nodes")

    border = nodes.filter("side is not null")
    whole = border.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("own").alias("own"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "tokens", "once")), F.min(F.struct("chunk", "side")).alias("owner"),
    )
    whole = work.materialize(whole, "border")
    kids = whole.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    whole = work.materialize(whole.join(kids, "node", "left").withColumn("kids", F.coalesce("kids", F.lit(0)) + F.col("n_children")), "children")
    # a node counts once, on the path that owns it; what lies below a path's node is on the same path
    path = Window.partitionBy("chunk", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    placed = border.select("chunk", "side", "depth", "node").join(whole.select("node", "owner", "own", "kids"), "node")
    mine = F.col("owner") == F.struct("chunk", "side")
    below = placed.select("node", F.sum(F.when(mine, F.col("own")).otherwise(0)).over(path).alias("below"), F.sum((mine & (F.col("kids") == 0)).cast("long")).over(path).alias("leaves")).groupBy("node").agg(F.sum("below").alias("below"), F.sum("leaves").alias("leaves"))
    least = lambda column: whole.select(F.col("node").alias(column), F.col("conv_id").alias("least"))
    ends = _hashed(border.filter("ends is not null").select("node", F.col("conv_id").alias("chunk_least"), F.split_part("ends", F.lit(","), F.lit(1)).cast("long").alias("first"), "ends"))
    of_border = whole.join(below, "node").join(ends, "node", "left").join(least("parent"), "parent", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    wide = lambda df: df.select(*(F.col(c).cast("long").alias(c) for c in columns[:-1]), columns[-1])
    of_border = of_border.select(
        "conv_id", "depth", F.col("least").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"), (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("tokens") - F.col("once") - F.col("below")).alias("saved_tokens"), F.coalesce("sha", F.lit(sha_of([]))).alias("ends_sha256"),
    )
    of_border = materialize(wide(of_border), "border_nodes")
    inner = lookup(nodes.filter("side is null"), least("parent"), ["parent"], "conv_id", "left")
    inner = inner.select("conv_id", "depth", F.coalesce("parent_conv_id", "least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("tokens") - F.col("once")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    found = materialize(wide(inner), "inner_nodes").unionByName(of_border)
    work.drop()
    return found
