"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path of turns; every distinct sequence of its first d
turns (role and text) is a node of depth d.  A turn is told by 128 bits of a
SHA-256 of role and text, a path by its turns' 16-byte tokens one after the
other, so paths in byte order are the trie in depth-first order and a node's
members stand together.

1. Paths are range-partitioned by (path, conv_id) and sorted.  The id in the
   key splits equal conversations too, so no path is too frequent for one
   shard.  The sorted shards are checkpointed in the shared folder, so that
   both passes and every retry see the same ones.
2. Nodes with members in several shards are the common prefixes of a shard's
   last path and the next shard's first.  The two end paths a shard reports
   (bounded by the number of shards times the longest path at a border) give
   the skeleton, the trie of these splitter paths, which is broadcast.
3. Each shard walks its sorted paths with a stack and finishes all nodes that
   are not in the skeleton, children with their parent.  For skeleton nodes it
   gives partial aggregates: smallest member, members, children, leaves and
   savings of its part of the subtree, and the ids of conversations that end
   there, in chunks.
4. A reduction by skeleton node adds the partial aggregates up.  All are sums
   (or minima): a skeleton node's own saving (members - 1) * words is counted
   per shard as members * words, and the words are taken off once, with the
   skeleton.  A skeleton node that turns out to have no children adds one leaf
   to each node above it.  Digests of ids run over a node's chunks in shard
   order, a chunk at a time.

Memory: a shard's finished children wait only for their parent, and children
of skeleton nodes for no one; a conversation's own turns make up one row (16
bytes and a number a turn), which is the unit that is not split.

Defined cases: null roles and texts are empty; rows of equal turn (null first)
are ordered by role, then by the token of their text; repeated rows are turns
of their own; rows without a ``conv_id`` take no part; an empty table has no
nodes, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.storage import checkpointed, kept, scratch, written

TOKEN = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a result batch, and ids of a chunk.
BATCH_ROWS, CHUNK_IDS = 8192, 1 << 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]
#: What a shard gives: finished nodes (``up``: the skeleton parent of one whose parent is there), parts of skeleton nodes (``at``), chunks of ids.
GIVEN = f"kind string, at int, up int, {NODE}, shard int, chunk int, ids binary"
GIVEN_NAMES = [c.split()[0] for c in GIVEN.split(", ")]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, token, words) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.substring(F.sha2(said.cast("binary"), 256), 1, 2 * TOKEN).alias("token"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )


def _path(turns: Column) -> list[Column]:
    return [F.unhex(F.array_join(F.transform(turns, lambda t: t["token"]), "")).alias("path"), F.transform(turns, lambda t: t["words"]).alias("words")]


def _ordered(turns: DataFrame, *keys: str) -> DataFrame:
    return turns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "token", "words"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every conversation as it is."""
    return _ordered(turns_of(conversations), "conv_id").select("conv_id", *_path(F.col("turns")))


def rebuilt_paths(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, path, words) of conversations whose first h turns are those of the first conversation of their group.

    h = crc32(decimal conv_id) % ``heads``; conversation c gets the first h
    turns of c - c % ``group`` (all if that has fewer, none if it is absent),
    then its own turns after its first h.  One exchange by the group serves
    the lists, the heads and their join.
    """
    grouped = turns_of(conversations).withColumn("first", F.expr(f"conv_id - conv_id % {group}")).repartition("first")
    own = _ordered(grouped, "first", "conv_id")
    head = own.where("conv_id = first").select("first", F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = own.join(head, "first", "left").withColumn("h", h)
    kept_head = F.when(F.col("head").isNotNull(), F.expr("slice(head, 1, h)")).otherwise(F.expr("slice(turns, 1, 0)"))
    turns = F.concat(kept_head, F.expr("slice(turns, h + 1, size(turns))"))
    return both.withColumn("turns", turns).select("conv_id", *_path(F.col("turns")))


def shared_prefix(a: bytes, b: bytes) -> int:
    """Tokens that both paths begin with."""
    n = min(len(a), len(b)) // TOKEN
    if a[: n * TOKEN] == b[: n * TOKEN]:
        return n
    x, y = (np.frombuffer(p, "V16", n) for p in (a, b))
    return int(np.argmax(x != y))


class Skeleton(NamedTuple):
    """Nodes whose members lie in several shards, in path order; ``words`` of the last turn, ``taken`` the words of the subtree's skeleton nodes."""

    prefixes: list[bytes]
    words: list[int]
    parents: list[int]
    children: list[int]
    taken: list[int]

    def find(self, prefix: bytes) -> int:
        i = bisect_left(self.prefixes, prefix)
        return i if i < len(self.prefixes) and self.prefixes[i] == prefix else -1


def skeleton_of(ends: list[tuple[bytes, bytes, list[int]]]) -> Skeleton:
    """From (first path, last path, words of the last path) of every shard with rows, in order."""
    found: dict[bytes, int] = {}
    for (_, last, words), (first, _, _) in zip(ends[:-1], ends[1:], strict=True):
        for d in range(shared_prefix(last, first) + 1):
            found[last[: d * TOKEN]] = words[d - 1] if d else 0
    prefixes = sorted(found)
    index = {p: i for i, p in enumerate(prefixes)}
    parents = [index[p[:-TOKEN]] if p else -1 for p in prefixes]
    words = [found[p] for p in prefixes]
    children, taken = [0] * len(prefixes), list(words)
    for i in range(len(prefixes) - 1, 0, -1):  # children stand after their parents
        children[parents[i]] += 1
        taken[parents[i]] += taken[i]
    return Skeleton(prefixes, words, parents, children, taken)


def _shard_ends(shards: DataFrame) -> list[tuple[bytes, bytes, list[int]]]:
    """Two paths a shard reach the driver."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, words = None, None, None
        for batch in batches:
            if batch.num_rows:
                first = batch.column("path")[0].as_py() if first is None else first
                last, words = batch.column("path")[-1].as_py(), batch.column("words")[-1].as_py()
        if first is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in ((TaskContext.get().partitionId(), pa.int32()), (first, pa.binary()), (last, pa.binary()), (words, pa.list_(pa.int32())))], names=["shard", "first", "last", "words"])

    found = shards.select("path", "words").mapInArrow(ends, "shard int, first binary, last binary, words array<int>").collect()
    return [(bytes(r["first"]), bytes(r["last"]), r["words"]) for r in sorted(found, key=lambda r: r["shard"])]


class _Open:
    """A node on the current path, with what its subtree gave so far."""

    __slots__ = ("at", "words", "least", "members", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, at: int, words: int):
        self.at, self.words, self.least = at, words, None
        self.members = self.children = self.leaves = self.saved = 0
        self.ends, self.waiting = None, []


class _Walk:
    """Walks a shard's sorted paths; ``rows`` collects what is finished."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard = skeleton, shard
        self.rows: list[tuple] = []
        self.open: list[_Open] = []
        self.path: bytes = b""
        self.ids: list[int] = []
        self.chunk = 0

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        depth = len(path) // TOKEN
        if not self.open:
            self._push(0, path, words)
        elif path != self.path:
            self._chunk()
            self._close(shared_prefix(self.path, path) + 1)
        for d in range(len(self.open), depth + 1):
            self._push(d, path, words)
        self.path = path
        top = self.open[-1]
        top.members += 1
        top.least = conv if top.least is None else min(top.least, conv)
        if top.at >= 0:
            self.ids.append(conv)
            if len(self.ids) >= CHUNK_IDS:
                self._chunk()
        elif top.ends is None:
            top.ends = hashlib.sha256(str(conv).encode())
        else:
            top.ends.update(b",%d" % conv)

    def end(self) -> None:
        if self.open:
            self._chunk()
            self._close(0)

    def _push(self, d: int, path: bytes, words: list[int]) -> None:
        # below a node that is not in the skeleton no node is
        known = not self.open or self.open[-1].at >= 0
        self.open.append(_Open(self.skeleton.find(path[: d * TOKEN]) if known else -1, words[d - 1] if d else 0))

    def _chunk(self) -> None:
        """The ids of conversations that end at the current skeleton node."""
        if self.ids:
            text = ",".join(map(str, self.ids)).encode()
            self.rows.append(("ids", self.open[-1].at, -1, None, None, None, None, None, None, None, None, self.shard, self.chunk, text))
            self.ids, self.chunk = [], self.chunk + 1

    def _close(self, depth: int) -> None:
        """Finish the open nodes of this depth and below."""
        while len(self.open) > depth:
            node = self.open.pop()
            d = len(self.open)
            up = self.open[-1] if self.open else None
            if up is not None:
                up.members += node.members
                up.least = node.least if up.least is None else min(up.least, node.least)
            if node.at >= 0:
                node.saved += node.members * node.words
                self.rows.append(("part", node.at, -1, node.least, d, None, node.members, node.children, node.leaves, node.saved, None, self.shard, None, None))
            else:
                node.leaves = node.leaves if node.children else 1
                node.saved += (node.members - 1) * node.words
                for child in node.waiting:
                    self.rows.append(child[:5] + (node.least,) + child[6:])
                digest = (node.ends or hashlib.sha256()).hexdigest()
                row = ("node", -1, -1, node.least, d, None, node.members, node.children, node.leaves, node.saved, digest, None, None, None)
                if up is None:
                    self.rows.append(row)
                else:
                    up.children += 1
                    if up.at >= 0:
                        self.rows.append(row[:2] + (up.at,) + row[3:])
                    else:
                        up.waiting.append(row)
            if up is not None:
                up.leaves += node.leaves
                up.saved += node.saved


def _given(shards: DataFrame, skeleton: Skeleton) -> DataFrame:
    context = shards.sparkSession.sparkContext
    shared = context.broadcast(skeleton)
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.int32(), pa.int32(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=GIVEN_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(shared.value, TaskContext.get().partitionId())
        for batch in batches:
            for conv, path, words in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), batch.column("words").to_pylist(), strict=True):
                walk.add(conv, path, words)
                if len(walk.rows) >= BATCH_ROWS:
                    yield batch_of(walk.rows)
                    walk.rows = []
        walk.end()
        if walk.rows:
            yield batch_of(walk.rows)

    return shards.mapInArrow(run, GIVEN)


def _digests(chunks: DataFrame) -> DataFrame:
    """(at, ends_sha256): one running digest a node over its chunks in order, a chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("at").to_pylist(), batch.column("ids"), strict=True):
                if node != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_buffer())
            if done:
                yield pa.record_batch([pa.array([x for x, _ in done], pa.int32()), pa.array([x for _, x in done])], names=["at", "ends_sha256"])
        if at is not None:
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([digest.hexdigest()])], names=["at", "ends_sha256"])

    return chunks.repartition("at").sortWithinPartitions("at", "shard", "chunk").select("at", "ids").mapInArrow(run, "at int, ends_sha256 string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row a node of the trie of ``paths`` (conv_id, path, words); see ``NODE``.

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (null
    for the root), ``n_convs`` the members, ``n_children``, ``n_leaves`` the
    childless nodes of the subtree, ``saved_tokens`` the sum over the subtree of
    (members - 1) * words of a node's last turn, ``ends_sha256`` the digest of
    the ids, ascending and comma-joined, of the conversations that end here.
    """
    spark = paths.sparkSession
    with scratch(spark, "trie"):
        rows = written(paths.select("conv_id", "path", F.col("words").cast("array<int>").alias("words")), "paths")
        shards = checkpointed(rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"))
        skeleton = skeleton_of(_shard_ends(shards))
        given = written(_given(shards, skeleton), "nodes")
        return kept(_reduced(given, skeleton), "trie-nodes")


def _reduced(given: DataFrame, skeleton: Skeleton) -> DataFrame:
    spark = given.sparkSession
    finished = given.where("kind = 'node'")
    if not skeleton.prefixes:
        return finished.select(*COLUMNS)
    sums = given.where("kind = 'part'").groupBy("at").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    table = list(zip(range(len(skeleton.prefixes)), (len(p) // TOKEN for p in skeleton.prefixes), skeleton.parents, skeleton.children, skeleton.taken, strict=True))
    bones = spark.createDataFrame(table, "at int, depth long, up int, inner long, taken long")
    known = sums.join(F.broadcast(bones), "at")
    # a skeleton node without any child is a leaf of all nodes above it: as many as its depth
    bare = known.where("n_children + inner = 0").select("at")
    lines = spark.sparkContext.broadcast(skeleton.parents)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column("at").to_pylist():
                while at >= 0:
                    out.append(at)
                    at = lines.value[at]
            yield pa.record_batch([pa.array(out, pa.int32())], names=["at"])

    more = bare.mapInArrow(above, "at int").groupBy("at").agg(F.count(F.lit(1)).alias("bare"))
    digests = _digests(given.where("kind = 'ids'"))
    nodes = known.join(more, "at", "left").join(digests, "at", "left").select(
        "at",
        "up",
        "conv_id",
        "depth",
        "n_convs",
        (F.col("n_children") + F.col("inner")).alias("n_children"),
        (F.col("n_leaves") + F.coalesce("bare", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") - F.col("taken")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
    nodes = written(nodes, "skeleton-nodes")
    # as many rows as the skeleton that was broadcast before
    parents = F.broadcast(nodes.select(F.col("at").alias("up"), F.col("conv_id").alias("parent")))
    with_parent = lambda df: df.join(parents, "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent")).select(*COLUMNS)
    return with_parent(finished).unionByName(with_parent(nodes.withColumn("parent_conv_id", F.lit(None).cast("long"))))
