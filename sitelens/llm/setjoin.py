"""Exact Jaccard join of documents as sets of five-word shingles, with set-relation skipping.

Two sets of a and b shingles with a Jaccard similarity of at least t share
``t / (1 + t) * (a + b)`` shingles, so under any common order of shingles
their prefixes of ``n - ceil(t * n) + 1`` shingles meet.  Steps:

1. One pass gives each document its set size and a fingerprint of its set;
   equal sets become one node.  The same pass counts hash buckets of all
   shingles in a fixed-size array.
2. Shingles of crowded buckets come last in the order, so passages that many
   documents share leave the prefixes.  The prefixes form index lists by
   shingle; lists of crowded shingles are salted by a factor that grows with
   the crowd.  Lists of one node are dropped.
3. In every list, nodes of like size point to one of them, their pivot: the
   one with the fewest rarer shingles, which has most in common with the rest.
   Each node is compared with the pivot that it meets most often; if
   linked, it keeps the pivot as its reference and its difference from it.
4. Nodes that links join already need no more answers.  Where a list holds
   references of different components, blocks of entries by size and position
   are skipped if their bound is too low.  Of the other reference pairs those
   that meet in k lists are compared once, however many nodes stand behind them.
5. What two nodes can share is at most what their references share plus both
   differences.  Only where that bound reaches the threshold are the nodes
   behind two references compared with each other.

Components of all links give the classes.  Steps 3 and 5 derive a set's
answers from those of a highly similar set, so a group of n near copies costs
n comparisons, and no link between different components is missed.

Nodes are told apart by 64-bit fingerprints of their sets, and shingles by
64-bit hashes.

Defined cases: documents without words have an empty set and link with
nothing; fewer than five words make one shingle of all; a null ``doc_id``
counts as no document to link: its row has its set size and a null component;
rows that share a ``doc_id`` are one document with several sets; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.graph import components, joined_labels
from sitelens.llm.storage import free_name, kept, scratch, written
from sitelens.llm.tokens import slices
from sitelens.llm.words import mix, short_hash, split_words, window_hashes, word_hashes

SHINGLE_WORDS = 5
PERCENT = 80
SKETCH_BITS = 20
MEET = 4
#: A side of a join of at most so many (id, id) rows, counted first, may be broadcast.
BROADCAST_ROWS = 1_000_000
BLOCK = 64
#: Bytes of text whose words are hashed at once.
SLICE_BYTES = 1 << 20


def shingle_sets(texts: pa.Array, n: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = split_words(texts)
    hashes = word_hashes(words)
    windows = window_hashes(hashes, n)
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(windows[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(np.array([short_hash(hashes[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> int | None:
    """A signed 64-bit number of a set; null for the empty one."""
    if len(s) == 0:
        return None
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + MEET)


def need(a, b, percent: int):
    """The least intersection of linked sets of ``a`` and ``b`` shingles."""
    return -(-percent * (a + b) // (100 + percent))


def _signatures(docs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, n_shingles, node) rows, and from each task its bucket counts in blocks."""
    mask = np.uint64((1 << bits) - 1)
    names = ["doc_id", "n_shingles", "node", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                sets = shingle_sets(batch.column("text"))
                if sets:
                    counts += np.bincount((np.concatenate(sets) & mask).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())],
                    names=names,
                )
        if counts.any():
            blocks = np.split(counts, _blocks(bits))
            none = pa.nulls(len(blocks), pa.int64())
            yield pa.record_batch([none, none, none, pa.array(range(len(blocks)), pa.int32()), pa.array([c.tobytes() for c in blocks], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, block int, counts binary")


def _blocks(bits: int) -> int:
    return 1 << min(bits, 6)


def _crowding(signatures: DataFrame, bits: int) -> np.ndarray:
    """A class a bucket: 0, or 1 + log2 of how far it is over what chance gives.

    Each block of buckets is summed and classed where it lies; a byte a bucket reaches the driver.
    """
    shingles = signatures.agg(F.sum("n_shingles")).first()[0] or 0
    mean = shingles / (1 << bits)
    limit, size = mean + 10 * mean**0.5 + 64, (1 << bits) // _blocks(bits)

    def classes(total: np.ndarray) -> bytes:
        crowd = np.zeros(size, np.uint8)
        over = total > limit
        crowd[over] = np.floor(np.log2(total[over] / limit)).astype(np.uint8) + 1
        return crowd.tobytes()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, done = None, np.zeros(size, np.uint64), []
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                if block != at:
                    done += [(at, classes(total))] if at is not None else []
                    at, total = block, np.zeros(size, np.uint64)
                total += np.frombuffer(blob.as_buffer(), np.uint32)
        done += [(at, classes(total))] if at is not None else []
        yield pa.record_batch([pa.array([b for b, _ in done], pa.int32()), pa.array([c for _, c in done], pa.binary())], names=["block", "classes"])

    blocks = signatures.where("block IS NOT NULL").select("block", "counts").repartition("block").sortWithinPartitions("block")
    crowd = np.zeros((_blocks(bits), size), np.uint8)
    for r in blocks.mapInArrow(add, "block int, classes binary").collect():
        crowd[r["block"]] = np.frombuffer(r["classes"], np.uint8)
    return crowd.ravel()


def _postings(docs: DataFrame, crowd: np.ndarray, percent: int, bits: int) -> DataFrame:
    """(token, salt, node, size, pos): each set's prefix, crowded shingles last."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # equal sets post once a task, so a hot group of copies stays small
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                tokens, salts, nodes, sizes = [], [], [], []
                for s in shingle_sets(batch.column("text")):
                    node = fingerprint(s)
                    if node is None or node in done:
                        continue
                    done.add(node)
                    c = crowd[s & mask]
                    p = prefix_length(len(s), percent)
                    if c.any():
                        order = np.lexsort((s, c))[:p]
                        s_prefix, c = s[order], c[order]
                    else:
                        s_prefix, c = s[:p], c[:p]
                    tokens.append(s_prefix)
                    # class 0 has salt -1; others the node's part among 2 ** class
                    part = np.uint64(node & ((1 << 64) - 1)) & ((np.uint64(1) << np.minimum(c, 30).astype(np.uint64)) - np.uint64(1))
                    salts.append(np.where(c > 0, part.astype(np.int64), -1))
                    nodes.append(node)
                    sizes.append((len(s), len(s_prefix)))
                if not tokens:
                    continue
                lengths = np.array([p for _, p in sizes])
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.concatenate(salts).astype(np.int32)),
                        pa.array(np.repeat(np.array(nodes, np.int64), lengths)),
                        pa.array(np.repeat(np.array([n for n, _ in sizes], np.int32), lengths)),
                        pa.array((np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)),
                    ],
                    names=["token", "salt", "node", "size", "pos"],
                )

    return docs.mapInArrow(run, "token long, salt int, node long, size int, pos int")


def runs_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The sorted rows in tables that end where a key ends; a key's rows are held together."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        first = None
        if held:
            last = held[-1]
            if any(last.column(k)[len(last) - 1].as_py() != table.column(k)[0].as_py() for k in keys):
                first = 0
        if first is None:
            change = np.zeros(len(table), bool)
            for k in keys:
                x = table.column(k).to_numpy()
                change[1:] |= x[1:] != x[:-1]
            cuts = np.flatnonzero(change)
            if len(cuts) == 0:
                held.append(table)
                continue
            first = int(cuts[-1])
        held.append(table.slice(0, first))
        if any(len(t) for t in held):
            yield pa.concat_tables(held).combine_chunks()
        held = [table.slice(first)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of lists with two nodes or more (crowded lists whole), each with the pivot of its list and size band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ("token", "salt")):
            token, salt, node, size, pos, band = (table.column(c).to_numpy() for c in ("token", "salt", "node", "size", "pos", "band"))
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            copy = ~fresh
            copy[1:] &= node[1:] == node[:-1]  # equal sets have equal places, so they stand together
            keep = np.flatnonzero(~copy)
            token, salt, node, size, pos, band, fresh = (x[keep] for x in (token, salt, node, size, pos, band, fresh))
            at = np.flatnonzero(fresh)
            length = np.diff(np.append(at, len(token)))
            lead = fresh.copy()
            lead[1:] |= band[1:] != band[:-1]
            first = np.flatnonzero(lead)
            pivot = np.repeat(node[first], np.diff(np.append(first, len(token))))
            some = (np.repeat(length, length) > 1) | (salt >= 0)
            columns = (token, node, size, pos, band, pivot, salt >= 0)
            yield pa.record_batch([pa.array(x[some]) for x in columns], names=["token", "node", "size", "pos", "band", "pivot", "crowded"])

    banded = postings.withColumn("band", F.floor(F.log("size") / F.log(F.lit(1.25))).cast("int"))
    ordered = banded.repartition("token", "salt").sortWithinPartitions("token", "salt", "band", "pos", "size", "node")
    return ordered.mapInArrow(run, "token long, node long, size int, pos int, band int, pivot long, crowded boolean")


def _sets(docs: DataFrame, signatures: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(node, s) with the shingles of the given nodes, from one document each."""
    rep = written(signatures.where("node IS NOT NULL").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), f"{name}-reps")
    small = rep.count() <= BROADCAST_ROWS
    wanted = docs.join(F.broadcast(rep) if small else rep, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                sets = shingle_sets(batch.column("text"))
                # another row of the same doc_id may hold another set
                mine = [(n, s) for n, s in zip(batch.column("node").to_pylist(), sets, strict=True) if fingerprint(s) == n]
                yield pa.record_batch([pa.array([n for n, _ in mine], pa.int64()), pa.array([s.tobytes() for _, s in mine], pa.binary())], names=["node", "s"])

    return written(wanted.select("node", "text").mapInArrow(run, "node long, s binary"), f"{name}-sets").dropDuplicates(["node"])


def _compared(docs: DataFrame, signatures: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """``pairs(a, b)`` with both sizes and the size of the intersection."""
    pairs = written(pairs.select("a", "b"), f"{name}-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, signatures, nodes, name)
    of = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes_a, sizes_b, shared = [], [], []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                sizes_a.append(len(x))
                sizes_b.append(len(y))
                if len(y) < len(x):
                    x, y = y, x
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared.append(int((y[place] == x).sum()))
            yield pa.record_batch([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in (sizes_a, sizes_b, shared))], names=["a", "b", "size_a", "size_b", "shared"])

    return written(joined.mapInArrow(run, "a long, b long, size_a long, size_b long, shared long"), name)


def _linked(percent: int):
    return F.expr(f"100 * shared >= {percent} * (size_a + size_b - shared)")


def _reference_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of references of different components that meet in enough lists and can reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ("token",)):
            token, ref, label, low, high, pos = (table.column(c).to_numpy() for c in ("token", "ref", "label", "low", "high", "pos"))
            at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            left, right, least = [], [], []
            for a, b in zip(at.tolist(), np.append(at[1:], len(token)).tolist(), strict=True):
                if b - a > 1:
                    sizes = low[a:b].astype(np.int64)
                    for i, j in meeting(label[a:b], sizes, high[a:b].astype(np.int64), pos[a:b].astype(np.int64), percent):
                        left.append(np.full(len(j), ref[a + i]))
                        right.append(ref[a + j])
                        least.append(np.minimum(MEET, need(sizes[j], sizes[i], percent)))
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.concatenate(least).astype(np.int32))], names=["a", "b", "least"])

    ordered = entries.repartition("token").sortWithinPartitions("token", "pos")
    met = ordered.mapInArrow(run, "a long, b long, least int").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"))
    return met.where("n >= least").select("a", "b")


def meeting(label, low, high, pos, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each entry of a list sorted by position, the later entries that it may link with.

    An entry stands for nodes of ``low`` to ``high`` shingles whose shingle of
    this list is at ``pos`` or later.  Where it is among the first ``MEET``
    that two sets share, they share at most ``MEET - 1`` and what follows it in
    either.  A block of entries is skipped if its sizes or positions rule all
    of them out.
    """
    n = len(low)
    starts = np.arange(0, n, BLOCK)
    block_low, block_high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
    rest = high - pos + MEET - 1
    block_rest = np.maximum.reduceat(rest, starts)
    for i in range(n - 1):
        fits = (100 * block_high >= percent * low[i]) & (100 * high[i] >= percent * block_low)
        fits &= np.minimum(block_rest, rest[i]) >= need(block_low, low[i], percent)
        fits &= starts + BLOCK > i + 1
        blocks = starts[fits]
        if len(blocks) == 0:
            continue
        j = (blocks[:, None] + np.arange(BLOCK)).ravel()
        j = j[(j > i) & (j < n)]
        ok = (label[j] != label[i]) & (100 * high[j] >= percent * low[i]) & (100 * high[i] >= percent * low[j])
        ok &= np.minimum(rest[j], rest[i]) >= need(low[j], low[i], percent)
        if ok.any():
            yield i, j[ok]


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    with scratch(docs.sparkSession, "join"):
        return kept(_jaccard_classes(docs, percent, sketch_bits), "jaccard-classes")


def _jaccard_classes(docs: DataFrame, percent: int, sketch_bits: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = written(_signatures(rows, sketch_bits), "join-signatures")
    crowd = _crowding(raw, sketch_bits)
    signatures = raw.where("n_shingles IS NOT NULL").drop("block", "counts")
    known = signatures.where("doc_id IS NOT NULL")
    identified = rows.where("doc_id IS NOT NULL")
    shared = written(_shared(_postings(identified, crowd, percent, sketch_bits)), "join-lists")
    compared = lambda pairs, name: _compared(identified, known, pairs, name)

    # 3: each node with the pivot that it meets most often; pivots of salted parts with their list's first
    meets = shared.where("pivot <> node").select(F.col("node").alias("a"), F.col("pivot").alias("b"), "size")
    crowded = shared.where("crowded AND pivot = node").select("token", "band", "pos", "size", "node")
    head = crowded.groupBy("token", "band").agg(F.min(F.struct("pos", "size", "node"))["node"].alias("b"))
    heads = crowded.join(head, ["token", "band"]).where("node <> b").select(F.col("node").alias("a"), "b", "size")
    met = meets.unionByName(heads).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    met = met.where(f"n >= least({MEET}, (size + 1) div 2)")
    best = met.groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("b"))
    first = compared(best, "join-first")
    links = first.where(_linked(percent)).select("a", "b")
    references = first.where(_linked(percent)).select(F.col("a").alias("node"), F.col("b").alias("ref"), (F.col("size_a") - F.col("shared")).alias("extra"))
    labels = components(links)

    # 4: references of different components that meet in a list
    told = shared.join(references, "node", "left").join(labels, "node", "left")
    told = told.select("token", "node", F.coalesce("ref", "node").alias("ref"), F.coalesce("label", "node").alias("label"), "size", "pos")
    entries = told.groupBy("token", "ref").agg(F.min("label").alias("label"), F.min("size").alias("low"), F.max("size").alias("high"), F.min("pos").alias("pos"))
    entries = written(entries, "join-entries")
    mixed = entries.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    second = compared(_reference_pairs(entries.join(mixed, "token"), percent), "join-second")
    labels = joined_labels(labels, second.where(_linked(percent)).select("a", "b"))

    # 5: nodes behind two references, where the references' overlap leaves room for a link
    sizes = shared.groupBy("node").agg(F.max("size").cast("long").alias("size"))
    members = sizes.join(references, "node", "left").join(labels, "node", "left")
    members = members.select("node", "size", F.coalesce("ref", "node").alias("ref"), F.coalesce("extra", F.lit(0)).alias("extra"), F.coalesce("label", "node").alias("label"))
    members = written(members, "join-members")
    groups = members.groupBy("ref").agg(F.max("extra").alias("extra"), F.min("size").alias("low"), F.min("label").alias("label"))
    side = lambda t, x, cols: t.select(F.col("ref").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))
    open_pairs = second.select("a", "b", "shared").join(side(groups, "a", ("extra", "low", "label")), "a").join(side(groups, "b", ("extra", "low", "label")), "b")
    room = f"{100 + percent} * (shared + extra_a + extra_b) >= {percent} * "
    open_pairs = open_pairs.where(f"label_a <> label_b AND extra_a + extra_b > 0 AND {room} (low_a + low_b)").select("a", "b", "shared")
    behind = open_pairs.join(side(members, "a", ("node", "size", "extra")), "a").join(side(members, "b", ("node", "size", "extra")), "b")
    behind = behind.where(f"{room} (size_a + size_b) AND 100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b) AND extra_a + extra_b > 0")
    third = compared(behind.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "join-third")
    labels = joined_labels(labels, third.where(_linked(percent)).select("a", "b"))
    return _classes(signatures, labels)


def _classes(signatures: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with the smallest ``doc_id`` of its component.  A ``doc_id`` with several sets joins their components."""
    known = signatures.where("doc_id IS NOT NULL AND node IS NOT NULL")
    # written, so that the sides of their join are plain exchanges and a giant component is split
    labelled = written(known.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label")), "join-labelled")
    first = written(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "join-classes")
    of_doc = labelled.join(first, "label").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.max("component_id").alias("other"))
    several = of_doc.where("component_id <> other")
    joined = components(labelled.join(first, "label").join(of_doc.select("doc_id", F.col("component_id").alias("low")), "doc_id").where("low <> component_id").select(F.col("low").alias("a"), F.col("component_id").alias("b"))) if not several.isEmpty() else None
    result = of_doc.select("doc_id", "component_id")
    if joined is not None:
        result = result.join(joined.withColumnRenamed("node", "component_id"), "component_id", "left").select("doc_id", F.coalesce("label", "component_id").alias("component_id"))
    rows = signatures.select("doc_id", "n_shingles")
    return rows.join(result, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without the near copies: of each component the document with the smallest ``doc_id`` stays.

    Rows without a ``doc_id`` stay, and so do repeated rows of a representative.
    """
    ident = free_name(docs.columns, "id")
    with scratch(docs.sparkSession, "join"):
        gone = _jaccard_classes(docs, percent, SKETCH_BITS).where("doc_id IS NOT NULL AND component_id <> doc_id")
        gone = kept(gone.select(F.col("doc_id").alias(ident)).distinct(), "near-copies")
    small = gone.count() <= BROADCAST_ROWS
    marked = docs.withColumn(ident, F.col("doc_id").cast("long"))
    return marked.join(F.broadcast(gone) if small else gone, ident, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
