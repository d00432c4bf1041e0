"""Repeated passages across documents by sparse suffix arrays.

A passage is a run of at least ``MIN_WORDS`` words that stands in two
different texts.  Steps:

1. Suffixes are kept only where a minimiser selects them: of every ``REACH``
   places in a row, the one whose ``GRAM`` words hash lowest (leftmost of
   equals).  Each passage then has a kept suffix among its first ``REACH``
   places, in both texts alike, and its first ``BLOCK`` words lie inside.
2. Suffixes whose first ``BLOCK`` words occur in one text only are dropped.
3. The others get their contexts, are sorted by what follows the block, and
   neighbours are compared: the match is extended right by the common prefix
   and left by the common words before, as far as a passage needs.
4. The longest extension to the right need not be the one to the left.  Where
   the neighbours did not confirm as many words of a suffix as its longest
   extensions to both sides could give together, or a block has so many
   suffixes that they were sorted in parts, every suffix of the block is
   compared under each shift of the ``MIN_WORDS`` words around it; equal ones
   are found by hash.  So no word of a passage is missed.
5. Confirmed stretches of a text are merged into spans.

Equal texts are one text in steps 1 to 5; each of their documents gets the
spans, and texts of several documents are spans as a whole.

Defined cases: null texts, empty texts and texts of fewer than ``MIN_WORDS``
words have no spans; a null ``doc_id`` stays null; rows that repeat both
``doc_id`` and text are one document and give their spans once; repeats inside
one text alone are none; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.setjoin import SLICE_BYTES, runs_of
from sitelens.llm.storage import kept, scratch, written
from sitelens.llm.tokens import slices
from sitelens.llm.words import PLACE_VALUES, mix, split_words, window_hashes, word_hashes

MIN_WORDS = 50
GRAM = 8
REACH = 24
BLOCK = MIN_WORDS - REACH + 1
SIDE = REACH - 1
#: Suffixes of one block that are sorted together; larger blocks are sorted in parts.
PART = 4096
#: A side of at most so many rows of one number, counted first, may be broadcast.
BROADCAST_ROWS = 1_000_000
SPANS = "key long, block long, start int, end int"


def kept_places(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of kept suffixes, text of each) in the batch's run of word hashes."""
    grams = window_hashes(hashes, GRAM)
    n = len(hashes) - MIN_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.arange(len(grams), dtype=np.int32)
    span = 1
    while span < REACH:  # the lowest of ever longer runs; leftmost of equals
        step = min(span, REACH - span)
        a, b = low[: len(low) - step], low[step:]
        low = np.where(grams[a] <= grams[b], a, b)
        span += step
    start = np.arange(n)
    text = np.searchsorted(offsets, start, side="right") - 1
    whole = start + MIN_WORDS <= offsets[text + 1]
    places, first = np.unique(low[:n][whole], return_index=True)
    return places.astype(np.int64), text[whole][first]


def block_hashes(hashes: np.ndarray, places: np.ndarray, n: int = BLOCK) -> np.ndarray:
    total = np.zeros(len(places), np.uint64)
    for k in range(n):
        total += hashes[places + k] * PLACE_VALUES[k]
    return mix(total)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))


def _suffixes(rows: DataFrame) -> DataFrame:
    """(block, key, pos) of every kept suffix, and a row with null ``block`` and the number of words for every text; a task takes each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                keys = batch.column("key").to_pylist()
                fresh = []
                for i, key in enumerate(keys):
                    if key not in done:
                        done.add(key)
                        fresh.append(i)
                batch = batch.take(pa.array(fresh, pa.int64()))
                words = split_words(batch.column("text"))
                hashes = word_hashes(words, fold=False)
                places, text = kept_places(hashes, words.offsets)
                pos = (places - words.offsets[text]).astype(np.int32)
                key = batch.column("key").to_numpy()
                block = pa.array(block_hashes(hashes, places).view(np.int64))
                yield pa.record_batch([block, pa.array(key[text]), pa.array(pos)], names=["block", "key", "pos"])
                sizes = pa.array(np.diff(words.offsets).astype(np.int32))
                yield pa.record_batch([pa.nulls(len(key), pa.int64()), pa.array(key), sizes], names=["block", "key", "pos"])

    return rows.where("text IS NOT NULL").select("key", "text").mapInArrow(run, "block long, key long, pos int")


def _contexts(rows: DataFrame, survivors: DataFrame) -> DataFrame:
    """(block, key, pos, salt, n_left, n_right, left, right) of the surviving suffixes.

    ``left`` are the words before the block, nearest first, ``right`` those
    behind it: 32-bit hashes, big-endian, so bytes sort like word sequences.
    """
    places = survivors.groupBy("key").agg(F.collect_set(F.struct("pos", "block", "salt")).alias("at"))  # bounded by the text
    keys = survivors.select("key").distinct()
    few = keys.count() <= BROADCAST_ROWS
    texts = rows.select("key", "text").join(F.broadcast(keys) if few else keys, "key", "left_semi").join(places, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                fresh = []
                for i, k in enumerate(batch.column("key").to_pylist()):
                    if k not in done:
                        done.add(k)
                        fresh.append(i)
                batch = batch.take(pa.array(fresh, pa.int64()))
                words = split_words(batch.column("text"))
                hashes = word_hashes(words, fold=False)
                short = np.append((hashes >> np.uint64(32)).astype(">u4"), np.zeros(1, ">u4"))
                at = batch.column("at")
                counts = np.diff(at.offsets.to_numpy())
                flat = at.flatten()
                pos, block, salt = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "block", "salt"))
                text = np.repeat(np.arange(batch.num_rows), counts)
                place = words.offsets[text] + pos
                n_left = np.minimum(SIDE, pos).astype(np.int32)
                n_right = np.minimum(SIDE, words.offsets[text + 1] - place - BLOCK).astype(np.int32)
                steps = np.arange(SIDE)
                left = np.where(steps < n_left[:, None], place[:, None] - 1 - steps, len(hashes))
                right = np.where(steps < n_right[:, None], place[:, None] + BLOCK + steps, len(hashes))
                sides = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * SIDE), len(pos), [None, pa.py_buffer(short[x].tobytes())]).cast(pa.binary()) for x in (left, right)]
                key = batch.column("key").to_numpy()[text]
                columns = [pa.array(block), pa.array(key), pa.array(pos), pa.array(salt), pa.array(n_left), pa.array(n_right), *sides]
                yield pa.record_batch(columns, names=["block", "key", "pos", "salt", "n_left", "n_right", "left", "right"])

    return texts.mapInArrow(run, "block long, key long, pos int, salt int, n_left int, n_right int, left binary, right binary")


def _words_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, SIDE)


def common(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Leading equal words of two tables of sequences of given lengths."""
    same = np.minimum.accumulate((a == b).astype(np.int8), axis=1).sum(axis=1)
    return np.minimum(same, np.minimum(n_a, n_b))


def _sortable(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), f"S{4 * SIDE}")


def _highest(n: int, order: np.ndarray, values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The higher value of each row's two pairs with its neighbours in ``order``, or -1 without ``some``."""
    pairs = np.concatenate([[-1], np.where(some, values, -1), [-1]])
    out = np.empty(n, np.int64)
    out[order] = np.maximum(pairs[:-1], pairs[1:])
    return out


def _neighbours(contexts: DataFrame) -> DataFrame:
    """Stretches that sorted neighbours confirm, and (with null ``start``) blocks that are left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ("block", "salt")):
            block, key, pos, salt, n_left, n_right = (table.column(c).to_numpy() for c in ("block", "key", "pos", "salt", "n_left", "n_right"))
            left, right = _words_of(table.column("left")), _words_of(table.column("right"))
            pair = (block[1:] == block[:-1]) & (salt[1:] == salt[:-1]) & (key[1:] != key[:-1])
            before = common(left[1:], left[:-1], n_left[1:], n_left[:-1])
            after = common(right[1:], right[:-1], n_right[1:], n_right[:-1])
            good = pair & (before + BLOCK + after >= MIN_WORDS)
            i = np.flatnonzero(good)
            out = [(key[j], block[j], pos[j] - before[i], pos[j] + BLOCK + after[i]) for j in (i, i + 1)]
            group = np.concatenate([[0], np.cumsum((block[1:] != block[:-1]) | (salt[1:] != salt[:-1]))])
            by_left = np.lexsort((_sortable(table.column("left")), group))
            beside = common(left[by_left[1:]], left[by_left[:-1]], n_left[by_left[1:]], n_left[by_left[:-1]])
            most_left = _highest(len(key), by_left, beside, group[by_left[1:]] == group[by_left[:-1]])
            most_right = _highest(len(key), np.arange(len(key)), after, group[1:] == group[:-1])
            got_left, got_right = (_highest(len(key), np.arange(len(key)), n, good) for n in (before, after))
            more = (most_left + BLOCK + most_right >= MIN_WORDS) & ((got_left < most_left) | (got_right < most_right))
            open_blocks = np.unique(block[more | (salt >= 0)])
            keys, blocks, starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
            m = len(open_blocks)
            yield pa.record_batch(
                [
                    pa.concat_arrays([pa.array(keys, pa.int64()), pa.nulls(m, pa.int64())]),
                    pa.array(np.concatenate([blocks, open_blocks]), pa.int64()),
                    pa.concat_arrays([pa.array(starts.astype(np.int32)), pa.nulls(m, pa.int32())]),
                    pa.concat_arrays([pa.array(ends.astype(np.int32)), pa.nulls(m, pa.int32())]),
                ],
                names=["key", "block", "start", "end"],
            )

    ordered = contexts.repartition("block", "salt").sortWithinPartitions("block", "salt", "right", "left", "key", "pos")
    return ordered.mapInArrow(run, SPANS)


def _shifted(contexts: DataFrame) -> DataFrame:
    """Every suffix under each shift of the MIN_WORDS words around its block: (window, key, block, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            block, key, pos, n_left, n_right = (table.column(c).to_numpy() for c in ("block", "key", "pos", "n_left", "n_right"))
            left, right = (_words_of(table.column(c)).astype(np.uint64) for c in ("left", "right"))
            for shift in range(SIDE + 1):
                rows = np.flatnonzero((n_left >= shift) & (n_right >= SIDE - shift))
                if len(rows) == 0:
                    continue
                h = block[rows].view(np.uint64) + np.uint64(shift)
                for k in range(shift):
                    h = mix(h * PLACE_VALUES[1] + left[rows, k])
                for k in range(SIDE - shift):
                    h = mix(h * PLACE_VALUES[2] + right[rows, k])
                start = (pos[rows] - shift).astype(np.int32)
                yield pa.record_batch([pa.array(x) for x in (h.view(np.int64), key[rows], block[rows], start, start + np.int32(MIN_WORDS))], names=["window", "key", "block", "start", "end"])

    return contexts.mapInArrow(run, f"window long, {SPANS}")


def _merged(stretches: DataFrame) -> DataFrame:
    """(key, passage_id, start, end): overlapping or touching stretches of a text as one span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ("key",)):
            key, block, start, end = (table.column(c).to_numpy() for c in ("key", "block", "start", "end"))
            text = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])).astype(np.int64)
            reach = np.maximum.accumulate((text << 32) + end)
            fresh = np.ones(len(key), bool)
            fresh[1:] = (text[1:] << 32) + start[1:] > reach[:-1]
            at = np.flatnonzero(fresh)
            last = np.append(at[1:], len(key)) - 1
            yield pa.record_batch(
                [pa.array(key[at]), pa.array(np.minimum.reduceat(block, at)), pa.array(start[at]), pa.array((reach[last] & 0xFFFFFFFF).astype(np.int32))],
                names=["key", "passage_id", "start", "end"],
            )

    ordered = stretches.repartition("key").sortWithinPartitions("key", "start")
    return ordered.mapInArrow(run, "key long, passage_id long, start int, end int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, passage_id, start_word, end_word, n_words`` of the spans that other documents hold too."""
    with scratch(docs.sparkSession, "passages"):
        return kept(_repeated_passages(docs), "repeated-passages")


def _repeated_passages(docs: DataFrame) -> DataFrame:
    rows = _keyed(docs)
    suffixes = written(_suffixes(rows), "suffixes")
    blocks = suffixes.where("block IS NOT NULL").groupBy("block").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    salt = F.when(F.col("n") > PART, F.pmod(F.xxhash64("key", "pos"), F.ceil(F.col("n") / PART)).cast("int")).otherwise(F.lit(-1))
    survivors = written(suffixes.join(blocks.select("block", "n"), "block").select("block", "key", "pos", salt.alias("salt")), "suffix-survivors")
    contexts = written(_contexts(rows, survivors), "suffix-contexts")
    near = written(_neighbours(contexts), "suffix-neighbours")
    left_open = near.where("start IS NULL").select("block").distinct()
    shifted = written(_shifted(contexts.join(left_open, "block")), "suffix-shifts")
    # written, so that both sides of the join are plain exchanges and a hot window is split
    equal = written(shifted.groupBy("window").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("window"), "equal-windows")
    stretches = near.where("start IS NOT NULL").unionByName(shifted.join(equal, "window").drop("window"))
    spans = _merged(stretches)

    members = rows.where("text IS NOT NULL").select("doc_id", "key").distinct()
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    sizes = suffixes.where("block IS NULL").select("key", F.col("pos").alias("end")).distinct()
    sized = sizes.where(F.col("end") >= MIN_WORDS).join(several, "key")
    copies = sized.select("key", F.col("key").alias("passage_id"), F.lit(0).alias("start"), "end")
    parts = spans.join(several, "key", "left_anti").unionByName(copies)
    out = members.join(parts, "key")
    return out.select("doc_id", "passage_id", F.col("start").cast("long").alias("start_word"), F.col("end").cast("long").alias("end_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"))
