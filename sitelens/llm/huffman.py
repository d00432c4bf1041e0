"""Token-id files: canonical length-limited Huffman codes from global counts.

Writing takes three steps.  Every document is encoded once into an id table.
A distributed count of the ids (a row per id at most, bounded by the
vocabulary) gives the code lengths by package-merge and the canonical codes.
The id table, ordered by ``doc_id`` over range partitions, then becomes one
shard file per partition.

File format (little-endian).  ``codebook``: magic, maximum length, then pairs
of id and code length.  ``shard-NNNNNN``: magic, then blocks.  A block is
independent: a header (ids, checkpoints, segments, 32-bit words), the segment
table (``doc_id``, whether it is null, ids), the checkpoints (the bit offset
of every ``STRIDE``-th id) and the code bits, most significant first.  A
block ends at a document's end unless the document alone fills it; a unit is
a run of blocks that begins and ends with whole documents, and the ``index``
table lists the units.

Reading decodes a block by one table lookup per id.  The checkpoints cut the
block into lanes that are decoded side by side.

Defined cases: null or empty texts have the end id alone; a null ``doc_id``
comes first and stays null; rows with equal ``doc_id`` are documents of their
own, in the order of their ids' checksum; an empty table gives no shards and
no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.packing import END_ID, token_table
from sitelens.llm.storage import file_system, put_file, work_dir, written
from sitelens.llm.tokens import default_vocabulary, id_type

MAX_LENGTH = 20
BLOCK_IDS = 1 << 17
STRIDE = 256
BOOK, SHARD = b"HUFB0001", b"HUFS0001"
HEAD = struct.Struct("<IIII")
SEGMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u4")])
UNITS = "shard int, unit int, at long, size long, blocks int, docs long, ids long"


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """(id, n): each task counts its ids in an array before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                part = np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=len(total))
                part[: len(total)] += total
                total = part
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes longer than {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    levels, row = [], coins
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(coins))
        row = both[rank]
    take, size = np.zeros(len(coins), np.int64), 2 * len(coins) - 2
    for is_coin in reversed(levels):
        k = int(is_coin[:size].sum())
        take[:k] += 1
        size = 2 * (size - k)
    take[:size] += 1
    lengths[order] = take
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id), each the next number at its length."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == length)
        code <<= length - last
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code, last = code + len(ids), length
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each window of the longest code's width: id and code length in one number."""
    width = int(lengths.max(initial=1))
    table = np.zeros(1 << width, np.uint64)
    for i, code in zip(np.flatnonzero(lengths), canonical_codes(lengths)[lengths > 0], strict=True):
        spare = width - int(lengths[i])
        table[int(code) << spare : (int(code) + 1) << spare] = (int(i) << 8) | int(lengths[i])
    return table, width


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit words, bit offset of every STRIDE-th id).  Codes of at most 32 bits touch two words each,
    and in every word but the last a code begins, so sums over the runs of equal words set the bits."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    if len(ids) == 0:
        return np.zeros(1, np.uint64), at
    value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[:-1] = np.add.reduceat(value >> np.uint64(32), first)
    words[1:] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words, at[::STRIDE]


def unpack_bits(words: np.ndarray, marks: np.ndarray, n: int, table: np.ndarray, width: int) -> np.ndarray:
    """The ids of a block: one lane per checkpoint, all lanes a step at a time."""
    wide = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
    lanes, out = len(marks), np.zeros((STRIDE, len(marks)), np.uint32)
    at, mask = marks.astype(np.int64), np.uint64((1 << width) - 1)
    for step in range(min(n, STRIDE)):
        if (lanes - 1) * STRIDE + step >= n:
            lanes, at = lanes - 1, at[: lanes - 1]
        found = table[(wide[at >> 5] >> (64 - width - (at & 31)).astype(np.uint64)) & mask]
        out[step, :lanes] = found >> np.uint64(8)
        at = at + (found & np.uint64(255)).astype(np.int64)
        # the last lane is the short one: it leaves before the others
    return out.T.reshape(-1)[:n]


def block_bytes(segments: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    words, marks = pack_bits(ids, lengths, codes)
    head = HEAD.pack(len(ids), len(marks), len(segments), len(words))
    return head + segments.tobytes() + marks.astype("<u4").tobytes() + words.astype("<u4").tobytes()


def read_block(data: memoryview, table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(segments, ids, bytes used) of the block at the start of ``data``."""
    n, n_marks, n_segments, n_words = HEAD.unpack_from(data)
    at = HEAD.size
    segments = np.frombuffer(data, SEGMENT, n_segments, at)
    at += segments.nbytes
    marks = np.frombuffer(data, "<u4", n_marks, at)
    at += marks.nbytes
    words = np.frombuffer(data, "<u4", n_words, at).astype(np.uint64)
    return segments, unpack_bits(words, marks, n, table, width), at + 4 * n_words


def block_at(stream) -> memoryview:
    """The bytes of the block at the stream's position."""
    head = stream.read(HEAD.size)
    _, n_marks, n_segments, n_words = HEAD.unpack(head)
    return memoryview(head + stream.read(n_segments * SEGMENT.itemsize + 4 * (n_marks + n_words)))


def blocks_of(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(begins a unit, segments, ids) of blocks of about BLOCK_IDS ids."""
    segments: list[tuple] = []
    parts: list[np.ndarray] = []
    held, fresh = 0, True

    def flush():
        return fresh, np.array(segments, SEGMENT), np.concatenate(parts)

    for batch in batches:
        for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
            values = np.frombuffer(ids.as_buffer(), kind)
            if held and held + len(values) > BLOCK_IDS:
                yield flush()
                segments, parts, held, fresh = [], [], 0, True
            for a in range(0, len(values), BLOCK_IDS):
                piece = values[a : a + BLOCK_IDS]
                segments.append((doc or 0, doc is None, len(piece)))
                parts.append(piece)
                held += len(piece)
                if held >= BLOCK_IDS:
                    yield flush()
                    segments, parts, held = [], [], 0
                    fresh = a + BLOCK_IDS >= len(values)
            if not held:
                fresh = True
            elif len(values) > BLOCK_IDS:  # the rest of a document that filled blocks closes its unit
                yield flush()
                segments, parts, held, fresh = [], [], 0, True
    if held:
        yield flush()


def write_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, max_length: int = MAX_LENGTH) -> DataFrame:
    """Write ``docs`` as shards below ``folder``; returns the index of units, which is also written there."""
    path = vocabulary or default_vocabulary()
    kind = id_type(path)
    tokens = written(token_table(docs, path, end_id), "huffman-tokens")
    seen = id_counts(tokens, kind).collect()  # bounded by the vocabulary
    counts = np.zeros(max([0, *(r["id"] for r in seen)]) + 1, np.int64)
    for r in seen:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max_length)
    used = np.flatnonzero(lengths)
    book = np.stack([used, lengths[used]], axis=1).astype("<u4").tobytes()
    put_file(f"{folder}/codebook", "driver", [BOOK, struct.pack("<I", max_length), book])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, codes, units = task.partitionId(), canonical_codes(lengths), []

        def chunks():
            at = len(SHARD)
            yield SHARD
            for fresh, segments, ids in blocks_of(batches, kind):
                data = block_bytes(segments, ids, lengths, codes)
                if fresh:
                    units.append([shard, len(units), at, 0, 0, len(segments), 0])
                units[-1][3] += len(data)
                units[-1][4] += 1
                units[-1][6] += len(ids)
                at += len(data)
                yield data

        stream = chunks()
        head = [next(stream), *(x for x in [next(stream, None)] if x)]
        if len(head) > 1:  # a shard without documents has no file
            put_file(f"{folder}/shard-{shard:06d}", f"{task.taskAttemptId()}", (x for part in (head, stream) for x in part))
            names = ["shard", "unit", "at", "size", "blocks", "docs", "ids"]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*units, strict=True), types, strict=True)], names=names)

    keyed = tokens.withColumn("tie", F.crc32("ids"))
    ordered = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie", "part", "local_start").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "tie", "part", "local_start"
    )
    ordered.select("doc_id", "ids").mapInArrow(write, UNITS).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(UNITS).parquet(f"{folder}/index")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents from the files: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids`` on request)."""
    index = spark.read.schema(UNITS).parquet(f"{folder}/index")
    totals = index.groupBy("shard").agg(F.sum("ids").alias("n")).orderBy("shard").collect()  # one number a shard
    ends = np.cumsum([0, *(r["n"] for r in totals)])
    base = {r["shard"]: int(a) for r, a in zip(totals, ends, strict=False)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        table, width = None, 0
        for batch in batches:
            for unit in batch.to_pylist():
                if table is None:
                    with fs.open_input_file(f"{root}/codebook") as f:
                        book = np.frombuffer(f.read()[len(BOOK) + 4 :], "<u4").reshape(-1, 2)
                    lengths = np.zeros(int(book[:, 0].max(initial=0)) + 1, np.uint8)
                    lengths[book[:, 0]] = book[:, 1]
                    table, width = decode_table(lengths)
                rows: list[list] = []
                kept: list[bytes] = []
                start = base[unit["shard"]] + unit["before"]
                with fs.open_input_file(f"{root}/shard-{unit['shard']:06d}") as f:
                    at = unit["at"]
                    for k in range(unit["blocks"]):
                        f.seek(at)
                        segments, ids, used = read_block(block_at(f), table, width)
                        at += used
                        ids = ids.astype("<u4")
                        ends = np.cumsum(segments["ids"].astype(np.int64))
                        for i, (doc, null, size) in enumerate(segments.tolist()):
                            piece = ids[ends[i] - size : ends[i]]
                            if k and not i:  # a unit of several blocks is one document
                                rows[-1][2] += size
                                rows[-1][3] = zlib.crc32(piece, rows[-1][3])
                                if with_ids:
                                    kept[-1] += piece.tobytes()
                            else:
                                rows.append([None if null else doc, start, size, zlib.crc32(piece)])
                                if with_ids:
                                    kept.append(piece.tobytes())
                            start += size
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    units = _offsets(index)
    spread = units.repartition(max(1, 4 * spark.sparkContext.defaultParallelism), "shard", "unit")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def _offsets(index: DataFrame) -> DataFrame:
    """Units with the ids before them in their shard."""
    from pyspark.sql import Window

    earlier = Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("before", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def encode_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The round trip: write shards into a folder of this run and read the documents back."""
    spark = docs.sparkSession
    folder = work_dir(spark, "huffman")
    write_ids(docs, folder, vocabulary)
    return read_ids(spark, folder)
