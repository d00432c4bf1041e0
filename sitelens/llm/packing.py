"""Packing: concatenate all documents' tokens and cut them into fixed windows.

Two passes.  The first encodes every document and writes its ids with the
task's number and the token count before it in that task.  Prefix sums over
the tasks' totals then give each document a global offset, and the second
pass cuts the documents at the multiples of the window, which needs neither a
shuffle nor an order.  Only the last sequence is not full.

Defined cases: a null text counts as empty and still has its end id; a null
``doc_id`` stays null; repeated rows are documents of their own; an empty
table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.storage import written
from sitelens.llm.tokens import binary_rows, default_vocabulary, encoder, id_type, slices, with_end

WINDOW = 4096
END_ID = 2
TOKENS = "part int, local_start long, doc_id long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_table(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """First pass: each document's ids (little-endian, as wide as the vocabulary needs), by task."""
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = with_end(*encoder(path).encode(batch.column("text")), end_id)
                n = batch.num_rows
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(before + offsets[:-1]),
                        batch.column("doc_id"),
                        pa.array(np.diff(offsets)),
                        binary_rows(ids.astype(id_type(path)), offsets),
                    ],
                    names=["part", "local_start", "doc_id", "n_tokens", "ids"],
                )
                before += int(offsets[-1])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(encode, TOKENS)


def part_starts(tokens: DataFrame) -> dict[int, int]:
    """Global offset of each first-pass task: one number a task goes through the driver."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([0, *(r["n"] for r in totals)])
    return {r["part"]: int(a) for r, a in zip(totals, ends, strict=False)}


def cut(tokens: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Second pass: one row per piece, with its boundary record (sequence and offset there)."""
    starts = part_starts(tokens)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n = batch.column("n_tokens").to_numpy()
            part = batch.column("part").to_numpy()
            base = np.fromiter((starts[int(p)] for p in part), np.int64, len(part)) + batch.column("local_start").to_numpy()
            first, last = base // window, (base + n - 1) // window
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            begin = np.maximum(sequence * window, base[row])
            end = np.minimum((sequence + 1) * window, (base + n)[row])
            start, length = begin - base[row], end - begin
            ids = batch.column("ids")
            kind = "<u2" if len(ids[0].as_buffer()) == 2 * int(n[0]) else "<u4"  # as the first pass wrote them
            crc = np.zeros(len(row), np.int64)
            kept: list[bytes] = []
            current, values = -1, np.zeros(0, np.uint32)
            for i, (r, a, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                if r != current:
                    current, values = r, np.frombuffer(ids[r].as_buffer(), kind).astype("<u4")
                crc[i] = zlib.crc32(values[a : a + m])
                if with_ids:
                    kept.append(values[a : a + m].tobytes())
            columns = [batch.column("doc_id").take(pa.array(row)), start, length, crc, n[row], sequence, begin - sequence * window]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    return tokens.mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in full windows; ``with_ids`` adds each piece's ids as 32-bit integers."""
    return cut(written(token_table(docs, vocabulary, end_id), "pack-tokens"), window, with_ids)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The training sequences from pieces that carry ``ids``: one row of at most ``window`` ids each.

    The last one is padded to a power of two only, all others are full.
    """

    def join(keys: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4").astype(np.int64)
        room = min(window, 1 << max(0, len(ids) - 1).bit_length())
        padded = np.concatenate([ids, np.full(max(0, room - len(ids)), pad_id, np.int64)])
        return pa.table({"sequence_id": [keys[0].as_py()], "used": [len(ids)], "ids": [padded]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, used long, ids array<long>")
