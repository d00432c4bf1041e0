"""Token counts of whole texts, huge documents by overlapping chunks.

Documents up to ``chunk_chars`` are encoded as they are.  A longer one is cut
into chunks that overlap around each cut, the chunks are encoded with offsets
in tasks of their own, and neighbouring encodings are spliced at a common
boundary in the overlap.

A boundary is proven stable where (1) a white-space character begins at it
and the character before is none, so that no pre-token of the supported
tokenizers reaches over it and normalisation cannot join across it; (2)
neither encoding has a token over it; (3) both encodings agree on a run of
``AGREE`` tokens before it or start together there, and on the next tokens
after it, so both have left the influence of their own cut.  Where an overlap
holds no such boundary, the document goes to the next level with overlaps and
chunks eight times as wide, and after the last level it is encoded whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a null
``doc_id`` stays null; repeated rows give equal repeated rows; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.storage import written
from sitelens.llm.tokens import default_vocabulary, encoder, load_tokenizer, slices

LIMIT = 2048
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 512
WIDEN = 8
LEVELS = 3
AGREE = 2
COUNTS = "doc_id long, n_bytes long, n_tokens long"
SIDES = "key string, zone long, cut long, side string, before array<long>, starts array<long>, ends array<long>, ids array<long>, edges array<long>, total long"


class LibraryEncoder:
    """Ids and character offsets of a text, by ``tokenizers`` (.json) or ``sentencepiece`` (.model)."""

    def __init__(self, path: str):
        self.path = path
        self.piece_model = path.endswith(".model")
        if self.piece_model:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            self.model = load_tokenizer(path)

    def count(self, texts: pa.Array) -> np.ndarray:
        if self.piece_model:
            rows = self.model.encode(pc.fill_null(texts, "").to_pylist(), num_threads=1)
            return np.fromiter(map(len, rows), np.int64, len(rows))
        return np.diff(encoder(self.path).encode(texts)[1])

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.piece_model:
            pieces = self.model.encode(text, return_type="proto").pieces
            body = np.frombuffer(text.encode(), np.uint8)
            chars = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])  # its offsets count bytes
            rows = [(p.id, chars[p.begin], chars[p.end]) for p in pieces]
        else:
            e = self.model.encode(text, add_special_tokens=False)
            rows = [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]
        table = np.array(rows, np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2]


def chunk_zones(text: str, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """(number, start, end) of overlapping chunks: each reaches ``overlap`` characters over its cuts."""
    cuts = list(range(chunk, len(text), chunk))
    bounds = [0, *cuts, len(text)]
    return [(k, max(0, a - overlap), min(len(text), b + overlap)) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def safe_edges(text: str, a: int, b: int) -> list[int]:
    """Positions in (a, b) at which white space begins after another character."""
    return [p for p in range(max(a + 1, 1), b) if text[p].isspace() and not text[p - 1].isspace()]


def splice(cut: int, left: tuple, right: tuple, edges: list[int]) -> tuple[int, int] | None:
    """(tokens of the left chunk before the boundary, of the right chunk before it), for the proven boundary nearest the cut.

    ``left`` and ``right`` are (tokens before the zone, starts, ends, ids) in
    the zone, by position in the document.
    """
    for p in sorted(edges, key=lambda p: abs(p - cut)):
        state = []
        for before, starts, ends, ids in (left, right):
            i = int(np.searchsorted(starts, p))
            state.append((i, before + i, i == 0 or ends[i - 1] <= p, list(zip(starts[max(0, i - AGREE) : i], ids[max(0, i - AGREE) : i], strict=True)), list(zip(starts[i : i + AGREE], ids[i : i + AGREE], strict=True))))
        (i, n, clear, back, ahead), (j, m, clear_too, back_too, ahead_too) = state
        if clear and clear_too and i >= AGREE and j >= AGREE and back == back_too and len(ahead) == AGREE and ahead == ahead_too:
            return n, m
    return None


def token_counts(docs: DataFrame, vocabulary: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    length = F.coalesce(F.length("text"), F.lit(0))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = LibraryEncoder(path)
        for big in batches:
            for batch in slices(big, "text"):
                texts = pc.fill_null(batch.column("text"), "")
                yield pa.record_batch([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(library.count(texts))], names=["doc_id", "n_bytes", "n_tokens"])

    out = rows.where(length <= chunk_chars).mapInArrow(whole, COUNTS)
    # equal texts are one case: a huge text is spliced once, however many rows hold it
    huge = rows.where(length > chunk_chars).withColumn("key", F.sha2("text", 256))
    if not huge.isEmpty():
        texts = written(huge.groupBy("key").agg(F.first("text").alias("text")), "huge-texts")
        counted = _levels(texts, path, chunk_chars, overlap_chars)
        sized = huge.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"))
        out = out.unionByName(sized.join(counted, "key").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _levels(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of every huge text; each level keeps what it could splice and widens the rest."""
    done = None
    for level in range(LEVELS):
        sides = written(texts.mapInArrow(_chunks(chunk, overlap), "key string, zone long, n long, a long, text string").repartition(F.col("key"), F.col("zone")).mapInArrow(_sides(path, chunk, overlap), SIDES), "chunk-sides")
        spliced = written(_spliced(sides), "spliced")
        good = spliced.where("ok").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = spliced.where("NOT ok").select("key")
        if failed.isEmpty():
            return done
        texts = texts.join(failed, "key", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = LibraryEncoder(path)
        for batch in batches:
            yield pa.record_batch([batch.column("key"), pa.array(library.count(batch.column("text")))], names=["key", "n_tokens"])

    return done.unionByName(texts.mapInArrow(whole, "key string, n_tokens long"))


def _chunks(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                zones = chunk_zones(text, chunk, overlap)
                for k, a, b in zones:
                    yield pa.record_batch([pa.array(x) for x in ([key], [k], [len(zones)], [a], [text[a:b]])], names=["key", "zone", "n", "a", "text"])

    return cut


def _sides(path: str, chunk: int, overlap: int):
    """Encodes a chunk; gives its view of the zone at either end, or its total if it is the last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = LibraryEncoder(path)
        for batch in batches:
            for row in batch.to_pylist():
                ids, starts, ends = library.offsets(row["text"])
                starts, ends = starts + row["a"], ends + row["a"]
                out = []
                last = row["zone"] == row["n"] - 1
                for side, zone in (("right", row["zone"] - 1), ("left", row["zone"])):
                    if zone < 0 or zone > row["n"] - 2:
                        continue
                    cut = (zone + 1) * chunk
                    lo, hi = np.searchsorted(starts, [cut - overlap, cut + overlap])
                    edges = [p + row["a"] for p in safe_edges(row["text"], cut - overlap - row["a"], min(cut + overlap - row["a"], len(row["text"])))]
                    out.append((row["key"], zone, cut, side, [int(lo)], starts[lo:hi].tolist(), ends[lo:hi].tolist(), ids[lo:hi].tolist(), edges, None))
                if last:
                    out.append((row["key"], row["zone"], 0, "total", [], [], [], [], [], len(ids)))
                names = [x.split()[0] for x in SIDES.split(", ")]
                lists, types = pa.list_(pa.int64()), [pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*types, *[lists] * 5, pa.int64()], strict=True)], names=names)

    return encode


def _spliced(sides: DataFrame) -> DataFrame:
    """Joins the two views of each zone, splices them, and sums up the texts' tokens."""
    view = lambda side: sides.where(F.col("side") == side).select("key", "zone", "cut", "edges", F.struct(F.col("before")[0].alias("before"), "starts", "ends", "ids").alias(side))
    pairs = view("left").join(view("right").drop("cut", "edges"), ["key", "zone"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tokens, ok = [], [], []
            for row in batch.to_pylist():
                left, right = (tuple(row[s][c] for c in ("before", "starts", "ends", "ids")) for s in ("left", "right"))
                found = splice(row["cut"], left, right, row["edges"])
                keys.append(row["key"])
                ok.append(found is not None)
                tokens.append(found[0] - found[1] if found else 0)
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(tokens, pa.int64()), pa.array(ok, pa.bool_())], names=["key", "n_tokens", "ok"])

    zones = pairs.mapInArrow(match, "key string, n_tokens long, ok boolean")
    totals = sides.where("side = 'total'").select("key", F.col("total").alias("n_tokens"), F.lit(True).alias("ok"))
    return zones.unionByName(totals).groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"), F.min("ok").alias("ok"))
