"""Benchmark decontamination by template canonicalisation.

A word becomes a typed placeholder if it is a number, a unit of measure or a
name (capitalised other than at the start of a sentence or line); other words
are literal, without case and edge punctuation.  Windows of ``WINDOW``
template words with at least ``MIN_LITERAL`` literal ones are joined by hash
between documents and benchmark items.  All windows are joined by the hash of
their words as well, names, numbers and units included, so copies of any words
and in any case are found.  A hit by templates also covers the words of the
windows without enough literals that lie next to it, as far as their templates
are equal; hits on one alignment that overlap or touch chain into a run, once
with all of this and once by templates alone.  A run counts if it has ``MIN_RUN`` words, or all words but
one of a shorter item (its first word looks like a name where a document has
it inside a sentence), whose slots are consistent: equal values of the item
stand for equal values of the document.  A run with a conflict is cut there:
it counts with the longest stretch whose slots hold the item's own values
(``exact``), or, if that is too short, with its longest consistent stretch
(``reparametrised``).  An item of
fewer than ``WINDOW`` words is found where a document has all its words in a row.

A stock phrase that many items and documents share must not join all of them.
A run lies within a chain of a document's hits, so hits in a chain with fewer
words than an item asks for are not joined with it.  Windows of more than
``COMMON`` index rows are looked up only for a document, item and shift that a
rarer window has met already, and where common windows alone make up a chain
that is long enough: then every join row may be part of a run.

Before the join a bitmap of the benchmark's window hashes drops the windows
of documents that cannot hit.  It has 32 bits a window, within 2**16 and
2**28 bits, and is built in the cluster by blocks of 4 KB, so at most 32 MB
reach the driver and the tasks at any size of the benchmark.

Defined cases: null or empty texts and items have no windows; a null ``doc_id`` stays null;
repeated rows give one hit an item; an empty table gives no hits; further
columns are ignored by ``contaminated`` and kept by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.storage import free_name, kept, scratch, written
from sitelens.llm.tokens import slices
from sitelens.llm.words import Words, mix, span_hashes, split_words, window_hashes

WINDOW = 5
MIN_LITERAL = 3
MIN_RUN = 13
#: Index rows of a window from which on it is looked up by alignments.
COMMON = 64
LEAST_BITS, MOST_BITS, BLOCK_BITS = 16, 28, 15
#: Bytes of text whose words are hashed at once.
SLICE_BYTES = 1 << 20
#: A side of at most so many rows of one number, counted first, may be broadcast.
BROADCAST_ROWS = 1_000_000

# Units of measure, currency and time.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mile miles ft feet inch inches yd yards l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "km/h mph kph m/s usd eur gbp dollar dollars euro euros pound pounds cent cents percent degree degrees watt watts volt volts"
).split()
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x9A3F00000000001, 0x9A3F00000000002, 0x9A3F00000000003))
#: A window: hash, whether by template, first word, slot values; templates and slot values of the unsearched words to its left (nearest first) and right.
ROW = "h long, templated boolean, pos int, slots array<long>, left array<long>, left_slots array<long>, right array<long>, right_slots array<long>"
ROW_NAMES = [c.split()[0] for c in ROW.split(", ")]
LEADING, TRAILING = b"\"'([{$<*#&|%", b".,;:!?\"')]}%>*#&|$"


def _lookup(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


IS_LEADING, IS_TRAILING, IS_STOP = _lookup(LEADING), _lookup(TRAILING), _lookup(b".!?:\n")


def _unit_hashes() -> np.ndarray:
    words = split_words(pa.array([" ".join(UNITS)]))
    return np.sort(span_hashes(words, words.starts, words.ends))


def folded(texts: pa.Array) -> pa.Array:
    """The texts in one case, word for word."""
    return pc.replace_substring(pc.utf8_lower(pc.utf8_upper(pc.replace_substring(texts.cast(pa.large_string()), "ß", "ss"))), "ẞ", "ss")


def templates(words: Words, unit_hashes: np.ndarray, same_case: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, slot value or 0, hash) of every word; ``same_case`` are the words of the folded texts."""
    data, starts, ends = words.data, words.starts.copy(), words.ends.copy()
    if len(starts) == 0:
        return (np.zeros(0, np.uint64),) * 3
    for _ in range(4):
        inner = ends - starts > 1
        starts += inner & IS_LEADING[data[starts]]
        inner = ends - starts > 1
        ends -= inner & IS_TRAILING[data[ends - 1]]
    value = span_hashes(same_case, same_case.starts + starts - words.starts, same_case.ends + ends - words.ends)
    first, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    opens = np.zeros(len(starts), bool)  # at the start of a text, line or sentence
    opens[words.offsets[:-1][words.offsets[:-1] < len(starts)]] = True
    opens[1:] |= IS_STOP[data[words.ends[:-1] - 1]] | _newline_between(words)
    number = (first >= 48) & (first <= 57)
    unit = np.isin(value, unit_hashes) & ~number
    name = capital & ~opens & ~unit
    out = value.copy()
    out[number], out[unit], out[name] = NUMBER, UNIT, NAME
    return out, np.where(number | unit | name, value, np.uint64(0)), value


def _newline_between(words: Words) -> np.ndarray:
    lines = np.concatenate([[0], np.cumsum(words.data == 10)])
    return lines[words.starts[1:]] > lines[words.ends[:-1]]


class Windows(NamedTuple):
    """Hash, text and place of some windows."""

    hashes: np.ndarray
    text: np.ndarray
    place: np.ndarray

    def where(self, some: np.ndarray) -> Windows:
        return Windows(*(x[some] for x in self))


def text_windows(texts: pa.Array, unit_hashes: np.ndarray) -> tuple[Windows, Windows, np.ndarray, np.ndarray, Words]:
    """(windows by template, windows by their words where that hash differs, template and slot value of every word, words)."""
    words = split_words(texts)
    hashes, slots, values = templates(words, unit_hashes, split_words(folded(texts)))
    place = np.arange(max(0, len(hashes) - WINDOW + 1))
    text = np.searchsorted(words.offsets, place, side="right") - 1
    slots_before = np.concatenate([[0], np.cumsum(slots != 0)])
    whole = place + WINDOW <= words.offsets[text + 1]
    n_slots = slots_before[place + WINDOW] - slots_before[place]
    by_template = Windows(window_hashes(hashes, WINDOW), text, place).where(whole & (WINDOW - n_slots >= MIN_LITERAL))
    by_words = Windows(window_hashes(values, WINDOW), text, place).where(whole & (n_slots > 0))
    return by_template, by_words, hashes, slots, words


def _lists(values: np.ndarray, start: np.ndarray, n: np.ndarray, step: int = 1) -> pa.ListArray:
    """Lists of ``n`` values from ``start`` on."""
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(start, n) + step * (np.arange(ends[-1]) - np.repeat(ends[:-1], n))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[at].view(np.int64)))


def _chains(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words of the chain of overlapping or touching spans of one text that each span belongs to."""
    if len(text) == 0:
        return np.zeros(0, np.int64)
    order = np.lexsort((start, text))
    t, a = text[order], start[order]
    reach = np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (a[1:] > reach[:-1])]))
    last = np.append(first[1:], len(t)) - 1
    out = np.empty(len(t), np.int64)
    out[order] = np.repeat(reach[last] - a[first], last - first + 1)
    return out


def _rows(texts: pa.Array, keep=None, least: int = 0) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """(text of each row, words of its chain, rows of ``ROW``) of the windows that ``keep`` lets through, in chains of ``least`` words."""
    templated, plain, hashes, slots, words = text_windows(texts, _unit_hashes())
    text, place = templated.text, templated.place
    first, last = words.offsets[text], words.offsets[text + 1]
    new_text = np.ones(len(text) + 1, bool)
    new_text[1:-1] = text[1:] != text[:-1]
    # words that only windows without enough literals have, back to the window before and on to the next
    n_left = place - np.where(new_text[:-1], first, np.roll(place, 1) + 1)
    n_right = np.where(new_text[1:], last, np.roll(place, -1) + WINDOW - 1) - place - WINDOW
    if keep is not None:
        some = keep(templated.hashes)
        templated, n_left, n_right = templated.where(some), n_left[some], n_right[some]
        plain = plain.where(keep(plain.hashes))
    h, text, place = (np.concatenate(x) for x in zip(templated, plain, strict=True))
    by_template = np.arange(len(h)) < len(n_left)
    n_left, n_right = (np.concatenate([n, np.zeros(len(plain.place), np.int64)]) for n in (n_left, n_right))
    chain = _chains(text, place - n_left, place + WINDOW + n_right)
    if least:
        some = chain >= least
        h, text, place, by_template, n_left, n_right, chain = (x[some] for x in (h, text, place, by_template, n_left, n_right, chain))
    left, right = (place - 1, n_left, -1), (place + WINDOW, n_right)
    lists = [_lists(slots, place, np.full(len(place), WINDOW)), _lists(hashes, *left), _lists(slots, *left), _lists(hashes, *right), _lists(slots, *right)]
    pos = (place - words.offsets[text]).astype(np.int32)
    return text, chain, pa.record_batch([pa.array(h.view(np.int64)), pa.array(by_template), pa.array(pos), *lists], names=ROW_NAMES)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_words and ``ROW``) of the benchmark's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                text, _, rows = _rows(batch.column("text"))
                size = np.diff(split_words(batch.column("text")).offsets)[text]
                yield pa.record_batch([batch.column("item_id").take(pa.array(text)), pa.array(size.astype(np.int32)), *rows.columns], names=["item_id", "item_words", *ROW_NAMES])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, f"item_id long, item_words int, {ROW}")


def window_bitmap(windows: DataFrame) -> tuple[np.ndarray, int]:
    """(bytes, bits) of the bitmap of window hashes, put together from blocks."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(32 * windows.count()).bit_length()))
    cells = windows.select(F.expr(f"h & {(1 << bits) - 1}").alias("cell")).distinct()

    def block(keys: tuple, table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << BLOCK_BITS, np.uint8)
        flags[table.column("cell").to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        return pa.table({"block": [keys[0].as_py()], "flags": [np.packbits(flags).tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    blocks = cells.withColumn("block", F.shiftright("cell", BLOCK_BITS)).groupBy("block").applyInArrow(block, "block long, flags binary")
    size = 1 << (BLOCK_BITS - 3)
    for r in blocks.collect():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["flags"], np.uint8)
    return out, bits


def _kept_by(bitmap: np.ndarray, bits: int):
    """Which hashes the bitmap has."""

    def keep(h: np.ndarray) -> np.ndarray:
        cell = h & np.uint64((1 << bits) - 1)
        return (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1

    return keep


def _document_windows(docs: DataFrame, bitmap: np.ndarray, bits: int, least: int) -> DataFrame:
    """(doc_id, key, chain and ``ROW``) of the documents' windows that the bitmap has, in chains of ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _kept_by(bitmap, bits)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                text, chain, rows = _rows(batch.column("text"), keep, least)
                at = pa.array(text)
                yield pa.record_batch([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(chain.astype(np.int32)), *rows.columns], names=["doc_id", "key", "chain", *ROW_NAMES])

    return docs.mapInArrow(run, f"doc_id long, key long, chain int, {ROW}")


def _whole_words(texts: pa.Array, sizes: list[int], whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words, hash) of every ``sizes`` words in a row; ``whole`` only where they are the whole text."""
    words = split_words(texts)
    _, _, values = templates(words, _unit_hashes(), split_words(folded(texts)))
    found = []
    for n in sizes:
        place = np.arange(max(0, len(values) - n + 1))
        text = np.searchsorted(words.offsets, place, side="right") - 1
        fits = place + n <= words.offsets[text + 1]
        if whole:
            fits &= (place == words.offsets[text]) & (place + n == words.offsets[text + 1])
        found.append((text[fits], place[fits] - words.offsets[text[fits]], np.full(int(fits.sum()), n), mix(window_hashes(values, n)[fits] + np.uint64(n))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def short_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """Runs like ``runs`` of items of fewer than ``WINDOW`` words, joined whole; None if there are no such items."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                text, _, n, h = _whole_words(batch.column("text"), list(range(1, WINDOW)), True)
                yield pa.record_batch([batch.column("item_id").take(pa.array(text)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64))], names=["item_id", "words", "h"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    index = written(rows.mapInArrow(items, "item_id long, words int, h long"), "short-items")
    sizes = sorted(r["words"] for r in index.select("words").distinct().collect())  # at most four
    if not sizes:
        return None
    bitmap, bits = window_bitmap(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _kept_by(bitmap, bits)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                text, pos, _, h = _whole_words(batch.column("text"), sizes, False)
                some = keep(h)
                text, pos, h = text[some], pos[some], h[some]
                _, first = np.unique(np.stack([text.view(np.uint64), h], 1), axis=0, return_index=True)  # a text's first of each
                first.sort()
                at = pa.array(text[first])
                yield pa.record_batch([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(pos[first].astype(np.int32)), pa.array(h[first].view(np.int64))], names=["doc_id", "key", "start", "h"])

    found = docs.mapInArrow(run, "doc_id long, key long, start int, h long").dropDuplicates(["key", "h"])
    hits = found.join(index, "h")
    return hits.select("doc_id", "key", "item_id", "start", "words", F.col("words").alias("item_words"), F.lit(True).alias("exact"))


def counting_stretch(start: int, end: int, slots: list[tuple[int, int, int]], least: int) -> tuple[int, int, bool]:
    """(start, words, whether exact) of the stretch of start:end that a run counts with.

    ``slots`` are (position, item value, document value) in order.  All of it if
    no item value stands for two values; else the longest stretch whose slots
    hold the item's own values, if it has ``least`` words; else the longest one
    without a conflict.  Of equally long stretches the first.
    """
    pairs = {(b, d) for _, b, d in slots}
    if len({b for b, _ in pairs}) == len(pairs):
        return start, end - start, all(b == d for b, d in pairs)
    edges = [start, *(x for pos, b, d in slots if b != d for x in (pos, pos + 1)), end]
    a, z = max(zip(edges[::2], edges[1::2], strict=True), key=lambda c: (c[1] - c[0], -c[0]))
    if z - a >= least:
        return a, z - a, True
    cuts, left, latest = [], start, {}
    for pos, b, d in slots:
        before = latest.get(b)
        if before is not None and before[0] != d and before[1] >= left:
            cuts.append((left, pos))
            left = before[1] + 1
        latest[b] = (d, pos)
    cuts.append((left, end))
    a, z = max(cuts, key=lambda c: (c[1] - c[0], -c[0]))
    return a, z - a, all(b == d for pos, b, d in slots if a <= pos < z)


def _stretches(grouped: DataFrame) -> DataFrame:
    """Each run cut to the stretch that it counts with."""
    columns = ["doc_id", "key", "item_id", "item_words", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, n, slots, least in zip(*(batch.column(c).to_pylist() for c in ("start", "words", "slots", "least")), strict=True):
                found.append(counting_stretch(a, a + n, [(x["at"], x["b"], x["d"]) for x in slots], least))
            parts = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))]
            yield pa.record_batch([*(batch.column(c) for c in columns), *parts], names=[*columns, "start", "words", "exact"])

    return grouped.select(*columns, "start", "words", "slots").mapInArrow(run, "doc_id long, key long, item_id long, item_words int, least int, start int, words int, exact boolean")


def _common(side: str) -> Column:
    """Leading words of ``side`` whose templates are equal in document and item."""
    same = F.zip_with(side, f"item_{side}", lambda d, b: F.coalesce(d == b, F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def _pairs(slots: str, place) -> Column:
    """(place, item value, document value) of the words of ``slots``; ``place`` gives that of the i-th."""
    zipped = F.arrays_zip(F.col(f"item_{slots}").alias("b"), F.col(slots).alias("d"))
    return F.transform(zipped, lambda x, i: F.struct(place(i).cast("int").alias("at"), x["b"].alias("b"), x["d"].alias("d")))


def _hits(found: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``found`` with the index rows of their window that can be part of a counting run."""
    fits = F.col("chain") >= F.col("least")
    shift = F.col("pos") - F.col("item_pos")
    often = written(index.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("h"), "common-windows")
    if often.isEmpty():
        return found.join(index, "h").where(fits).withColumn("shift", shift)
    rare = written(found.join(index.join(often, "h", "left_anti"), "h").where(fits).withColumn("shift", shift), "rare-hits")
    shared, common = written(found.join(often, "h", "left_semi"), "common-found"), index.join(often, "h", "left_semi")
    # alignments that a rarer window has met
    met = rare.select("key", "item_id", "shift").distinct()
    placed = shared.join(met, "key").withColumn("item_pos", F.col("pos") - F.col("shift"))
    again = placed.join(common, ["h", "item_id", "item_pos"]).select(rare.columns)
    # chains of common windows alone
    along = Window.partitionBy("key").orderBy("from", "pos", "h")
    spans = shared.withColumns({"from": F.col("pos") - F.size("left"), "to": F.col("pos") + WINDOW + F.size("right")})
    breaks = F.coalesce((F.col("from") > F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    spans = spans.withColumn("part", F.sum(breaks).over(along))
    whole = Window.partitionBy("key", "part")
    spans = spans.withColumn("chain", (F.max("to").over(whole) - F.min("from").over(whole)).cast("int")).drop("from", "to", "part")
    alone = spans.join(common, "h").where(fits).withColumn("shift", shift).select(rare.columns)
    return rare.unionByName(again).unionByName(alone)


def runs(docs: DataFrame, benchmark: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Stretches that count: ``doc_id, key, item_id, start, words, item_words, exact``."""
    least = F.least(F.lit(min_run), F.greatest(F.col("item_words") - 1, F.lit(WINDOW))).cast("int")
    index = written(benchmark_windows(benchmark).withColumn("least", least), "bench-windows")
    bitmap, bits = window_bitmap(index)
    shortest = index.agg(F.min("least")).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    found = written(_document_windows(rows, bitmap, bits, shortest), "doc-windows")
    hits = _hits(found, index.withColumnsRenamed({c: f"item_{c}" for c in ROW_NAMES[1:]}))
    # by words if either window is: all of them are equal then
    hits = hits.withColumn("templated", F.col("templated") & F.col("item_templated"))
    hits = hits.drop("h", "chain").dropDuplicates(["key", "item_id", "shift", "pos", "templated"])
    # once with all words that agree and once by templates alone, so that no slot outside these takes a run away
    hits = hits.withColumn("wide", F.explode(F.when(F.col("templated"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    left, right = (F.when(F.col("wide") & F.col("templated"), _common(side)).otherwise(F.lit(0)) for side in ("left", "right"))
    hits = hits.withColumns({"n_left": left, "n_right": right})
    hits = hits.withColumns({"from": F.col("pos") - F.col("n_left"), "to": F.col("pos") + WINDOW + F.col("n_right")})
    along = Window.partitionBy("key", "item_id", "shift", "wide").orderBy("pos")
    breaks = F.coalesce((F.col("from") > F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    chained = hits.withColumn("break", breaks).withColumn("run", F.sum("break").over(along))
    own_slots = _pairs("slots", lambda i: F.col("pos") + i)
    equal = lambda x: F.coalesce(F.greatest(F.nullif(x["b"], F.lit(0)), F.nullif(x["d"], F.lit(0))), F.lit(0))
    equals = F.transform(own_slots, lambda x: F.struct(x["at"].alias("at"), equal(x).alias("b"), equal(x).alias("d")))
    own = F.when(F.col("templated"), own_slots).otherwise(equals)
    before = F.slice(_pairs("left_slots", lambda i: F.col("pos") - 1 - i), F.lit(1), F.col("n_left"))
    after = F.slice(_pairs("right_slots", lambda i: F.col("pos") + WINDOW + i), F.lit(1), F.col("n_right"))
    pairs = F.filter(F.concat(own, before, after), lambda x: (x["b"] != 0) | (x["d"] != 0))
    # a run's slots are at most the words of its item
    grouped = chained.groupBy("doc_id", "key", "item_id", "item_words", "least", "shift", "wide", "run").agg(
        F.min("from").alias("start"),
        (F.max("to") - F.min("from")).alias("words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(pairs)))).alias("slots"),
    )
    long = _stretches(grouped.where("words >= least")).where("words >= least")
    out = long.select("doc_id", "key", "item_id", "start", "words", "item_words", "exact")
    short = short_items(rows, benchmark)
    return out if short is None else out.unionByName(short)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """One row a document and benchmark item that it holds, by the longest run."""
    with scratch(docs.sparkSession, "decontamination"):
        found = kept(runs(docs, benchmark, min_run), "benchmark-runs")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "exact", "start", "item_words")).alias("r"))
    kind = F.when(F.col("r.exact"), F.lit("exact")).otherwise(F.lit("reparametrised"))
    share = F.least(F.lit(1.0), F.col("r.words") / F.col("r.item_words"))
    return best.select("doc_id", "item_id", F.col("r.start").cast("long").alias("start_word"), F.col("r.words").cast("long").alias("n_words"), share.alias("item_share"), kind.alias("kind"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    with scratch(docs.sparkSession, "decontamination"):
        bad = kept(runs(docs, benchmark, min_run).select("key").distinct(), "contaminated-keys")
    small = bad.count() <= BROADCAST_ROWS
    key = free_name(docs.columns, "key")
    bad = bad.withColumnRenamed("key", key)
    marked = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return marked.join(F.broadcast(bad) if small else bad, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
