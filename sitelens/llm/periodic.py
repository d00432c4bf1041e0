"""Periodic run detection over the words of whole texts, with multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q and at least
``max(MIN_WORDS, MIN_PERIODS * q)`` words that no neighbouring word extends
keeping that period.  All runs of a text are found:

* Periods up to ``DIRECT`` words are too short for windows of their own: each
  such lag is scanned directly over the whole batch.
* Every scale k = 16, 32, 64, ... finds the periods of k/2+1 to k words.  Each
  block of k consecutive words has a name (names double from scale to scale),
  and of every k/2 consecutive blocks the one with the least name is selected.
  A run of such a period q holds two windows q words apart with the same
  content, so whatever one selects the other selects q words later; and since
  a block of k >= q words recurs inside the run only at multiples of q, the two
  are neighbours among the selected blocks of that name.  Neighbouring equal
  minimizers at a distance within the scale's periods are the seeds.
* A seed (place, distance) is extended to both sides, comparing words at that
  distance, to the whole stretch with this period.  Of equal stretches the one
  with the smallest period is the run: by the periodicity lemma the others'
  periods are its multiples.

Words are compared by exact numbers of a batch's dictionary; names are hashes
that only propose seeds, and every seed is verified word by word.  The work is
linear in the words at each scale, and a text takes part in a scale only if it
is long enough for its shortest period.

Rows are independent, so nothing is shuffled and no key can be hot.  A task
holds about ``SLICE_BYTES`` of text at once, or one longer text.

Defined cases: null and empty texts have no words, no runs and an empty
collapsed text; repeated rows give equal rows; an empty table gives no rows;
all columns of the input stay, and a column that has the name of a new one is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.storage import free_name
from sitelens.llm.tokens import slices
from sitelens.llm.words import mix

MIN_WORDS, MIN_PERIODS = 6, 4
#: Lags that are scanned directly; the first scale begins above.
DIRECT = 8
SLICE_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_NONE = np.uint64((1 << 64) - 1)


def least_words(period: int) -> int:
    return max(MIN_WORDS, MIN_PERIODS * period)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _direct(ids: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) for the short periods."""
    for q in range(1, min(DIRECT, len(ids) // MIN_PERIODS) + 1):
        same = (ids[q:] == ids[:-q]) & (text[q:] == text[:-q])
        first, end = _stretches(same)
        long = end - first + q >= least_words(q)
        for a, b in zip(first[long].tolist(), end[long].tolist(), strict=True):
            yield a, b + q, q


def _selected(names: np.ndarray, window: int) -> np.ndarray:
    """Places whose name is the least of some ``window`` neighbouring ones, by running minima of blocks."""
    n = len(names)
    window = min(window, n)

    def sliding(x: np.ndarray, best, fill) -> np.ndarray:
        blocks = np.concatenate([x, np.full(-len(x) % window, fill, x.dtype)]).reshape(-1, window)
        before = best.accumulate(blocks, axis=1).ravel()
        after = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return best(after[: len(x) - window + 1], before[window - 1 : len(x)])

    least = sliding(names, np.minimum, _NONE)
    # a place is selected where the greatest of the minima of its windows is its own name
    padded = np.concatenate([np.zeros(window - 1, names.dtype), least, np.zeros(window - 1, names.dtype)])
    return np.flatnonzero((sliding(padded, np.maximum, np.uint64(0)) == names) & (names != _NONE))


def _extended(ids: np.ndarray, first: int, end: int, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` in which words ``lag`` apart are equal, within a text's words first:end."""

    def reach(forward: bool) -> int:
        done, step = 0, 64
        room = end - lag - at if forward else at - first
        while done < room:
            take = min(step, room - done)
            if forward:
                x = ids[at + done : at + done + take] == ids[at + lag + done : at + lag + done + take]
            else:
                x = (ids[at - done - take : at - done] == ids[at + lag - done - take : at + lag - done])[::-1]
            wrong = int(np.argmin(x))
            if not x[wrong]:
                return done + wrong
            done, step = done + take, step * 2
        return done

    return at - reach(False), at + lag + reach(True)


def _scaled(ids: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) for the periods above ``DIRECT``, scale by scale; shorter texts drop out on the way."""
    sizes = np.diff(offsets)
    names, width = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids))
    while len(names):
        # names of blocks twice as wide; a block that runs over its text's end gets none
        if len(names) <= width:
            return
        wide = np.full(len(names), _NONE)
        whole = place[: len(names) - width] + 2 * width <= offsets[owner[: len(names) - width] + 1]
        joined = mix(names[:-width] * np.uint64(0x9E3779B97F4A7C15) + np.roll(names, -width)[:-width])
        joined[joined == _NONE] = 0
        wide[: len(names) - width][whole] = joined[whole]
        names, width = wide, 2 * width
        if width < 2 * DIRECT:
            continue
        enough = (sizes >= MIN_PERIODS * (width // 2 + 1))[owner]
        if not enough.all():
            names, owner, place = names[enough], owner[enough], place[enough]
        if len(names) == 0:
            return
        at = _selected(names, width // 2)
        order = at[np.lexsort((at, names[at]))]
        a, b = order[:-1], order[1:]
        lag = place[b] - place[a]
        seed = (names[a] == names[b]) & (owner[a] == owner[b]) & (lag > width // 2) & (lag <= width)
        a, lag = a[seed], lag[seed]
        order = np.lexsort((a, lag))
        known, until = 0, -1
        for i in order.tolist():
            p, q = int(place[a[i]]), int(lag[i])
            if q == known and p < until:
                continue
            t = owner[a[i]]
            start, end = _extended(ids, int(offsets[t]), int(offsets[t + 1]), p, q)
            known, until = q, end - q
            if end - start >= least_words(q):
                yield start, end, q


def runs_of_words(ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of every run, in order; text t has the words ids[offsets[t]:offsets[t+1]]."""
    if len(ids) == 0:
        return []
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    best: dict[tuple[int, int], int] = {}
    for found in (_direct(ids, text), _scaled(ids, offsets)):
        for start, end, q in found:
            best[start, end] = min(q, best.get((start, end), q))
    rows = [(int(text[start]), start, end, q) for (start, end), q in best.items()]
    return sorted((t, start - int(offsets[t]), end - start, q) for t, start, end, q in rows)


def _batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """(word numbers, offsets, dictionary) of a batch, exact."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    owner = owner[some.to_numpy(zero_copy_only=False)]
    coded = words.filter(some).dictionary_encode()
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, coded.dictionary.to_pylist()


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words, joined by one space, without those that
    some run contains after its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for whole in batches:
            for batch in slices(whole, source, SLICE_BYTES):
                ids, offsets, names = _batch_words(batch.column(source))
                found: list[list] = [[] for _ in range(batch.num_rows)]
                keep = np.ones(len(ids), bool)
                for t, start, length, q in runs_of_words(ids, offsets):
                    found[t].append({"start": start, "length": length, "period": q})
                    a = int(offsets[t]) + start
                    keep[a + q : a + length] = False
                words = np.array(names, object)[ids] if len(ids) else np.zeros(0, object)
                collapsed = [" ".join(words[a:b][keep[a:b]]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [batch.column(c) for c in old] + [pa.array(np.diff(offsets)), pa.array(found, kind), pa.array(collapsed, pa.string())]
                yield pa.record_batch(columns, names=[*old, "n_words", "runs", "collapsed"])

    stay = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    source = free_name(docs.columns, "source_text")
    rows = docs.select(*(F.col(f"`{c}`") for c in stay), F.col(f"`{text}`").cast("string").alias(source))
    old = stay
    schema = T.StructType([*(docs.schema[c] for c in stay), *T._parse_datatype_string(f"n_words bigint, runs {RUNS}, collapsed string").fields])
    return rows.mapInArrow(run, schema)


def repeated_tail(ident: str = "doc_id", text: str = "text") -> Column:
    """The text in which, for one in ten ids, the words from some word on repeat the first p of them.

    With h = crc32(decimal id), g = floor(h / 10), n words: where h % 10 = 0 and
    n > 0, each word i >= a becomes word a + (i - a) % p, with a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)).  Other texts, and those of null ids, stay.
    """
    h = F.crc32(F.col(ident).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.expr(f"regexp_extract_all(`{text}`, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")

    def rebuilt(w: Column, i: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")

    # a one-element array names the word list once, so that it is split once
    whole = F.transform(F.array(words), lambda w: F.array_join(F.transform(w, lambda x, i: F.get(w, rebuilt(w, i))), " "))[0]
    return F.when((h % 10 == 0) & F.col(f"`{text}`").isNotNull(), whole).otherwise(F.col(f"`{text}`").cast("string"))


def run_digests(rows: DataFrame) -> DataFrame:
    """``doc_id``, the number of runs, the run of the greatest length/period, and digests of all runs and of ``collapsed``."""
    better = lambda x, y: (x["length"] * y["period"]) > (y["length"] * x["period"])
    # runs come by start, then period: of equal ones the first stays
    top = F.aggregate(F.slice("runs", 2, 1 << 30), F.get("runs", F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    milli = F.expr("(1000 * top.length) div top.period")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return rows.withColumn("top", top).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        milli.alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
