"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is bound
from its letters' vectors, each rotated by its place, by multiplication; a
text's profile bundles (adds) its trigrams' vectors; a language's prototype
bundles the profiles of its training texts, each at unit length.  A text gets
the language whose prototype has the largest cosine with its profile.

Letters are folded to lower case; a run of other characters is one gap.  The
letter vectors come from a generator seeded with the letter, so no table is
kept or shipped.

Training reads every labelled text except those whose ``crc32(doc_id) mod 3``
is 1.  Prediction reads every whole text and nothing but the text.

Defined cases: null text and text without a letter are ``und`` with score 0;
so is every text if there is nothing to learn from; a null ``doc_id`` is not
held out and not learned from; equal scores go to the first language in
order; repeated rows give equal rows; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.tokens import lean_memory

DIMENSIONS = 512
FOLDS, HELD_FOLD = 3, 1
GAP = 32
UNKNOWN = "und"
#: Trigram vectors that a process keeps; a full cache starts afresh.
CACHE_TRIGRAMS = 100_000
#: A text is rejected below this share of the least score among learned texts of its length class, of so many texts at least.
MARGIN, CLASS_ROWS = 0.8, 30


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1 << 16)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([20, 24, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


class Profiles:
    """Profiles of texts, with the trigram vectors met so far."""

    def __init__(self, dimensions: int = DIMENSIONS, cache: int = CACHE_TRIGRAMS):
        self.dimensions, self.cache = dimensions, cache
        self._reset()

    def _reset(self) -> None:
        self._keys = np.zeros(0, np.int64)
        self._rows = np.zeros(0, np.int64)
        self._vectors = np.zeros((min(self.cache, 1024), self.dimensions), np.float32)

    def _learn(self, keys: np.ndarray) -> None:
        used = len(self._keys)
        if used + len(keys) > len(self._vectors):  # room doubles, so few texts copy the table
            room = np.zeros((max(2 * len(self._vectors), used + len(keys)), self.dimensions), np.float32)
            room[:used] = self._vectors[:used]
            self._vectors = room
        for i, key in enumerate(keys.tolist(), used):
            a, b, c = (letter_vector((key >> s) & 0x1FFFFF, self.dimensions) for s in (42, 21, 0))
            self._vectors[i] = np.roll(a, 2) * np.roll(b, 1) * c
        rows = np.arange(used, used + len(keys))
        both, where = np.concatenate([self._keys, keys]), np.concatenate([self._rows, rows])
        order = np.argsort(both)
        self._keys, self._rows = both[order], where[order]

    def of(self, text: str | None) -> np.ndarray | None:
        """The profile of a text, or None if it has no letter."""
        return self.measured(text)[0]

    def measured(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """The profile and the number of trigrams of a text."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        is_letter = letters()[codes]
        if not is_letter.any():
            return None, 0
        codes[~is_letter] = GAP
        kept = is_letter.copy()
        kept[1:] |= is_letter[:-1]  # the first other character after a letter stays as the gap
        codes = codes[kept]
        codes = np.concatenate([[GAP], codes, np.full(int(codes[-1] != GAP), GAP)])
        keys, counts = np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)
        place = np.searchsorted(self._keys, keys)
        known = place < len(self._keys)
        known[known] = self._keys[place[known]] == keys[known]
        if not known.all():
            full = len(self._keys) + int((~known).sum()) > self.cache
            if full:
                self._reset()
            self._learn(keys if full else keys[~known])
            place = np.searchsorted(self._keys, keys)
        return counts.astype(np.float32) @ self._vectors[self._rows[place]], len(codes) - 2


def held_out() -> Column:
    """Whether a row belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """(text, lang) of every row that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """(languages, a unit prototype each), from all learnable rows."""
    return _prototypes(learnable(docs), dimensions)


def _prototypes(learned: DataFrame, dimensions: int) -> tuple[list[str], np.ndarray]:
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        profiles, sums = Profiles(dimensions), {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                v = profiles.of(text.as_py())
                if v is not None:
                    lang = lang.as_py()
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64) / max(np.linalg.norm(v), 1e-9)
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "v"])

    def add(keys: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer()) for v in table.column("v"))
        return pa.table({"lang": [keys[0].as_py()], "v": [total.tobytes()]})

    sums = learned.mapInArrow(bundle, "lang string, v binary").groupBy("lang").applyInArrow(add, "lang string, v binary").collect()
    sums = sorted((r["lang"], np.frombuffer(r["v"])) for r in sums)
    if not sums:
        return [], np.zeros((0, dimensions))
    stack = np.stack([v for _, v in sums])
    return [lang for lang, _ in sums], stack / np.maximum(np.linalg.norm(stack, axis=1, keepdims=True), 1e-9)


def judged(names: list[str], stack: np.ndarray, dimensions: int, profiles: Profiles, text: str | None) -> tuple[str, float, int]:
    """(language, score, number of trigrams) of a text."""
    v, n = profiles.measured(text) if names else (None, 0)
    if v is None:
        return UNKNOWN, 0.0, 0
    cosine = stack @ v.astype(np.float64) / max(float(np.linalg.norm(v)), 1e-9)
    i = int(np.argmax(cosine))
    return names[i], min(1.0, max(0.0, float(cosine[i]))), n


def languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    names, stack = prototypes(docs, dimensions)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        profiles = Profiles(dimensions)
        for batch in batches:
            found = [judged(names, stack, dimensions, profiles, t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64())]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def least_scores(learned: DataFrame, names: list[str], stack: np.ndarray, dimensions: int) -> dict[int, float]:
    """By length class (power of two of trigrams): ``MARGIN`` times the least score that a learned text of the class has.

    A class with fewer than ``CLASS_ROWS`` learned texts has no bound of its own.
    """
    if not names:
        return {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        profiles = Profiles(dimensions)
        for batch in batches:
            found = [judged(names, stack, dimensions, profiles, t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([pa.array([n.bit_length() for _, _, n in found], pa.int32()), pa.array([x for _, x, _ in found], pa.float64())], names=["size", "score"])

    scored = learned.select("text").mapInArrow(score, "size int, score double").where("size > 0")
    rows = scored.groupBy("size").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).collect()  # at most one a bit
    return {r["size"]: MARGIN * r["least"] for r in rows if r["n"] >= CLASS_ROWS}


def bound_of(n: int, bounds: dict[int, float]) -> float:
    """The bound for a text of n trigrams: that of its class, or of the next shorter class that has one."""
    return next((bounds[k] for k in range(n.bit_length(), 0, -1) if k in bounds), 0.0)


def known_language(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of ``docs`` in a language that was learned.  All columns stay.

    Rows go whose text has no letter, or whose score lies below anything that
    learned texts of like length have (``least_scores``): other languages, and
    letters that are no language.  Only the text goes through Python.
    """
    learned = learnable(docs)
    names, stack = _prototypes(learned, dimensions)
    bounds = least_scores(learned, names, stack, dimensions)

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean_memory()
        profiles = Profiles(dimensions)
        for texts in batches:
            found = [judged(names, stack, dimensions, profiles, t.as_py()) for t in texts]
            yield pa.array([lang != UNKNOWN and score >= bound_of(n, bounds) for lang, score, n in found], pa.bool_())

    return docs.where(known(F.col("text").cast("string")))
