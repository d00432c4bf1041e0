"""Token ids of whole texts, batch-wise, with a public tokenizer file.

The library encodes about one megabyte a second, mostly in the merges of
words it has met before.  For a tokenizer whose pre-tokenizer drops white
space, the encoding of a text is the concatenation of the encodings of its
white-space separated words: no pre-token, merge, normalisation or special
string reaches over white space.  Such words are encoded by the library once
per process and looked up afterwards; other tokenizers get whole texts.
A full stop or comma between a letter and white space is a pre-token of its
own, so it is set apart first, and A-Z are lower-cased first where the
tokenizer does so anyway (texts that may hold special strings excepted).
"""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a process keeps; a full cache starts afresh.
CACHE_WORDS = 400_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20


def default_vocabulary() -> str:
    """The path of the word-level BPE file among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and up in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (i for i in range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


BYTE_CHARS = _byte_chars()


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def drops_white_space(tokenizer) -> bool:
    """Whether the pre-tokenizer keeps only matches of a pattern without white space."""
    spec = json.loads(tokenizer.to_str())
    first = spec.get("pre_tokenizer") or {}
    for step in first.get("pretokenizers", [first]):
        if step.get("type") == "Split" and step.get("behavior") == "Removed" and step.get("invert"):
            pattern = step.get("pattern", {}).get("Regex", "")
            glued = any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec.get("added_tokens", []))
            return "[^\\s" in pattern and "\\s+" not in pattern and " ?" not in pattern and not glued
        return False
    return False


class TextEncoder:
    """Encodes Arrow string arrays into flat id arrays."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = load_tokenizer(path)
        self.by_word = drops_white_space(self.tokenizer)
        self.lowers = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str()).get("normalizer"))
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self._slot: dict[str, int] = {"": 0}
        self._start = np.zeros(1 << 16, np.int64)
        self._size = np.zeros(1 << 16, np.int64)
        self._ids = np.zeros(1 << 18, np.uint32)
        self._used = 0

    def _library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add words with their ids, laid end to end."""
        slot, n = len(self._slot), len(words)
        while slot + n > len(self._start):
            self._start, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._size))
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._start[slot : slot + n] = self._used + np.cumsum(sizes) - sizes
        self._size[slot : slot + n] = sizes
        self._ids[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        self._slot.update(zip(words, range(slot, slot + n), strict=True))

    def _learn(self, words: list[str]) -> None:
        """Encode new words.  Letters of the Latin blocks alone are one pre-token: lower-cased and spelled in the
        byte-level alphabet they go to the library's model directly; all other words go through the whole library."""
        plain, spelled, other = [], [], []
        for w in words:
            if self.lowers and w.isalpha() and max(w) < "\u0180" and "\u0130" not in w and is_normalized("NFC", w):
                plain.append(w)
                spelled.append(w if w.isascii() and w.islower() else "".join(map(BYTE_CHARS.__getitem__, w.lower().encode())))
            elif w not in self._slot:
                other.append(w)
        tokenize = self.tokenizer.model.tokenize
        rows = [[t.id for t in tokenize(w)] for w in spelled] + self._library(other)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self._keep(plain + other, np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum())), sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i+1]]; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            rows = self._library(texts.to_pylist())
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter((i for r in rows for i in r), np.uint32, int(sizes.sum()))
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        if self.lowers:
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,])(\s|$)", r"\1 \2\3")
        words = pc.ascii_split_whitespace(texts)
        per_text = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        if len(coded) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [w for w in names if w not in self._slot]
        if len(self._slot) + len(missing) > self.cache_words and len(self._slot) > 1:
            self._reset()
            missing = names
        if missing:
            self._learn(missing)
        slot = self._slot
        slots = np.fromiter(map(slot.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self._size[slots]
        ends = np.cumsum(sizes)
        where = np.repeat(self._start[slots] - (ends - sizes), sizes)
        where += np.arange(len(where), dtype=np.int64)
        return self._ids[where], np.concatenate([[0], ends])[per_text]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


@lru_cache(maxsize=1)
def lean_memory() -> None:
    """Make this worker return what it frees: large arrays by mappings of their own, Arrow's buffers by the same allocator.

    A worker serves many tasks, and memory that it keeps between them counts
    against its executor.  Where the C library has no such settings, nothing changes.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        library = ctypes.CDLL(None)
        for option, value in ((-3, 1 << 20), (-1, 1 << 20), (-8, 2)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            library.mallopt(option, value)
    except (OSError, AttributeError):
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text (one row at least)."""
    lean_memory()
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(run)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end_id`` after each."""
    out = np.insert(ids, offsets[1:], np.uint32(end_id))
    return out, offsets + np.arange(len(offsets))


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary array whose row i holds the bytes of values[offsets[i]:offsets[i+1]]."""
    values = np.ascontiguousarray(values)
    at = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def id_type(path: str) -> str:
    """The narrowest little-endian integer that holds the vocabulary's ids."""
    return "<u2" if load_tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"
