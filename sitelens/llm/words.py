"""Words and their hashes for a whole Arrow batch at once.

A word is a run of bytes other than space, tab, newline, vertical tab, form
feed and carriage return; UTF-8 keeps those bytes out of other characters.  A
word's hash is a polynomial over 64-bit random values of its bytes, mixed at
the end, so one pass over the batch's buffer hashes all of its words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEED = 20240229
_RNG = np.random.default_rng(SEED)
#: One random odd value a byte; white space is 0, so it adds nothing to a run of bytes.
BYTE_VALUES = _RNG.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUES[[9, 10, 11, 12, 13, 32]] = 0
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = FOLDED_VALUES[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE_VALUES = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; up to 2**20 of them are kept, longer tables only as long as they are used."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) == 1 << 20:
            _POWERS[name] = have
    return have[:n]


class Words(NamedTuple):
    """``data`` holds the batch's bytes; word i lies at starts[i]:ends[i]; text t has words offsets[t]:offsets[t+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def split_words(texts: pa.Array) -> Words:
    """The words of all texts; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, body = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(texts) + 1, np.int64))
    word = ~(((data - np.uint8(9)) < 5) | (data == 32))
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~word[:-1]
    fresh[at[:-1][at[:-1] < len(data)]] = True
    last = np.ones(len(data), bool)
    last[:-1] = fresh[1:] | ~word[1:]
    starts, ends = np.flatnonzero(word & fresh), np.flatnonzero(word & last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def word_hashes(words: Words, fold: bool = True) -> np.ndarray:
    """A hash a word; ``fold`` makes A-Z equal to a-z."""
    if len(words.starts) == 0:
        return np.zeros(0, np.uint64)
    values = (FOLDED_VALUES if fold else BYTE_VALUES)[words.data]
    values *= _powers("up", BASE, len(values))
    # between words there is only white space (0), or another text, whose words start runs of their own
    sums = np.add.reduceat(values, words.starts)
    return mix(sums * _powers("down", BASE_INVERSE, len(values))[words.starts])


def span_hashes(words: Words, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash of each byte span, equal to ``word_hashes`` where the span is a word."""
    values = (FOLDED_VALUES if fold else BYTE_VALUES)[words.data]
    values *= _powers("up", BASE, len(values))
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    safe = np.minimum(starts, max(0, len(values) - 1))
    return mix((total[ends] - total[starts]) * _powers("down", BASE_INVERSE, max(1, len(values)))[safe])


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row (also those that run over a text's end)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += hashes[k : k + m] * PLACE_VALUES[k]
    return mix(total)


def short_hash(hashes: np.ndarray) -> np.uint64:
    """A hash of a whole text of fewer words than a window."""
    return mix(np.array([(hashes * PLACE_VALUES[: len(hashes)]).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0]
