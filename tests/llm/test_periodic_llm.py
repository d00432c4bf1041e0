"""Periodic runs against brute force over all starts and periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sitelens.llm import periodic
from sitelens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every stretch of equal words at a lag; of equal stretches the smallest period."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def rebuilt(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    words = rebuilt(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(kept))


def words_with_runs(rnd, n, letters):
    out = []
    while len(out) < n:
        kind = rnd.random()
        if kind < 0.4:
            out += [rnd.choice(letters) for _ in range(rnd.randint(1, 30))]
        else:
            unit = [rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 11, 16, 17, 31, 32, 33, 48, 64, 65, 90]))]
            out += (unit * 9)[: rnd.randint(2 * len(unit), 9 * len(unit))]
    return out[:n]


@pytest.mark.parametrize("letters", [2, 3, 40, 4000])
def test_every_run_of_random_texts(letters):
    rnd = random.Random(letters)
    alphabet = [f"w{i}" for i in range(letters)]
    texts = [words_with_runs(rnd, n, alphabet) for n in [0, 1, 5, 6, 7, 8, 40, 200, 700, 1500, 0, 3000]]
    number = {w: i for i, w in enumerate(alphabet)}
    ids = np.array([number[w] for t in texts for w in t], np.int64)
    offsets = np.cumsum([0, *map(len, texts)])
    want = [(t, *r) for t, words in enumerate(texts) for r in brute_runs(words)]
    assert periodic.runs_of_words(ids, offsets) == want and want


def test_neighbouring_texts_do_not_join():
    ids = np.array([1] * 5 + [1] * 5 + [1, 2] * 3 + [1, 2] * 4, np.int64)
    assert periodic.runs_of_words(ids, np.array([0, 5, 10, 16, 24])) == [(3, 0, 8, 2)]


def test_long_periods():
    rnd = random.Random(3)
    for q in (127, 128, 129, 511, 513, 1000, 2048):
        unit = [rnd.randrange(1 << 30) for _ in range(q)]
        words = np.array([*range(-7, 0), *(unit * 4), -100, *range(-300, -200)], np.int64) + (1 << 20)
        assert periodic.runs_of_words(words, np.array([0, len(words)])) == [(0, 7, 4 * q, q)]
        assert periodic.runs_of_words(words[: 7 + 4 * q - 1], np.array([0, 4 * q + 6])) == []


def test_cases_columns_and_query(spark):
    rnd = random.Random(8)
    line = "you may not copy this\n"
    huge = " ".join(words_with_runs(rnd, 30000, [f"v{i}" for i in range(900)]))
    texts = [None, "", "   \t\n", "a " * 6, "a " * 5, "a\x0bb\x0ca\rb " * 9, line * 12, "x" * 100000, "é ö " * 20 + "end", "ab ab ab " * 6]
    rows = [(i, t, "k", 1, 5, "c") for i, t in enumerate(texts)] + [(3, texts[3], "k", 1, 5, "c"), (None, line * 8, None, None, None, None), (-5, line * 8, "k", 1, 5, "c")]
    rows += [(200 + i, " ".join(words_with_runs(rnd, 60, "abc")), "k", 1, 2, "c") for i in range(40)]
    schema = "doc_id long, text string, source_text string, runs int, N_Words int, extra string"
    df = spark.createDataFrame(rows, schema)
    out = periodic.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "source_text", "extra", "n_words", "runs", "collapsed"]
    for r in out.collect():
        words = WORD.findall(r["text"] or "")
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == brute_runs(words)
    digests = periodic.run_digests(periodic.periodic_runs(df.withColumn("text", periodic.repeated_tail())))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, digests.collect()), key=key) == sorted((brute_row(r[0], r[1]) for r in rows), key=key)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    one = periodic.periodic_runs(spark.createDataFrame([(1, huge)], "doc_id long, text string")).first()
    inside = lambda runs: [tuple(x) for x in runs if x[0] + x[1] < 6000]
    assert len(one["runs"]) > 100 and inside(one["runs"]) == inside(brute_runs(huge.split()[:6000]))


def test_query_over_given_documents(spark):
    want = [brute_row(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op11_periodic_runs"](spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(got.dtypes)["exponent_milli"] == dict(got.dtypes)["start"] == dict(got.dtypes)["n_runs"] == "bigint"
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(r[1] for r in want)
