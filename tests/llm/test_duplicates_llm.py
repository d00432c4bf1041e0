"""Jaccard classes, repeated passages and components against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitelens.llm import setjoin, storage, suffix
from sitelens.llm.graph import components

DOCS = "doc_id long, text string, key string, node long, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def joined(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def brute_classes(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(fold(text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    pairs = []
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                pairs.append((rows[i][0], rows[j][0]))
    label = joined(pairs, {d for d, _ in rows})
    return sorted((d, len(s), label[d]) for (d, _), s in zip(rows, sets, strict=True))


def found_classes(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], DOCS)
    return sorted(tuple(r) for r in setjoin.jaccard_classes(df, **options).select("doc_id", "n_shingles", "component_id").collect())


def hard_rows():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, rows = some(40), []
    for _ in range(25):
        base = some(rnd.randint(20, 110))
        for _ in range(rnd.randint(1, 12)):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            if rnd.random() < 0.3:
                w = passage + w
            if rnd.random() < 0.2:
                w += some(rnd.randint(1, 15))
            rows.append(" ".join(w))
    rows += [" ".join(passage + some(rnd.randint(3, 25))) for _ in range(50)]
    chain = some(150)
    for _ in range(40):
        rows.append(" ".join(chain))
        for _ in range(rnd.randint(1, 4)):
            chain[rnd.randrange(150)] = rnd.choice(words)
    rows += [rows[0]] * 5 + [None, "", " \n", "a b", "A  b", "a b c d", "x " * 30000, "X " * 40]
    ids = rnd.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("bits", [6, 20])
def test_classes_equal_brute_force(spark, bits):
    rows = hard_rows()
    assert found_classes(spark, rows, sketch_bits=bits) == brute_classes(rows)


def test_null_and_repeated_ids(spark):
    a, b, c = ("p q r s t u", "v w x y z a", "m n o p q r")
    df = spark.createDataFrame([(1, a, "", 0, 0), (1, b, "", 0, 0), (2, b, "", 0, 0), (None, a, "", 0, 0), (3, c, "", 0, 0), (3, c, "", 0, 0)], DOCS)
    got = sorted((tuple(r) for r in setjoin.jaccard_classes(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 2, 3), (3, 2, 3)], key=str)


def test_a_repeated_id_joins_components(spark):
    a, b, c = ("p q r s t u", "v w x y z a", "m n o p q r")
    df = spark.createDataFrame([(5, a, "", 0, 0), (5, b, "", 0, 0), (2, a, "", 0, 0), (3, b, "", 0, 0), (9, c, "", 0, 0)], DOCS)
    assert {r["doc_id"]: r["component_id"] for r in setjoin.jaccard_classes(df).collect()} == {2: 2, 3: 2, 5: 2, 9: 9}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert setjoin.jaccard_classes(empty).collect() == []
    assert setjoin.representatives(empty).collect() == []
    assert suffix.repeated_passages(empty).collect() == []


def test_representatives_keep_columns_and_one_of_each(spark):
    rows = hard_rows()
    df = spark.createDataFrame([(d, t, f"k{d}", d, 2) for d, t in rows], DOCS)
    kept = setjoin.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, label in brute_classes(rows) if d == label)


def test_block_skipping_misses_no_pair():
    rng = np.random.default_rng(0)
    for n in (2, 65, 300):
        low = rng.integers(5, 60, n)
        high, pos = low + rng.integers(0, 4, n), np.sort(rng.integers(0, 12, n))
        label = rng.integers(0, 20, n)
        got = {(i, int(j)) for i, found in setjoin.meeting(label, low, high, pos, 80) for j in found}
        rest = high - pos + setjoin.MEET - 1
        want = {
            (i, j)
            for i in range(n)
            for j in range(i + 1, n)
            if label[i] != label[j] and 100 * high[j] >= 80 * low[i] and 100 * high[i] >= 80 * low[j] and min(rest[i], rest[j]) >= setjoin.need(int(low[i]), int(low[j]), 80)
        }
        assert got == want


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(k * 7 % 101, (k + 1) * 7 % 101) for k in range(90)] + [(200, 300), (300, 400), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(path).collect()}
    nodes = {k * 7 % 101 for k in range(91)}
    assert got == {**dict.fromkeys(nodes, min(nodes)), 200: 200, 300: 200, 400: 200}


def brute_windows(rows):
    """Every 50-word window that stands in two different texts, by text and place."""
    at = defaultdict(set)
    for text in {t for _, t in rows if t}:
        w = WORD.findall(text)
        for i in range(len(w) - 49):
            at[tuple(w[i : i + 50])].add((text, i))
    return {place for places in at.values() if len({t for t, _ in places}) > 1 for place in places}


def passage_rows():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    passages = [some(n) for n in (50, 50, 51, 60, 75, 120, 300)] + [some(49), some(30)]
    rows = []
    for _ in range(90):
        w = some(rnd.randint(0, 90))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            if rnd.random() < 0.3:  # a part only, sometimes shorter than a passage
                a = rnd.randrange(len(p))
                p = p[a : a + rnd.randint(30, 80)]
            w = w + p + some(rnd.randint(0, 40))
        rows.append(" ".join(w))
    base = some(200)
    for _ in range(20):
        w = list(base)
        w[rnd.randrange(200)] = "changed"
        rows.append(" \n".join(w))
    self_repeat = " ".join(some(70) * 2)
    rows += [self_repeat, rows[3], rows[3], None, "", "short text", "A" + rows[3][1:], "y " * 20000]
    return list(enumerate(rows))


def test_passages_against_brute_force(spark):
    rows = passage_rows()
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], DOCS).repartition(5)
    got = defaultdict(list)
    for r in suffix.repeated_passages(df).collect():
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50
        got[r["doc_id"]].append((r["start_word"], r["end_word"]))
    windows, texts = brute_windows(rows), Counter(t for _, t in rows if t)
    places = defaultdict(set)
    for text, i in windows:
        places[text].add(i)
    for doc, text in rows:
        if not text:
            assert doc not in got
            continue
        n = len(WORD.findall(text))
        if texts[text] > 1 and n >= 50:
            assert got[doc] == [(0, n)]
            continue
        spans = sorted(got[doc])
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
        covered = {k for i in places[text] for k in range(i, i + 50)}
        found = {k for a, b in spans for k in range(a, b)}
        assert found <= covered  # every reported word is in a repeated window
        for i in places[text]:  # every repeated window meets a reported span
            assert any(a < i + 50 and i < b for a, b in spans)


def crossed_rows():
    """Four texts a group: pairs share what follows a core, other pairs share what precedes it."""
    rnd, rows = random.Random(4), []
    some = lambda n: [f"v{rnd.randrange(9000)}" for _ in range(n)]
    for _ in range(30):
        core, left, rights = some(40), some(10), (some(25), some(25))
        for k in range(4):
            rows.append(" ".join(some(30) + (left if k % 2 == 0 else some(10)) + core + rights[k // 2] + some(30)))
    return list(enumerate(rows))


@pytest.mark.parametrize("make", [crossed_rows, passage_rows])
def test_spans_are_whole(spark, make):
    rows = make()
    got, covered, texts = defaultdict(set), defaultdict(set), Counter(t for _, t in rows if t)
    for r in suffix.repeated_passages(spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], DOCS)).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    for text, i in brute_windows(rows):
        covered[text].update(range(i, i + 50))
    assert all(got[d] == covered[t] for d, t in rows if t and texts[t] == 1)


def test_hot_blocks_are_sorted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PART", 4)
    rnd = random.Random(2)
    some = lambda n: [f"u{rnd.randrange(5000)}" for _ in range(n)]
    passage = some(55)
    rows = [(i, " ".join(some(rnd.randint(20, 60)) + passage + some(rnd.randint(20, 60)))) for i in range(40)]
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], DOCS)
    got = suffix.repeated_passages(df).collect()
    assert {r["doc_id"] for r in got} == set(range(40))
    assert all(50 <= r["n_words"] <= 56 for r in got)


def test_further_links_move_only_what_they_join(spark):
    from sitelens.llm.graph import joined_labels

    rnd = random.Random(12)
    first = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(90)]
    second = [(rnd.randrange(240), rnd.randrange(240)) for _ in range(40)] + first[:3]
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    with storage.scratch(spark, "test"):
        labels = components(frame(first))
        got = {r["node"]: r["label"] for r in joined_labels(labels, frame(second)).collect()}
        same = joined_labels(labels, frame(first[:5]))
        assert same is labels
    met = {x for p in first + second if p[0] != p[1] for x in p}
    want = joined([p for p in first + second if p[0] != p[1]], met)
    assert {n: x for n, x in got.items()} == {n: want[n] for n in got} and set(got) >= {n for n in met if want[n] != n}
