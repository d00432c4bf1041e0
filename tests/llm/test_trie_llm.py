"""The prefix trie of conversations against a brute-force version and its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from sitelens.llm import trie
from sitelens.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, path int, words string, first double"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn), role or "", text or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = turns.get(base, [])[:h] + mine[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = own + sum(saved[k] for k in kids[p])
    low = {p: min(m) for p, m in members.items()}
    return sorted((low[p], len(p), low[p[:-1]] if p else -1, len(members[p]), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p in members)


def table(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*trie.COLUMNS).collect())


@pytest.fixture(params=[True, False], ids=["few shards", "many shards"])
def shards(spark, request):
    """With and without joining small partitions, so that the skeleton is empty or deep."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (str(request.param).lower(), before[1] if request.param else "23"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def conversations(seed, n, hot):
    rnd = random.Random(seed)
    say = [f"{w} {w} said" for w in "abcdef"] + ["", None, "\x0b \t", "ü  x"]
    rows = []
    for c in range(n):
        length = 3 if c < hot else rnd.choice([1, 1, 2, 3, 4, 6, 9])
        for t in range(length):
            rows.append((c, t, "user" if c < hot or rnd.random() < 0.7 else None, "same words here" if c < hot else rnd.choice(say), 1, "w", 0.5))
    rows += [(None, 1, "user", "lost", 1, "w", 0.5), (-5, None, "user", "x", 1, "w", 0.5), (-5, 0, "user", "y", 1, "w", 0.5), (-25, 2, "b", "a", 1, "w", 0.5), (-25, 2, "a", "b", 1, "w", 0.5)]
    rows += [(7777, 0, "user", "twice", None, None, None)] * 2 + [(8888, t, "user", f"turn {t}", 1, "w", 0.5) for t in range(300)] + [(8889, t, "user", f"turn {t}", 1, "w", 0.5) for t in range(250)]
    rows += [(9000, 0, "user", "long " * 20000, 1, "w", 0.5)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, hot", [(60, 0), (400, 150)])
def test_trie_equals_brute_force(spark, shards, n, hot):
    rows = conversations(n, n, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plain = {c: v for c, v in ((c, [(r or "", x or "") for _, _, r, x in sorted((((t is not None, t), 0, r or "", x or "") for cc, t, r, x, *_ in rows if cc == c))]) for c in {r[0] for r in rows} - {None})}
    assert table(trie.prefix_trie(trie.rebuilt_paths(df))) == brute(rebuilt(rows))
    assert table(trie.prefix_trie(trie.paths(df))) == brute(plain)


def test_chunks_of_ids(spark, shards, monkeypatch):
    rows = [(c, 0, "user", "hello there", 1, "w", 0.5) for c in range(500)] + [(c, 1, "user", "again", 1, "w", 0.5) for c in range(0, 500, 2)]
    assert table(trie.prefix_trie(trie.paths(spark.createDataFrame(rows, SCHEMA)))) == brute({c: [("user", "hello there")] + [("user", "again")] * (c % 2 == 0) for c in range(500)})
    walk, ids = trie._Walk(trie.Skeleton([b"", b"x" * 16], [0, 2], [-1, 0], [1, 0], [2, 2]), 3), list(range(0, 900, 3))
    monkeypatch.setattr(trie, "CHUNK_IDS", 64)
    for c in ids:
        walk.add(c, b"x" * 16, [2])
    walk.end()
    chunks = [r for r in walk.rows if r[0] == "ids"]
    assert b",".join(r[13] for r in chunks).decode() == ",".join(map(str, ids)) and [r[12] for r in chunks] == list(range(len(chunks))) and {r[1] for r in chunks} == {1}


def test_empty_and_one(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert table(trie.prefix_trie(trie.rebuilt_paths(none))) == []
    rows = [(4, 0, None, None, 1, "w", 0.5)]
    assert table(trie.prefix_trie(trie.rebuilt_paths(spark.createDataFrame(rows, SCHEMA)))) == brute(rebuilt(rows))


def test_query_equals_brute_force_and_sql(spark, shards):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_trie"](spark, SMALL)
    assert got.columns == trie.COLUMNS and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    found = table(got)
    assert found == brute(rebuilt(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    sql = con.execute(ORACLE["op12_conversation_trie"]).fetchall()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in sql) == found
