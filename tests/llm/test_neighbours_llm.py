"""Nearest neighbours by posting lists against brute force."""

import numpy as np
import pytest

from sitelens.llm import neighbours
from sitelens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string, list string"


def brute(rows, asked, k=10):
    """{query: [(distance, id)]} over all usable rows."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if asked(q):
            best = out.setdefault(q, {})
            for i, y in good:
                if i != q and len(y) == len(x):
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((x - y) ** 2).sum())))
    return {q: sorted((d, i) for i, d in b.items())[:k] for q, b in out.items()}


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items()) / sum(map(len, want.values()))


def held(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "v", "l") for i, v in vectors], SCHEMA)


@pytest.mark.parametrize("kind", ["uniform", "clustered", "hot"])
def test_recall_and_exact_distances(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 300)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    if kind != "uniform":
        x = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] * 3 + x * 0.3
    if kind == "hot":
        x[rng.choice(3000, 1000, replace=False)] = x[7]  # one very common vector
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    df = held(spark, vectors)
    got = answers(neighbours.nearest(df, df.where("vec_id % 20 = 0"), list_rows=64))
    want = brute(vectors, lambda q: q % 20 == 0)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        for d, i in found:
            assert abs(d - np.sqrt(((x[q].astype(np.float32).astype(float) - x[i].astype(np.float32).astype(float)) ** 2).sum())) < 1e-12


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1, 0]), (1, [0, 0]), (2, [nan, 1]), (3, [inf, 1]), (4, [None, 1]), (5, None), (6, []), (None, [1, 0]), (7, [1, 1]), (8, [1, 1]), (8, [1, 1]), (9, [5, 5]), (9, [2, 0]), (100, [1, 0, 0]), (101, [0, 1, 0]), (200, [0, 0]), (300, [1, 0]), (-100, [9])]
    df = held(spark, vectors)
    got = answers(neighbours.nearest(df, df.where("vec_id % 100 = 0")))
    want = brute(vectors, lambda q: q % 100 == 0)
    assert got == {q: w for q, w in want.items() if w}
    assert [i for _, i in got[0]] == [300, 7, 8, 9] and [i for _, i in got[100]] == [101] and -100 not in got
    assert answers(neighbours.nearest(df.limit(0), df.limit(0))) == {}
    assert answers(neighbours.nearest(df, df.where("vec_id = 5"))) == {}


def test_huge_components(spark):
    rows = spark.createDataFrame([(i, [1e200 * (i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [i for _, i in answers(neighbours.nearest(rows, rows.where("vec_id = 0")))[0]] == [1, 2, 3, 4]


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    centroids = rng.normal(size=(512, 16))
    graph, points = neighbours.Graph.of(centroids), rng.normal(size=(200, 16))
    d = np.sqrt(((points[:, None] - centroids) ** 2).sum(2))
    ids, dist = graph.nearest(points)
    assert (ids[:, 0] == d.argmin(1)).mean() >= 0.99 and np.allclose(dist, np.take_along_axis(d, ids, 1))
    assert all(len(set(r)) == len(r) for r in ids.tolist())
    near = graph.within(points, 1.3)
    want = [set(np.flatnonzero(r <= 1.3 * r.min()).tolist()) for r in d]
    assert sum(len(set(a.tolist()) & b) for a, b in zip(near, want, strict=True)) >= 0.98 * sum(map(len, want))


def test_balanced_lists_and_replicas():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4096, 8))
    c = neighbours.balanced_centroids(x, 64)
    assert c.shape == (64, 8)
    index = neighbours.Index({8: neighbours.Graph.of(c)}, {8: 100})
    row, lists = index.lists_of(x)
    d = np.sqrt(((x[:, None] - c) ** 2).sum(2))
    assert set(row.tolist()) == set(range(4096)) and lists.min() >= 100 and np.bincount(row).max() == neighbours.REPLICAS
    assert (np.bincount(row) > 1).sum() > 400
    assert all(d[r, n - 100] <= (1 + neighbours.CLOSURE) * d[r].min() * 1.01 for r, n in zip(row.tolist(), lists.tolist(), strict=True))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = QUERIES["op13_balanced_lists"](spark, f"/root/testdata/{sf}")
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert recall(answers(got), brute(rows, lambda q: q % 100 == 0)) >= 0.9
