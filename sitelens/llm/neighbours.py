"""Approximate nearest neighbours with balanced posting lists.

1. Fit: centroids come from a sample of at most ``2 * SAMPLE`` vectors (a
   documented bound, drawn by a hash of id and vector), cut again and again
   into halves of equal size along the line between two cluster centres.  Their
   number is a power of two that grows with the rows, ``LIST_ROWS`` a list, up
   to ``MOST_LISTS``.  They are the nodes of a neighbour graph in memory,
   searched by a beam; centroids and graph are broadcast (at most
   ``MOST_LISTS`` vectors and ``DEGREE`` edges each).
2. Index: every row goes to the list of its nearest centroid.  Boundary vectors
   go to up to ``REPLICAS`` lists: those whose centroid is at most
   ``1 + CLOSURE`` times as far as the nearest, unless a chosen centroid is
   nearer to that centroid than the vector is.
3. Search: a query reads all lists whose centroid is at most ``ratio`` times as
   far as its nearest one, however many these are.  The ratio is measured:
   ``CALIBRATION`` queries (a documented bound) are answered by a scan of all
   rows, and the ratio is the one under which ``AIM`` of their true neighbours
   lie in a list that is read.  Where the data are clustered this prunes nearly
   all lists, in uniform data only some.
4. Scan: lists are cut by a hash of the id into chunks of about ``CHUNK_ROWS``
   counted rows.  Chunks and the queries that read them meet by (list, chunk);
   a task holds one chunk and streams the queries past it, so neither a crowded
   list nor a query region that many share is held as a whole.  Each chunk
   gives a query its best k, and an aggregate by query merges these.

Distances are Euclidean, exact in double precision on the original vectors: a
product of matrices proposes, with room for its rounding, and differences
decide; ties go to the smaller id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id; vectors of another length
have another index and are not compared; rows of equal id are one item with
several vectors, whose nearest counts, and never a neighbour of that id's
query; with fewer than k candidates all read ones come; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.storage import kept, scratch, written

NEIGHBOURS = 10
SAMPLE, LIST_ROWS, MOST_LISTS = 32_768, 256, 4096
DEGREE, BEAM = 32, 32
REPLICAS, CLOSURE = 2, 0.1
CALIBRATION, AIM = 64, 0.97
CHUNK_ROWS = 16_384
#: Queries, and pairs of a query and a vector, that a scan holds at once.
QUERY_BLOCK, PAIR_BLOCK = 256, 100_000
FOUND = "query_id long, vec_id long, score double"


def usable(vector: str) -> Column:
    """Whether a vector has components, all finite, one of them not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, finite)
    return whole & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a list column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def placed(points: np.ndarray) -> np.ndarray:
    """The points as the index sees them: so bounded that no square overflows."""
    return np.clip(points, -1e100, 1e100)


def balanced_centroids(vectors: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Centroids of ``lists`` (a power of two) parts of equal size, neighbouring parts next to each other."""
    rng = np.random.default_rng(seed)
    parts = [vectors]
    while len(parts) < lists:
        halves = []
        for p in parts:
            a, b = p[rng.integers(len(p))], p[rng.integers(len(p))]
            for _ in range(6):
                near = ((p - a) ** 2).sum(1) <= ((p - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = p[near].mean(0), p[~near].mean(0)
            order = np.argsort(p @ (b - a), kind="stable")
            halves += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        parts = halves
    return np.array([p.mean(0) for p in parts])


class Graph(NamedTuple):
    """Centroids with edges to their nearest centroids and around a ring, which keeps the graph connected."""

    centroids: np.ndarray
    norms: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, degree: int = DEGREE) -> Graph:
        n = len(centroids)
        norms = (centroids**2).sum(1)
        near = np.empty((n, min(degree, n)), np.int64)
        for a in range(0, n, 512):
            d = norms[a : a + 512, None] + norms - 2 * centroids[a : a + 512] @ centroids.T
            near[a : a + 512] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
        at = np.arange(n)[:, None]
        return cls(centroids, norms, np.concatenate([near, (at + 1) % n, (at - 1) % n, (at + n // 2) % n], axis=1))

    def distances(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of point i to the centroids ids[i]."""
        d = (points**2).sum(1)[:, None] + self.norms[ids] - 2 * np.einsum("bd,bnd->bn", points, self.centroids[ids])
        return np.sqrt(np.maximum(d, 0))

    def nearest(self, points: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the ``beam`` nearest centroids found, nearest first.

        The beam starts with centroids spread over the parts; the nearest that
        were not yet followed are followed along their edges, until all of the
        beam were.  No centroid's distance is taken twice.
        """
        n, at_once = len(self.centroids), max(4, beam // 8)
        beam = min(beam, n)
        start = np.unique(np.linspace(0, n - 1, min(n, max(beam, int(n**0.5)))).astype(np.int64))
        ids = np.repeat(start[None], len(points), 0)
        dist = self.distances(points, ids)
        seen = np.zeros((len(points), n), bool)
        seen[:, start] = True
        ids, dist, done = _best(ids, dist, np.zeros(ids.shape, bool), beam)
        squares, writer = (points**2).sum(1), np.zeros((len(points), n), np.int32)
        active = np.arange(len(points))
        while True:
            open_dist = np.where(done[active], np.inf, dist[active])
            pick = np.argpartition(open_dist, min(at_once, beam) - 1, axis=1)[:, :at_once]
            some = np.isfinite(np.take_along_axis(open_dist, pick, 1)).any(1)
            active, pick = active[some], pick[some]
            if len(active) == 0:
                break
            row = active[:, None]
            done[row, pick] = True
            new = self.edges[ids[row, pick]].reshape(len(active), -1)
            # of a centroid that several lead to, the last counts
            place = np.arange(new.shape[1], dtype=np.int32)[None]
            writer[row, new] = place
            r, c = np.nonzero(~seen[row, new] & (writer[row, new] == place))
            found, owner = new[r, c], active[r]
            seen[owner, found] = True
            far = np.full(new.shape, np.inf)
            far[r, c] = np.sqrt(np.maximum(squares[owner] + self.norms[found] - 2 * np.einsum("nd,nd->n", points[owner], self.centroids[found]), 0))
            ids[active], dist[active], done[active] = _best(np.concatenate([ids[active], new], 1), np.concatenate([dist[active], far], 1), np.concatenate([done[active], ~np.isfinite(far)], 1), beam)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def within(self, points: np.ndarray, ratio: float) -> list[np.ndarray]:
        """For each point all centroids found at most ``ratio`` times as far as the nearest; the beam widens until it reaches beyond."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(points)
        left, beam = np.arange(len(points)), BEAM
        while len(left):
            ids, dist = self.nearest(points[left], beam)
            limit = dist[:, 0] * ratio
            whole = (dist[:, -1] > limit) | (beam >= len(self.centroids))
            for i in np.flatnonzero(whole).tolist():
                out[left[i]] = ids[i][dist[i] <= limit[i]]
            left, beam = left[~whole], 2 * beam
        return out


def _best(ids: np.ndarray, dist: np.ndarray, done: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``beam`` nearest of each row, in any order."""
    order = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, dist, done))


class Index(NamedTuple):
    """The graphs by vector length, and the number of the first list of each."""

    graphs: dict[int, Graph]
    first: dict[int, int]

    def lists_of(self, points: np.ndarray, replicas: int = REPLICAS, closure: float = CLOSURE) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that hold each point."""
        graph, base = self.graphs[points.shape[1]], self.first[points.shape[1]]
        ids, dist = (x[:, :replicas] for x in graph.nearest(points))
        keep = np.isfinite(dist) & (dist <= (1 + closure) * dist[:, :1])
        keep[:, 0] = True
        for j in range(1, ids.shape[1]):
            for i in range(j):
                apart = np.sqrt(((graph.centroids[ids[:, i]] - graph.centroids[ids[:, j]]) ** 2).sum(1))
                keep[:, j] &= ~keep[:, i] | (apart >= dist[:, j])
        row, col = np.nonzero(keep)
        return row, base + ids[row, col]


def fit(vectors: DataFrame, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS, sample: int = SAMPLE) -> Index:
    """Centroids and graph for each vector length of ``vectors(id, v)``."""
    counts = {r["size"]: r["n"] for r in vectors.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    graphs, first, lists = {}, {}, 0
    for size, n in sorted(counts.items()):
        part = vectors.where(F.size("v") == size)
        if n > sample:
            part = part.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
        drawn = np.unique(placed(matrix(part.select("v").limit(2 * sample).toArrow().column("v"), size)), axis=0)
        want = min(most_lists, max(1, len(drawn) // 8), max(1, n // list_rows))
        want = 1 << (want.bit_length() - 1)
        graphs[size] = Graph.of(balanced_centroids(drawn, want) if len(drawn) else np.zeros((1, size)))
        first[size] = lists
        lists += want
    return Index(graphs, first)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        yield size, batch.take(pa.array(np.flatnonzero(sizes == size)))


def postings(vectors: DataFrame, index: Index) -> DataFrame:
    """(list, id, v): every row in its lists."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 128):
                for size, batch in _by_size(whole.slice(begin, 128)):
                    row, found = shared.value.lists_of(placed(matrix(batch.column("v"), size)))
                    yield pa.record_batch([pa.array(found.astype(np.int32)), *batch.take(pa.array(row)).columns], names=["list", "id", "v"])

    return vectors.mapInArrow(run, f"list int, id long, v {vectors.schema['v'].dataType.simpleString()}")


def best_pairs(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, distance) of the k nearest points of each query among these, another id than its own, ties to the smaller id."""
    if len(points) == 0:
        return
    with np.errstate(over="ignore"):
        norms = (points**2).sum(1)
    several = len(np.unique(ids)) < len(ids)
    for begin in range(0, len(queries), QUERY_BLOCK):
        q, own = queries[begin : begin + QUERY_BLOCK], query_ids[begin : begin + QUERY_BLOCK]
        with np.errstate(over="ignore", invalid="ignore"):
            q_norms = (q**2).sum(1)
            squares = q_norms[:, None] + norms - 2 * q @ points.T
            room = 1e-12 * (q_norms + norms.max()) * (16 + points.shape[1])
        other = ids != own[:, None]
        if several or not np.isfinite(squares).all():
            near = other  # an id's other vectors, or numbers beyond the product's range: all differences decide
        else:
            squares[~other] = np.inf
            kth = np.partition(squares, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            near = (squares <= (kth + room)[:, None]) & other
        row, col = np.nonzero(near)
        edges = np.searchsorted(row, np.arange(len(q) + 1))
        a = 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + PAIR_BLOCK, side="right")) - 1)
            r, c = row[edges[a] : edges[b]], col[edges[a] : edges[b]]
            with np.errstate(over="ignore"):
                dist = np.sqrt(((points[c] - q[r]) ** 2).sum(1))
            order = np.lexsort((ids[c], dist, r))
            r, c, dist = r[order], c[order], dist[order]
            if several:
                _, once = np.unique(np.stack([r, ids[c]], 1), axis=0, return_index=True)
                once.sort()  # an id's first is its nearest
                r, c, dist = r[once], c[once], dist[once]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            top = rank < k
            yield own[r[top]], ids[c[top]], dist[top]
            a = b


def _found(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for q, i, d in parts:
        yield pa.record_batch([pa.array(q), pa.array(i), pa.array(d)], names=["query_id", "vec_id", "score"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query with their rank."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scanned(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact answers of a bounded list of queries, by a scan of all rows."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[tuple[int, list[float]]]] = {}
        for q in shared.value:
            by_size.setdefault(len(q[1]), []).append(q)
        for whole in batches:
            for size, batch in _by_size(whole):
                if size in by_size:
                    ids, points = np.array([i for i, _ in by_size[size]], np.int64), np.array([v for _, v in by_size[size]], np.float64)
                    yield from _found(best_pairs(matrix(batch.column("v"), size), batch.column("id").to_numpy(), points, ids, k))

    return _merged(vectors.mapInArrow(run, FOUND), k)


def calibrated_ratio(vectors: DataFrame, queries: DataFrame, lists: DataFrame, index: Index, k: int, aim: float = AIM) -> float:
    """The ratio under which the lists that are read hold ``aim`` of the true neighbours of some queries."""
    some = [(r["id"], list(r["v"])) for r in queries.orderBy(F.xxhash64("id", "v"), "id").limit(CALIBRATION).collect()]
    truth = written(scanned(vectors, some, k), "truth")
    held: dict[int, set[int]] = {}
    for r in truth.select(F.col("vec_id").alias("id")).distinct().join(lists.select("id", "list"), "id").distinct().collect():
        held.setdefault(r["id"], set()).add(r["list"])
    points: dict[int, list[np.ndarray]] = {}
    for i, v in some:
        points.setdefault(i, []).append(placed(np.array(v, np.float64)))
    needed = []
    for r in truth.collect():
        ratios = []
        for p in points[r["query_id"]]:
            graph, base = index.graphs[len(p)], index.first[len(p)]
            d = np.sqrt(((graph.centroids - p) ** 2).sum(1))
            ratios += [d[x - base] / d.min() if d.min() > 0 else np.inf for x in held[r["vec_id"]] if 0 <= x - base < len(d)]
        if ratios:
            needed.append(min(ratios))
    needed = sorted(x for x in needed if np.isfinite(x))
    return max(1.0, needed[min(len(needed) - 1, int(aim * len(needed)))]) * (1 + 1e-9) if needed else 1.0


def probes(queries: DataFrame, index: Index, ratio: float, chunks: dict[int, int]) -> DataFrame:
    """(list, chunk, id, v): each query at all chunks of the lists that it reads."""
    shared = queries.sparkSession.sparkContext.broadcast((index, chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, chunks = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                for size, batch in _by_size(whole.slice(begin, 64)):
                    found = index.graphs[size].within(placed(matrix(batch.column("v"), size)), ratio)
                    rows = [(i, x, c) for i, near in enumerate(found) for x in (near + index.first[size]).tolist() for c in range(chunks.get(x, 0))]
                    for at in range(0, len(rows), 4096):
                        row, lists, chunk = (np.array(x, np.int32) for x in zip(*rows[at : at + 4096], strict=True))
                        yield pa.record_batch([pa.array(lists), pa.array(chunk), *batch.take(pa.array(row)).columns], names=["list", "chunk", "id", "v"])

    return queries.mapInArrow(run, f"list int, chunk int, id long, v {queries.schema['v'].dataType.simpleString()}")


def _scan(rows: DataFrame, k: int) -> DataFrame:
    """The best k of each chunk for each query; ``rows`` has a chunk's vectors (kind 0) and queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, points, ids = None, [], None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "chunk", "kind")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part, kind = batch.slice(a, b - a), int(keys[a, 2])
                size = len(part.column("v")[0])
                values, numbers = matrix(part.column("v"), size), part.column("id").to_numpy()
                if tuple(keys[a, :2]) != at:
                    at, held, points = tuple(keys[a, :2]), [], None
                if kind == 0:
                    # repeated rows stand together and count once
                    fresh = np.ones(len(numbers), bool)
                    fresh[1:] = (numbers[1:] != numbers[:-1]) | (values[1:] != values[:-1]).any(1)
                    if held and held[-1][1][-1] == numbers[0] and (held[-1][0][-1] == values[0]).all():
                        fresh[0] = False
                    if fresh.any():
                        held.append((values[fresh], numbers[fresh]))
                    continue
                if points is None and held:
                    points, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                if points is not None:
                    yield from _found(best_pairs(points, ids, values, numbers, k))

    ordered = rows.repartition("list", "chunk").sortWithinPartitions("list", "chunk", "kind", "id", "v")
    return ordered.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, ident: str = "vec_id", vector: str = "embedding", list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``queries`` the k nearest rows of ``vectors`` found, other than its own."""
    spark = vectors.sparkSession
    rows = lambda df: df.where(usable(vector) & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("v"))
    every, asked = rows(vectors), rows(queries)
    with scratch(spark, "neighbours"):
        index = fit(every, list_rows, most_lists)
        if not index.graphs:
            return kept(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), "neighbours")
        asked = asked.where(F.size("v").isin(list(index.graphs)))
        lists = written(postings(every, index), "postings")
        ratio = calibrated_ratio(every, asked, lists, index, k)
        chunks = {r["list"]: -(-r["n"] // CHUNK_ROWS) for r in lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = spark.createDataFrame(sorted(chunks.items()), "list int, parts int")
        cut = lists.join(F.broadcast(parts), "list")  # at most one row a list
        cut = cut.select("list", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int").alias("chunk"), F.lit(0).alias("kind"), "id", "v")
        asking = probes(asked, index, ratio, chunks).select("list", "chunk", F.lit(1).alias("kind"), "id", "v")
        return kept(_merged(_scan(cut.unionByName(asking), k), k), "neighbours")
