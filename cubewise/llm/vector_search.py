"""Nearest vectors with an inverted multi-index.

The two halves of the vectors are quantised apart, so centroids squared cells
need only two small codebooks, whose size follows the number of rows. What
quantising leaves away is known for every centroid: the ``QUANTILE`` of the
residual norms of *all* rows of the index that are assigned to it. A query
goes through the cells with a heap, by the sum of what its halves can score
there: the score with the centroid, plus ``ALLOW`` deviations of the score of
such a residual. So cells of long or badly quantised vectors come early, and
cells of copies, which leave nothing away, get no allowance. It stops where
that sum falls below the score that the query's last neighbour is expected to
have, read off a sample. Entries of visited cells are compared in double
precision.

Rows and queries meet in blocks: a block of rows holds the cells of a few
first-half centroids, and large ones are split, as are the queries. A query is
sent to the blocks that it visits only. Where vectors have structure, a query
visits a bounded number of cells, centroids grow with the root of the rows,
and so what is sent grows with their power of 1.5.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, read_table

#: Centroids of a half: at least, at most, and rows for each cell in between.
CENTROIDS = 64
MOST_CENTROIDS = 512
CELL = 12
#: Rows that the codebooks are fitted on and scores are estimated from: at most so many, or so many for each centroid.
SAMPLE = 4096
EACH = 32
ROUNDS = 12
#: First-half centroids of a block, and rows or queries of one, about.
GROUP = 8
BLOCK = 4096
#: Deviations of a residual's score that a cell is allowed, and the quantile of residual norms that is taken for one.
ALLOW = 2.1
QUANTILE = 0.99
#: Entries that a query visits at least (or all).
LEAST = 400


@dataclass(frozen=True)
class Index:
    first: np.ndarray
    second: np.ndarray
    sample: np.ndarray
    counts: np.ndarray | None = None
    #: Deviation of the score of a residual with a query half of length 1, for each centroid.
    spread_first: np.ndarray | None = None
    spread_second: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return int(self.counts.sum())


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, c)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """``vec_id, v`` of the rows of ``vectors(vec_id, embedding)`` that take
    part: not null, not zero, finite, of this (or else the most frequent) length."""
    v = F.col("embedding").cast("array<double>")
    ok = vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0") \
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    if length is not None:
        return ok.where(F.size("v") == length)
    sizes = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return ok.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def fit(rows: DataFrame) -> Index | None:
    """Codebooks from the rows smallest by a hash of their id: ``SAMPLE``, or
    ``EACH`` for every centroid where there are more."""
    n = rows.count()
    k = int(min(MOST_CENTROIDS, max(CENTROIDS, (n / CELL) ** 0.5)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(SAMPLE, EACH * k)).select("v").collect()
    if not sample:
        return None
    x = np.array([r["v"] for r in sample], np.float64)
    half = x.shape[1] // 2
    return Index(_kmeans(x[:, :half], k), _kmeans(x[:, half:], k), x)


def visited(q: np.ndarray, index: Index, k: int) -> np.ndarray:
    """Cells (first, second) of one query, as a table of booleans: the
    multi-sequence traversal by summed reach."""
    half = index.first.shape[1]
    a = index.first @ q[:half] + ALLOW * float(np.linalg.norm(q[:half])) * index.spread_first
    b = index.second @ q[half:] + ALLOW * float(np.linalg.norm(q[half:])) * index.spread_second
    oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b = a[oa], b[ob]
    scores = np.sort(index.sample @ q)[::-1]
    rank = -(-k * len(scores) // max(index.rows, 1)) + 1  # one more: the query itself may be in the sample
    floor = scores[min(rank, len(scores) - 1)]
    out = np.zeros((len(a), len(b)), bool)
    # its own cell: there, what quantising leaves away of its neighbours points where its own does
    out[_nearest(q[None, :half], index.first)[0], _nearest(q[None, half:], index.second)[0]] = True
    heap, entries = [(-(a[0] + b[0]), 0, 0)], 0
    done = np.zeros(len(a), np.int64)  # in row i the first done[i] columns have been visited
    while heap:
        s, i, j = heapq.heappop(heap)
        if -s < floor and entries >= LEAST:
            break
        out[oa[i], ob[j]] = True
        entries += index.counts[oa[i], ob[j]]
        done[i] = j + 1
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
    return out


def _assign(index: Index):
    half = index.first.shape[1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                c1, c2 = _nearest(x[:, :half], index.first), _nearest(x[:, half:], index.second)
                left = [np.linalg.norm(part, axis=1) for part in (x[:, :half] - index.first[c1], x[:, half:] - index.second[c2])]
                yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), *map(pa.array, left)],
                                      names=["vec_id", "v", "c1", "c2", "r1", "r2"])
    return run


def _spread(placed: DataFrame, cell: str, residual: str, centroids: np.ndarray) -> np.ndarray:
    """For each centroid the ``QUANTILE`` of its rows' residual norms, over the root of their length."""
    out = np.zeros(len(centroids))
    for r in placed.groupBy(cell).agg(F.percentile_approx(residual, QUANTILE, 1000).alias("x")).collect():  # one row for each centroid
        out[r[cell]] = r["x"] / max(1, centroids.shape[1]) ** 0.5
    return out


def _probe(index: Index, k: int):
    """A row for each query and group of first-half centroids that it visits."""
    def run(batches):
        for batch in batches:
            ids, take, part, cells = batch.column("vec_id"), [], [], []
            for n, q in enumerate(_matrix(batch.column("v")) if batch.num_rows else []):
                seen = visited(q, index, k)
                for g in range(0, len(seen), GROUP):
                    if seen[g:g + GROUP].any():
                        take.append(n)
                        part.append(g // GROUP)
                        cells.append(np.packbits(seen[g:g + GROUP]).tobytes())
            at = pa.array(take, pa.int64())
            yield pa.record_batch([ids.take(at), batch.column("v").take(at), pa.array(part, pa.int32()), pa.array(cells, pa.binary())],
                                  names=["query_id", "q", "part", "cells"])
    return run


def best(ids: np.ndarray, scores: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by exact score, ties to the smaller id. ``scores`` come from
    one matrix product; those near the limit are computed anew, each alike."""
    if len(ids) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= limit - 1e-9 * max(1.0, abs(limit)))
        ids, x = ids[near], x[near]
    exact = (x * q).sum(axis=1)
    order = np.lexsort((ids, -exact))[:k]
    return ids[order], exact[order]


def _compare(width: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("v")) if left.num_rows else None
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            cell = (left.column("c1").to_numpy() % GROUP) * width + left.column("c2").to_numpy()
            queries, q = right.column("query_id").to_numpy(), _matrix(right.column("q"))
            for i, bits in enumerate(right.column("cells").to_pylist()):
                seen = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
                at = np.flatnonzero(seen[cell] & (ids != queries[i]))
                if len(at):
                    v, s = best(ids[at], x[at] @ q[i], x[at], q[i], k)
                    out_q.append(np.full(len(v), queries[i]))
                    out_v.append(v)
                    out_s.append(s)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query_id": pa.array(cat(out_q, np.int64), pa.int64()), "vec_id": pa.array(cat(out_v, np.int64), pa.int64()),
                         "score": pa.array(cat(out_s, np.float64), pa.float64())})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries(vec_id,
    embedding)`` the k nearest found among the rows of ``vectors`` with another
    id, by inner product, ties to the smaller vec_id.

    Vectors that are null, zero, hold null or non-finite components, or have
    another length than most take no part. A vec_id on several rows is
    searched and found as often. Other columns are ignored; without usable
    rows there is no result."""
    rows = usable(vectors)
    index = fit(rows)
    if index is None:
        return scratch.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = usable(queries, index.sample.shape[1])
    placed = scratch.save(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v")
                          .mapInArrow(_assign(index), "vec_id long, v array<double>, c1 int, c2 int, r1 double, r2 double"))
    table = np.zeros((len(index.first), len(index.second)), np.int64)
    for r in placed.groupBy("c1", "c2").count().collect():  # one row for each cell at most
        table[r["c1"], r["c2"]] = r["count"]
    index = replace(index, counts=table, spread_first=_spread(placed, "c1", "r1", index.first), spread_second=_spread(placed, "c2", "r2", index.second))
    probes = scratch.save(asked.select(F.col("vec_id").cast("long").alias("vec_id"), "v").repartition(scratch.spark.sparkContext.defaultParallelism * 2)
                          .mapInArrow(_probe(index, k), "query_id long, q array<double>, part int, cells binary"))

    salts = [max(1, -(-int(table[g:g + GROUP].sum()) // BLOCK)) for g in range(0, len(table), GROUP)]
    blocks = max(1, -(-(probes.groupBy("part").count().agg(F.max("count")).first()[0] or 0) // BLOCK))
    part = F.floor(F.col("c1") / GROUP).cast("int")
    left = placed.withColumn("part", part).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.get(F.lit(salts), F.col("part"))).cast("int")) \
        .withColumn("block", F.explode(F.lit(list(range(blocks)))))
    right = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.get(F.lit(salts), F.col("part")) - 1))) \
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    keys = ("part", "salt", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(len(index.second), k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), Scratch(spark, "vector-search"))
