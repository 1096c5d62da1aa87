"""Operator 11: exact top-k search by pivot-table elimination.

The score is an integer inner product.  With M the largest squared length of all vectors, each vector x gets one more
component, sqrt(M - |x|^2), and each query q a zero; then |q - x|^2 = |q|^2 + M - 2 score, so the highest scores are the
smallest distances of a metric space.  The distances of every vector to all pivots are computed once and stored with it.
|d(q, p) - d(p, x)| is a lower bound of d(q, x) for each pivot p; the largest of them gives the highest score that x may
have.  A query's candidates are taken in the order of this bound and it stops at the first one that can't reach its k-th
best score so far, so the result is exact; ties with the k-th best are still looked at.

The pivots are the PIVOTS vectors of a sample (SAMPLE vectors, those with the smallest hashed ids) that a farthest-first
walk takes.  The sample also gives each query the k-th best score it starts with.  Sample and pivots only decide how soon a
query stops, never what it finds.

The stored table is sorted by nearest pivot, then id, in ranges, so a batch of it holds vectors that are close to each
other: a batch whose intervals of distances rule it out for a query is passed over at once, and a much repeated vector is
dealt over several partitions.  Queries go to the tasks as one matrix of PASS_BYTES at most; more queries make more passes,
each written before the next one is fetched, so neither the driver nor a task holds more than a pass, a batch and the k best
of each query.  No vector is shuffled for a pass; only each task's k best of a query are.  Where the bounds rule little out (independent
components in 64 dimensions) every pass computes nearly all products; that is the price of exactness.

Defined results: a vector that is null or holds a null or non-finite component, and a row without an id, take no part; a
missing component of a shorter vector counts as 0; rows of one id are one candidate, which counts with the best score of any
of them, and no candidate of the query with that id; fewer than k candidates are all returned; ties go to the smaller id; other
columns are ignored; an empty table gives an empty result.  Scores that may not fit 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, scratch, written

PIVOTS, SAMPLE, PASS_BYTES = 32, 2048, 16 << 20
#: A query's candidates are evaluated so many at a time, then twice as many, and so on.
FIRST = 256
LEAST = np.iinfo(np.int64).min
RESULT = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * component) of each vector that takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    took = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & finite)
    return took.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=flat.dtype)
    line = np.repeat(np.arange(len(column)), sizes)
    out[line, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """Where distances are taken: the pivots with their added component, and M."""

    def __init__(self, sample: np.ndarray, most: float, pivots: int) -> None:
        self.most = most
        held = self.lifted(sample)
        chosen, far = [0], np.full(len(held), np.inf)
        while len(chosen) < min(pivots, len(held)):
            far = np.minimum(far, ((held - held[chosen[-1]]) ** 2).sum(axis=1))
            if not far.max() > 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots = held[chosen]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        squares = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * (lifted @ self.pivots.T)
        return np.sqrt(np.maximum(squares, 0))

    def ceiling(self, squared: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The highest score at a distance of ``bound`` or more from a query of the ``squared`` length; the margin is far above what rounding loses."""
        scale = squared + self.most
        return (scale - bound * bound) / 2 + 1e-6 * scale + 1


def pivot_table(vectors: DataFrame, space: Space, width: int) -> DataFrame:
    """(vec_id, v, d, cell): the distances to all pivots and the nearest one, in ranges by cell and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = space.distances(space.lifted(matrix(batch.column(1), width)))
                sizes = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(sizes, pa.array(d.ravel())), pa.array(d.argmin(axis=1).astype(np.int32))], ["vec_id", "v", "d", "cell"])

    made = written(vectors.mapInArrow(run, "vec_id long, v array<long>, d array<double>, cell int"), "pivot-distances")
    return written(made.repartitionByRange(partitions(vectors.sparkSession), "cell", "vec_id").sortWithinPartitions("cell", "vec_id"), "pivot-table")


def kth(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> int:
    """The k-th best score among distinct ids other than ``own``; LEAST if there are fewer."""
    best: dict[int, int] = {}
    for i in np.argsort(-scores, kind="stable").tolist():
        if ids[i] != own:
            best.setdefault(int(ids[i]), int(scores[i]))
            if len(best) == k:
                return min(best.values())
    return LEAST


class Search:
    """The queries of one pass, and the k best that one task has found for each."""

    def __init__(self, ids: np.ndarray, asked: np.ndarray, near: np.ndarray, least: np.ndarray, space: Space, k: int) -> None:
        self.ids, self.near, self.least, self.space, self.k = ids, near, least.copy(), space, k
        self.asked, self.squared = asked, (asked.astype(np.float64) ** 2).sum(axis=1)
        self.found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(ids)
        self.products = 0

    def take(self, ids: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        """One batch of the pivot table."""
        low, high = d.min(axis=0), d.max(axis=0)
        bound = np.maximum(np.maximum(self.near - high, low - self.near), 0).max(axis=1)
        for q in np.flatnonzero(self.space.ceiling(self.squared, bound) >= self.least).tolist():
            most = self.space.ceiling(self.squared[q], np.abs(d - self.near[q]).max(axis=1))
            left = np.flatnonzero(most >= self.least[q])
            left = left[np.argsort(-most[left], kind="stable")]
            at, step = 0, FIRST
            while at < len(left) and most[left[at]] >= self.least[q]:
                some = left[at : at + step]
                self.products += len(some)
                score = v[some] @ self.asked[q]
                good = (score >= self.least[q]) & (ids[some] != self.ids[q])
                if good.any():
                    self._merge(q, score[good].astype(np.int64), ids[some][good])
                at, step = at + step, 2 * step

    def _merge(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.found[q][0], score]), np.concatenate([self.found[q][1], ids])
        order = np.lexsort((-score, ids))  # by id, the best score of each first
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
        order = order[np.lexsort((ids[order], -score[order]))][: self.k]
        self.found[q] = score[order], ids[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], score[order[-1]])


def _searching(make, width: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = make()
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1), width)
                search.take(batch.column(0).to_numpy(), v if exact else v.astype(np.float64), matrix(batch.column(2), search.near.shape[1]))
        sizes = [len(x) for x, _ in search.found]
        if sum(sizes):
            score, ids = (np.concatenate(x) for x in zip(*search.found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(search.ids, sizes)), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def top_scores(vectors: DataFrame, asked: str = "vec_id % 50 = 0", k: int = 5, vector: str = "embedding", scale: int = 256, pivots: int = PIVOTS, sample: int = SAMPLE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector where ``asked`` holds the k others of the highest inner product of whole numbers."""
    spark = vectors.sparkSession
    with scratch(spark) as keep:
        rows = written(whole_numbers(vectors, vector, scale), "pivot-vectors")
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        most, large, width = rows.agg(F.max(square), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))), F.max(F.size("v"))).head()
        empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        if most is None:
            return empty
        large = large or 0.0
        if large * large * width >= 2.0**62:
            raise ValueError("the scores may not fit 64 bits")
        exact = large * large * width >= 2.0**53  # beyond that floating-point products aren't whole
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
        own, held = some.column(0).to_numpy(), matrix(some.column(1), width)
        space = Space(held, most, pivots)
        table = pivot_table(rows, space, width)
        queries = table.where(asked)
        passes = max(1, -(-queries.count() * 8 * (width + len(space.pivots)) // pass_bytes))
        parts = []
        for n in range(passes):
            got = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == n).select("vec_id", "v").toArrow()
            if not got.num_rows:
                continue
            ids, q = got.column(0).to_numpy(), matrix(got.column(1), width)
            near = space.distances(np.column_stack([q.astype(np.float64), np.zeros(len(q))]))
            least = np.concatenate([[kth(s, own, i, k) for s, i in zip(q[at : at + 256] @ held.T, ids[at : at + 256], strict=True)] for at in range(0, len(ids), 256)])
            q = q if exact else q.astype(np.float64)
            make = lambda ids=ids, q=q, near=near, least=least: Search(ids, q, near, least, space, k)
            parts.append(written(table.mapInArrow(_searching(make, width, exact), RESULT), "pivot-near"))
        if not parts:
            return empty
        near = parts[0]
        for x in parts[1:]:
            near = near.unionByName(x)
        best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # rows of one id are one candidate
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return keep(written(best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "pivot-top"))


def top_scores_sql(every: int = 50, k: int = 5, scale: int = 256) -> str:
    """The same in DuckDB's SQL."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= {k}"""
