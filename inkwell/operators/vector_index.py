"""An inverted file of vectors: nearest vectors by cosine, from codes of one byte a component, exactly ranked at the end.

``VectorIndex.build`` writes below a folder:

* ``vectors``: the vectors that can be among the nearest (row, vec_id, v).  Of equal vectors the ``most_k`` + 1 smallest ids are
  enough for any query; a partial limit keeps them, so a vector repeated through a third of the table is no hot key.
* ``codes``: the unit vectors by cell.  The cells' centroids come from k-means over a sample of SAMPLE vectors, those of the
  smallest hashed ids; every vector is coded.  A vector is its centroid plus ``step`` times whole numbers from -127 to 127; ``err``
  is the length of what is lost, which bounds how far any product with a unit query can be off.  A cell is dealt into chunks of
  about CHUNK vectors, so no cell is too large for a task.
* ``cells`` and ``sample``: centroids, radii and chunks, and the sample; both have fixed bounds, go to every task, and are
  all that the driver reads.

A search reads the codes once for about every DEAL queries.  Each query starts with its k-th best in the sample; it goes to the chunks of the cells that can
hold better ones (the product with the centroid plus the radius says so), or to the best ``probes`` cells.  A task holds one chunk
and streams the queries past it; only what can still be among a query's k best is looked up and ranked by exact cosine.
The numbers of tasks follow those of queries, chunks and candidates, so what a task sorts doesn't grow.
Without ``probes`` the result is that of brute force.  ``probes_for`` picks the number of cells by the recall within the sample.

Defined results: a null or zero vector is at cosine 0 from everything; a vector with a null or non-finite component, and a row
without an id, take no part; missing components of shorter vectors are 0; ties go to the smaller id; rows with the query's
id aren't its neighbours; of queries with the same id the smallest asks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files
from . import retrieval
from .batches import parts as in_parts

SAMPLE, MOST_CELLS, CHUNK, ROUNDS = 16_384, 1024, 4096, 8
#: Queries that meet a chunk at once, and more than single precision can lose in a product of unit vectors.
BLOCK, MARGIN = 256, 1e-5
#: Numbers in a matrix of products; it has fewer rows where there are more cells, or more vectors in the sample or in a chunk.
PRODUCTS = 1 << 18
#: Queries that meet a copy of a chunk, bytes of a task's rows, and candidates of a task; more of any make more tasks and no larger ones.
DEAL, TASK_BYTES, TASK_ROWS = 8192, 64 << 20, 1 << 19
MEETS = "cell int, chunk int, deal int, kind int, id long, own long, code binary, step double, err double"


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key long, v array<double>) of the rows that take part."""
    v = F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias(key), v.alias("v")).where(finite & F.col(key).isNotNull())


def dense(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of unit length, filled up or cut to ``width``; zero stays zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    line = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(column), max(width, int(sizes.max(initial=0)))))
    out[line, at] = flat
    largest = np.abs(out).max(axis=1, initial=0, keepdims=True)
    out = np.divide(out, largest, out=np.zeros_like(out), where=largest > 0)  # squares of tiny or huge numbers stay in range
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)[:, :width]


def lines(width: int) -> int:
    """So many rows of ``width`` products are worked on at once."""
    return min(BLOCK, max(1, PRODUCTS // max(1, width)))


def nearest_cells(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square, out, step = (centroids * centroids).sum(axis=1), np.zeros(len(x), dtype=np.int64), lines(len(centroids))
    for top in range(0, len(x), step):
        out[top : top + step] = (square - 2 * (x[top : top + step] @ centroids.T)).argmin(axis=1)
    return out


def centroids_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from the sample's first distinct vectors on."""
    _, first = np.unique(sample, axis=0, return_index=True)
    out = sample[np.sort(first)[:cells]].copy()
    for _ in range(rounds if len(out) else 0):
        own = nearest_cells(sample, out)
        n = np.bincount(own, minlength=len(out))
        total = np.zeros_like(out)
        np.add.at(total, own, sample)
        out[n > 0] = total[n > 0] / n[n > 0, None]
    return out


def coded(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, steps, errors and distances to the centroid of unit vectors in their cells."""
    rest = x - centroids[own]
    step = np.abs(rest).max(axis=1, initial=0) / 127
    code = np.rint(np.divide(rest, step[:, None], out=np.zeros_like(rest), where=step[:, None] > 0)).astype(np.int8)
    lost = rest - step[:, None] * code
    return code, step, np.sqrt((lost * lost).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _from_bytes(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


class VectorIndex:
    """The index below ``where``; ``build`` makes one, and any later run may open it by its folder."""

    def __init__(self, spark: SparkSession, where: str) -> None:
        if "done" not in files.names(spark, where):
            raise ValueError(f"no whole index at {where}")
        self.spark, self.where = spark, where
        self.width, self.most_k, self.rows = (int(x) for x in files.get(spark, f"{where}/done").split())
        cells = self.read("cells").orderBy("cell").toArrow()  # MOST_CELLS at most
        self.centroids = np.array(cells.column("centroid").to_pylist()).reshape(-1, self.width)
        self.radius, self.chunks = cells.column("radius").to_numpy(), cells.column("chunks").to_numpy()
        sample = self.read("sample").orderBy("at").toArrow()  # SAMPLE at most
        self.sample_ids, self.sample = sample.column("vec_id").to_numpy(), dense(sample.column("v"), self.width)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.where}/{name}")

    @classmethod
    def build(cls, vectors: DataFrame, where: str | None = None, vec_id: str = "vec_id", vector: str = "embedding", most_k: int = 10, sample: int = SAMPLE, most_cells: int = MOST_CELLS, chunk: int = CHUNK) -> VectorIndex:
        """Writes an index of ``vectors`` (vec_id, embedding) for up to ``most_k`` neighbours below ``where`` (a new folder by default)."""
        spark = vectors.sparkSession
        where = where or files.folder(spark, "vector-index")
        # row_number with a bound gets a partial limit before its exchange: of a repeated vector each task passes on most_k + 1 rows.
        copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        kept = clean(vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), "vec_id", "v").withColumn("copy", copy).where(F.col("copy") <= most_k + 1)
        kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v").write.parquet(f"{where}/vectors")
        held = spark.read.parquet(f"{where}/vectors")
        n, width = held.agg(F.count("*"), F.greatest(F.max(F.size("v")), F.lit(1))).head()
        some = held.orderBy(F.xxhash64("vec_id"), "row").limit(sample).select("vec_id", "v").toArrow()
        units = dense(some.column("v"), width)
        centers = centroids_of(units, int(min(most_cells, max(1, n**0.5))))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (x for whole in batches for x in in_parts(whole, 4 * BLOCK)):
                x = dense(batch.column(2), width)
                own = nearest_cells(x, centers) if len(x) else np.zeros(0, dtype=int)
                codes, step, err, far = coded(x, own, centers)
                columns = [pa.array(own.astype(np.int32)), batch.column(0), batch.column(1), _bytes(codes), pa.array(step), pa.array(err), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "row", "vec_id", "code", "step", "err", "far"])

        schema = "cell int, row long, vec_id long, code binary, step double, err double, far double"
        held.mapInArrow(code, schema).write.parquet(f"{where}/coded")
        made = spark.read.parquet(f"{where}/coded")
        sizes = {r["cell"]: r for r in made.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # a row for each cell
        chunks = [max(1, -(-sizes[c]["n"] // chunk)) if c in sizes else 0 for c in range(len(centers))]
        cells = [(c, centers[c].tolist(), float(sizes[c]["radius"]) if c in sizes else 0.0, chunks[c]) for c in range(len(centers))]
        spark.createDataFrame(cells, "cell int, centroid array<double>, radius double, chunks int").write.parquet(f"{where}/cells")
        spark.createDataFrame(list(zip(range(len(units)), some.column("vec_id").to_pylist(), some.column("v").to_pylist(), strict=True)), "at int, vec_id long, v array<double>").write.parquet(f"{where}/sample")
        dealt = made.withColumn("chunk", _chunk(chunks)).drop("far")
        dealt.repartition("cell", "chunk").write.partitionBy("cell").parquet(f"{where}/codes")
        files.put(spark, f"{where}/done", f"{width} {most_k} {n}")
        files.remove(spark, f"{where}/coded")
        return cls(spark, where)

    def probes_for(self, recall: float, k: int = 5, asked: int = 512) -> int:
        """How many cells hold that share of the k nearest within the sample, for the first ``asked`` of it.

        A sample is sparser than the table, so its neighbours lie further off and in later cells: the number errs upwards.
        """
        q = self.sample[:asked]
        if len(q) < 2:
            return len(self.centroids)
        near = np.where(self.sample_ids[None, :] == self.sample_ids[: len(q), None], -np.inf, q @ self.sample.T)
        best = np.argsort(-near, axis=1, kind="stable")[:, :k]
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        ranks = np.sort(np.take_along_axis(place, nearest_cells(self.sample, self.centroids)[best], axis=1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1

    def candidates(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, row, low, high): bounds of the cosine of every vector that may be among a query's k nearest, of (query_id, v)."""
        if k > self.most_k:
            raise ValueError(f"the index keeps copies for {self.most_k} neighbours at most")
        asked, chunks = queries.count(), max(1, int(self.chunks.sum()))
        deals = max(1, -(-asked // DEAL))
        sent = queries.select("query_id", "v").mapInArrow(self._scatter(k, probes, deals), MEETS)
        codes = self.spark.read.schema("cell int, chunk int, row long, vec_id long, code binary, step double, err double").parquet(f"{self.where}/codes")
        deal = F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal")
        held = codes.select("cell", "chunk", deal, F.lit(0).alias("kind"), F.col("row").alias("id"), F.col("vec_id").alias("own"), "code", "step", "err")
        # Rows that meet, with some 100 bytes beside their vectors, if each query goes to every chunk, or to the most that ``probes`` cells have.
        most = chunks if probes is None else int(np.sort(self.chunks)[::-1][:probes].sum())
        size = deals * self.rows * (self.width + 100) + asked * most * (4 * self.width + 100)
        tasks = min(chunks * deals, max(4 * self._parts(), -(-size // TASK_BYTES)))
        met = held.unionByName(sent).repartition(tasks, "cell", "chunk", "deal").sortWithinPartitions("cell", "chunk", "deal", "kind", "id")
        return met.mapInArrow(self._meet(k), "query_id long, row long, low double, high double")

    def _parts(self) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """(query_id, vec_id, rank, similarity) for queries (query_id, query): exact, or within the best ``probes`` cells."""
        asked = clean(queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("v")), "query_id", "v").groupBy("query_id").agg(F.min("v").alias("v"))
        if not self.rows:
            return self.spark.createDataFrame([], "query_id long, vec_id long, rank int, similarity double")
        at = files.folder(self.spark, "vector-search")
        asked.write.parquet(f"{at}/asked")
        asked = self.spark.read.schema(asked.schema).parquet(f"{at}/asked")
        self.candidates(asked, k, probes).write.parquet(f"{at}/found")
        found = self.spark.read.parquet(f"{at}/found")
        found = found.repartition(max(self._parts(), -(-found.count() // TASK_ROWS)), "query_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
        kth = F.max(F.when(F.col("n") == k, F.col("low"))).over(Window.partitionBy("query_id"))
        near = found.withColumn("n", place).withColumn("least", kth).where(F.col("high") >= F.coalesce("least", F.lit(-2.0))).select("query_id", "row")
        held = self.read("vectors").select("row", "vec_id", F.col("v").alias("x"))
        ranked = near.join(held, "row").join(asked, "query_id").select("query_id", "vec_id", padded_cosine(F.col("v"), F.col("x")).alias("similarity"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
        return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")

    def _scatter(self, k: int, probes: int | None, deals: int = 1):
        width, centers, chunks, radius, ids, units = self.width, self.centroids, self.chunks, self.radius, self.sample_ids, self.sample

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = np.cumsum(chunks) - chunks
            step = lines(max(len(ids), len(centers), int(chunks.sum())))
            for batch in batches:
                for top in range(0, batch.num_rows, step):
                    part = batch.slice(top, step)
                    own, q = part.column(0).to_numpy(), dense(part.column(1), width)
                    near = np.where(ids[None, :] == own[:, None], -np.inf, q @ units.T)
                    least = np.partition(near, -k, axis=1)[:, -k] - MARGIN if near.shape[1] >= k else np.full(len(q), -np.inf)
                    least = np.where(np.isfinite(least), least, -2.0)
                    reach = q @ centers.T
                    if probes is None:
                        goes = reach + radius + MARGIN >= least[:, None]
                    else:
                        goes = np.zeros(reach.shape, dtype=bool)
                        np.put_along_axis(goes, np.argsort(-reach, axis=1, kind="stable")[:, :probes], True, axis=1)
                    at, cell = np.nonzero(goes & (chunks > 0))
                    n = chunks[cell]
                    chunk = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at, cell, payload = np.repeat(at, n), np.repeat(cell, n), _bytes(q.astype(np.float32))
                    deal = ((own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(deals)).astype(np.int32)  # ids may share a factor
                    for k0 in range(0, len(at), 8192):
                        some = slice(k0, k0 + 8192)
                        i = at[some]
                        columns = [pa.array(cell[some].astype(np.int32)), pa.array(chunk[some].astype(np.int32)), pa.array(deal[i]), pa.array(np.ones(len(i), dtype=np.int32)), pa.array(own[i]), pa.array(own[i]), payload.take(pa.array(i)), pa.array(np.zeros(len(i))), pa.array(least[i])]
                        yield pa.RecordBatch.from_arrays(columns, ["cell", "chunk", "deal", "kind", "id", "own", "code", "step", "err"])

        return run

    def _meet(self, k: int):
        width, centers = self.width, self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, parts, chunk = None, [], None
            for batch in batches:
                key = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
                starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, dtype=int)
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                    part, (cell, number, deal, kind) = batch.slice(a, b - a), key[a].tolist()
                    if (cell, number, deal) != current:
                        current, parts, chunk = (cell, number, deal), [], None
                    if kind == 0:
                        parts.append((part.column(4).to_numpy(), part.column(5).to_numpy(), _from_bytes(part.column(6), np.int8, width), part.column(7).to_numpy(), part.column(8).to_numpy()))
                        continue
                    if chunk is None and parts:
                        rows, ids, codes, step, err = (np.concatenate(x) for x in zip(*parts, strict=True))
                        chunk, parts = (rows, ids, codes.astype(np.float32).T.copy(), step.astype(np.float32), err + MARGIN), []
                    step = lines(len(chunk[0])) if chunk else 1
                    for top in range(0, part.num_rows if chunk else 0, step):
                        yield _held_against(part.slice(top, step), chunk, centers[cell].astype(np.float32), width, k)

        return run


def _held_against(part: pa.RecordBatch, chunk: tuple, center: np.ndarray, width: int, k: int) -> pa.RecordBatch:
    """What of a chunk may be among the k nearest of each of the queries."""
    rows, ids, codes, step, err = chunk
    q, own, least = _from_bytes(part.column(6), np.float32, width), part.column(5).to_numpy(), part.column(8).to_numpy()
    near = np.where(ids[None, :] == own[:, None], -np.inf, (q @ center)[:, None] + (q @ codes) * step)
    low = near - err
    if near.shape[1] >= k:
        least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
    i, j = np.nonzero((near + err >= least[:, None]) & (near > -np.inf))
    return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(rows[j]), pa.array(low[i, j].astype(float)), pa.array((near + err)[i, j].astype(float))], ["query_id", "row", "low", "high"])


def padded_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, of which the shorter counts as filled up with zeros; 0 where either is zero."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    n = F.greatest(F.size(a), F.size(b))
    fill = lambda x: F.when(F.size(x) == n, x).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: zero(F.try_element_at(x, i))))
    return F.when(n > 0, retrieval.cosine(fill(a), fill(b))).otherwise(0.0)


def _chunk(chunks: list[int]) -> Column:
    return F.pmod(F.xxhash64("row"), F.get(F.array(*map(F.lit, chunks or [1])), F.col("cell")).cast("long")).cast("int")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, recall: the share of the exact (query_id, vec_id) that were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
