"""The inverted file of vectors against brute force in plain numpy."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.operators import vector_index
from inkwell.operators.vector_index import VectorIndex, recall

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    def unit(v):
        x = np.zeros(8)
        x[: len(v or [])] = v or []
        n = np.sqrt((x * x).sum())
        return x / n if n else x

    out = set()
    held = [(i, unit(v)) for i, v in rows if i is not None and all(c is not None and np.isfinite(c) for c in v or [])]
    for q, v in asked:
        if all(c is not None and np.isfinite(c) for c in v or []):
            near = sorted((-round(float(x @ unit(v)), 9), i) for i, x in held if i != q)[:k]
            out |= {(q, i, n + 1, -s + 0.0) for n, (s, i) in enumerate(near)}
    return out


def got(index, queries, k, probes=None):
    return {(r.query_id, r.vec_id, r["rank"], round(r.similarity, 9) + 0.0) for r in index.search(queries, k, probes).collect()}


def clustered(n, seed=5, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 8))
    return [(i, (centers[rng.integers(12)] + spread * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]


def test_exact_with_odd_rows(spark):
    """Copies by the hundred, zero, null, short and non-finite vectors, repeated ids, small chunks, and the index opened again."""
    rows = clustered(900) + [(2000 + i, [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 0.5]) for i in range(500)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [1.0, 2.0]), (3004, [float("nan")] * 8), (3005, [None, 1.0]), (None, [1.0] * 8), (3006, [1e-30] * 8), (3007, [float("inf")] + [0.0] * 7), (7, [1.0] * 8), (7, [1.0] * 8), (3008, [1e30, 1e30])]
    asked = [r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] >= 3000)]
    v = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).withColumn("cell", F.lit("x"))
    q = spark.createDataFrame(asked, "query_id long, query array<float>")
    index = VectorIndex.build(v, most_k=4, sample=200, most_cells=9, chunk=50)
    assert got(index, q, 4) == brute(rows, asked, 4)
    again = VectorIndex(spark, index.where)
    assert got(again, q, 3) == brute(rows, asked, 3) and got(again, q, 1, probes=99) == brute(rows, asked, 1)
    with pytest.raises(ValueError):
        index.search(q, 5)


def test_few_and_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.0, 1.0])], "query_id long, query array<float>")
    assert VectorIndex.build(none).search(q, 3).collect() == []
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5])]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA))
    assert got(index, q, 3) == brute(rows, [(1, [1.0, 0.0]), (9, [0.0, 1.0])], 3)
    assert index.search(q.where("false"), 3).collect() == []
    with pytest.raises(ValueError):
        VectorIndex(spark, f"{index.where}/codes")


def test_copies_are_no_pairs(spark):
    """A vector through half of the table costs a query k + 1 candidates for each chunk and no more."""
    rows = clustered(1500) + [(5000 + i, [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]) for i in range(1500)]
    v = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = VectorIndex.build(v, most_k=5)
    assert index.rows == 1506
    q = v.where("vec_id >= 5000").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    assert index.candidates(q, 5).count() <= 1500 * 6
    plan = index.candidates(q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_recall_and_pruning(spark):
    rows = clustered(3000)
    v = spark.createDataFrame(rows, SCHEMA)
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = VectorIndex.build(v, sample=1000)
    probes = index.probes_for(0.97)
    assert probes < len(index.centroids) / 2
    exact = index.search(asked, 5)
    r = recall(index.search(asked, 5, probes), exact).head()
    assert r.queries == 150 and r.recall >= 0.95
    sent = index.candidates(asked.select("query_id", F.col("query").cast("array<double>").alias("v")), 5).count()
    assert sent < 150 * 60


def peak(work):
    """MB that numpy and Python hold at most beyond what was there before; Arrow's own buffers aren't counted."""
    tracemalloc.start()
    out = work()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most, out


def test_products_are_bounded():
    """However many cells, sampled vectors or vectors of a chunk a batch meets, its matrices have at most PRODUCTS numbers."""
    rng = np.random.default_rng(1)
    x, centers = rng.normal(size=(10_000, 8)), rng.normal(size=(1024, 8))
    most, own = peak(lambda: vector_index.nearest_cells(x, centers))
    assert most < 20 and (own == ((centers * centers).sum(axis=1) - 2 * (x @ centers.T)).argmin(axis=1)).all()

    index = VectorIndex.__new__(VectorIndex)
    index.width, index.centroids, index.chunks, index.radius = 8, centers, np.full(1024, 40), np.full(1024, -2.0)
    index.sample_ids, index.sample = np.arange(16_384), vector_index.dense(pa.array(rng.normal(size=(16_384, 8)).tolist()), 8)
    asked = pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(rng.normal(size=(256, 8)).tolist())], ["query_id", "v"])
    most, sent = peak(lambda: sum(x.num_rows for x in index._scatter(5, 40)([asked])))
    assert most < 20 and sent == 256 * 40 * 40

    codes = rng.integers(-127, 128, (4096, 8), dtype=np.int8)
    columns = [*np.zeros((4, 4096), dtype=np.int32), np.arange(4096), np.arange(4096)]
    held = pa.RecordBatch.from_arrays([*map(pa.array, columns), vector_index._bytes(codes), pa.array(np.full(4096, 1e-3)), pa.array(np.full(4096, 9.0))], [f"c{i}" for i in range(9)])
    columns = [*np.zeros((3, 256), dtype=np.int32), np.ones(256, dtype=np.int32), np.arange(256) + 5000, np.arange(256) + 5000]
    sent = pa.RecordBatch.from_arrays([*map(pa.array, columns), vector_index._bytes(rng.normal(size=(256, 8)).astype(np.float32)), pa.array(np.zeros(256)), pa.array(np.full(256, -2.0))], [f"c{i}" for i in range(9)])
    most, found = peak(lambda: sum(x.num_rows for x in index._meet(5)([held, sent])))
    assert most < 40 and found == 256 * 4096


def test_more_queries_make_more_tasks(spark, monkeypatch):
    """What a task sorts doesn't grow with queries, vectors or candidates, and dealt queries have the same neighbours."""
    for name, n in (("DEAL", 40), ("TASK_BYTES", 50_000), ("TASK_ROWS", 200)):
        monkeypatch.setattr(vector_index, name, n, raising=False)
    rows = clustered(1200)
    asked = [r for r in rows if r[0] % 4 == 0]
    v, q = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "query_id long, query array<float>")
    index = VectorIndex.build(v, most_k=4, sample=200, most_cells=9, chunk=50)
    found = index.candidates(q.select("query_id", F.col("query").cast("array<double>").alias("v")), 4)
    sizes = found.select(F.spark_partition_id().alias("task")).groupBy("task").count()
    assert found.rdd.getNumPartitions() > 16 and sizes.agg(F.max("count")).head()[0] < found.count() / 8
    assert got(index, q, 4) == brute(rows, asked, 4)
