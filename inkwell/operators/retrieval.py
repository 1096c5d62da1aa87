"""The k best passages of each document for a query, by shared words or by vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from .batches import parts


def ranked_sentences(text: Column, query: Column) -> Column:
    """array of (score, pos, sentence), best first: by the number of distinct query words, ties in order of the text.

    All within the row, so nothing is shuffled; a document's sentences are the only thing held.
    """
    held = F.struct(T.source_sentences(text).alias("s"), F.array_distinct(T.lowered(query)).alias("asked"))

    def ranked(x: Column) -> Column:
        scored = F.transform(x["s"], lambda s, i: F.struct((-F.size(F.array_intersect(x["asked"], T.lowered(s)))).alias("minus"), i.alias("pos"), s.alias("sentence")))
        return F.transform(F.array_sort(scored), lambda r: F.struct((-r["minus"]).alias("score"), r["pos"].alias("pos"), r["sentence"].alias("sentence")))

    return T.let(held, ranked)


def top_sentences(df: DataFrame, text: str, query: str, k: int) -> DataFrame:
    """Adds ``retrieved``: the k best sentences; ones that share nothing fill up."""
    return df.withColumn("retrieved", F.slice(ranked_sentences(F.col(text), F.col(query)), 1, k))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return T.let(F.struct(vector.alias("v"), norm.alias("n")), lambda x: F.transform(x["v"], lambda v: F.when(x["n"] > 0, v.cast("double") / x["n"]).otherwise(0.0)))


def top_vectors(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int = 10_000) -> DataFrame:
    """(query_id, vec_id, rank, similarity): the k nearest of ``vectors`` (vec_id, embedding) for each query (query_id, query).

    Queries go to every partition of the vectors as a matrix, about ``most_queries`` at a time (dealt by hashed id, so that
    more of them mean more passes and no larger matrix).  An Arrow batch of vectors is multiplied with it at once, and only
    each query's k best of the batch, and what ties with them, go on to the query's window.
    """
    passes = max(1, -(-queries.count() // most_queries))
    out = None
    for n in range(passes):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n)
        got = part.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")).toArrow()
        near = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_nearest(got, k), "query_id long, vec_id long, similarity double")
        out = near if out is None else out.unionByName(near)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")


def _matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of unit length, zero where a vector is null or zero."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        if v.is_valid:
            out[k, : len(v.values)] = v.values.to_numpy(zero_copy_only=False)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _nearest(queries: pa.Table, k: int):
    width = max((len(v.values) for v in queries.column(1) if v.is_valid), default=0)
    ids, asked = queries.column(0).to_numpy(), _matrix(queries.column(1), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (batch.num_rows and len(ids)):
                continue
            own = batch.column(0).to_numpy()
            held = _matrix(batch.column(1), width)
            for top in range(0, len(ids), 256):
                near = np.where(own[None, :] == ids[top : top + 256, None], -np.inf, asked[top : top + 256] @ held.T)
                least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
                q, v = np.nonzero((near >= least[:, None] - 1e-9) & (near > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(ids[top + q]), pa.array(own[v]), pa.array(near[q, v])], ["query_id", "vec_id", "similarity"])

    return run


ENCODED, FALLBACK = "encoded", "fallback:lexical"


def _vectors(model: Callable[[list[str]], np.ndarray], asked: list[str], at_once: int) -> dict[str, np.ndarray]:
    """Unit vectors of distinct texts, ``at_once`` to a call; the texts of a call that fails are tried one by one, and those that fail alone have none."""
    out = {}
    calls = [asked[i : i + at_once] for i in range(0, len(asked), at_once)]
    while calls:
        some = calls.pop()
        try:
            v = np.asarray(model(some), dtype=float).reshape(len(some), -1)
        except Exception:  # noqa: BLE001  whatever a model fails with, the rows' status says so
            calls += [[t] for t in some] if len(some) > 1 else []
            continue
        out.update(zip(some, v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12), strict=True))
    return out


def top_encoded(df: DataFrame, text: str, query: str, k: int, encode: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, at_once: int = 256) -> DataFrame:
    """Adds ``retrieved``, the k sentences (score, pos, sentence) nearest to the query, and ``retrieved_status``.

    ``encode`` is a factory of a function from texts to vectors; it is made once for each task and called with up to
    ``at_once`` of the distinct texts of a part of an Arrow batch.  Similarities are rounded to nine digits, ties go by place.  Without an
    encoder, or for rows with a text that it fails on, shared words decide, and the status is ``fallback:lexical``.
    """
    lexical = top_sentences(df, text, query, k)
    if encode is None:
        return lexical.withColumn("retrieved_status", F.lit(FALLBACK))
    kind = pa.list_(pa.struct([("score", pa.int32()), ("pos", pa.int32()), ("sentence", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in (x for whole in batches for x in parts(whole)):
            rows = [(q or "", x or []) for q, x in zip(batch.column("_asked").to_pylist(), batch.column("_sentences").to_pylist(), strict=True)]
            try:
                model = model or encode()
                known = _vectors(model, list(dict.fromkeys(t for q, x in rows for t in (q, *x))), at_once)
            except Exception:  # noqa: BLE001  a model that can't be made
                known = {}
            out, status = [], []
            for (asked, sentences), fallback in zip(rows, batch.column("retrieved"), strict=True):
                whole = all(t in known for t in (asked, *sentences))
                status.append(ENCODED if whole else FALLBACK)
                if not whole:
                    out.append(fallback.as_py())
                    continue
                near = np.round([known[x] @ known[asked] for x in sentences], 9)
                out.append([{"score": round(1000 * float(near[i])), "pos": int(i), "sentence": sentences[i]} for i in np.argsort(-near, kind="stable")[:k]])
            columns = {n: batch.column(n) for n in names} | {"retrieved": pa.array(out, kind), "retrieved_status": pa.array(status, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    names = df.columns
    held = lexical.withColumn("_asked", F.col(query)).withColumn("_sentences", T.source_sentences(F.col(text)))
    return held.mapInArrow(run, StructType([*df.schema.fields, StructField("retrieved", lexical.schema["retrieved"].dataType), StructField("retrieved_status", StringType())]))
