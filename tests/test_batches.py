"""What Python makes of one Arrow batch is bounded, however many rows Spark sends at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.operators import batches, retrieval, scoring, spans


def test_parts_are_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": ["x" * (3 << 20 if i == 500 else 10) for i in range(1000)]})
    made = list(batches.parts(batch))
    assert [i for x in made for i in x.column(0).to_pylist()] == list(range(1000))
    assert all(x.num_rows <= batches.ROWS and (x.num_rows == 1 or x.nbytes <= batches.BYTES) for x in made)
    assert list(batches.parts(batch.slice(0, 0))) == []


def _same():
    return lambda prompt: prompt


@pytest.mark.parametrize(
    "name, of",
    [
        ("mentions", lambda df: spans.with_mentions(df.select("key", "text", F.expr("array(named_struct('surface', 'a', 'type', 'date'))").alias("c")), "text", "c")),
        ("mentions_of", lambda df: spans.with_mentions_of(df.select("key", "text"), "text", [("a", "date")])),
        ("tagged", lambda df: spans.tagged(df.select("key", F.split("text", "b").alias("parts"), F.expr(f"CAST(array() AS {spans.MENTION})").alias("m")))),
        ("iob_spans", lambda df: spans.entities(df.select(F.col("key").alias("doc_id"), F.split("text", "b").alias("tokens"), F.transform(F.split("text", "b"), lambda _: F.lit("B-DATE")).alias("tags")))),
        ("iob_sets", lambda df: spans.entities(df.select(F.col("key").alias("doc_id"), F.split("text", "b").alias("tokens"), F.transform(F.split("text", "b"), lambda _: F.lit("B-DATE")).alias("tags")), "set")),
        ("judge", lambda df: scoring.chat_column(df, "text", "answer", _same, tries=1, wait=0.0)),
        ("scores", lambda df: scoring.fresh_scores(df.select(F.col("text").alias("premise"), F.col("text").alias("claim")), "overlap")),
    ],
)
def test_a_large_batch_leaves_in_parts(spark, monkeypatch, name, of):
    held = []
    df = spark.range(3000).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("aba aba "), F.col("id").cast("string")).alias("text"))
    kind = type(df)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *a, **k: held.append((self, f)) or real(self, f, schema, *a, **k))
    of(df)
    monkeypatch.undo()
    given, run = held[0]
    rows = given.toArrow().combine_chunks().to_batches()
    assert max(x.num_rows for x in rows) == 3000
    made = list(run(iter(rows)))
    assert len(made) >= 3000 // batches.ROWS and sum(x.num_rows for x in made) >= 3000


def _bounded():
    def model(xs):
        if not 1 < len(xs) <= 4 * batches.ROWS:
            raise ValueError(f"{len(xs)} texts")
        return [[1.0, len(x)] for x in xs]

    return model


def test_encoder_gets_the_texts_of_a_part(spark):
    df = spark.range(2000).coalesce(1).select("id", F.concat(F.lit("The mill stood by the river for years, number "), "id", F.lit(". It was never seen again by anyone in year "), "id", F.lit(".")).alias("text"), F.concat(F.lit("mill "), "id").alias("q"))
    got = retrieval.top_encoded(df, "text", "q", 1, _bounded, at_once=1 << 20).groupBy("retrieved_status").count().collect()
    assert [tuple(r) for r in got] == [(retrieval.ENCODED, 2000)]
