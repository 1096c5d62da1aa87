"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters; ``bytes.split()`` cuts at exactly them.
WHITE = r"\x20\x09-\x0D"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and ``more``; any other column, whatever its name, is pruned from the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset a local one serves a local master; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/inkwell-shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Paths of the tables written within each open ``scratch``, the innermost last.
_open: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, and its reader knows no partitioning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables written within, but for those given to ``keep``, which pass to the scratch around it.

    What is still to be computed from a table has to keep it; a table that only went into other written ones may go.
    """
    mine, kept = [], set()
    _open.append(mine)

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.written_to)
        return table

    try:
        yield keep
    finally:
        _open.pop()
        for path in mine:
            if path not in kept:
                delete(spark, path)
        if _open:
            _open[-1].extend(x for x in mine if x in kept)


#: Bounds of an Arrow batch in rows and in bytes; the byte bound holds for long texts and sets, so memory doesn't grow with either.
BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())


def fewer_rows(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """From now on the session's queries send at most ``rows`` rows and about ``size`` bytes at a time to Python, so that few texts are in memory; a longer text comes by itself.

    A lazy result is computed with the settings of that later time, so whoever returns one can't put the old ones back.
    """
    now = int(spark.conf.get(BATCH_ROWS))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH_ROWS, rows)
    now = _bytes(spark)
    if now <= 0 or now > size:
        spark.conf.set(BATCH_BYTES, size)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> Iterator[None]:
    """``fewer_rows`` for the queries run within."""
    before = {k: spark.conf.get(k) for k in (BATCH_ROWS, BATCH_BYTES)}
    fewer_rows(spark, rows, size)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: log2 of the fewest and most bits of a bitmap over hashed ids, which so is at most 16 MB, and bits for each id.
FEWEST_BITS, MOST_BITS, BITS_EACH = 16, 27, 16


def bitmap_size(n: int) -> int:
    """log2 of the bits of a bitmap over ``n`` ids: BITS_EACH or more for each id, as long as that is within MOST_BITS."""
    return min(MOST_BITS, max(FEWEST_BITS, (BITS_EACH * n - 1).bit_length()))


def _slot(size: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << size))


def bitmap(ids: DataFrame, size: int) -> DataFrame:
    """(bucket, bits, size): at most 2^size / 32768 rows of 4 KB, whatever the number of ids."""
    rows = ids.select(F.bitmap_bucket_number(_slot(size)).alias("bucket"), F.bitmap_bit_position(_slot(size)).alias("bit"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def in_bitmap(docs: DataFrame, bits: DataFrame, size: int) -> DataFrame:
    """Adds ``maybe``: false only for ids that aren't in the bitmap."""
    bit = F.bitmap_bit_position(_slot(size))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))) != 0
    out = docs.withColumn("bucket", F.bitmap_bucket_number(_slot(size))).join(F.broadcast(bits), "bucket", "left")
    return out.withColumn("maybe", F.coalesce(held, F.lit(False))).drop("bucket", "bits")


def marked_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``maybe``: false only where doc_id surely isn't among ``ids``; about one in BITS_EACH of the others is let through.

    The bitmap grows with the number of ids up to 2^MOST_BITS bits.  For n ids beyond 2^MOST_BITS / BITS_EACH, 8 million,
    it lets through a share of 1 - exp(-n / 2^MOST_BITS) of the others; what is done to them stays the same, and at worst
    every row goes through the one shuffle that follows.
    """
    size = bitmap_size(ids.count())
    return in_bitmap(docs, written(bitmap(ids, size), "ids"), size)


def set_apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose doc_id surely isn't among ``ids``, and (row, doc_id) of the rest, which alone need a shuffle."""
    held = marked_ids(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id")), ids)
    return held.where("NOT maybe").select("row.*"), held.where("maybe").select("row", "doc_id")


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies ``work`` to each Arrow batch; one batch is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def per_document(df: DataFrame, make: Callable[[], Callable], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Appends to the ``keep`` columns what ``make()(text)`` returns, a tuple with a value for each further column of ``schema``.

    ``make`` runs once in each Python worker's task, so tables and models are built there and not for each row.
    """
    names = [x.split()[0] for x in schema.split(",")][len(keep) :]
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [arrow[x.split()[1]] for x in schema.split(",")][len(keep) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = list(zip(*(work(x) for x in texts(batch.column(batch.schema.names.index("text")))), strict=True))
            columns = [batch.column(batch.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x, t) for x, t in zip(made, types, strict=True)], list(keep) + names)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[str]:
    """The values one at a time, null as empty; the batch isn't copied to a Python list."""
    for x in column:
        yield x.as_py() or ""
