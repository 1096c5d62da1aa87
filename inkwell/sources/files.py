"""A folder that the driver and all executors reach, and small files put into it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; only a local master may do without that setting."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/inkwell-shared"
    return f"{where}/inkwell/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file, a manifest, a header or the like, through Spark's file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def commit(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file so that it is there whole or not at all: under another name first, then renamed."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}-drafts/{uuid.uuid4().hex}"
    put(spark, draft, text)
    (old, fs), (new, _) = _at(spark, draft), _at(spark, path)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"can't commit {name} in {folder}")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def get(spark: SparkSession, path: str) -> str:
    """The text of one small file."""
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none where there is no such folder."""
    at, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)
