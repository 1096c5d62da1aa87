"""Operator 5: token counts as delta-maintained rollups.

A batch is a table of signed changes: an insert adds a document's counts, a delete takes them off, a revision does both,
under the same or another tokenizer version.  A commit sums the batch by source, language and tokenizer version (partial
sums on the map side, so a source with a third of all rows sends one row from each task) and writes those few rows under
the batch's own name; a batch whose marker is there already is not applied again, however often it is sent, and one that
broke off before its marker is overwritten.  Totals are the sum of the committed deltas; compaction folds them into one.

Defined results: a null source or language is a key of its own; a null text counts as empty; a null count adds nothing;
keys whose documents have all been taken off again are left out of the totals; repeated rows count each time; an empty
batch commits and changes nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_ranks, encode, encoding
from .common import scratch, shared_dir, texts, written

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def inserts(rows: DataFrame, times: str | None = None) -> DataFrame:
    """Changes that add rows (source, lang, tokenizer, tokens); with ``times`` a row stands for as many documents as that column says."""
    n = F.col(times).cast("long") if times else F.lit(1).cast("long")
    return rows.select(*KEYS, n.alias("docs"), (n * F.coalesce(F.col("tokens").cast("long"), F.lit(0))).alias("tokens"))


def deletes(rows: DataFrame, times: str | None = None) -> DataFrame:
    """Changes that take the same rows off."""
    return inserts(rows, times).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame, times: str | None = None) -> DataFrame:
    return deletes(old, times).unionByName(inserts(new, times))


class Rollup:
    """Totals under ``path``, which every executor and the driver reach through Spark's file system."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/inkwell/rollup-{uuid.uuid4().hex}"

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._file(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _mark(self, name: str, folded: list[str]) -> None:
        """A marker appears at once and whole: it is written aside and renamed."""
        fs, aside = self._file(f"aside-{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray("\n".join(folded).encode()))
        stream.close()
        fs.mkdirs(self._file("committed")[1])
        marker = self._file(f"committed/{name}")[1]
        if not fs.rename(aside, marker):
            fs.delete(aside, False)
            if not fs.exists(marker):  # else another committer of the same batch was first
                raise OSError(f"the marker of {name} can't be written; the batch isn't committed")

    def committed(self) -> list[str]:
        """Names of the batches that were applied, and of the folds of them."""
        return self._names("committed")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if it was already.  A name is one path segment, and ``fold-`` begins those of compaction."""
        if not re.fullmatch(r"[A-Za-z0-9._=-]+", batch) or batch.startswith(("fold-", ".", "_")):
            raise ValueError(f"not a batch name: {batch!r}")
        fs, marker = self._file(f"committed/{batch}")
        if fs.exists(marker):
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")  # what a broken-off attempt left goes
        self._mark(batch, [])
        return True

    def live(self) -> list[str]:
        """Committed deltas that no fold has replaced."""
        names = self.committed()
        folds = [f"{self.path}/committed/{x}" for x in names if x.startswith("fold-")]
        gone = {r[0] for r in self.spark.read.text(folds).collect()} if folds else set()
        return [x for x in names if x not in gone]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens."""
        live = self.live()
        if not live:
            return self.spark.createDataFrame([], DELTA)
        deltas = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/deltas/{x}" for x in live))
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> str | None:
        """Folds all live deltas into one; its marker lists what it replaces, so readers see either those or the fold."""
        live = self.live()
        if len(live) < 2:
            return None
        name = f"fold-{uuid.uuid5(uuid.NAMESPACE_OID, '|'.join(live)).hex}"
        self.totals().write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        self._mark(name, live)
        return name


def counted(docs: DataFrame, tokenizer: str = "byte_bpe_50k", rank_file: str | None = None, pattern: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, text_hash (32 bytes), and ``more`` long columns, of every whole text; map-only."""
    default = default_ranks() if rank_file is None or pattern is None else ("", "")
    rank_file, pattern = rank_file or default[0], pattern or default[1]
    names = ["doc_id", "source", "lang", "tokenizer", "tokens", "text_hash", *more]

    def run(batches):
        encoding(rank_file, pattern)
        for batch in batches:
            n, digest = [], []
            for t in texts(batch.column(3)):
                n.append(len(encode(t, rank_file, pattern)))
                digest.append(hashlib.sha256(t.encode()).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *batch.columns[4:]], names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"), *more)
    types = {"doc_id": "long", "tokens": "long", "text_hash": "binary"} | dict.fromkeys(more, "long")
    return rows.mapInArrow(run, ", ".join(f"{x} {types.get(x, 'string')}" for x in names))


def both_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, text_hash, and words, the count of the version before the byte-level one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return counted(docs.withColumn("words", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), tokenizer, more=("words",))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """source, lang, tokenizer, docs, tokens after a corpus's usual history over all documents.

    All are inserted by word count; exact copies (all rows of equal texts but those with the smallest doc_id) are deleted;
    what is left is revised from word counts to byte-level BPE counts; and the first batch is sent again, which changes
    nothing.
    """
    with scratch(docs.sparkSession):
        # Both counts of a text in one row, and whether it is a copy: one join of hashes marks them, and batches only filter.
        both = written(both_counts(docs), "rollup-counts")
        first = written(both.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "rollup-first")
        marked = both.join(first, "text_hash", "left").select("source", "lang", "words", "tokens", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"))
        marked = written(marked.groupBy("source", "lang", "copy", "words", "tokens").agg(F.count("*").alias("n")), "rollup-marked")

        def rows(tokenizer: str, count: str) -> DataFrame:
            return marked.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(count).alias("tokens"), "n", "copy")

        old, new = rows("words-1", "words"), rows("byte_bpe_50k", "tokens")
        rollup = Rollup(docs.sparkSession, path)
        rollup.commit("1-insert", inserts(old, "n"))
        rollup.commit("2-delete-copies", deletes(old.where("copy"), "n"))
        rollup.commit("3-revise", revisions(old.where("NOT copy"), new.where("NOT copy"), "n"))
        rollup.commit("1-insert", inserts(old, "n"))
    return rollup.totals()
