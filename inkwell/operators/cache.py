"""A score cache that outlives a run: an append-only table keyed by content hash, for one scorer and model version.

Below the root, ``scorer=<name>/version=<version>`` holds ``batches/batch=<batch>`` (Parquet, partitioned by hash prefix) and
``commits/<batch>``, a marker made after the batch is whole.  Only marked batches count, so a run that breaks off
loses the batch it was in and nothing else; the next one scores what is still missing.  A changed model version is another
folder, so it starts empty.  Failed calls are stored with their error and tried again by the next run.

What is known is found by a bitmap over hashes first: what it rules out is new for sure; of the rest the hashes alone meet the
known ones in an anti-join.  So the texts of known pairs aren't shuffled.  The new pairs are written once, then scored prefix by prefix, a committed batch at a time.

Two runs at the same time may score a pair twice; the smallest row of a hash counts.  ``compact`` folds committed batches into
one: its marker names what it replaces, so a reader sees either the old batches or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import scoring

SCHEMA = "hash string, entail double, contradict double, error string"
#: New pairs that make a batch; whole prefixes are added up until there are so many.
COMMIT_PAIRS = 50_000
#: Hash digits of a prefix, and log2 of a bitmap's bits at most (16 MB) and at least.
DIGITS, MOST_BITS, FEWEST_BITS = 1, 27, 16


def content_hash(premise: Column, claim: Column) -> Column:
    """SHA-256 of both texts, the first with its length, so no two pairs are written alike; null counts as empty."""
    p, c = (F.coalesce(x, F.lit("")) for x in (premise, claim))
    return F.sha2(F.concat(F.length(p).cast("string"), F.lit(":"), p, c), 256)


def _slot(size: int) -> Column:
    return F.pmod(F.xxhash64("hash"), F.lit(1 << size))


def _bitmap(known: DataFrame, size: int) -> DataFrame:
    bits = known.select(F.bitmap_bucket_number(_slot(size)).alias("bucket"), F.bitmap_bit_position(_slot(size)).alias("bit"))
    return bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _maybe(asked: DataFrame, bitmap: DataFrame, size: int) -> DataFrame:
    """Adds ``maybe``: false only for a hash that isn't in the bitmap."""
    bit = F.bitmap_bit_position(_slot(size))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))) != 0
    met = asked.withColumn("bucket", F.bitmap_bucket_number(_slot(size))).join(F.broadcast(bitmap), "bucket", "left")
    return met.withColumn("maybe", F.coalesce(held, F.lit(False))).drop("bucket", "bits")


class ScoreCache:
    """Scores of ``scorer`` at ``version`` below ``root``; ``asked`` and ``scored`` tell what the last call of ``scores`` did."""

    def __init__(self, spark: SparkSession, root: str, scorer: str = "overlap", version: str = "1") -> None:
        if scorer not in scoring.SCORERS:
            raise ValueError(f"no scorer {scorer!r}; there are {sorted(scoring.SCORERS)}")
        self.spark, self.scorer, self.where = spark, scorer, f"{root}/scorer={scorer}/version={version}"
        self.asked = self.scored = 0

    def committed(self) -> list[str]:
        """Names of the batches that count, those left out that a later one replaces.  One name for each batch, a few bytes each; ``compact`` keeps them few."""
        named = {x: files.get(self.spark, f"{self.where}/commits/{x}") for x in files.names(self.spark, f"{self.where}/commits")}
        gone = {x for text in named.values() for x in text.split()}
        return sorted(set(named) - gone)

    def rows(self) -> DataFrame:
        """(hash, entail, contradict, error) of all committed batches."""
        paths = [f"{self.where}/batches/batch={x}" for x in self.committed()]
        read = self.spark.read.schema(f"{SCHEMA}, batch string, prefix string").option("basePath", f"{self.where}/batches")
        return read.parquet(*paths).drop("batch", "prefix") if paths else self.spark.createDataFrame([], SCHEMA)

    def known(self) -> DataFrame:
        return self.rows().where("error IS NULL")

    def _commit(self, made: DataFrame, replaces: list[str] = ()) -> None:
        name = uuid.uuid4().hex
        made.select("hash", "entail", "contradict", "error", F.substring("hash", 1, DIGITS).alias("prefix")).write.partitionBy("prefix").parquet(f"{self.where}/batches/batch={name}")
        files.put(self.spark, f"{self.where}/commits/{name}", " ".join(replaces))

    def missing(self, pairs: DataFrame, work: str) -> DataFrame:
        """One row for each hash of ``pairs`` (premise, claim, hash as 32 bytes) that isn't known, and ``asked``; ``work``: a folder of this run.

        Texts are shuffled for those rows alone: hashes are made distinct and held against the known ones by themselves, and of the pairs
        that the bitmap can't rule out a second one over the missing hashes lets through what is needed.
        """
        known = self.known().select(F.unhex("hash").alias("hash"))
        n = known.count()
        held = pairs.withColumn("maybe", F.lit(False)) if not n else self._marked(pairs, known, n, f"{work}/bitmap")
        held.groupBy("hash").agg(F.max("maybe").alias("maybe")).write.parquet(f"{work}/asked")
        asked = self.spark.read.schema("hash binary, maybe boolean").parquet(f"{work}/asked")
        self.asked = asked.count()
        new = held.where("NOT maybe").drop("maybe")
        if n:
            asked.where("maybe").select("hash").join(known, "hash", "left_anti").write.parquet(f"{work}/unclear")
            unclear = self.spark.read.schema("hash binary").parquet(f"{work}/unclear")
            if k := unclear.count():
                again = self._marked(held.where("maybe").drop("maybe"), unclear, k, f"{work}/again").where("maybe").drop("maybe")
                new = new.unionByName(again.join(unclear, "hash", "left_semi").select(*new.columns))
        return new.dropDuplicates(["hash"])

    def _marked(self, pairs: DataFrame, hashes: DataFrame, n: int, at: str) -> DataFrame:
        """``maybe`` by a bitmap of the ``n`` hashes, written to ``at``."""
        size = min(MOST_BITS, max(FEWEST_BITS, (16 * n - 1).bit_length()))
        _bitmap(hashes, size).write.parquet(at)
        return _maybe(pairs, self.spark.read.parquet(at), size)

    def fill(self, pairs: DataFrame, batch: int = 32, commit_pairs: int = COMMIT_PAIRS) -> None:
        """Scores what isn't known of rows (premise, claim, ..): hash prefix after hash prefix, committed once ``commit_pairs`` are there."""
        work = f"{self.where}/work/{uuid.uuid4().hex}"
        hashed = pairs.select("premise", "claim", F.unhex(content_hash(F.col("premise"), F.col("claim"))).alias("hash"))
        new = self.missing(hashed, work).withColumn("prefix", F.substring(F.lower(F.hex("hash")), 1, DIGITS))
        new.write.partitionBy("prefix").parquet(f"{work}/new")
        sizes = self.spark.read.schema("premise string, claim string, hash binary, prefix string").parquet(f"{work}/new").groupBy("prefix").count().collect()  # 16 rows at most
        self.scored = sum(r["count"] for r in sizes)
        run, size = [], 0
        for prefix, n in sorted((r["prefix"], r["count"]) for r in sizes):
            run, size = [*run, prefix], size + n
            if size >= commit_pairs or prefix == max(r["prefix"] for r in sizes):
                part = self.spark.read.parquet(*(f"{work}/new/prefix={x}" for x in run)).select("premise", "claim", F.lower(F.hex("hash")).alias("hash"))
                self._commit(scoring.fresh_scores(part, self.scorer, batch, keep="hash"))
                run, size = [], 0
        files.remove(self.spark, work)

    def scores(self, pairs: DataFrame, batch: int = 32, commit_pairs: int = COMMIT_PAIRS) -> DataFrame:
        """Adds entail, contradict and error to rows (premise, claim, ..), as ``scored_pairs`` does, and keeps what had to be computed."""
        self.fill(pairs, batch, commit_pairs)
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "entail", "contradict", "error")).alias("s")
        known = self.rows().groupBy("hash").agg(best)
        met = pairs.withColumn("hash", content_hash(F.col("premise"), F.col("claim"))).join(known, "hash", "left")
        return met.select(*pairs.columns, "s.entail", "s.contradict", "s.error")

    def compact(self) -> None:
        """One batch in place of those there are; of a hash scored twice one row stays, and errors that were made good since go."""
        old = self.committed()
        if len(old) > 1:
            best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "entail", "contradict", "error")).alias("s")
            self._commit(self.rows().groupBy("hash").agg(best).select("hash", "s.entail", "s.contradict", "s.error"), old)

    def drop_replaced(self) -> None:
        """Deletes batches without a marker and those that a later one replaces, for a time when no other run reads or writes."""
        count = set(self.committed())
        for folder in ("commits", "batches"):  # a batch without its marker is none, so markers go first
            for name in files.names(self.spark, f"{self.where}/{folder}"):
                if name.removeprefix("batch=") not in count:
                    files.remove(self.spark, f"{self.where}/{folder}/{name}")
