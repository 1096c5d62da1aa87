"""A training-data pipeline of five stages over ``documents``; each stage works on all that the one before it kept.

Defined results, of every stage: a null text counts as empty (and stays null until it is encoded), whole texts are read
however long, columns beside those of ``documents`` are carried along whatever their names, and an empty table gives an
empty one.  Ties and repeated rows: the classifier and the secrets network judge every row on its own; of rows with one
doc_id, and of rows without any that have equal texts, near-duplicate removal keeps one, and of a group the smallest doc_id;
rows of one doc_id get the same rate.  A corpus without labels keeps every document at rate 1.

A stage leaves the session with at most 1000 rows and 4 MB to an Arrow batch, also where it is called without ``run``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.bpe import bpe_documents
from inkwell.llm.common import delete, fewer_rows, load, scratch, shared_dir, small_batches
from inkwell.llm.mixing import mixed
from inkwell.llm.quality import keep_good, train
from inkwell.llm.secrets import redact
from inkwell.llm.simhash import keep_one

#: Multiples of each domain's expected tokens: of what the classifier let through, text that looks low or toxic is thinned
#: out, and clean text stays as it is, so no document comes twice after near-duplicates have gone.
RATES = {"low": 0.5, "toxic": 0.25, "clean": 1.0}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents of the corpus, takes for good and clean; the rest goes."""
    fewer_rows(spark)
    return keep_good(docs, train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near fingerprints (3 bits) or similar sets of five-word shingles (0.8 or more) link."""
    fewer_rows(spark)
    return keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and n_chars counted anew."""
    fewer_rows(spark)
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says, most of them once; domains are learned from the labelled documents of the whole corpus."""
    fewer_rows(spark)
    return mixed(docs, load(spark, sf_dir, "labels"), RATES, corpus=load(spark, sf_dir, "documents"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids as little-endian unsigned 32-bit integers."""
    fewer_rows(spark)
    return bpe_documents(docs, with_ids=True)


STAGES = [("quality", quality_stage), ("dedup", dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: The classifier, the network and the encoder can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet in the shared folder and read again.

    What a stage has written goes once the next one has been written, and its intermediate tables once it has.
    """
    where = f"{shared_dir(spark)}/inkwell/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark), small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}-{name}")
        docs = spark.read.parquet(f"{where}/{k}-{name}")
        if k:
            delete(spark, f"{where}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
