"""Corpora by manifest: a name and a source pick an adapter, which gives a DataFrame of records."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ADAPTERS: dict[str, Callable[[SparkSession, str, dict], DataFrame]] = {}


def adapter(name: str):
    def put(load):
        ADAPTERS[name] = load
        return load

    return put


def available() -> list[str]:
    return sorted(ADAPTERS)


def manifest(spark: SparkSession, folder: str) -> dict:
    """corpus.json, read through Spark, so that it may lie in any store."""
    return json.loads(spark.read.text(f"{folder}/corpus.json", wholetext=True).head()[0])


def load_corpus(spark: SparkSession, name: str, source: str | None = None, limit: int | None = None, data: str = "data") -> DataFrame:
    """Records of one source; 0 or no limit means all.  A limit takes the smallest ids, so it is the same in every run."""
    if name.lower() == "synthetic":
        return _limited(ADAPTERS["synthetic"](spark, "", {}), limit)
    about = manifest(spark, f"{data}/{name}")
    spec = {"corpus": about.get("name", name)} | about["sources"][source or about["default_source"]]
    return _limited(find(spec["adapter"])(spark, f"{data}/{name}", spec), limit)


def find(name: str) -> Callable[[SparkSession, str, dict], DataFrame]:
    """The adapter of this name; ``tei_x``, a variant for some archive, is read as ``tei``."""
    for known in (name, name.partition("_")[0]):
        if known in ADAPTERS:
            return ADAPTERS[known]
    raise KeyError(f"no adapter {name!r}; there are {available()}")


def _limited(records: DataFrame, limit: int | None) -> DataFrame:
    return records.orderBy("id").limit(limit) if limit else records
