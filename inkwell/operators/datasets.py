"""Training sets: fine-tuning rows, preference pairs, and single judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sft(rows: DataFrame) -> DataFrame:
    """prompt, completion: the completion starts with a space."""
    return rows.select("prompt", F.concat(F.lit(" "), F.trim("chosen")).alias("completion"))


def dpo(pairs: DataFrame) -> DataFrame:
    return pairs.select("prompt", "chosen", "rejected")


def kto(pairs: DataFrame) -> DataFrame:
    """prompt, completion, label: each (prompt, chosen) is positive once, every rejected is negative each time."""
    good = pairs.select("prompt", F.col("chosen").alias("completion")).distinct().withColumn("label", F.lit(True))
    return good.unionByName(pairs.select("prompt", F.col("rejected").alias("completion"), F.lit(False).alias("label")))


def sound(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with all three texts, and those that lack one; the caller decides whether the latter stop the run."""
    filled = F.lit(True)
    for c in ("prompt", "chosen", "rejected"):
        filled = filled & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return pairs.where(filled), pairs.where(~filled)


def lengths(texts: DataFrame, text: str) -> DataFrame:
    """shortest, median, upper_median, longest: words of the texts."""
    n = texts.select(F.regexp_count(F.col(text), F.lit(r"\S+")).alias("n"))
    counts = n.groupBy("n").agg(F.count("*").alias("k"))  # few distinct lengths, whatever the number of texts
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("xs"), F.sum("k").alias("total"))

    def at(place):
        """The length at a place counted from 0."""
        step = lambda a, x: F.struct((a["seen"] + x["k"]).alias("seen"), F.when((a["seen"] <= place) & (place < a["seen"] + x["k"]), x["n"]).otherwise(a["n"]).alias("n"))
        return F.aggregate("xs", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("n")), step, lambda a: a["n"])

    upper, lower = F.expr("total div 2"), F.expr("(total - 1) div 2")
    return listed.select(at(F.lit(0)).alias("shortest"), ((at(upper) + at(lower)) / 2).alias("median"), at(upper).alias("upper_median"), at(F.col("total") - 1).alias("longest")).where("shortest IS NOT NULL")


def kinds(pairs: DataFrame, kind: str = "kind") -> DataFrame:
    return pairs.groupBy(kind).agg(F.count("*").alias("rows"))


def equal_pairs(pairs: DataFrame) -> DataFrame:
    """How many pairs have the same text on both sides; should be none."""
    return pairs.agg(F.count_if(F.col("chosen") == F.col("rejected")).alias("equal_pairs"))


def overlap_report(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """both, left_only, right_only: how two tables' keys meet."""
    a, b = left.select(*key).distinct().withColumn("l", F.lit(1)), right.select(*key).distinct().withColumn("r", F.lit(1))
    met = a.join(b, key, "full")
    return met.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))
