"""Best of N: picks, gates, and labelled pairs.

Candidates are rows (record_id, i, text, F, unsup, linguistic, composite, ...).  Ties are settled the same way in any run:
by the index of the candidate.  Each rule is a grouped minimum or maximum over a struct, with map-side combination; no
window needs a group's rows in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files

def number(c: str | Column) -> Column:
    """NaN as null, as it would otherwise be the greatest."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def best(score: Column, fields: Column, where: Column | None = None, last: bool = False) -> Column:
    """Aggregate: the fields of the row with the highest score; among equals the first index (or the last)."""
    key = F.struct(score.alias("s"), (F.col("i") if last else -F.col("i")).alias("t"))
    keep = score.isNotNull() if where is None else score.isNotNull() & where
    return F.max_by(fields, F.when(keep, key))


def rules(candidates: DataFrame, rewards: list[str], gate_unsup: int = 1, eligible: Column | None = None) -> dict[str, tuple[Column, Column]]:
    """Score and condition of each pick.

    A candidate's score is its reward plus its length penalty; filtered and unscoreable ones don't compete for the gate.
    """
    ok = F.lit(True) if eligible is None else eligible
    gate = ok & (F.col("unsup") <= gate_unsup)
    if "status" in candidates.columns:
        gate = gate & ~F.coalesce(F.col("status").startswith("unscoreable:"), F.lit(False))
    score = lambda r: number(F.col(r) + F.col("length_guard"))
    return {f"pick_{r}": (score(r), ok) for r in rewards} | {"pick_gated": (score("linguistic"), gate)}


def pick(candidates: DataFrame, rewards: list[str], gate_unsup: int = 1, eligible: Column | None = None) -> DataFrame:
    """record_id, pick_<reward> for each, and pick_gated: the richest of those within the gate; null where there is none."""
    made = [best(score, F.col("i"), where).alias(name) for name, (score, where) in rules(candidates, rewards, gate_unsup, eligible).items()]
    return candidates.groupBy("record_id").agg(*made)


def diverges(picks: list[str]) -> Column:
    """Whether the rewards pick different candidates."""
    return F.size(F.array_distinct(F.filter(F.array(*picks), lambda x: x.isNotNull()))) > 1


FIELDS = ("i", "text", "F", "unsup", "linguistic")


def reward_pairs(candidates: DataFrame, gate_unsup: int = 1, fab_unsup: int = 2, fab_f: float = 0.6) -> DataFrame:
    """record_id, chosen, rejected, kind: the richest candidate within the gate against the richest that isn't faithful.

    The rejected one must not be the chosen, so candidates are read twice; they are written once before, as they may be costly to
    compute.
    """
    spark, kept = candidates.sparkSession, files.folder(candidates.sparkSession, "reward-pairs")
    candidates.select("record_id", *FIELDS).write.parquet(kept)
    candidates = spark.read.schema(candidates.select("record_id", *FIELDS).schema).parquet(kept)
    row = F.struct(*FIELDS)
    bad = (F.col("unsup") >= fab_unsup) | (F.col("F") <= fab_f)
    score = number("linguistic")
    first = candidates.groupBy("record_id").agg(best(score, row, F.col("unsup") <= gate_unsup).alias("chosen"), F.count("*").alias("n")).where("chosen IS NOT NULL AND n >= 2")
    others = candidates.join(first.select("record_id", F.col("chosen.i").alias("c")), "record_id").where(F.col("i") != F.col("c"))
    second = others.groupBy("record_id").agg(best(score, row, bad).alias("rejected")).where("rejected IS NOT NULL")
    return first.select("record_id", "chosen").join(second, "record_id").withColumn("kind", F.when(F.col("rejected.unsup") >= fab_unsup, "fabrication").otherwise("flattened"))


def mean_ratings(ratings: DataFrame) -> DataFrame:
    """record_id, i, rating: the mean of all annotators."""
    return ratings.groupBy("record_id", F.col("candidate_i").alias("i")).agg(F.avg("overall").alias("rating"))


def human_pairs(candidates: DataFrame, ratings: DataFrame, min_gap: float = 1.0, gate_unsup: int = 1, gate_chosen: bool = False) -> DataFrame:
    """record_id, chosen, rejected, kind, ratings: the best rated against the worst rated.

    Among equal ratings the worst is the first candidate and the best is the last.  At least two must be rated, and the gap
    must be ``min_gap`` or more.
    """
    rated = candidates.join(mean_ratings(ratings), ["record_id", "i"])
    row = F.struct(*FIELDS, "rating")
    made = rated.groupBy("record_id").agg(best(F.col("rating"), row, last=True).alias("chosen"), F.min_by(row, F.struct("rating", "i")).alias("rejected"), F.count("*").alias("n"))
    made = made.where((F.col("n") >= 2) & (F.col("chosen.rating") - F.col("rejected.rating") >= min_gap))
    if gate_chosen:
        made = made.where(F.col("chosen.unsup") <= gate_unsup)
    return made.drop("n").withColumn("kind", F.when(F.col("rejected.unsup") >= gate_unsup + 1, "fabrication").otherwise("low_rated"))


def authored_pairs(candidates: DataFrame, authored: DataFrame) -> DataFrame:
    """record_id, author, confidence, chosen, rejected, kind: every authored text against the least faithful candidate.

    Where that candidate is blank or the same text, the row is for fine-tuning only (rejected null).
    """
    mine = authored.select("record_id", "author", "confidence", F.trim("text").alias("chosen")).where("chosen <> ''")
    worst = candidates.groupBy("record_id").agg(F.min_by(F.struct(F.trim("text").alias("text"), "F", "unsup"), F.struct(number("F"), "i")).alias("worst"))
    out = mine.join(worst, "record_id")
    ok = (F.coalesce(F.col("worst.text"), F.lit("")) != "") & (F.col("worst.text") != F.col("chosen"))
    return out.select("record_id", "author", "confidence", "chosen", F.when(ok, F.col("worst.text")).alias("rejected"), F.when(ok, "human_vs_machine").otherwise("sft_only").alias("kind"))


def judge_pairs(judged: DataFrame) -> DataFrame:
    """record_id, chosen, rejected for rows (record_id, text, judge): the best text (ties: the greater text) against each other one."""
    top = judged.groupBy("record_id").agg(F.max(F.struct(number("judge").alias("judge"), "text")).alias("top"))
    return judged.join(top, "record_id").where(F.col("text") != F.col("top.text")).select("record_id", F.col("top.text").alias("chosen"), F.col("text").alias("rejected"))


def gate_curve(candidates: DataFrame, most: int = 4) -> DataFrame:
    """gate, records: how many records have a candidate with at most ``gate`` unsupported claims."""
    least = candidates.groupBy("record_id").agg(F.min("unsup").alias("least")).where("least IS NOT NULL")
    gates = least.select(F.explode(F.sequence(F.greatest(F.col("least"), F.lit(0)).cast("int"), F.greatest(F.col("least"), F.lit(most)).cast("int"))).alias("gate")).where(F.col("gate") <= most)
    counts = gates.groupBy("gate").agg(F.count("*").alias("records"))
    return counts.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("gate")).join(counts, "gate", "left").select("gate", F.coalesce("records", F.lit(0)).alias("records"))


def attempts(tries: DataFrame, fallback: DataFrame) -> DataFrame:
    """record_id, text, source: the first accepted of the tries (record_id, attempt, text, accepted), else the fallback's text."""
    first = tries.where("accepted").groupBy("record_id").agg(F.min_by("text", "attempt").alias("tried"))
    done = F.coalesce(F.when(F.col("tried") != "", F.col("tried")), F.col("text"))
    return fallback.join(first, "record_id", "left").select("record_id", done.alias("text"), F.when(F.coalesce(F.col("tried"), F.lit("")) != "", "llm").otherwise("template").alias("source"))


def accepted(style: Column, unsup: Column) -> Column:
    """Whether a rendering is what its style asks for."""
    return F.when(style == "good", unsup == 0).when(style == "fabricated", unsup >= 1).otherwise(True)
