"""Whole flows: prompts from records, scores of candidates, labelled training rows, rewards by case, and the reports on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import grounding as G
from ..functions import guards, parsing
from ..functions import lexicons as L
from ..functions import rewards as R
from ..functions import text as T
from . import retrieval, scoring, selection


def open_book_prompts(records: DataFrame, excerpt: int = 8, with_relations: bool = False) -> DataFrame:
    """id, record_block, prompt: the record as context, with the sentences of its source that are nearest to its unit."""
    block = parsing.record_block(F.col("unit"), F.col("title"), F.col("provenance"), F.col("entities"), F.col("relations") if with_relations else None, F.col("subjects"))
    held = retrieval.top_sentences(records.withColumn("record_block", block), "source_text", "unit", excerpt)
    near = F.array_join(F.transform("retrieved", lambda r: r["sentence"]), " ")
    record = F.concat("record_block", F.when(near != "", F.concat(F.lit("\nExcerpt: "), near)).otherwise(""))
    return held.select("id", "record_block", parsing.prompt(F.col("unit"), F.col("register"), record).alias("prompt"))


def attested(df: DataFrame, blob: Column) -> DataFrame:
    """Adds attested_words and attested_years of everything that the record says."""
    return df.withColumn("attested_words", G.index_words(blob)).withColumn("attested_years", G.attested_years(blob))


def faithfulness(df: DataFrame, key: list[str], method: str = "lexical", judge: Callable | None = None, **settings) -> DataFrame:
    """key, F, unsupported, status of rows (key, text, premises, subject, attested_words, attested_years).

    ``lexical`` looks names and years up, ``nli`` scores claims against premises with a registered scorer, ``llm`` asks a
    chat model (``judge``: a factory of a function from prompt to answer) for counts; where it fails, the status says so and
    the lexical score stands in.
    """
    if method == "nli":
        return scoring.entailment_faithfulness(df, key, "text", "premises", "subject", "attested_words", "attested_years", **settings)
    plain = df.withColumn("_f", G.lexical_faithfulness(F.col("text"), F.col("attested_words"), F.col("attested_years")))
    if method == "lexical":
        return plain.select(*key, "_f.F", "_f.unsupported", F.lit(G.SCORED).alias("status"))
    if method != "llm" or judge is None:
        raise ValueError(f"unknown method {method!r}, or no judge; there are lexical, nli and llm")
    ask = F.concat(F.lit("RECORD:\n"), G.premise_text(F.col("premises")), F.lit("\n\nNARRATIVE:\n"), F.col("text"))
    told = scoring.chat_column(plain.withColumn("_ask", ask), "_ask", "_answer", judge, **settings)
    count = lambda k: F.get_json_object(F.regexp_extract(F.coalesce("_answer", F.lit("")), r"(?s)\{.*\}", 0), f"$.{k}").try_cast("int")
    bad, total = count("unsupported"), F.greatest(F.lit(1), count("total"))
    scored = bad.isNotNull() & count("total").isNotNull()
    return told.select(
        *key, F.when(scored, F.greatest(F.lit(0.0), 1 - bad / total)).otherwise(F.col("_f.F")).alias("F"), F.when(scored, bad).otherwise(F.col("_f.unsupported")).alias("unsupported"),
        F.when(scored, G.SCORED).otherwise("fallback:lexical").alias("status"),
    )


def scored_candidates(candidates: DataFrame, records: DataFrame, method: str = "lexical", premises: int = 20, **settings) -> DataFrame:
    """Every score and guard of candidates (record_id, i, text) of records in the common shape.

    Premises are the sentences of the source nearest to the unit and the text; the attested set is the whole record.
    """
    block = parsing.record_block(F.col("unit"), F.col("title"), F.col("provenance"), F.col("entities"), F.col("relations"), F.col("subjects"))
    known = attested(records.select(F.col("id").alias("record_id"), "unit", "source_text", block.alias("record_block")), F.concat_ws(" ", "record_block", "source_text"))
    met = candidates.select("record_id", "i", "text").where(T.n_pieces(F.col("text")) >= 4).join(known, "record_id")
    met = retrieval.top_sentences(met.withColumn("_q", F.concat_ws(" ", "unit", "text")), "source_text", "_q", premises)
    met = met.withColumn("premises", F.transform("retrieved", lambda r: r["sentence"])).withColumn("subject", F.col("unit")).drop("retrieved", "_q")
    faith = faithfulness(met, ["record_id", "i"], method, **settings).withColumnRenamed("unsupported", "unsup")
    rich = X.with_features(met.select("record_id", "i", "text", "source_text", "record_block"))
    rich = rich.withColumn("sensational", R.sensationalism(F.col("text"), F.col("source_text"))).withColumn("overlap", guards.copy_overlap(F.col("text"), F.concat_ws(" ", "record_block", "source_text"))).withColumn("format_hits", guards.format_hits(F.col("text")))
    out, why = guards.filtered(F.col("format_hits"), F.col("overlap"))
    joined = rich.join(faith, ["record_id", "i"])
    return joined.select(
        "record_id", "i", "text", "F", "unsup", "status", X.linguistic_reward(digits=4).alias("linguistic"), R.composite(F.col("F"), F.col("unsup"), X.quality(), F.col("calibration"), F.col("sensational"), 3).alias("composite"),
        guards.length_penalty(F.col("text")).alias("length_guard"), guards.copy_penalty(F.col("overlap")).alias("copy_guard"), guards.format_penalty(F.col("format_hits")).alias("format_guard"), out.alias("guard_filtered"), why.alias("guard_reason"),
    )


def best_of_n(scored: DataFrame, rewards: tuple[str, ...] = ("linguistic", "composite"), gate_unsup: int = 1, guarded: bool = True) -> DataFrame:
    """Picks of each reward and of the gate, and whether the rewards differ."""
    ok = ~F.col("guard_filtered") if guarded else None
    return selection.pick(scored, list(rewards), gate_unsup, ok).withColumn("diverges", selection.diverges([f"pick_{r}" for r in rewards]))


def training_rows(candidates: DataFrame, prompts: DataFrame, label: str = "reward", ratings: DataFrame | None = None, authored: DataFrame | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """Fine-tuning rows (prompt, completion, record_id, kind) and pairs (prompt, chosen, rejected, record_id, kind) under one of the three labels."""
    if label == "authored":
        made = selection.authored_pairs(candidates, authored)
    elif label == "human":
        made = selection.human_pairs(candidates, ratings, **settings)
        made = made.select("record_id", F.trim("chosen.text").alias("chosen"), F.trim("rejected.text").alias("rejected"), "kind")
    elif label == "reward":
        made = selection.reward_pairs(candidates, **settings).select("record_id", F.trim("chosen.text").alias("chosen"), F.trim("rejected.text").alias("rejected"), "kind")
    else:
        raise ValueError(f"unknown label {label!r}; there are reward, human and authored")
    rows = made.join(prompts.select(F.col("id").alias("record_id"), "prompt"), "record_id")
    return rows.select("prompt", F.concat(F.lit(" "), "chosen").alias("completion"), "record_id", "kind"), rows.where("rejected IS NOT NULL").select("prompt", "chosen", "rejected", "record_id", "kind")


REWARDS = ("linguistic", "composite", "human", "judge")


def reward_by_case(completions: DataFrame, cases: DataFrame, reward: str = "composite", persona: str = "balanced", judge: Callable | None = None, **settings) -> DataFrame:
    """completion_id, reward, guards, total for rows (completion_id, case_id, messages or text); 0 where the case is unknown.

    ``cases``: case_id, blob, facts, and for ``human`` salient and references, for ``judge`` record.  A case may be a record
    of a corpus: then blob is all that it says, and its facts are the sentences of its source.  ``human`` weighs six
    dimensions as a persona does; ``judge`` asks a chat model (a factory of a function from prompt to answer), a failed
    answer scores 0.  The guards are added to the reward as rewards of their own.
    """
    if reward not in REWARDS:
        raise ValueError(f"no reward {reward!r}; there are {', '.join(REWARDS)}")
    text = parsing.completion_text(F.col("messages")) if "messages" in completions.columns else F.col("text")
    more = {"human": ["salient", "references"], "judge": ["record"]}.get(reward, [])
    held = completions.select("completion_id", "case_id", F.coalesce(text, F.lit("")).alias("text")).join(cases.select("case_id", "blob", "facts", *more), "case_id", "left")
    held = held.withColumn("known", F.col("blob").isNotNull()).withColumn("blob", F.coalesce("blob", F.lit("")))
    rich = X.with_features(held).withColumn("_w", G.index_words(F.col("blob"))).withColumn("_y", G.index_years(F.col("blob")))
    rich = rich.withColumn("_f", G.lexical_faithfulness(F.col("text"), F.col("_w"), F.col("_y"))).withColumn("_s", R.sensationalism(F.col("text"), G.premise_text(F.coalesce("facts", F.array().cast("array<string>")))))
    if reward == "human":
        weights = dict(zip((*L.DIMENSIONS, "fab"), L.PERSONAS[persona], strict=True))
        told = {
            "coverage": R.coverage(F.col("text"), F.coalesce("salient", F.array().cast("array<string>"))), "specificity": F.col("concreteness"), "grounding": F.col("_f.F"), "source": F.when(R.names_source(F.col("text"), F.col("references")), 1.0).otherwise(0.0),
            "calibration": R.human_calibration(F.col("calibration")), "restraint": F.greatest(F.lit(0.0), 1 - F.col("_s")),
        }
        score = sum((w * told[d] for d, w in weights.items() if d in told), F.lit(0.0)) - weights["fab"] * F.col("_f.unsupported")
    elif reward == "judge":
        if judge is None:
            raise ValueError("the judge reward needs a judge")
        rich = judged(rich.withColumn("record", F.coalesce("record", F.lit(""))), "record", "text", judge, **settings)
        score = F.col("judge")
    else:
        score = X.linguistic_reward(digits=4) if reward == "linguistic" else R.composite(F.col("_f.F"), F.col("_f.unsupported"), X.quality(), F.col("calibration"), F.col("_s"), 4)
    guard = guards.length_penalty(F.col("text")) + guards.format_penalty(guards.format_hits(F.col("text"))) + guards.copy_penalty(guards.copy_overlap(F.col("text"), F.col("blob")))
    out = rich.select("completion_id", F.when(F.col("known"), score).otherwise(0.0).alias("reward"), F.when(F.col("known"), guard).otherwise(0.0).alias("guards"))
    return out.withColumn("total", F.col("reward") + F.col("guards"))


def judged(df: DataFrame, record: str, text: str, call: Callable, **settings) -> DataFrame:
    """Adds ``judge``: messages for a judge, its answer, and the score parsed from it, 0 where there is none."""
    ask = F.array_join(F.transform(parsing.judge_messages(F.col(record), F.col(text)), lambda m: m["content"]), "\n\n")
    told = scoring.chat_column(df.withColumn("_ask", ask), "_ask", "_answer", call, **settings)
    return told.withColumn("judge", parsing.judge_score(F.col("_answer"))).drop("_ask", "_answer", "_answer_status")


def extracted(df: DataFrame, text: str, call: Callable, **settings) -> DataFrame:
    """Adds ``extraction`` (entities, relationships) as an extractor (a factory of a function from text to JSON) answers."""
    told = scoring.chat_column(df, text, "_answer", call, **settings)
    return told.withColumn("extraction", parsing.extraction(F.col("_answer"))).drop("_answer", "_answer_status")


def name_extractor():
    """An extractor without a model: capitalised words that don't begin a sentence, each once, as persons."""
    import json
    import re

    first, name = re.compile(r"[.!?]\s+\S+"), re.compile(r" ([A-ZÀ-Þ][a-zà-ÿ]+)")
    return lambda text: json.dumps({"entities": [{"entity_text": x, "entity_type": "PERSON"} for x in dict.fromkeys(name.findall(first.sub("", text)))], "relationships": []}, ensure_ascii=False)


#: A statement that no record has.
OFF_RECORD = "Then in 1871 old Captain Ferrow of Quillmarsh sold the lighthouse to Doctor Ibsen."


def downstream(df: DataFrame, key: list[str], text: str, false: str = OFF_RECORD) -> DataFrame:
    """key, downstream: by how much a clause of the text itself is better grounded in the text than a false statement, 0 to 1."""
    held = attested(df.select(*key, F.col(text).alias("_t")), F.col("_t"))
    first = F.substring(F.element_at(F.split("_t", r"\."), 1), 1, 200)
    score = lambda x: G.lexical_faithfulness(x, F.col("attested_words"), F.col("attested_years"))["F"]
    return held.select(*key, F.greatest(F.lit(0.0), score(first) - score(F.lit(false))).alias("downstream"))


def case_prompts(cases: DataFrame, unit: Column, block: Column, registers: tuple[str, ...] = ("testimony", "finding_aid")) -> DataFrame:
    """case_id, register, prompt: each case once for each register."""
    each = cases.select("case_id", unit.alias("_unit"), block.alias("_block"), F.explode(F.array(*map(F.lit, registers))).alias("register"))
    return each.select("case_id", "register", parsing.prompt(F.col("_unit"), F.col("register"), F.col("_block")).alias("prompt"))


# ---- Reports ---------------------------------------------------------------------------------------------------------


def mean_row(scored: DataFrame, columns: tuple[str, ...] = ("F", "unsup", "composite", "linguistic")) -> DataFrame:
    return scored.agg(*(F.avg(c).alias(c) for c in columns))


def divergence(picks: DataFrame) -> DataFrame:
    """records, diverging."""
    return picks.agg(F.count("*").alias("records"), F.count_if("diverges").alias("diverging"))


def diagnostics(scored: DataFrame) -> DataFrame:
    """status, rows: how many scores are vacuous or came from a fallback."""
    return scored.groupBy("status").agg(F.count("*").alias("rows"))


def acceptance(rendered: DataFrame) -> DataFrame:
    """style, rows, accepted, mean_F for rows (style, F, unsup)."""
    ok = selection.accepted(F.col("style"), F.col("unsup"))
    return rendered.groupBy("style").agg(F.count("*").alias("rows"), F.count_if(ok).alias("accepted"), F.avg("F").alias("mean_F"))


def _cells(df: DataFrame, cell: list[str], score: str) -> DataFrame:
    return df.groupBy(*cell).agg(*(F.max(F.when(F.col("profile") == p, F.col(score))).alias(p) for p in L.PROFILES))


def arm_agreement(df: DataFrame, cell: list[str], one: str, two: str) -> DataFrame:
    """other, cells, agree: in how many cells both scores say the same about good against another profile."""
    a, b = _cells(df, cell, one), _cells(df, cell, two)
    met = a.join(b.withColumnsRenamed({p: f"_{p}" for p in L.PROFILES}), cell)
    same = F.array(*(F.struct(F.lit(p).alias("other"), ((F.col("good") > F.col(p)) == (F.col("_good") > F.col(f"_{p}"))).alias("same")) for p in L.PROFILES[1:]))
    return met.select(F.explode(same).alias("s")).groupBy(F.col("s.other").alias("other")).agg(F.count("*").alias("cells"), F.count_if("s.same").alias("agree"))


def judge_counters(df: DataFrame, cell: list[str], score: str) -> DataFrame:
    """cells, good_top, good_over_fabricated, fabricated_under_flattened, ties of a judge's scores."""
    c = _cells(df, cell, score)
    good, flat, false = (F.col(p) for p in L.PROFILES)
    return c.agg(
        F.count("*").alias("cells"), F.count_if((good > flat) & (good > false)).alias("good_top"), F.count_if(good > false).alias("good_over_fabricated"), F.count_if(false < flat).alias("fabricated_under_flattened"),
        F.count_if(F.size(F.array_distinct(F.array(good, flat, false))) < 3).alias("ties"),
    )


def label_balance(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("rows"))


def score_line(df: DataFrame, key: list[str]) -> DataFrame:
    """key, and one line of text with all scores of a row (F, status, unsup, composite, linguistic)."""
    parts = [G.shown(F.col("F"), F.col("status")), F.col("unsup").cast("string"), F.format_number("composite", 3), F.format_number("linguistic", 3)]
    names = ("F", "unsup", "composite", "linguistic")
    return df.select(*key, F.concat_ws("  ", *(F.concat(F.lit(f"{n}="), p) for n, p in zip(names, parts, strict=True))).alias("line"))


