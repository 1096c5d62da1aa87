"""Parsers of what language models answer, and prompts for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

EXTRACTED = "struct<entities:array<struct<entity_text:string,entity_type:string>>,new_entities:array<struct<entity_text:string,entity_type:string>>,relationships:array<struct<relation_type:string,head_entity_text:string,tail_entity_text:string>>>"


def judge_score(raw: Column) -> Column:
    """The score of the last flat JSON object that has one, else of the first ``score: number``, else 0."""
    plain = F.regexp_replace(F.coalesce(raw, F.lit("")), "```(?:json)?", "")
    blocks = F.regexp_extract_all(plain, F.lit(r"(?s)\{[^{}]*\}"), F.lit(0))
    scores = F.filter(F.transform(blocks, lambda b: F.get_json_object(b, "$.score").try_cast("double")), lambda s: s.isNotNull())
    loose = F.regexp_extract(plain, r'(?i)"?score"?\s*[:=]\s*(\d+(?:\.\d+)?)', 1).try_cast("double")
    return F.coalesce(F.try_element_at(scores, F.lit(-1)), loose, F.lit(0.0))


def extraction(raw: Column) -> Column:
    """struct(entities, relationships) from the outermost braces of an answer; empty where there is no JSON."""
    found = F.from_json(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0), EXTRACTED)
    some = lambda a: F.when(F.size(a) > 0, a)
    entities = F.coalesce(some(found["entities"]), some(found["new_entities"]), F.array().cast("array<struct<entity_text:string,entity_type:string>>"))
    relations = F.coalesce(found["relationships"], F.array().cast("array<struct<relation_type:string,head_entity_text:string,tail_entity_text:string>>"))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.struct(
        F.transform(F.filter(entities, lambda e: filled(e["entity_text"])), lambda e: F.struct(e["entity_text"].alias("entity_text"), F.coalesce(e["entity_type"], F.lit("MISCELLANEOUS")).alias("entity_type"))).alias("entities"),
        F.transform(F.filter(relations, lambda r: filled(r["head_entity_text"]) & filled(r["tail_entity_text"])), lambda r: F.struct(F.coalesce(r["relation_type"], F.lit("related_to")).alias("relation_type"), r["head_entity_text"].alias("head_entity_text"), r["tail_entity_text"].alias("tail_entity_text"))).alias("relationships"),
    )


def _filled(template: str, **values: Column) -> Column:
    """A template with columns in its braces, joined piece by piece so that values stay as they are."""
    parts, rest = [], template
    while True:
        at = min((rest.find(f"{{{k}}}") for k in values if f"{{{k}}}" in rest), default=-1)
        if at < 0:
            break
        key = next(k for k in values if rest.startswith(f"{{{k}}}", at))
        parts += [F.lit(rest[:at]), values[key]]
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts, F.lit(rest))


def prompt(unit: Column, register: Column, record: Column) -> Column:
    style = F.replace(F.when(F.coalesce(register, F.lit("")) != "", register).otherwise("archival_micro_narrative"), F.lit("_"), F.lit("-"))
    return _filled(L.INSTRUCTION, unit=F.coalesce(unit, F.lit("[unit]")), register=style, record=F.coalesce(record, F.lit("")))


def judge_messages(record: Column, narrative: Column) -> Column:
    """array of (role, content) for a judge."""
    user = _filled(L.JUDGE_USER.replace("{{", "{").replace("}}", "}"), record=record, narrative=narrative)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(L.JUDGE_SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def render_messages(style: str, unit: Column, register: Column, record: Column) -> Column:
    ask = F.concat(_filled(L.RENDER_STYLE[style], unit=unit, register=register), F.lit("\n\nRECORD:\n"), record)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(L.RENDER_SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), ask.alias("content")))


def chat(user: Column, system: str | None = None, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """A user's turn in a chat template, up to where the answer starts."""
    head = f"{start}system\n{system}{end}\n" if system else ""
    return F.concat(F.lit(f"{head}{start}user\n"), user, F.lit(f"{end}\n{start}assistant\n"))


def with_end(completion: Column, end: str = "<|im_end|>") -> Column:
    trimmed = F.regexp_replace(completion, r"\s+$", "")
    return F.when(trimmed.endswith(end), completion).otherwise(F.concat(trimmed, F.lit(end)))


def completion_text(messages: Column) -> Column:
    """The last message's content."""
    return F.try_element_at(messages, F.lit(-1))["content"]


def record_block(unit: Column, title: Column, provenance: Column, entities: Column, relations: Column | None = None, subjects: Column | None = None, per_type: int = 40, most: int = 20) -> Column:
    """A record as prompt context: unit, title, source, names by type in order of appearance, and on request relations."""
    from .text import first_seen

    some = lambda c: F.coalesce(c, F.lit("")) != ""
    kinds = F.array_distinct(F.transform(entities, lambda e: e["type"]))
    named = F.transform(kinds, lambda k: F.concat(F.initcap(k), F.lit(": "), F.array_join(F.slice(first_seen(F.transform(F.filter(entities, lambda e: e["type"] == k), lambda e: e["name"])), 1, per_type), "; ")))
    lines = [
        F.concat(F.lit("Unit: "), F.when(some(unit), unit).otherwise(F.coalesce(title, F.lit("")))),
        F.when(some(title) & ~title.eqNullSafe(unit), F.concat(F.lit("Title: "), title)),
        F.when(some(provenance), F.concat(F.lit("Source: "), provenance)),
        F.when(F.size(named) > 0, F.array_join(named, "\n")),
    ]
    if relations is not None:
        told = F.transform(F.slice(relations, 1, most), lambda r: F.concat(r["head"], F.lit(" ["), r["type"], F.lit("] "), r["tail"]))
        lines.append(F.when(F.size(relations) > 0, F.concat(F.lit("Relations: "), F.array_join(told, " | "))))
    if subjects is not None:
        lines.append(F.when(F.size(subjects) > 0, F.concat(F.lit("Subjects: "), F.array_join(F.slice(first_seen(subjects), 1, most), "; "))))
    return F.concat_ws("\n", *lines)
