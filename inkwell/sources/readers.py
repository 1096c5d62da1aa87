"""Readers: JSON lines of extracted facts, TEI files, token-tag files, annotations, pairs, ratings of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import lexicons as L
from ..functions import text as T
from ..operators import spans
from .registry import adapter
from .synthetic import records as synthetic_records

TEI = "{http://www.tei-c.org/ns/1.0}"


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


# ---- Records ---------------------------------------------------------------------------------------------------------


def focal(entities: Column, relations: Column) -> Column:
    """The most frequent person; else the entity with the most relations; else the first entity.  Ties: the first seen."""

    def mode(xs: Column) -> Column:
        counted = lambda all_: F.transform(F.array_distinct(all_), lambda x: F.struct(F.size(F.filter(all_, lambda y: y == x)).alias("n"), (-F.array_position(all_, x)).alias("at"), x.alias("x")))
        return F.array_max(T.let(xs, counted))["x"]

    persons = F.transform(F.filter(entities, lambda e: F.upper(e["type"]).startswith("PER")), lambda e: e["name"])
    ends = F.flatten(F.transform(relations, lambda r: F.array(r["head"], r["tail"])))
    return F.coalesce(mode(persons), mode(ends), F.try_element_at(F.transform(entities, lambda e: e["name"]), F.lit(1)), F.lit(""))


@adapter("synthetic")
def synthetic(spark: SparkSession, base: str, spec: dict) -> DataFrame:
    return synthetic_records(spark, spec.get("register", "testimony"))


@adapter("iob_jsonl")
def facts_jsonl(spark: SparkSession, base: str, spec: dict) -> DataFrame:
    """Records of JSON lines; rows without a text are left out while reading, so nothing downstream sees them."""
    rows = spark.read.schema(schemas.EXTRACTED).json(f"{base}/{spec['path']}").where(filled(F.col("document_text")))
    none = F.array().cast("array<struct<entity_text:string,entity_type:string>>")
    both = F.concat(F.coalesce("base_entities", none), F.coalesce("new_entities", none))
    entities = F.transform(F.filter(both, lambda e: filled(e["entity_text"])), lambda e: F.struct(e["entity_text"].alias("name"), F.coalesce(e["entity_type"], F.lit("ENTITY")).alias("type")))
    told = F.filter(F.coalesce("relationships", F.array().cast("array<struct<relation_type:string,head_entity_text:string,tail_entity_text:string>>")), lambda r: filled(r["head_entity_text"]) & filled(r["tail_entity_text"]))
    relations = F.transform(told, lambda r: F.struct(r["relation_type"].alias("type"), r["head_entity_text"].alias("head"), r["tail_entity_text"].alias("tail")))
    held = rows.select(F.coalesce("id", F.lit("")).alias("id"), entities.alias("entities"), relations.alias("relations"), F.col("document_text").alias("source_text"))
    return held.select(
        "id", F.lit(spec.get("corpus", "")).alias("corpus"), F.lit(spec.get("register", "testimony")).alias("register"), focal(F.col("entities"), F.col("relations")).alias("unit"),
        F.col("id").alias("title"), "entities", "relations", "source_text", F.array().cast("array<string>").alias("subjects"), F.lit(f"{spec.get('corpus', '')} relation-extraction".strip()).alias("provenance"),
    )


# ---- TEI -------------------------------------------------------------------------------------------------------------


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """name, value: one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "value")


def _flat(element) -> str:
    return re.sub(r"\s+", " ", "".join(element.itertext())).strip()


def tei_header(xml: str) -> dict:
    root = ElementTree.fromstring(xml.encode())
    first = lambda tag: next((_flat(e) for e in root.iter(f"{TEI}{tag}")), "")
    inner = lambda outer, tag, once: [_flat(x) for o in root.iter(f"{TEI}{outer}") for x in (o.findall(f"{TEI}{tag}")[:1] if once else o.findall(f"{TEI}{tag}"))]
    return {"title": first("title"), "repository": first("repository"), "collection": first("collection"), "persons": inner("person", "persName", False), "places": inner("place", "placeName", True), "orgs": inner("org", "orgName", False)}


def tei_body(xml: str) -> tuple[list[str], list[str]]:
    """Texts of all paragraphs and of all terms, at any depth, without empty ones."""
    root = ElementTree.fromstring(xml.encode())
    return [t for e in root.iter(f"{TEI}p") if (t := _flat(e))], [t for e in root.iter(f"{TEI}term") if (t := _flat(e))]


def narrator(persons: Column, title: Column) -> Column:
    """The first person called narrator, else the first person, without parentheses; else the title up to a comma."""
    plain = lambda p: F.trim(F.regexp_replace(p, r"\s*\(.*?\)\s*", ""))
    told = F.try_element_at(F.filter(persons, lambda p: F.contains(F.lower(p), F.lit("narrator"))), F.lit(1))
    return F.coalesce(plain(told), plain(F.try_element_at(persons, F.lit(1))), F.trim(F.element_at(F.split(title, ","), 1)))


@adapter("tei")
def tei(spark: SparkSession, base: str, spec: dict) -> DataFrame:
    """Documents of a header file and numbered split files; those without either are left out."""
    files = whole_files(spark, f"{base}/{spec.get('path', 'xml')}/*.xml").withColumn("id", F.element_at(F.split("name", "_"), 1))
    header = "title string, repository string, collection string, persons array<string>, places array<string>, orgs array<string>"

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [pa.string()] * 3 + [pa.list_(pa.string())] * 3
        for b in batches:
            got = [tei_header(x) for x in b.column(1).to_pylist()]
            keys = ("title", "repository", "collection", "persons", "places", "orgs")
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], t) for k, t in zip(keys, lists, strict=True))], ["id", *keys])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [tei_body(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.list_(pa.string()))], ["id", "n", "paragraphs", "terms"])

    head = files.where(F.col("name").endswith("_header.xml")).select("id", "value").mapInArrow(heads, f"id string, {header}")
    number = F.regexp_extract("name", r"_split_(\d+)", 1)
    split = files.where(number != "").select("id", number.cast("int").alias("n"), "value").mapInArrow(bodies, "id string, n int, paragraphs array<string>, terms array<string>")
    body = split.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "paragraphs", "terms"))).alias("s"))
    typed = lambda c, t: F.transform(c, lambda x: F.struct(x.alias("name"), F.lit(t).alias("type")))
    return head.join(body, "id").select(
        "id", F.lit(spec.get("corpus", "")).alias("corpus"), F.lit(spec.get("register", "testimony")).alias("register"), narrator(F.col("persons"), F.col("title")).alias("unit"), "title",
        F.concat(typed("persons", "PERSON"), typed("places", "PLACE"), typed("orgs", "ORG")).alias("entities"), F.array().cast("array<struct<type:string,head:string,tail:string>>").alias("relations"),
        F.array_join(F.flatten(F.transform("s", lambda s: s["paragraphs"])), "\n\n").alias("source_text"), F.flatten(F.transform("s", lambda s: s["terms"])).alias("subjects"),
        F.concat_ws(", ", "repository", F.when(filled(F.col("collection")), F.col("collection"))).alias("provenance"),
    )


COMMON = {element: common for _, element, _, common in L.TYPES}


def tei_spans(xml: str) -> tuple[str, list[tuple[str, str, int, int]]]:
    """Text of the body's paragraphs, run together, and the spans of the entities directly in them."""
    body = next(ElementTree.fromstring(xml.encode()).iter(f"{TEI}body"), None)
    text, spans = "", []
    for p in body.findall(f"{TEI}p") if body is not None else ():
        text += p.text or ""
        for child in p:
            start = len(text)
            text += child.text or ""
            if (kind := COMMON.get(child.tag.rpartition("}")[2])) is not None:
                spans.append((child.text or "", kind, start, len(text)))
            text += child.tail or ""
    return text, spans


def tei_entities(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, entities with offsets; the order of text and elements within a paragraph needs a parser that keeps it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("surface", pa.string()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            got = [tei_spans(x) for x in b.column(1).to_pylist()]
            rows = [[dict(zip(("surface", "type", "start", "end"), s, strict=True)) for s in spans] for _, spans in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(rows, span)], ["doc_id", "text", "entities"])

    return whole_files(spark, path).select(F.regexp_replace("name", r"\.[^.]*$", "").alias("name"), "value").mapInArrow(run, schemas.SPANS)


def entity_sets(spans: DataFrame) -> DataFrame:
    """doc_id, entity, type: distinct normalised surfaces."""
    return spans.select("doc_id", F.explode("entities").alias("e")).select("doc_id", T.normal(F.col("e.surface")).alias("entity"), F.col("e.type").alias("type")).distinct()


# ---- Token tags ------------------------------------------------------------------------------------------------------


def tag_rows(files: DataFrame) -> DataFrame:
    """doc_id, pos, token, tag from rows (name, value); a blank line has neither token nor tag."""
    lines = files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("doc_id"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    parts = F.regexp_extract("line", r"^(.*) (\S+)\s*$", 1), F.regexp_extract("line", r"^(.*) (\S+)\s*$", 2)
    return lines.select("doc_id", "pos", *(F.when(F.trim("line") != "", p).alias(n) for p, n in zip(parts, ("token", "tag"), strict=True)))


def tag_arrays(files: DataFrame) -> DataFrame:
    """doc_id, tokens, tags from rows (name, value): the lines of a file within its row; a blank line has neither token nor tag."""
    lines = F.split("value", r"\r?\n")
    part = lambda k: F.transform(lines, lambda x: F.when(F.trim(x) != "", F.regexp_extract(x, r"^(.*) (\S+)\s*$", k)))
    return files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("doc_id"), part(1).alias("tokens"), part(2).alias("tags"))


def iob_entities(tags: DataFrame, mode: str = "offsets") -> DataFrame:
    """Entities of tagged tokens: rows (doc_id, tokens, tags) of arrays, or a row for each token (doc_id, pos, token, tag).

    ``offsets``: doc_id, surface, type, start, end in the text of all tokens joined by spaces; B opens an entity, the I of
    its type that follow go on with it, also over a blank line, and other I are ignored.
    ``set``: doc_id, entity, type, each once for a document; a blank line ends an entity, and an I that fits none opens one.

    Arrays are folded where they are read; only rows of single tokens are gathered by document first.
    """
    if "tokens" not in tags.columns:
        each = tags.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "tag"))).alias("x"))
        tags = each.select("doc_id", F.transform("x", lambda r: r["token"]).alias("tokens"), F.transform("x", lambda r: r["tag"]).alias("tags"))
    found = spans.entities(tags, mode)
    if mode == "offsets":
        return found
    each = F.array_distinct(F.transform("found", lambda x: F.struct(T.normal(x["entity"]).alias("entity"), x["type"].alias("type"))))
    return found.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.entity", "x.type")


# ---- Annotations, candidates, pairs ----------------------------------------------------------------------------------


def ratings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """annotator, record_id, candidate_i, overall; files that aren't JSON or have no responses are left out."""
    rows = spark.read.schema(schemas.RATINGS).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("responses IS NOT NULL")
    return rows.select("annotator", F.explode("responses").alias("r")).select("annotator", "r.record_id", "r.candidate_i", "r.overall")


def authored(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """author, record_id, text, confidence; the file's name stands for a missing author; blank texts are left out."""
    rows = spark.read.schema(schemas.AUTHORED).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.select(F.coalesce("author", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("author"), "summaries").where("summaries IS NOT NULL")
    return rows.select("author", F.explode("summaries").alias("s")).select("author", "s.record_id", F.trim("s.text").alias("text"), "s.confidence").where("text <> ''")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """corpus, source, gen_model, record_id, unit, register, record_block, prompt_user, and each candidate's columns."""
    rows = spark.read.schema(schemas.CANDIDATES).option("multiLine", True).json(path).select("corpus", "source", "gen_model", F.explode("records").alias("r"))
    return rows.select("corpus", "source", "gen_model", F.col("r.id").alias("record_id"), "r.unit", "r.register", "r.record_block", "r.prompt_user", F.explode("r.candidates").alias("c")).select("*", "c.*").drop("c")


def pairs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """prompt, chosen, rejected, rejected_kind, meta; a row that lacks one of the three texts stops the run, or, not ``strict``, is left out."""
    rows = spark.read.schema(schemas.PAIRS).json(path)
    whole = F.lit(True)
    for c in ("prompt", "chosen", "rejected"):
        whole = whole & filled(F.trim(F.col(c)))
    if not strict:
        return rows.where(whole)
    # Put into the chosen column, so that no optimiser drops the check.
    return rows.withColumn("chosen", F.when(whole, F.col("chosen")).otherwise(F.raise_error(F.concat(F.lit("a pair lacks a text: "), F.coalesce(F.to_json(F.struct("prompt", "chosen", "rejected")), F.lit(""))))))


def fine_tuning(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SFT).json(path)


def with_fallback(template: DataFrame, written: DataFrame, key: list[str]) -> DataFrame:
    """key, text: the written text where there is a non-empty one, else the template's."""
    other = written.select(*key, F.col("text").alias("_text"))
    return template.join(other, key, "left").select(*key, F.coalesce(F.when(F.col("_text") != "", F.col("_text")), F.col("text")).alias("text"))


def word_ratings(spark: SparkSession, path: str) -> DataFrame:
    """word, rating of a table of norms; ratings that aren't numbers are left out.  Join it broadcast only if it is small."""
    rows = spark.read.option("header", True).csv(path)
    word, rating = rows.columns[:2]
    return rows.select(F.lower(F.trim(F.col(f"`{word}`"))).alias("word"), F.col(f"`{rating}`").try_cast("double").alias("rating")).where("rating IS NOT NULL AND word <> ''")


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """id, title, unit, record_block of a records file."""
    rows = spark.read.schema(schemas.CANDIDATES).option("multiLine", True).json(path).select(F.explode("records").alias("r"))
    return rows.select("r.id", "r.title", "r.unit", "r.register", "r.record_block")
