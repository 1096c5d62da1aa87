"""The synthetic grid: cases x registers x profiles, rendered, traced and scored with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import grounding as G
from ..functions import lexicons as L
from ..functions import rewards as R
from ..functions import text as T
from . import cases as fixed


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.rows(), schemas.CASE)


def entity(which: Column) -> Column:
    return F.try_element_at(F.filter("entities", lambda e: e["id"] == which), F.lit(1))


def source_of(thing: Column) -> Column:
    """The first source that grounds an attribute or event."""
    return F.try_element_at(F.filter("sources", lambda s: s["id"] == thing["grounded_by"][0]), F.lit(1))


def salient_events() -> Column:
    return F.filter("events", lambda e: (e["salience"] >= 2) & (F.size(e["grounded_by"]) > 0))


def specific_attributes() -> Column:
    return F.filter(entity(F.col("focal"))["attributes"], lambda a: (a["specificity"] == "specific") & (F.size(F.coalesce(a["grounded_by"], F.array())) > 0))


def attribution(source: Column, register: str) -> Column:
    if register == "finding_aid":
        return F.concat(F.lit("("), source["kind"], F.lit(", "), source["archive_ref"], F.lit(")"))
    said = {"registry": "the registry records", "testimony": "according to family testimony", "letter": "a surviving letter notes", "catalogue_entry": "the catalogue records", "caption": "a photo caption records"}
    out = F.lit("the record notes")
    for kind, phrase in said.items():
        out = F.when(source["kind"] == kind, phrase).otherwise(out)
    return out


def date_phrase(date: Column, register: str, hedge: bool) -> Column:
    v, c = date["value"], date["certainty"]
    if register == "testimony":
        plain, probable, open_ = F.concat(F.lit("in "), v), F.concat(F.lit("probably in "), v), F.concat(F.lit("at some point, perhaps "), v)
    else:
        plain, probable, open_ = v, F.concat(v, F.lit(" (probable)")), F.concat(v, F.lit(" (undated; unconfirmed)"))
    return F.when(c == "attested", plain).when(c == "probable", probable).otherwise(open_) if hedge else plain


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def terse(summary: Column, name: Column) -> Column:
    """Without the focal name in front."""
    short = F.replace(name, F.lit("the "), F.lit(""))
    cut = lambda n: F.substring(summary, F.length(n) + 2, F.length(summary))
    rest = F.when(F.startswith(summary, F.concat(name, F.lit(" "))), cut(name)).when(F.startswith(summary, F.concat(short, F.lit(" "))), cut(short)).otherwise(summary)
    return _capital(rest)


def false_clause(register: str) -> Column:
    """Picks from the pools by the sum of the id's character codes."""
    h = F.aggregate(F.filter(F.split("case_id", ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c))
    of = lambda pool, k: F.element_at(T.words_in(pool), (F.pmod(F.floor(h / k), F.lit(len(pool))) + 1).cast("int"))
    name, place, date = of(L.FALSE_NAMES, 1), of(L.FALSE_PLACES, 3), of(L.FALSE_DATES, 5)
    if register == "testimony":
        return F.concat(name, F.lit(" is said to have handled the matter at "), place, F.lit(" on "), date, F.lit("."))
    return F.concat(F.lit("Cross-referenced to "), name, F.lit(", "), place, F.lit(", "), date, F.lit(" (confirmed)."))


def _flattened(register: str) -> Column:
    focal = entity(F.col("focal"))
    if register == "testimony":
        person = F.concat(focal["name"], F.lit(" was an ordinary person whose life, like so many others, was caught up in the events of the period."))
        return F.when(focal["type"] == "person", person).otherwise(F.concat(focal["name"], F.lit(" was one of many such places and institutions in the city during those difficult years.")))
    return F.concat(_label(focal["name"]), F.lit(". Of local significance; affected by wartime events. See file."))


def _label(name: Column) -> Column:
    """As it is where it starts with a capital; else a capital and the rest in lower case."""
    return F.when(name.rlike(r"^\p{Lu}"), name).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, F.lit(2), F.length(name)))))


def _testimony(fabricate: bool) -> Column:
    focal = entity(F.col("focal"))
    first = F.try_element_at(specific_attributes(), F.lit(1))
    v, said = first["value"], attribution(source_of(first), "testimony")
    told = F.concat(F.lit("is recorded with "), first["key"], F.lit(" "), v, F.lit(", "), said)
    for key, lead in (("role", "served as "), ("address", "stood at "), ("built", "dated from "), ("school", "attended "), ("purpose", "existed for "), ("inventory_no", "is held under inventory ")):
        told = F.when(first["key"] == key, F.concat(F.lit(lead), v, F.lit(", "), said)).otherwise(told)
    told = F.when(first["key"] == "occupation", F.concat(F.lit("was, "), said, F.lit(", a "), v, F.lit(" by trade"))).otherwise(told)
    opening = F.concat(focal["name"], F.lit(" "), told, F.lit("."))

    def event(e: Column) -> Column:
        body = F.concat(e["summary"], F.lit(" "), date_phrase(e["date"], "testimony", not fabricate))
        return F.concat(body, F.lit(".")) if fabricate else F.concat(body, F.lit(", "), attribution(source_of(e), "testimony"), F.lit("."))

    middle = F.transform(salient_events(), event)
    if fabricate:
        end = F.concat(F.transform("fabrications", lambda f: f["text"]), F.array(false_clause("testimony")))
    else:
        end = F.when(F.exists("events", lambda e: e["sensitivity"] == "high"), F.array(F.lit("Beyond that, the record falls silent."))).otherwise(F.array().cast("array<string>"))
    start = F.when(F.size(specific_attributes()) > 0, F.array(opening)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(start, middle, end), " ")


def _finding_aid(fabricate: bool) -> Column:
    focal = entity(F.col("focal"))
    value = lambda *keys: F.try_element_at(F.transform(F.filter(specific_attributes(), lambda a: a["key"].isin(*keys)), lambda a: a["value"]), F.lit(1))
    name = focal["name"]
    parts = F.split(name, r"\s+")
    person = F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "))
    born, occupation = value("birth_year"), value("occupation", "role")
    person = F.concat(person, F.coalesce(F.concat(F.lit(" (b. "), born, F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(", "), occupation), F.lit("")))
    thing = F.concat(_label(name), F.coalesce(F.concat(F.lit(", "), value("address", "built", "inventory_no", "purpose")), F.lit("")))
    head = F.concat(F.when(focal["type"] == "person", person).otherwise(thing), F.lit("."))

    def event(e: Column) -> Column:
        body = F.concat(terse(e["summary"], name), F.lit(", "), date_phrase(e["date"], "finding_aid", not fabricate))
        return F.concat(body, F.lit(" (confirmed).")) if fabricate else F.concat(body, F.lit(" "), attribution(source_of(e), "finding_aid"), F.lit("."))

    middle = F.transform(salient_events(), event)
    if fabricate:
        false = F.transform("fabrications", lambda f: F.concat(f["text"], F.when(F.rtrim(f["text"]).endswith("."), " (confirmed)").otherwise(" (confirmed).")))
        end = F.concat(false, F.array(false_clause("finding_aid")))
    else:
        silent = (focal["type"] == "person") & F.exists("events", lambda e: e["sensitivity"] == "high")
        end = F.when(silent, F.array(F.lit("Further fate undocumented."))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head), middle, end), " ")


def render(register: str, profile: str) -> Column:
    if profile == "flattened":
        return _flattened(register)
    return (_testimony if register == "testimony" else _finding_aid)(profile == "fabricated")


def trace(profile: str) -> Column:
    events, attributes, false = F.size(salient_events()), F.size(specific_attributes()), F.size("fabrications")
    real = events + attributes
    share = F.when(real + false > 0, F.round(real / (real + false), 3)).otherwise(0.0)
    sensational = F.exists("fabrications", lambda f: f["sensational"])
    made = {
        "good": (F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0), F.lit(False)),
        "flattened": (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0), F.lit(False)),
        "fabricated": (F.lit(1.0), F.lit(1.0), share, F.lit(0.0), false, sensational),
    }[profile]
    names = ("coverage", "specific", "attributed", "calibration", "fabrications", "sensational")
    return F.struct(*(c.alias(n) for c, n in zip(made, names, strict=True)), F.greatest(events, F.lit(1)).alias("total_salient_grounded"))


def facts() -> Column:
    """The case as premises: its entities' attributes, then its events."""
    attributes = F.flatten(F.transform("entities", lambda e: F.transform(e["attributes"], lambda a: G.attribute_fact(a["key"], e["name"], a["value"]))))
    return F.concat(attributes, F.transform("events", lambda e: G.event_fact(e["summary"], e["date"]["value"])))


def blob() -> Column:
    """Everything that a case attests, for word and year indexes."""
    entities = F.transform("entities", lambda e: F.concat_ws(" | ", e["name"], F.transform(e["attributes"], lambda a: a["value"])))
    events = F.transform("events", lambda e: F.concat_ws(" | ", e["summary"], e["date"]["value"]))
    return F.array_join(F.concat(entities, events, F.transform("sources", lambda s: s["kind"])), " | ")


def salient_strings() -> Column:
    names = F.transform(F.filter("entities", lambda e: e["type"].isin("person", "place", "org")), lambda e: e["name"])
    return F.array_distinct(F.concat(names, F.transform(F.filter("events", lambda e: e["salience"] >= 2), lambda e: e["date"]["value"])))


def case_block() -> Column:
    """The fact base as prompt context."""
    focal = entity(F.col("focal"))
    told = F.transform("entities", lambda e: F.concat(F.lit("- "), e["name"], F.when(F.size(e["attributes"]) > 0, F.concat(F.lit(" ("), F.array_join(F.transform(e["attributes"], lambda a: F.concat(a["key"], F.lit(": "), a["value"])), "; "), F.lit(")"))).otherwise("")))
    events = F.transform("events", lambda e: F.concat(F.lit("- "), e["summary"], F.lit(" ["), e["date"]["value"], F.lit(", "), e["date"]["certainty"], F.lit("; src "), F.array_join(e["grounded_by"], ","), F.lit("]")))
    sources = F.array_join(F.transform("sources", lambda s: F.concat(s["id"], F.lit("="), s["kind"], F.lit(" "), s["archive_ref"])), "; ")
    lines = F.concat(F.array(F.concat(F.lit("Focal: "), focal["name"], F.lit(" ("), focal["type"], F.lit(")")), F.lit("Entities:")), told, F.array(F.lit("Events:")), events, F.array(F.concat(F.lit("Sources: "), sources)))
    return F.array_join(lines, "\n")


def gold_candidates() -> Column:
    """array of (surface, type): names without their articles, event dates, and the focal entity's years; the first type of a surface counts."""
    named = F.transform(F.filter("entities", lambda e: e["type"].isin("person", "place", "org")), lambda e: F.struct(T.without_article(e["name"]).alias("surface"), e["type"].alias("type")))
    dates = F.transform("events", lambda e: F.struct(e["date"]["value"].alias("surface"), F.lit("date").alias("type")))
    years = F.transform(F.filter(entity(F.col("focal"))["attributes"], lambda a: a["key"].isin("birth_year", "built")), lambda a: F.struct(a["value"].alias("surface"), F.lit("date").alias("type")))
    every = F.concat(*(x.cast("array<struct<surface:string,type:string>>") for x in (named, dates, years)))
    return F.transform(T.first_seen(F.transform(every, lambda c: c["surface"])), lambda s: F.element_at(F.filter(every, lambda c: c["surface"] == s), 1))


def grid(spark: SparkSession, limit: int | None = None) -> DataFrame:
    """case_id, focal_name, focal_type, register, profile, text, trace, oracle_score, and what the rewards need of the case."""
    cells = F.array(*(F.struct(F.lit(r).alias("register"), F.lit(p).alias("profile"), render(r, p).alias("text"), trace(p).alias("trace")) for r in L.REGISTERS for p in L.PROFILES))
    focal = entity(F.col("focal"))
    held = cases(spark).select(
        "case_id", focal["name"].alias("focal_name"), focal["type"].alias("focal_type"), F.explode(cells).alias("c"), facts().alias("facts"), blob().alias("blob"),
        salient_strings().alias("salient"), F.transform("sources", lambda s: s["archive_ref"]).alias("references"), case_block().alias("block"), gold_candidates().alias("gold"),
    )
    out = held.select("case_id", "focal_name", "focal_type", "c.*", "facts", "blob", "salient", "references", "block", "gold").withColumn("oracle_score", R.oracle(F.col("trace")))
    return out.orderBy("case_id", "register", "profile").limit(limit) if limit else out


def records(spark: SparkSession, register: str = "testimony") -> DataFrame:
    """Cases in the common record shape; the source text is the good rendering."""
    focal = entity(F.col("focal"))["name"]
    held = cases(spark).select("case_id", "events", focal.alias("unit"), F.transform("entities", lambda e: F.struct(e["name"].alias("name"), F.upper(e["type"]).alias("type"))).alias("named"), render(register, "good").alias("source_text"))
    return held.select(
        F.col("case_id").alias("id"), F.lit("SYNTHETIC").alias("corpus"), F.lit(register).alias("register"), "unit", F.col("unit").alias("title"), F.col("named").alias("entities"),
        F.transform("events", lambda e: F.struct(e["type"].alias("type"), F.col("unit").alias("head"), e["summary"].alias("tail"))).alias("relations"),
        "source_text", F.array().cast("array<string>").alias("subjects"), F.lit("synthetic").alias("provenance"),
    )
