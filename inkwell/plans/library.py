"""More queries of the catalogue: readers and writers round trip, reports, model hooks, each with its oracle in DuckDB's SQL.

Files that readers need are made from tables first: whole tables by Spark's writers, and one file for each row where a
format has a document a file, which is done for the nations and regions, whose number is fixed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import grounding as G
from ..functions import lexicons as L
from ..functions import parsing
from ..functions import text as T
from ..operators import agreement, datasets, flows, retrieval, scoring, selection
from ..sources import files, readers, registry, sinks
from . import fragments as D
from .catalogue import _CAND, _PAIRS, ORACLES, TEXTS_SQL, candidates, documents, pairs, query, reward_pairs, rounded, table, texts

# ---- Readers ---------------------------------------------------------------------------------------------------------


def _facts(spark, sf_dir) -> str:
    """Documents as JSON lines of extracted facts below a corpus folder with its manifest; the data folder's path."""
    data = files.folder(spark, "corpora")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"))
    person = F.when(F.col("lang") == "en", "PERSON").otherwise("ORG")
    entity = lambda text, kind: F.array(F.struct(text.alias("entity_text"), kind.alias("entity_type")))
    rows = d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document_text"), entity(F.col("source"), person).alias("base_entities"), entity(F.col("lang"), F.lit(None).cast("string")).alias("new_entities"),
        F.array(F.struct(F.lit("in").alias("relation_type"), F.col("lang").alias("head_entity_text"), F.col("source").alias("tail_entity_text")), F.struct(F.lit("of").alias("relation_type"), F.lit("").alias("head_entity_text"), F.col("source").alias("tail_entity_text"))).alias("relationships"),
    )
    sinks.jsonl(rows, f"{data}/demo/facts")
    files.put(spark, f"{data}/demo/corpus.json", json.dumps({"name": "demo", "default_source": "facts", "sources": {"facts": {"adapter": "iob_jsonl", "path": "facts", "register": "finding_aid"}}}))
    return data


_FACTS = """SELECT doc_id::VARCHAR AS id, 'demo' AS corpus, 'finding_aid' AS register, CASE WHEN lang = 'en' THEN coalesce(source, 'none') ELSE coalesce(lang, 'none') END AS unit, CASE WHEN lang = 'en' THEN 'PERSON' ELSE 'ORG' END || ',ENTITY' AS types,
    'in:' || coalesce(lang, 'none') || '>' || coalesce(source, 'none') AS relations, md5(text) AS text_md5, 'demo relation-extraction' AS provenance FROM documents WHERE coalesce(text, '') <> ''"""


def _told(records: DataFrame) -> DataFrame:
    return records.select(
        "id", "corpus", "register", "unit", F.array_join(F.transform("entities", lambda e: e["type"]), ",").alias("types"),
        F.array_join(F.transform("relations", lambda r: F.concat(r["type"], F.lit(":"), r["head"], F.lit(">"), r["tail"])), ",").alias("relations"), F.md5("source_text").alias("text_md5"), "provenance",
    )


@query("corpus_facts", _FACTS)
def corpus_facts(spark, sf_dir):
    """Manifest, adapter and record shape of JSON lines."""
    return _told(registry.load_corpus(spark, "demo", data=_facts(spark, sf_dir)))


@query("corpus_limit", f"SELECT * FROM ({_FACTS}) ORDER BY id LIMIT 25")
def corpus_limit(spark, sf_dir):
    """The 25 records with the smallest ids: the limit of a loader."""
    return _told(registry.load_corpus(spark, "demo", "facts", 25, _facts(spark, sf_dir)))


def _geography(spark, sf_dir) -> list:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).orderBy("n_nationkey").collect()


@query(
    "corpus_tei",
    """SELECT r_regionkey::VARCHAR AS id, coalesce(first(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 3 = 0 AND n_nationkey % 2 = 0), first(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 3 = 0), r_name) AS unit, r_name || ', a region' AS title, count(*) AS entities,
    md5(string_agg('Nation ' || n_name || '.' || chr(10) || chr(10) || 'Key ' || n_nationkey, chr(10) || chr(10) ORDER BY n_nationkey)) AS text_md5, string_agg(n_name, ';' ORDER BY n_nationkey) AS subjects, 'Archive of ' || r_name || CASE WHEN r_regionkey % 2 = 1 THEN ', Tables' ELSE '' END AS provenance
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
)
def corpus_tei(spark, sf_dir):
    """Header and split files of a region, a split for each nation; nations are persons, places and organisations in turn."""
    data, n = files.folder(spark, "corpora"), {}
    by: dict[int, list] = {}
    for x in _geography(spark, sf_dir):
        by.setdefault(x["r_regionkey"], []).append(x)
    for key, rows in by.items():
        named = ["", "", ""]
        for x in rows:
            tags = (("person", "persName"), ("place", "placeName"), ("org", "orgName"))[x["n_nationkey"] % 3]
            name = x["n_name"] + (" (narrator)" if x["n_nationkey"] % 3 == 0 and x["n_nationkey"] % 2 == 0 else "")
            named[x["n_nationkey"] % 3] += f"<{tags[0]}><{tags[1]}>{name}</{tags[1]}></{tags[0]}>"
        head = f"<title>{rows[0]['r_name']}, a region</title><repository>Archive of {rows[0]['r_name']}</repository><collection>{'Tables' if key % 2 else ''}</collection>{''.join(named)}"
        files.put(spark, f"{data}/geo/xml/{key}_header.xml", f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader>{head}</teiHeader></TEI>')
        for x in rows:
            n[key] = n.get(key, 0) + 1
            body = f"<p>Nation\n {x['n_name']}.</p><p> </p><p>Key {x['n_nationkey']}</p><term>{x['n_name']}</term>"
            files.put(spark, f"{data}/geo/xml/{key}_split_{n[key]}.xml", f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>{body}</body></text></TEI>')
    files.put(spark, f"{data}/geo/xml/99_header.xml", '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>No body</title></teiHeader></TEI>')
    files.put(spark, f"{data}/geo/corpus.json", json.dumps({"name": "geo", "default_source": "xml", "sources": {"xml": {"adapter": "tei_archive", "path": "xml"}}}))
    got = registry.load_corpus(spark, "geo", data=data)
    return got.select("id", "unit", "title", F.size("entities").cast("long").alias("entities"), F.md5("source_text").alias("text_md5"), F.array_join("subjects", ";").alias("subjects"), "provenance")


@query(
    "tei_entity_sets",
    f"""SELECT 'n' || n_nationkey AS doc_id, unnest([array_to_string(regexp_extract_all(n_name, '{L.TOKEN}'), ' '), array_to_string(regexp_extract_all(r_name, '{L.TOKEN}'), ' '), '1938']) AS entity, unnest(['LOCATION', 'ORGANIZATION', 'DATE']) AS type FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def tei_entity_sets(spark, sf_dir):
    """A text for each nation, its mentions marked, written as TEI files, read with offsets, and reduced to sets."""
    where = files.folder(spark, "tei")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    met = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("n"), "n_nationkey").alias("doc_id"), F.col("n_name").alias("title"), F.lit("S1 & S2").alias("references"), "r_name")
    kind = lambda s, t: F.struct(s.alias("surface"), F.lit(t).alias("type"))
    met = met.withColumn("text", F.concat(F.lit("<"), "title", F.lit("> & "), "r_name", F.lit(" since 1938, says "), "title", F.lit(".")))
    met = met.withColumn("mentions", sinks.mentions(F.col("text"), F.array(kind(F.col("title"), "place"), kind(F.col("r_name"), "org"), kind(F.lit("1938"), "date"))))
    for x in sinks.tei_texts(met, "doc_id").collect():  # one for each nation
        files.put(spark, f"{where}/{x['doc_id']}.xml", x["value"])
    return readers.entity_sets(readers.tei_entities(spark, f"{where}/*.xml"))


@query("word_norms", "SELECT lower(trim(p_name)) || ' ' || p_partkey AS word, p_retailprice::DOUBLE AS rating FROM part WHERE p_partkey % 7 <> 0")
def word_norms(spark, sf_dir):
    """A table of ratings of words with entries that aren't numbers."""
    where = files.folder(spark, "norms")
    rating = F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    table(spark, sf_dir, "part").select(F.upper(F.concat_ws(" ", F.trim("p_name"), "p_partkey")).alias("Word"), rating.alias("Conc.M")).write.option("header", True).csv(where)
    return readers.word_ratings(spark, where)


@query("rating_files", "SELECT r_name AS annotator, n_name AS record_id, n_nationkey AS candidate_i, (n_nationkey % 5 + 1)::INT AS overall FROM nation JOIN region ON n_regionkey = r_regionkey")
def rating_files(spark, sf_dir):
    """A file for each annotator, here a region; one more that isn't JSON and one without responses."""
    where, by = files.folder(spark, "ratings"), {}
    for x in _geography(spark, sf_dir):
        by.setdefault(x["r_name"], []).append({"record_id": x["n_name"], "candidate_i": x["n_nationkey"], "overall": x["n_nationkey"] % 5 + 1})
    for k, (name, rows) in enumerate(by.items()):
        files.put(spark, f"{where}/{k}.json", json.dumps({"annotator": name, "corpus": "geo", "responses": rows, "notes": {"a": "b"}}, indent=1))
    files.put(spark, f"{where}/broken.json", "{not json")
    files.put(spark, f"{where}/empty.json", '{"annotator": "nobody"}')
    return readers.ratings(spark, where)


@query(
    "authored_files",
    "SELECT CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'f' || r_regionkey || '.json' END AS author, n_name AS record_id, 'About ' || n_name AS text, CASE WHEN n_nationkey % 4 > 0 THEN (n_nationkey % 4)::INT END AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 > 0",
)
def authored_files(spark, sf_dir):
    """A file for each author, some without a name; some summaries are blank, some have no confidence."""
    where, by = files.folder(spark, "authored"), {}
    for x in _geography(spark, sf_dir):
        n = x["n_nationkey"]
        by.setdefault((x["r_regionkey"], x["r_name"]), []).append({"record_id": x["n_name"], "text": f"  About {x['n_name']} " if n % 3 else "  "} | ({"confidence": n % 4} if n % 4 else {}))
    for (key, name), rows in by.items():
        files.put(spark, f"{where}/f{key}.json", json.dumps({"summaries": rows} | ({} if key % 2 else {"author": name})))
    return readers.authored(spark, where)


_CANDIDATE_SQL = "SELECT r_name AS record_id, n_nationkey AS i, 'About ' || n_name AS text, (n_nationkey % 4)::INT AS unsup, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 2.0::DOUBLE END AS judge FROM nation JOIN region ON n_regionkey = r_regionkey"


def _candidate_file(spark, sf_dir) -> str:
    where, by = files.folder(spark, "candidates"), {}
    for x in _geography(spark, sf_dir):
        n = x["n_nationkey"]
        by.setdefault(x["r_name"], []).append({"i": n, "text": f"About {x['n_name']}", "F": 1 / (1 + n % 4), "unsup": n % 4, "judge": n / 2 if n % 2 == 0 else None})
    records = [{"id": r, "title": f"Region {r}", "unit": r.lower(), "register": "testimony", "record_block": f"Unit: {r}", "prompt_user": "p", "picks": {"a": 1}, "candidates": c} for r, c in by.items()]
    files.put(spark, f"{where}/c.json", json.dumps({"corpus": "geo", "source": "xml", "gen_model": "m", "k": 5, "records": records}, indent=1))
    return f"{where}/c.json"


@query("candidate_file", _CANDIDATE_SQL)
def candidate_file(spark, sf_dir):
    return readers.candidates(spark, _candidate_file(spark, sf_dir)).select("record_id", "i", "text", "unsup", "judge")


@query("record_file", "SELECT r_name AS id, 'Region ' || r_name AS title, lower(r_name) AS unit, 'testimony' AS register, 'Unit: ' || r_name AS record_block FROM region")
def record_file(spark, sf_dir):
    return readers.record_texts(spark, _candidate_file(spark, sf_dir))


@query("pair_files", f"SELECT md5(prompt) AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected, CASE WHEN len(chosen) % 2 = 0 THEN 'fabrication' ELSE 'flattened' END AS kind FROM {_PAIRS} WHERE trim(rejected, ' ') <> '' AND trim(chosen, ' ') <> '' AND trim(prompt, ' ') <> ''")
def pair_files(spark, sf_dir):
    """Pairs through JSON lines; those that lack a text are left out."""
    where = files.folder(spark, "pairs")
    sinks.jsonl(pairs(spark, sf_dir).withColumn("rejected_kind", F.when(F.length("chosen") % 2 == 0, "fabrication").otherwise("flattened")), where)
    return readers.pairs(spark, where, strict=False).select(F.md5("prompt").alias("prompt"), F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), F.col("rejected_kind").alias("kind"))


@query("fine_tuning_files", f"SELECT md5(prompt) AS prompt, md5(' ' || trim(chosen)) AS completion FROM {_PAIRS}")
def fine_tuning_files(spark, sf_dir):
    where = files.folder(spark, "sft")
    sinks.jsonl(datasets.sft(pairs(spark, sf_dir)), where, nulls=False)
    return readers.fine_tuning(spark, where).select(F.md5("prompt").alias("prompt"), F.md5("completion").alias("completion"))


# ---- Writers and reports ---------------------------------------------------------------------------------------------

_HTML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    "blind_sheet",
    f"""SELECT conv_id, count(*) AS n, 'A' AS first_label, chr((64 + count(*))::INT) AS last_label, count(*) AS labels, md5(string_agg({_HTML.format("coalesce(text, '')")}, chr(10) ORDER BY turn)) AS html FROM (SELECT DISTINCT conv_id, turn, text FROM conversations) GROUP BY conv_id""",
)
def blind_sheet(spark, sf_dir):
    """Turns of a conversation as candidates in an order drawn from a seed: labels from A on, each once, and what they show."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("record_id"), F.col("turn").alias("i"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    s = sinks.rating_sheet(c)
    html = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "html"))), lambda x: x["html"]), "\n"))
    return s.groupBy(F.col("record_id").alias("conv_id")).agg(F.count("*").alias("n"), F.min("label").alias("first_label"), F.max("label").alias("last_label"), F.count_distinct("label").alias("labels"), html.alias("html"))


@query(
    "blind_sheet_labels",
    f"""SELECT conv_id, turn, chr((64 + row_number() OVER (PARTITION BY conv_id ORDER BY sha256('7:' || conv_id || ':' || turn), turn, text))::INT) AS label, md5({_HTML.format('text')}) AS html
    FROM (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM conversations)""",
)
def blind_sheet_labels(spark, sf_dir):
    """The sheet row by row: the order itself is compared."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("record_id"), F.col("turn").alias("i"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return sinks.rating_sheet(c).select(F.col("record_id").alias("conv_id"), F.col("i").alias("turn"), "label", F.md5("html").alias("html"))


@query("authoring_sheet", f"SELECT doc_id AS id, source AS title, lang AS unit, md5(substr(text, 1, 1200)) AS excerpt, md5({_HTML.format('substr(text, 1, 1200)')}) AS html FROM documents")
def authoring_sheet(spark, sf_dir):
    made = sinks.authoring_sheet(documents(spark, sf_dir, "doc_id", "source", "lang", "text").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("unit"), F.col("text").alias("source_text")))
    return made.select("id", "title", "unit", F.md5("excerpt").alias("excerpt"), F.md5("html").alias("html"))


@query(
    "report_markdown",
    """WITH p AS (SELECT CASE WHEN quality = 0 THEN 'flattened' WHEN toxic = 1 THEN 'fabricated' ELSE 'good' END AS profile, avg((quality - toxic)::DOUBLE) AS o, avg(n_chars / 1000.0::DOUBLE) AS s, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    g AS (SELECT max(o) FILTER (profile = 'good') AS go, max(o) FILTER (profile = 'flattened') AS fo, max(o) FILTER (profile = 'fabricated') AS xo, max(s) FILTER (profile = 'good') AS gs, max(s) FILTER (profile = 'fabricated') AS xs, sum(n)::BIGINT AS n,
      string_agg(printf('| %s | %.3f | %.3f |', profile, o, s), chr(10) ORDER BY CASE profile WHEN 'good' THEN 0 WHEN 'flattened' THEN 1 ELSE 2 END) AS t FROM p)
    SELECT printf('# Synthetic grid' || chr(10) || chr(10) || '%d texts, %d preference pairs.', n, 0) || chr(10) || chr(10) || '| profile | oracle | surface |' || chr(10) || '|-|-|-|' || chr(10) || t || chr(10) || chr(10) ||
      '- ' || CASE WHEN go > greatest(fo, xo) THEN 'PASS' ELSE 'FAIL' END || ': the reference judge ranks good first' || chr(10) || '- ' || CASE WHEN xs >= gs * 0.85 THEN 'PASS' ELSE 'FAIL' END || ': the surface score is fooled by invented detail' || chr(10) AS report FROM g""",
)
def report_markdown(spark, sf_dir):
    """The report over labelled documents: clean, low and toxic ones as the three profiles."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    profile = F.when(F.col("quality") == 0, "flattened").when(F.col("toxic") == 1, "fabricated").otherwise("good")
    means = {r["profile"]: r for r in d.groupBy(profile.alias("profile")).agg(F.avg((F.col("quality") - F.col("toxic")).cast("double")).alias("o"), F.avg(F.col("n_chars") / 1000).alias("s"), F.count("*").alias("n")).collect()}
    text = sinks.report([(p, means[p]["o"], means[p]["s"]) for p in L.PROFILES], sum(r["n"] for r in means.values()), 0)
    return spark.createDataFrame([(text,)], "report string")


@query("acceptance_by_style", f"SELECT style, count(*) AS rows, count(*) FILTER (CASE style WHEN 'good' THEN unsup = 0 WHEN 'fabricated' THEN unsup >= 1 ELSE true END) AS accepted, round(avg(F), 6) AS mean_F FROM (SELECT *, (['good', 'flattened', 'fabricated'])[i % 3 + 1] AS style FROM {_CAND}) GROUP BY 1")
def acceptance_by_style(spark, sf_dir):
    style = F.element_at(F.array(*map(F.lit, L.PROFILES)), (F.col("i") % 3 + 1).cast("int"))
    return rounded(flows.acceptance(candidates(spark, sf_dir).withColumn("style", style)), ["mean_F"])


@query("pair_kinds", f"SELECT kind, count(*) AS rows FROM ({ORACLES['reward_pairs']}) GROUP BY 1")
def pair_kinds(spark, sf_dir):
    return datasets.kinds(reward_pairs(spark, sf_dir))


@query("equal_pair_count", f"SELECT count(*) FILTER (substr(chosen, 1, 30) = substr(rejected, 1, 30)) AS equal_pairs FROM {_PAIRS}")
def equal_pair_count(spark, sf_dir):
    """Pairs cut to 30 characters, so that some are equal."""
    return datasets.equal_pairs(pairs(spark, sf_dir).select(F.substring("chosen", 1, 30).alias("chosen"), F.substring("rejected", 1, 30).alias("rejected")))


@query("rendering_fallback", "SELECT doc_id, md5(CASE WHEN quality = 1 THEN 'written for ' || doc_id ELSE text END) AS text_md5 FROM documents LEFT JOIN labels USING (doc_id)")
def rendering_fallback(spark, sf_dir):
    """Written texts for documents of good quality, empty ones for the other labelled ones, none for the rest."""
    made = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("written for "), "doc_id")).otherwise("").alias("text"))
    return readers.with_fallback(table(spark, sf_dir, "documents").select("doc_id", "text"), made, ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5"))


def _prf_sql(got: str, gold: str, rows: str) -> str:
    return f"""SELECT l_orderkey, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0::DOUBLE END, 6) AS f1 FROM (SELECT l_orderkey, CASE WHEN len(g) = 0 AND len(w) = 0 THEN 1::DOUBLE WHEN len(g) = 0 THEN 0::DOUBLE ELSE len(list_intersect(g, w)) / len(g) END AS p,
    CASE WHEN len(g) = 0 AND len(w) = 0 THEN 1::DOUBLE WHEN len(w) = 0 THEN 0::DOUBLE ELSE len(list_intersect(g, w)) / len(w) END AS r FROM (SELECT l_orderkey, coalesce(list(DISTINCT {got}) FILTER ({rows}), []) AS g, list(DISTINCT {gold}) AS w FROM lineitem GROUP BY 1))"""


def _links(spark, sf_dir) -> DataFrame:
    """Relations of an order: a part comes from a supplier; found are those of more than 25 pieces, in another spelling."""
    link = lambda head, tail: F.struct(F.lit("x").alias("relation_type"), head.alias("head_entity_text"), tail.alias("tail_entity_text"))
    got = link(F.concat(F.lit(" PART "), "l_partkey"), F.concat(F.lit("Supplier "), "l_suppkey", F.lit(" ")))
    gold = link(F.concat(F.lit("part "), "l_partkey"), F.concat(F.lit("supplier "), "l_suppkey"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_quantity") > 25, got)).alias("got"), F.collect_list(gold).alias("gold"))


@query("link_f1", _prf_sql("l_partkey || '>' || l_suppkey", "l_partkey || '>' || l_suppkey", "l_quantity > 25"))
def link_f1(spark, sf_dir):
    s = _links(spark, sf_dir).select("l_orderkey", agreement.precision_recall(agreement.link_set(F.col("got")), agreement.link_set(F.col("gold"))).alias("s"))
    return rounded(s.select("l_orderkey", "s.*"), ("precision", "recall", "f1"))


@query("entity_f1", _prf_sql("l_partkey", "l_partkey", "l_quantity > 25"))
def entity_f1(spark, sf_dir):
    """The parts alone, as entities."""
    named = lambda c: agreement.entity_set(F.transform(c, lambda r: F.struct(r["head_entity_text"].alias("entity_text"))))
    s = _links(spark, sf_dir).select("l_orderkey", agreement.precision_recall(named(F.col("got")), named(F.col("gold"))).alias("s"))
    return rounded(s.select("l_orderkey", "s.*"), ("precision", "recall", "f1"))


_STATUS = f"CASE WHEN unsup = 0 THEN '{G.NO_CLAIMS}' WHEN unsup % 5 = 4 THEN '{G.VAGUE}' ELSE '{G.SCORED}' END"


def _scored(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("unsup") == 0, G.NO_CLAIMS).when(F.col("unsup") % 5 == 4, G.VAGUE).otherwise(G.SCORED)
    return candidates(spark, sf_dir).withColumn("status", status).withColumn("composite", F.col("density"))


@query("mean_scores", f"SELECT round(avg(F), 6) AS F, round(avg(unsup), 6) AS unsup, round(avg(density), 6) AS composite, round(avg(linguistic), 6) AS linguistic FROM {_CAND}")
def mean_scores(spark, sf_dir):
    return rounded(flows.mean_row(_scored(spark, sf_dir)), ("F", "unsup", "composite", "linguistic"))


@query("status_diagnostics", f"SELECT {_STATUS} AS status, count(*) AS rows FROM {_CAND} GROUP BY 1")
def status_diagnostics(spark, sf_dir):
    return flows.diagnostics(_scored(spark, sf_dir))


@query("status_counters", f"SELECT count(*) AS rows, count(*) FILTER (s = '{G.SCORED}') AS scored, count(*) FILTER (s LIKE 'unscoreable:%') AS vacuous, 0::BIGINT AS fallback, 0::BIGINT AS failed FROM (SELECT {_STATUS} AS s FROM {_CAND})")
def status_counters(spark, sf_dir):
    """Counters that the pass that writes the scores fills on its way."""
    rows, seen = scoring.observed(_scored(spark, sf_dir))
    rows.select("record_id", "i", "status", "F").write.parquet(files.folder(spark, "scored"))
    return spark.createDataFrame([tuple(seen.get[k] for k in ("rows", "scored", "vacuous", "fallback", "failed"))], "rows long, scored long, vacuous long, fallback long, failed long")


@query("score_lines", f"SELECT i, printf('F=%s  unsup=%d  composite=%.3f  linguistic=%.3f', CASE WHEN status = '{G.SCORED}' THEN printf('%.2f', F) ELSE upper(status) END, unsup, density, linguistic) AS line FROM (SELECT *, {_STATUS} AS status FROM {_CAND})")
def score_lines(spark, sf_dir):
    return flows.score_line(_scored(spark, sf_dir), ["i"])


@query("label_balance", f"SELECT label, count(*) AS rows FROM ({ORACLES['kto_rows']}) GROUP BY 1")
def label_balance(spark, sf_dir):
    return flows.label_balance(datasets.kto(pairs(spark, sf_dir)))


@query("verified_render", "SELECT conv_id AS record_id, md5(CASE WHEN coalesce(t, '') <> '' THEN t ELSE 'template ' || conv_id END) AS text, CASE WHEN coalesce(t, '') <> '' THEN 'llm' ELSE 'template' END AS source FROM (SELECT conv_id, first(text ORDER BY turn) FILTER (len(text) % 3 = 1) AS t FROM conversations GROUP BY 1)")
def verified_render(spark, sf_dir):
    """Turns as tries, accepted by their length; else a template."""
    c = table(spark, sf_dir, "conversations")
    tries = c.select(F.col("conv_id").alias("record_id"), F.col("turn").alias("attempt"), "text", (F.length("text") % 3 == 1).alias("accepted"))
    made = selection.attempts(tries, c.select(F.col("conv_id").alias("record_id")).distinct().withColumn("text", F.concat(F.lit("template "), "record_id")))
    return made.select("record_id", F.md5("text").alias("text"), "source")


# ---- Parsers, prompts and model hooks --------------------------------------------------------------------------------


@query("extraction_parse", """SELECT event_id, (event_id % 4 <= 1)::INT AS entities, CASE event_id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'MISCELLANEOUS' END AS type, (event_id % 4 = 1)::INT AS relations, CASE WHEN event_id % 4 = 1 THEN 'e' || event_id || ' related_to C' END AS told FROM events""")
def extraction_parse(spark, sf_dir):
    """Answers in four shapes: text around JSON with a blank entity, new entities and a relation without a type, no JSON, broken JSON."""
    e = F.concat(F.lit("e"), F.col("event_id"))
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('note {"entities":[{"entity_text":"'), e, F.lit('","entity_type":"PERSON"},{"entity_text":""}],"relationships":[]} end')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"new_entities":[{"entity_text":"'), e, F.lit('"}],"relationships":[{"head_entity_text":"'), e, F.lit('","tail_entity_text":"C"}]}')))
        .when(F.col("event_id") % 4 == 2, F.lit("none"))
        .otherwise(F.lit('{"entities": ['))
    )
    x = table(spark, sf_dir, "events").select("event_id", parsing.extraction(raw).alias("x"))
    r = F.try_element_at(F.col("x.relationships"), F.lit(1))
    told = F.concat(r["head_entity_text"], F.lit(" "), r["relation_type"], F.lit(" "), r["tail_entity_text"])
    return x.select("event_id", F.size("x.entities").alias("entities"), F.try_element_at(F.col("x.entities"), F.lit(1))["entity_type"].alias("type"), F.size("x.relationships").alias("relations"), told.alias("told"))


@query("date_attributes", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN y::VARCHAR WHEN 2 THEN '1938' END AS "when", CASE WHEN o_orderkey % 4 = 1 THEN y::VARCHAR END AS "from", CASE WHEN o_orderkey % 4 = 1 THEN (y + 1)::VARCHAR END AS "to" FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""")
def date_attributes(spark, sf_dir):
    """A year, two with a dash, one in blanks, a day in words."""
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    value = F.when(k == 0, y.cast("string")).when(k == 1, F.concat(y.cast("string"), F.lit("–"), (y + 1).cast("string"))).when(k == 2, " 1938 ").otherwise("12 May 1938")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.date_attributes(value).alias("d")).select("o_orderkey", "d.*")


@query("render_prompts", f"""SELECT doc_id, md5({D.q(L.RENDER_SYSTEM)} || replace(replace({D.q(L.RENDER_STYLE['good'])}, '{{unit}}', source), '{{register}}', lang) || chr(10) || chr(10) || 'RECORD:' || chr(10) || text) AS digest FROM documents""")
def render_prompts(spark, sf_dir):
    m = parsing.render_messages("good", F.col("source"), F.col("lang"), F.col("text"))
    return documents(spark, sf_dir, "doc_id", "source", "lang", "text").select("doc_id", F.md5(F.array_join(F.transform(m, lambda x: x["content"]), "")).alias("digest"))


def _judge():
    """A judge for tests: it rates by the length of what it reads, now and then without JSON, and sometimes it fails."""

    def ask(prompt: str) -> str:
        n = len(prompt)
        if n % 7 == 0:
            raise ValueError("no")
        return f'Well. {{"score": {n % 11}}}' if n % 3 else f"score: {n % 10}"

    return ask


_ASKED = f"{len(L.JUDGE_SYSTEM) + 2 + len(L.JUDGE_USER.replace('{{', '{').replace('}}', '}').replace('{record}', '').replace('{narrative}', ''))} + len(source) + len(text)"


@query("judge_flow", f"SELECT doc_id, (CASE WHEN n % 7 = 0 THEN 0 WHEN n % 3 > 0 THEN n % 11 ELSE n % 10 END)::DOUBLE AS judge FROM (SELECT doc_id, {_ASKED} AS n FROM documents)")
def judge_flow(spark, sf_dir):
    """Messages, a judge's answer, and the score in it; a judge that fails gives 0."""
    d = documents(spark, sf_dir, "doc_id", "source", "text")
    return flows.judged(d, "source", "text", _judge, tries=1, wait=0.0).select("doc_id", "judge")


def _echo():
    def ask(prompt: str) -> str:
        if len(prompt) % 3 == 0:
            raise ValueError("no")
        return f"A{len(prompt)}" if len(prompt) % 3 == 1 else ""

    return ask


@query("chat_answers", "SELECT conv_id, turn, CASE len(text) % 3 WHEN 1 THEN 'A' || len(text) WHEN 2 THEN '' END AS answer, CASE len(text) % 3 WHEN 0 THEN 'failed: ValueError(''no'')' WHEN 1 THEN 'ok' ELSE 'empty' END AS answer_status FROM conversations WHERE text IS NOT NULL")
def chat_answers(spark, sf_dir):
    """A model that answers, fails, or says nothing, by the length of the prompt."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return flows.scoring.chat_column(c, "text", "answer", _echo, tries=1, wait=0.0).select("conv_id", "turn", "answer", "answer_status")


@query("extractor_names", rf"SELECT doc_id, len(list_distinct(regexp_extract_all(regexp_replace(text, '[.!?]\s+\S+', '', 'g'), ' ([A-ZÀ-Þ][a-zà-ÿ]+)', 1)))::INT AS names FROM {TEXTS_SQL}")
def extractor_names(spark, sf_dir):
    """The extractor that needs no model."""
    return flows.extracted(texts(spark, sf_dir), "text", flows.name_extractor, tries=1, wait=0.0).select("doc_id", F.size("extraction.entities").alias("names"))


_FALSE_NAMES, _FALSE_YEARS = D.names_in("f"), D.years("f")


@query(
    "downstream_metric",
    f"""WITH t AS (SELECT doc_id, substr(string_split(text, '.')[1], 1, 200) AS g, {D.q(flows.OFF_RECORD)} AS f, {D.lowered('text')} AS w, {D.years('text')} AS y FROM {TEXTS_SQL}),
    x AS (SELECT doc_id, w, y, {D.names_in('g')} AS gn, {D.years('g')} AS gy, {_FALSE_NAMES} AS fn, {_FALSE_YEARS} AS fy FROM t)
    SELECT doc_id, round(greatest(0::DOUBLE, CASE WHEN len(gn) + len(gy) > 0 THEN (len(list_filter(gn, lambda n: list_contains(w, n))) + len(list_filter(gy, lambda n: list_contains(y, n)))) / (len(gn) + len(gy)) ELSE 1::DOUBLE END
      - CASE WHEN len(fn) + len(fy) > 0 THEN (len(list_filter(fn, lambda n: list_contains(w, n))) + len(list_filter(fy, lambda n: list_contains(y, n)))) / (len(fn) + len(fy)) ELSE 1::DOUBLE END), 6) AS downstream FROM x""",
)
def downstream_metric(spark, sf_dir):
    return rounded(flows.downstream(texts(spark, sf_dir), ["doc_id"], "text"), ["downstream"])


def _letters():
    """An encoder for tests: counts of letters."""
    import numpy as np

    return lambda xs: np.array([[x.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for x in xs], dtype=float)


_NEAR = "round(list_dot_product(a, b) / (greatest(sqrt(list_dot_product(a, a)), 1e-12::DOUBLE) * greatest(sqrt(list_dot_product(b, b)), 1e-12::DOUBLE)), 9)"


def _counts(t: str) -> str:
    return f"list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (len(lower({t})) - len(replace(lower({t}), c, '')))::DOUBLE)"


@query(
    "encoded_retrieval",
    f"""WITH s AS (SELECT doc_id, {D.source_sentences('text')} AS s FROM {TEXTS_SQL}), e AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence, s[1] AS asked FROM s WHERE len(s) > 0),
    v AS (SELECT doc_id, pos, {_counts('asked')} AS a, {_counts('sentence')} AS b FROM e),
    r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY {_NEAR} DESC, pos) - 1 AS rank FROM v)
    SELECT doc_id, rank::INT AS rank, pos::INT AS pos, 'encoded' AS status FROM r WHERE rank < 3""",
)
def encoded_retrieval(spark, sf_dir):
    """The three sentences nearest to the first one by an encoder of letters."""
    first = F.coalesce(F.try_element_at(T.source_sentences(F.col("text")), F.lit(1)), F.lit(""))
    top = retrieval.top_encoded(texts(spark, sf_dir).withColumn("q", first), "text", "q", 3, _letters)
    return top.select("doc_id", F.col("retrieved_status").alias("status"), F.posexplode("retrieved").alias("rank", "r")).select("doc_id", "rank", "r.pos", "status")



# ---- Profiles from labels: what the grid's reports say, over documents ----------------------------------------------

_PROFILED = f"""(SELECT source, lang, profile, n_chars, round({D.REWARD}, 4) AS linguistic FROM (SELECT source, lang, n_chars, CASE WHEN quality = 0 THEN 'flattened' WHEN toxic = 1 THEN 'fabricated' ELSE 'good' END AS profile, {D.feature_columns('text')}
    FROM documents JOIN labels USING (doc_id)))"""
_CELLS = "(SELECT source, lang, " + ", ".join(f"max({c}) FILTER (profile = '{p}') AS {c[0]}_{p}" for c in ("linguistic", "n_chars") for p in L.PROFILES) + f" FROM {_PROFILED} GROUP BY ALL)"


def profiled(spark, sf_dir) -> DataFrame:
    """Labelled documents with a profile (clean, low, toxic), in cells of a source and a language."""
    d = documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    profile = F.when(F.col("quality") == 0, "flattened").when(F.col("toxic") == 1, "fabricated").otherwise("good")
    return X.with_features(d).select("source", "lang", "n_chars", profile.alias("profile"), X.linguistic_reward(digits=4).alias("linguistic"))


@query("win_counts", f"SELECT count(*) AS cells, count(*) FILTER (l_good > l_fabricated) AS wins FROM {_CELLS}")
def win_counts(spark, sf_dir):
    return agreement.wins(profiled(spark, sf_dir), ["source", "lang"], "profile", "linguistic", "good", "fabricated")


@query("arm_agreement", " UNION ALL ".join(f"SELECT '{p}' AS other, count(*) AS cells, count(*) FILTER ((l_good > l_{p}) = (n_good > n_{p})) AS agree FROM {_CELLS} WHERE source IS NOT NULL AND lang IS NOT NULL" for p in L.PROFILES[1:]))
def arm_agreement(spark, sf_dir):
    """Whether the surface reward and the length say the same."""
    return flows.arm_agreement(profiled(spark, sf_dir), ["source", "lang"], "linguistic", "n_chars")


@query(
    "judge_counters",
    f"""SELECT count(*) AS cells, count(*) FILTER (l_good > l_flattened AND l_good > l_fabricated) AS good_top, count(*) FILTER (l_good > l_fabricated) AS good_over_fabricated, count(*) FILTER (l_fabricated < l_flattened) AS fabricated_under_flattened,
    count(*) FILTER (l_good IS NOT DISTINCT FROM l_flattened OR l_good IS NOT DISTINCT FROM l_fabricated OR l_flattened IS NOT DISTINCT FROM l_fabricated) AS ties FROM {_CELLS}""",
)
def judge_counters(spark, sf_dir):
    """The surface reward as the judge."""
    return flows.judge_counters(profiled(spark, sf_dir), ["source", "lang"], "linguistic")


def _prompt_sql(unit: str, register: str, record: str) -> str:
    return f"replace(replace(replace({D.q(L.INSTRUCTION)}, '{{unit}}', {unit}), '{{register}}', {register}), '{{record}}', {record})"


_REGISTER = "replace(register, '_', '-')"


@query("case_prompts", f"SELECT doc_id AS case_id, register, md5({_prompt_sql('source', _REGISTER, 'text')}) AS prompt FROM documents, (VALUES ('testimony'), ('finding_aid')) registers(register)")
def case_prompts(spark, sf_dir):
    """Each document as a case, once for each register."""
    d = documents(spark, sf_dir, "doc_id", "source", "text").withColumnRenamed("doc_id", "case_id")
    return flows.case_prompts(d, F.col("source"), F.col("text")).withColumn("prompt", F.md5("prompt"))


@query(
    "training_pairs",
    f"""SELECT record_id, kind, md5({_prompt_sql("c.source", "c.lang", "record_id")}) AS prompt, md5(trim(c.text)) AS chosen, md5(trim(r.text)) AS rejected
    FROM ({ORACLES['reward_pairs']}) JOIN documents c ON c.doc_id = chosen JOIN documents r ON r.doc_id = rejected WHERE record_id IS NOT NULL""",
)
def training_pairs(spark, sf_dir):
    """Training data end to end: candidates scored, paired by reward, and given their record's prompt."""
    record = F.concat("source", F.lit("/"), "lang")
    prompts = table(spark, sf_dir, "documents").select("source", "lang").distinct().select(record.alias("id"), parsing.prompt(F.col("source"), F.col("lang"), record).alias("prompt"))
    made = flows.training_rows(candidates(spark, sf_dir), prompts, "reward")[1]
    return made.select("record_id", "kind", *(F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")))


@query("unscoreable_rows", f"SELECT starts_with({_STATUS}, 'unscoreable:') AS unscoreable, count(*) AS rows FROM {_CAND} GROUP BY 1")
def unscoreable_rows(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy(G.is_unscoreable(F.col("status")).alias("unscoreable")).agg(F.count("*").alias("rows"))
