import json

import pytest
from pyspark.sql import functions as F

from inkwell.sources import readers, registry, sinks, synthetic

HEADER = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>Letter, 1938</title><repository>Archive</repository><collection>Box 1</collection>
<person><persName>Otto (guard)</persName></person><person><persName>Anna  K. (Narrator)</persName></person><place><placeName>Graz</placeName><placeName>Gratz</placeName></place><org><orgName>Aid</orgName></org></teiHeader></TEI>"""
BODY = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><p>First <persName>Anna</persName> came.</p><p> </p><term>flight</term><p>Part {n}</p></body></text></TEI>"""


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    base = tmp_path_factory.mktemp("data") / "C"
    (base / "xml").mkdir(parents=True)
    (base / "xml" / "d1_header.xml").write_text(HEADER)
    for n in (10, 2):
        (base / "xml" / f"d1_split_{n}.xml").write_text(BODY.format(n=n))
    (base / "xml" / "d2_header.xml").write_text(HEADER)
    rows = [
        {"id": "x0", "document_text": "Text", "base_entities": [], "new_entities": [{"entity_text": "Anna", "entity_type": "PERSON"}, {"entity_text": "Otto", "entity_type": "PERSON"}, {"entity_text": "Otto"}], "relationships": [{"relation_type": "knows", "head_entity_text": "Anna", "tail_entity_text": ""}]},
        {"id": "x1", "document_text": ""},
        {"id": "x2", "document_text": "T", "base_entities": [{"entity_text": "Graz"}], "relationships": [{"relation_type": "r", "head_entity_text": "Aid", "tail_entity_text": "Graz"}, {"relation_type": "r", "head_entity_text": "Aid", "tail_entity_text": "Wien"}]},
    ]
    (base / "facts.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows))
    (base / "corpus.json").write_text(json.dumps({"name": "C", "default_source": "t", "sources": {"t": {"adapter": "tei_letters", "path": "xml"}, "f": {"adapter": "iob_jsonl", "path": "facts.jsonl"}, "u": {"adapter": "none"}}}))
    return str(base.parent)


def test_tei(spark, corpus):
    rows = registry.load_corpus(spark, "C", data=corpus).collect()
    assert [r.id for r in rows] == ["d1"]
    r = rows[0]
    assert (r.unit, r.title, r.provenance) == ("Anna K.", "Letter, 1938", "Archive, Box 1")
    assert r.source_text == "First Anna came.\n\nPart 2\n\nFirst Anna came.\n\nPart 10"
    assert [e.name for e in r.entities] == ["Otto (guard)", "Anna K. (Narrator)", "Graz", "Aid"] and r.subjects == ["flight", "flight"]


def test_facts(spark, corpus):
    rows = {r.id: r for r in registry.load_corpus(spark, "C", "f", data=corpus).collect()}
    assert set(rows) == {"x0", "x2"} and rows["x0"].unit == "Anna" and rows["x0"].relations == [] and rows["x0"].entities[2].type == "ENTITY"
    assert rows["x2"].unit == "Aid"
    assert registry.load_corpus(spark, "C", "f", limit=1, data=corpus).count() == 1


def test_unknown_adapter(spark, corpus):
    with pytest.raises(KeyError):
        registry.load_corpus(spark, "C", "u", data=corpus)
    assert registry.available() == ["iob_jsonl", "synthetic", "tei"]


def test_synthetic_records(spark):
    rows = registry.load_corpus(spark, "synthetic", limit=3).collect()
    assert [r.id for r in rows] == ["synth_case_001", "synth_case_002", "synth_case_003"] and rows[0].entities[0].type == "PERSON"


def test_two_ways_to_read_tags(spark):
    text = "Anna B-PERS\nKahn I-PERS\n\nHof I-PERS\nx O\nGraz I-LOC\nWien I-LOC\n. O\nUlm B-LOC\nOtto I-PERS\n"
    tags = readers.tag_rows(spark.createDataFrame([("d.iob", text)], "name string, value string"))
    spans = sorted((r.start, r.end, r.surface, r.type) for r in readers.iob_entities(tags, "offsets").collect())
    assert spans == [(0, 13, "Anna Kahn Hof", "PERSON"), (28, 31, "Ulm", "LOCATION")]
    sets = {(r.entity, r.type) for r in readers.iob_entities(tags, "set").collect()}
    assert sets == {("Anna Kahn", "PERSON"), ("Hof", "PERSON"), ("Graz Wien", "LOCATION"), ("Ulm", "LOCATION"), ("Otto", "PERSON")}


def test_mentions_longest_first(spark):
    wanted = F.array(*(F.struct(F.lit(s).alias("surface"), F.lit(t).alias("type")) for s, t in (("Adler", "person"), ("Adler & Son", "org"), ("a.b", "date"))))
    got = spark.range(1).select(sinks.mentions(F.lit("Adler & Son, Adler, a.b axb"), wanted).alias("m")).head().m
    assert [(m.start, m.end, m.surface) for m in got] == [(0, 11, "Adler & Son"), (13, 18, "Adler"), (20, 23, "a.b")]


def test_tei_offsets_survive_markup(spark):
    xml = sinks.tei_document("T", "S1", "In <Graz> & 1938", [{"start": 3, "end": 9, "surface": "<Graz>", "type": "place"}, {"start": 12, "end": 16, "surface": "1938", "type": "date"}])
    text, spans = readers.tei_spans(xml)
    assert text == "In <Graz> & 1938" and spans == [("<Graz>", "LOCATION", 3, 9), ("1938", "DATE", 12, 16)] and 'when="1938"' in xml


def test_sheets(spark):
    c = spark.createDataFrame([("r", k, f"<{k}>") for k in range(4)], "record_id string, i int, text string")
    rows = sinks.rating_sheet(c).collect()
    assert sorted(r.label for r in rows) == list("ABCD") and {r.html for r in rows} == {f"&lt;{k}&gt;" for k in range(4)}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sinks.rating_sheet(c).collect()))


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"annotator": "x", "responses": [{"record_id": "r", "candidate_i": 1, "overall": 4}]}))
    (tmp_path / "b.json").write_text('{"other": 1}')
    (tmp_path / "c.json").write_text("not json")
    assert [tuple(r) for r in readers.ratings(spark, str(tmp_path)).collect()] == [("x", "r", 1, 4)]
    (tmp_path / "d.json").write_text(json.dumps({"summaries": [{"record_id": "r", "text": " t ", "confidence": None}, {"record_id": "q", "text": " "}]}))
    assert [tuple(r) for r in readers.authored(spark, str(tmp_path)).collect()] == [("d.json", "r", "t", None)]


def test_pairs_that_lack_a_text(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    p.write_text('{"prompt":"p","chosen":"a","rejected":"b"}\n{"prompt":"p","chosen":" ","rejected":"b"}\n')
    assert readers.pairs(spark, str(p), strict=False).count() == 1
    with pytest.raises(Exception, match="lacks a text"):
        readers.pairs(spark, str(p)).collect()


def test_word_ratings(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("word,rating\n Hat ,4.5\nbad,x\n")
    assert [tuple(r) for r in readers.word_ratings(spark, str(p)).collect()] == [("hat", 4.5)]


def test_jsonl_with_nulls(spark, tmp_path):
    sinks.jsonl(spark.createDataFrame([("é", None)], "a string, b int"), str(tmp_path / "o"))
    assert [f.read_text() for f in (tmp_path / "o").glob("part*") if f.stat().st_size] == ['{"a":"é","b":null}\n']


def test_grid(spark):
    rows = synthetic.grid(spark).collect()
    assert len(rows) == 48
    mean = lambda p: sum(r.oracle_score for r in rows if r.profile == p) / 16
    assert [round(mean(p), 3) for p in ("good", "flattened", "fabricated")] == [0.85, 0.075, -0.275]
    assert sinks.report([("good", 0.85, 2.5), ("flattened", 0.1, 1.1), ("fabricated", -0.3, 3.0)], 48, 32).count("PASS") == 2
