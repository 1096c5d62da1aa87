from pyspark.sql import functions as F

from inkwell.functions import features as X
from inkwell.functions import grounding as G
from inkwell.functions import guards, parsing
from inkwell.functions import rewards as R
from inkwell.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1).alias("x")]).select(column.alias("r")).head()["r"]


def test_tokens_keep_accents(spark):
    assert one(spark, T.tokens(F.col("t")), t="Café №7, _x") == ["Café", "№", "7", ",", "_x"]
    assert one(spark, T.pieces(F.col("t")), t="  a \n b ") == ["a", "b"]


def test_ngrams_of_few_words(spark):
    assert one(spark, T.ngrams(T.pieces(F.col("t")), 5), t="a b c d") == []
    assert len(one(spark, T.ngrams(T.pieces(F.col("t")), 2), t="a b a b")) == 2


def test_chunks_keep_their_numbers(spark):
    text = " ".join(f"w{k}" for k in range(310))
    got = one(spark, T.chunked(F.col("t")), t=text)
    assert [(c["chunk"], len(c["text"].split())) for c in got] == [(0, 150), (1, 150)]
    assert one(spark, T.chunked(F.col("t")), t="") == []


def test_stem(spark):
    assert [one(spark, T.stem(F.lit(w))) for w in ("Burning", "shot", "red", "boxes", "bus", "dragged")] == ["burn", "shot", "red", "box", "bus", "dragg"]


def test_strip_hedges(spark):
    assert one(spark, T.strip_hedges(F.lit("He was probably, perhaps removed in 1940"))) == "He was removed in 1940"
    assert one(spark, T.strip_hedges(F.lit("perhaps he did"))) == "perhaps he did"


def test_redact(spark):
    assert one(spark, T.redact(F.lit("Marta Hellinger and MARTA, of Hellingers"), F.lit("Marta Hellinger"))) == "[unit] and [unit], of Hellingers"
    assert one(spark, T.redact(F.lit("Café. (Anna) K"), F.lit("Anna, Café"))) == "[unit]. ([unit]) K"


def test_claims(spark):
    got = one(spark, T.split_claims(F.lit("This account reflects what we know. Marta worked at the mill, which closed in 1938. The registry records."), F.lit("Marta")))
    assert got == ["Marta worked at the mill.", "Marta closed in 1938."]


def test_dates(spark):
    assert one(spark, T.date_attributes(F.lit("1938–1939"))).asDict() == {"when": None, "from": "1938", "to": "1939"}
    assert one(spark, T.date_attributes(F.lit(" 1938 ")))["when"] == "1938"


def test_features_of_empty_text(spark):
    row = X.with_features(spark.createDataFrame([("",)], "text string")).head()
    assert (row.proper_noun_density, row.number_date_density, row.concreteness, row.lexical_density, row.calibration) == (0, 0, 0.5, 0, 0)


def test_faithfulness_counts_repeats(spark):
    f = G.lexical_faithfulness(F.lit("In Vienna and Vienna and Graz 1938, 1938, 1940."), F.array(F.lit("vienna")), F.array(F.lit("1938")))
    got = one(spark, f)
    assert got["unsupported"] == 2 and abs(got["F"] - 4 / 6) < 1e-12
    assert one(spark, G.lexical_faithfulness(F.lit("nothing here"), F.array(F.lit("a")), F.array(F.lit("1")))).asDict() == {"F": 1.0, "unsupported": 0}


def test_verdicts(spark):
    v = lambda *x: one(spark, G.verdict(*map(F.lit, x)))
    assert v(0, 0, 0, 0)["status"] == G.NEITHER and v(0, 1, 0, 0)["status"] == G.NO_CLAIMS and v(1, 0, 0, 0)["status"] == G.NO_PREMISES
    assert v(2, 1, 0, 0).asDict() == {"F": 1.0, "unsupported": 0, "status": G.VAGUE}
    assert v(3, 1, 1, 2)["F"] == 1 / 3


def test_claim_tags(spark):
    tag = lambda e, c, i, veto=False: one(spark, G.claim_tag(F.lit(e), F.lit(c), F.lit(i), veto))
    assert [tag(0.5, 0.9, False), tag(0.5, 0.9, False, True), tag(0.1, 0.5, False), tag(0.1, 0.1, True), tag(0.1, 0.1, False)] == ["supported", "contradicted", "contradicted", "invented", "vague"]


def test_guards(spark):
    assert one(spark, guards.format_hits(F.lit("Focal: x\n- a\n- b"))) == 3 + 0.5
    assert one(spark, guards.copy_overlap(F.lit("a b c d e f"), F.lit("x a b c d e"))) == 0.5
    assert one(spark, guards.length_penalty(F.lit(" ".join(["w"] * 180)))) == -1


def test_sensational_words_that_the_source_has(spark):
    assert one(spark, R.sensationalism(F.lit("the house burned"), F.lit("it was burning"))) == 0
    assert one(spark, R.sensationalism(F.lit("the house burned"), F.lit(None).cast("string"))) > 0


def test_source_words_also_inside_words(spark):
    assert one(spark, R.names_source(F.lit("a person")))


def test_judge_scores(spark):
    answers = {'```json\n{"score": 8}\n```': 8.0, "thinking {x} then {\"score\": 3} {\"y\": 1}": 3.0, "score: 7.5 of ten": 7.5, "": 0.0, "{broken": 0.0}
    assert {a: one(spark, parsing.judge_score(F.lit(a))) for a in answers} == answers
    assert one(spark, parsing.judge_score(F.lit(None).cast("string"))) == 0


def test_extraction(spark):
    got = one(spark, parsing.extraction(F.lit('so: {"entities": [{"entity_text": "Anna"}, {"entity_text": ""}], "relationships": [{"head_entity_text": "a"}]} end')))
    assert [e.asDict() for e in got["entities"]] == [{"entity_text": "Anna", "entity_type": "MISCELLANEOUS"}] and got["relationships"] == []
    assert one(spark, parsing.extraction(F.lit("no json"))).asDict() == {"entities": [], "relationships": []}


def test_prompts_keep_braces_of_the_record(spark):
    assert "{unit} [x]" in one(spark, parsing.prompt(F.lit("Anna"), F.lit(None).cast("string"), F.lit("{unit} [x]")))


def test_record_block(spark):
    e = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in (("Anna", "PERSON"), ("Graz", "PLACE"), ("Anna", "PERSON"), ("", "PLACE"))))
    got = one(spark, parsing.record_block(F.lit("Anna"), F.lit("A letter"), F.lit(""), e, None, F.array(F.lit("x"), F.lit("x"))))
    assert got == "Unit: Anna\nTitle: A letter\nPerson: Anna\nPlace: Graz\nSubjects: x"


def test_proper_nouns_by_definition(spark):
    """The regex against sentences, tokens and bare tokens, on random strings of what matters to either."""
    import random

    r = random.Random(4)
    rows = [("".join(r.choice("  ..;:?!,()'\"[]AÀBcé\n1") for _ in range(r.randint(0, 40))),) for _ in range(3000)]
    rows += [("".join(r.choice(("Anna ", "NATO ", "NATOX ", "a ", "B. ", "(Graz) ", "x.Y ", "\n", "'AB', ", "É")) for _ in range(r.randint(0, 12))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "t string").select("t", X.propers(F.col("t")).alias("a"), F.size(F.filter(T.later_tokens(F.col("t")), lambda x: x.rlike(r"^[A-ZÀ-Þ][a-zà-ÿ]|^[A-ZÀ-Þ]{1,4}$"))).alias("b"))
    assert [tuple(x) for x in df.where("a <> b").take(3)] == []
