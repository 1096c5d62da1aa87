"""What a record attests, and how far a text stays within it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T

NO_CLAIMS, NO_PREMISES, NEITHER = "unscoreable:no-claims", "unscoreable:no-premises", "unscoreable:no-claims-or-premises"
SCORED, VAGUE = "scored", "vague-only"


def index_words(blob: Column) -> Column:
    return F.array_distinct(T.lowered(blob))


def index_years(blob: Column) -> Column:
    """Runs of three or four digits, also within longer ones, as a record's numbers are."""
    return F.array_distinct(F.regexp_extract_all(blob, F.lit(r"\p{Nd}{3,4}"), F.lit(0)))


def attested_years(blob: Column) -> Column:
    return F.array_distinct(T.years(blob))


def names_in(text: Column) -> Column:
    """Capitalised words after the first of a sentence, in lower case, without stopwords; repeats stay."""
    found = F.filter(T.later_tokens(text), lambda t: t.rlike("^[A-Za-zÀ-ÿ]+$") & t.rlike(r"^\p{Lu}"))
    return F.filter(F.transform(found, F.lower), lambda w: ~w.isin(*L.STOPWORDS))


def lexical_faithfulness(text: Column, known_words: Column, known_years: Column) -> Column:
    """struct(F, unsupported): names and years, each as often as it occurs, that the record has or lacks."""
    held = F.struct(names_in(text).alias("names"), T.years(text).alias("years"), known_words.alias("w"), known_years.alias("y"))

    def judged(x: Column) -> Column:
        ok = F.size(F.filter(x["names"], lambda n: F.array_contains(x["w"], n))) + F.size(F.filter(x["years"], lambda y: F.array_contains(x["y"], y)))
        total = F.size(x["names"]) + F.size(x["years"])
        return F.struct(F.when(total > 0, ok / total).otherwise(1.0).alias("F"), (total - ok).alias("unsupported"))

    return T.let(held, judged)


def invented_specific(claim: Column, known_words: Column, known_years: Column) -> Column:
    """A claim of five words or more with a name or a year that the record lacks."""
    later = F.transform(F.slice(T.pieces(claim), 2, 1 << 30), T.bare)
    named = F.exists(later, lambda t: t.rlike("^[A-Za-zÀ-ÿ]+$") & t.rlike(r"^\p{Lu}") & ~F.lower(t).isin(*L.STOPWORDS) & ~F.array_contains(known_words, F.lower(t)))
    dated = F.exists(T.years(claim), lambda y: ~F.array_contains(known_years, y))
    return (T.n_pieces(claim) >= 5) & (named | dated)


def attribute_fact(key: Column, name: Column, value: Column) -> Column:
    return F.concat(F.lit("The "), F.replace(key, F.lit("_"), F.lit(" ")), F.lit(" of "), name, F.lit(" is "), value, F.lit("."))


def event_fact(summary: Column, date: Column) -> Column:
    return F.concat(F.regexp_replace(summary, r"\.+$", ""), F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit(" in "), date)).otherwise(""), F.lit("."))


def premise_text(facts: Column, most: int = L.PREMISE_CHARS) -> Column:
    return F.substring(F.array_join(facts, " "), 1, most)


def claim_tag(entail: Column, contradict: Column, invented: Column, veto: bool = False) -> Column:
    """Verdict on a claim from its largest scores over the premises: supported, contradicted, invented or vague."""
    supported, against = entail >= L.ENTAIL, contradict >= L.CONTRADICT
    tag = F.when(supported, "supported").when(against, "contradicted").when(invented, "invented").otherwise("vague")
    return F.when(against, "contradicted").otherwise(tag) if veto else tag


def verdict(claims: Column, premises: Column, supported: Column, fabricated: Column) -> Column:
    """struct(F, unsupported, status) from the numbers of claims, premises, supported and fabricated claims."""
    none = F.when((claims == 0) & (premises == 0), NEITHER).when(claims == 0, NO_CLAIMS).when(premises == 0, NO_PREMISES)
    judged = supported + fabricated
    status = F.coalesce(none, F.when(judged > 0, SCORED).otherwise(VAGUE))
    return F.struct(F.when(none.isNull() & (judged > 0), supported / judged).otherwise(1.0).alias("F"), F.when(none.isNull(), fabricated).otherwise(0).alias("unsupported"), status.alias("status"))


def is_unscoreable(status: Column) -> Column:
    return status.startswith("unscoreable:")


def shown(f: Column, status: Column) -> Column:
    """The status in capitals where there is no score."""
    return F.when(status == SCORED, F.format_number(f, 2)).otherwise(F.upper(status))


def cache_key(*parts: Column) -> Column:
    """Content hash of texts, each followed by a zero byte."""
    return F.sha1(F.concat(*(x for p in parts for x in (p.cast("string"), F.lit("\0")))))
