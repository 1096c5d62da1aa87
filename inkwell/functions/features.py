"""The five surface features, the surface reward, and the first version of the surface score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T

def _root(n: Column) -> Column:
    return F.sqrt(F.greatest(n, F.lit(1)).cast("double"))


#: A token after white space that no sentence mark precedes, with title case or of one to four capitals, without its outer punctuation.
PROPER = r"""(?<=[^\s.;:?!])\s+[,.;:()\[\]'"]*+(?:[A-ZÀ-Þ][a-zà-ÿ]|[A-ZÀ-Þ]{1,4}[,.;:()\[\]'"]*+(?=\s|$|[?!]\s))"""


def propers(text: Column) -> Column:
    """Proper tokens after the first of a sentence; one pass of a regex, not a list of sentences of tokens."""
    return F.regexp_count(text, F.lit(PROPER))


def proper_noun_density(text: Column) -> Column:
    return propers(text) / _root(T.n_pieces(text))


def number_date_density(text: Column) -> Column:
    """Tokens with a digit: since tokens are runs, those are the runs with one."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]*\p{Nd}[\p{L}\p{N}_]*")) / _root(T.n_pieces(text))


def _rated(content: Column, ratings: dict[str, float]) -> Column:
    """Rating sums in fives of a hundredth, so that the order of addition doesn't show."""
    table = F.create_map(*(F.lit(x) for w, r in ratings.items() for x in (w, round(r * 100))))
    found = F.filter(F.transform(content, lambda w: F.try_element_at(table, w)), lambda r: r.isNotNull())
    total = F.aggregate(found, F.lit(0), lambda a, r: a + r)
    return F.when(F.size(found) > 0, total / F.size(found) / 500).otherwise(0.5)


def concreteness(text: Column, ratings: dict[str, float] | None = None) -> Column:
    """Mean rating of the rated content words as a share of five; one half where none is rated."""
    return concreteness_of(T.content_words(text), ratings)


def concreteness_of(content: Column, ratings: dict[str, float] | None = None) -> Column:
    ratings = ratings or L.CONCRETENESS
    return _rated(F.filter(content, lambda w: w.isin(*ratings)), ratings)


def lexical_density(text: Column) -> Column:
    n = F.regexp_count(text, F.lit(L.WORD))
    return F.when(n > 0, F.size(T.content_words(text)) / n).otherwise(0.0)


def calibration_of(content: Column) -> Column:
    n = F.greatest(F.size(content), F.lit(1))
    return (F.size(F.filter(content, lambda w: w.isin(*L.HEDGES))) - F.size(F.filter(content, lambda w: w.isin(*L.OVERCLAIM)))) / n


def calibration(text: Column) -> Column:
    """Hedging less overclaiming, as a share of the content words."""
    return calibration_of(T.content_words(text))


def with_features(df: DataFrame, text: str = "text", ratings: dict[str, float] | None = None) -> DataFrame:
    """Adds the five features; content words are found once for three of them."""
    names = [c for c in df.columns]
    held = df.select(*names, T.content_words(F.col(text)).alias("_content"), F.regexp_count(F.col(text), F.lit(L.WORD)).alias("_words"), T.n_pieces(F.col(text)).alias("_n"))
    return held.select(
        *names,
        (propers(F.col(text)) / _root(F.col("_n"))).alias("proper_noun_density"),
        (F.regexp_count(F.col(text), F.lit(r"[\p{L}\p{N}_]*\p{Nd}[\p{L}\p{N}_]*")) / _root(F.col("_n"))).alias("number_date_density"),
        concreteness_of(F.col("_content"), ratings).alias("concreteness"),
        F.when(F.col("_words") > 0, F.size("_content") / F.col("_words")).otherwise(0.0).alias("lexical_density"),
        calibration_of(F.col("_content")).alias("calibration"),
    )


def linguistic_reward(weights: dict[str, float] | None = None, digits: int | None = None) -> Column:
    """The weighted sum over feature columns."""
    total = sum((F.col(k) * w for k, w in list((weights or L.WEIGHTS).items())[1:]), F.col("proper_noun_density") * (weights or L.WEIGHTS)["proper_noun_density"])
    return total if digits is None else F.round(total, digits)


def quality() -> Column:
    """Mean of the four features that measure detail."""
    return (F.col("proper_noun_density") + F.col("number_date_density") + F.col("concreteness") + F.col("lexical_density")) / 4


def surface_score(text: Column) -> Column:
    """struct(density, propers, numbers): the first version, which leaves out parentheses and knows ASCII capitals only."""
    plain = F.regexp_replace(text, r"\([^)]*\)", " ")
    each = F.transform(F.split(plain, r"[.;:]\s+"), T.pieces)
    later = F.flatten(F.transform(each, lambda s: F.slice(s, 2, 1 << 30)))
    all_tokens = F.flatten(each)
    propers = F.size(F.filter(later, lambda t: F.btrim(t, F.lit(L.EDGE)).rlike("^[A-Z]")))
    numbers = F.size(F.filter(all_tokens, lambda t: t.rlike(r"\p{Nd}")))
    return F.struct(F.round((propers + numbers) / _root(F.size(all_tokens)), 3).alias("density"), propers.alias("propers"), numbers.alias("numbers"))
