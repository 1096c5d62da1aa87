"""Tokenising and other text functions, Column to Column, all built-ins.

Regular expressions use explicit Unicode classes: ``\\w`` and ``\\b`` mean different things to Java and to RE2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

LETTER = r"[\p{L}\p{N}_]"
OTHER = r"[^\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda computes what it takes from outside anew for each element."""
    return F.transform(F.array(value), body)[0]


def words_in(xs: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, xs))


def literal(text: str) -> str:
    """A pattern that matches exactly this text."""
    return "".join(f"\\{c}" if c in r"\.+*?()[]{}|^$-/&~#" else c for c in text)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, and single other characters."""
    return F.regexp_extract_all(text, F.lit(L.TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Runs of Latin letters."""
    return F.regexp_extract_all(text, F.lit(L.WORD), F.lit(0))


def lowered(text: Column) -> Column:
    """Words in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(L.WORD), F.lit(0))


def pieces(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def n_pieces(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def content_words(text: Column) -> Column:
    return F.filter(lowered(text), lambda w: ~w.isin(*L.STOPWORDS))


def cut_after(text: Column, marks: str) -> Column:
    """Splits at the white space that follows one of the marks, which stay."""
    return F.split(F.regexp_replace(text, rf"([{marks}])\s+", "$1" + L.CUT), L.CUT)


def sentences(text: Column) -> Column:
    """Parts between a mark with white space behind it; the marks go."""
    return F.split(text, r"[.;:?!]\s+")


def bare(token: Column) -> Column:
    """Without punctuation at either end."""
    return F.btrim(token, F.lit(L.EDGE))


def later_tokens(text: Column) -> Column:
    """The bare tokens of each sentence but its first."""
    each = F.transform(sentences(text), lambda s: F.transform(F.slice(pieces(s), 2, 1 << 30), bare))
    return F.flatten(each)


def years(text: Column) -> Column:
    """Numbers of four digits that stand alone."""
    return F.filter(F.regexp_extract_all(text, F.lit(rf"{LETTER}+"), F.lit(0)), lambda t: t.rlike(r"^\p{Nd}{4}$"))


def stem(word: Column) -> Column:
    """Lower case, without the first of four endings that leaves three letters or more."""
    low = F.lower(word)
    out = low
    for ending in reversed(("ing", "ed", "es", "s")):
        fits = low.endswith(ending) & (F.length(low) > len(ending) + 2)
        out = F.when(fits, F.substring(low, F.lit(1), F.length(low) - len(ending))).otherwise(out)
    return out


def ngrams(xs: Column, n: int) -> Column:
    """Distinct runs of n elements, joined by a cut mark."""
    return let(xs, lambda x: F.when(F.size(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, n), L.CUT)))).otherwise(F.array().cast("array<string>")))


def normal(surface: Column) -> Column:
    """Tokens joined by single spaces."""
    return F.array_join(tokens(surface), " ")


def without_article(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^(the|a|an)\s+", "")


def first_seen(xs: Column) -> Column:
    """Distinct elements in their order, without nulls and empty ones."""
    return F.array_distinct(F.filter(xs, lambda x: F.coalesce(x, F.lit("")) != ""))


def chunked(text: Column, size: int = 150, least: int = 20) -> Column:
    """(chunk number, words joined by spaces) of windows of ``size`` words; those under ``least`` words keep their number but are left out."""

    def cut(xs: Column) -> Column:
        n = F.size(xs)
        numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
        kept = F.filter(numbers, lambda i: F.least(n - i * size, F.lit(size)) >= least)
        return F.transform(kept, lambda i: F.struct(i.alias("chunk"), F.array_join(F.slice(xs, i * size + 1, size), " ").alias("text")))

    return let(pieces(text), cut)


def strip_hedges(claim: Column) -> Column:
    """Without hedging words, unless fewer than three words would be left."""
    longest = sorted(L.HEDGES, key=lambda w: (-len(w), w))
    cut = F.regexp_replace(claim, rf"(?iu)(^|{OTHER})(?:{'|'.join(longest)})(?={OTHER}|$)[ ,]*", "$1")
    cut = F.regexp_replace(cut, rf"(?iu)(^|{OTHER})(?:{'|'.join(longest)})(?={OTHER}|$)[ ,]*", "$1")  # two in a row share a border
    tidy = F.btrim(F.regexp_replace(cut, r"\s{2,}", " "), F.lit(" ,"))
    return F.when(n_pieces(tidy) >= 3, tidy).otherwise(claim)


def redact(text: Column, focal: Column, mark: str = "[unit]") -> Column:
    """Every part of the name of three characters or more becomes the mark, the longest first; runs of marks become one."""
    parts = F.array_sort(F.array_distinct(F.filter(F.split(focal, r"[,\s]+"), lambda p: F.length(p) > 2)), lambda a, b: F.length(b) - F.length(a))
    quoted = lambda p: F.regexp_replace(p, r"([^\p{L}\p{N}_])", r"\\$1")
    done = F.aggregate(parts, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(rf"(?iu)(?<!{LETTER})"), quoted(p), F.lit(rf"(?!{LETTER})")), F.lit(mark)))
    return F.regexp_replace(done, rf"{literal(mark)}(?:[,\s]+{literal(mark)})+", mark)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def date_attributes(value: Column) -> Column:
    """struct(when, from, to): a number, or two with a dash between them."""
    parts = F.transform(F.split(value, "[–-]"), lambda s: F.trim(s))
    number = r"^\p{Nd}+$"
    two = (F.size(parts) == 2) & F.forall(parts, lambda p: p.rlike(number))
    return F.struct(F.when(F.trim(value).rlike(number), F.trim(value)).alias("when"), F.when(two, parts[0]).alias("from"), F.when(two, F.get(parts, F.lit(1))).alias("to"))


def split_claims(text: Column, subject: Column | None = None) -> Column:
    """Sentences to clauses that can be true or false on their own.

    Sentences about the text itself, fragments that only name a source, and clauses that end in a copula are left out; a
    clause without a subject of its own gets the given one.
    """
    meta = rf"(?iu)(?:^|{OTHER})(?:{L.META})(?:{OTHER}|$)"
    source = rf"(?iu)(?:^|{OTHER})(?:{L.PROVENANCE})(?:{OTHER}|$)"
    whole = F.filter(F.transform(cut_after(F.trim(text), ".;!?"), lambda s: F.trim(s)), lambda s: (n_pieces(s) >= 4) & ~s.rlike(meta))
    raw = F.flatten(F.transform(whole, lambda s: F.transform(F.split(F.regexp_replace(s, f"(?i){L.CLAUSE}", L.CUT), L.CUT), lambda c: F.btrim(c, F.lit(" ,.;:")))))

    def told(c: Column) -> Column:
        n = n_pieces(c)
        last = F.lower(F.regexp_extract(c, r"(\S+)\s*$", 1))
        return (n >= 3) & ~(c.rlike(source) & (n <= 6)) & ~last.isin(*L.COPULAS)

    def finished(c: Column) -> Column:
        if subject is None:
            return F.concat(F.regexp_replace(c, r"[ ,.]+$", ""), F.lit("."))
        lead = F.lower(F.regexp_extract(c, r"^\s*(\S+)", 1))
        lost = ~c.rlike(r"^\p{Lu}") & ~lead.isin(*L.PRONOUNS) & (F.coalesce(subject, F.lit("")) != "")
        return F.concat(F.regexp_replace(F.when(lost, F.concat(subject, F.lit(" "), c)).otherwise(c), r"[ ,.]+$", ""), F.lit("."))

    return F.transform(F.filter(raw, told), finished)


def source_sentences(text: Column) -> Column:
    """Sentences of five words or more that aren't administrative lines."""
    cut = F.split(F.regexp_replace(F.regexp_replace(text, r"([.!?])\s+", "$1" + L.CUT), r"\n+", L.CUT), L.CUT)
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: (n_pieces(s) >= 5) & ~s.rlike(f"(?i){L.ADMIN}"))


def fold(function: Callable[[Column, Column], Column], start: Column, xs: Column) -> Column:
    return F.aggregate(xs, start, function)
