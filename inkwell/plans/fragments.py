"""DuckDB fragments for the oracle, written from the definitions, not from the Spark expressions."""

from __future__ import annotations

from ..functions import lexicons as L


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def pieces(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '\s+'), lambda x: x <> '')"


def n_pieces(t: str) -> str:
    return rf"len(regexp_extract_all({t}, '\S+'))"


def lowered(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '{L.WORD}')"


def content(t: str) -> str:
    return f"list_filter({lowered(t)}, lambda w: NOT list_contains({listed(L.STOPWORDS)}, w))"


def later(t: str) -> str:
    """Bare tokens of each sentence but its first."""
    each = rf"list_transform(string_split_regex({t}, '[.;:?!]\s+'), lambda s: {pieces('s')})"
    return f"list_transform(flatten(list_transform({each}, lambda p: p[2:])), lambda x: trim(x, {q(L.EDGE)}))"


def years(t: str) -> str:
    return rf"list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda y: regexp_full_match(y, '\p{{Nd}}{{4}}'))"


def feature_columns(t: str) -> str:
    root = f"sqrt(greatest({n_pieces(t)}, 1))"
    words = f"regexp_extract_all({t}, '{L.WORD}')"
    norms = "MAP {" + ", ".join(f"{q(w)}: {round(r * 100)}" for w, r in L.CONCRETENESS.items()) + "}"
    rated = f"list_filter(list_transform({content(t)}, lambda w: {norms}[w]), lambda r: r IS NOT NULL)"
    share = lambda xs: f"len(list_filter({content(t)}, lambda w: list_contains({listed(xs)}, w)))"
    return rf"""
  len(list_filter({later(t)}, lambda x: regexp_matches(x, '^[A-ZÀ-Þ][a-zà-ÿ]') OR regexp_matches(x, '^[A-ZÀ-Þ]{{1,4}}$'))) / {root} AS proper_noun_density,
  len(list_filter(regexp_extract_all({t}, '{L.TOKEN}'), lambda x: regexp_matches(x, '\p{{Nd}}'))) / {root} AS number_date_density,
  CASE WHEN len({rated}) > 0 THEN list_sum({rated})::DOUBLE / len({rated}) / 500 ELSE 0.5::DOUBLE END AS concreteness,
  CASE WHEN len({words}) > 0 THEN len({content(t)}) / len({words}) ELSE 0.0::DOUBLE END AS lexical_density,
  ({share(L.HEDGES)} - {share(L.OVERCLAIM)}) / greatest(len({content(t)}), 1) AS calibration"""


def rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}::DOUBLE, {digits}) AS {c}" for c in columns)


FEATURES = tuple(L.WEIGHTS)
REWARD = " + ".join(f"{w}::DOUBLE * {c}" for c, w in L.WEIGHTS.items())


def grams(t: str, n: int = L.COPY_N) -> str:
    """The words are held once in a list of one, as a lambda would compute them anew for each element."""
    return f"list_transform([{pieces(f'lower({t})')}], lambda p: list_distinct(list_transform(range(1, len(p) - {n - 2}), lambda i: array_to_string(p[i:i + {n - 1}], chr(31)))))[1]"


def format_hits(t: str) -> str:
    marks = "|".join(L.SCAFFOLD)
    return f"len(regexp_extract_all({t}, '(?im){marks}')) + 0.5::DOUBLE * greatest(0, len({t}) - len(replace({t}, chr(10), '')) - 1)"


def stem(w: str) -> str:
    low = f"lower({w})"
    cases = " ".join(f"WHEN ends_with({low}, '{e}') AND len({low}) > {len(e) + 2} THEN {low}[:-{len(e) + 1}]" for e in ("ing", "ed", "es", "s"))
    return f"CASE {cases} ELSE {low} END"


def sensationalism(t: str, source: str | None = None) -> str:
    hits = f"list_filter({lowered(t)}, lambda w: list_contains({listed(L.SENSATIONAL)}, w))"
    if source:
        known = f"list_transform(regexp_extract_all(coalesce({source}, ''), '{L.WORD}'), lambda s: {stem('s')})"
        hits = f"list_filter({hits}, lambda w: NOT list_contains({known}, {stem('w')}))"
    return f"len({hits}) / sqrt(greatest(len({lowered(t)}), 1))"


def names_in(t: str) -> str:
    found = rf"list_filter({later(t)}, lambda x: regexp_full_match(x, '[A-Za-zÀ-ÿ]+') AND regexp_matches(x, '^\p{{Lu}}'))"
    return f"list_filter(list_transform({found}, lambda x: lower(x)), lambda x: NOT list_contains({listed(L.STOPWORDS)}, x))"


OTHER = r"[^\p{L}\p{N}_]"


def claims(t: str, subject: str | None = None) -> str:
    cut = rf"list_transform(string_split(regexp_replace(trim({t}, ' ' || chr(9) || chr(10) || chr(13)), '([.;!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s))"
    whole = f"list_filter({cut}, lambda s: {n_pieces('s')} >= 4 AND NOT regexp_matches(s, '(?i)(?:^|{OTHER})(?:{L.META})(?:{OTHER}|$)'))"
    raw = f"flatten(list_transform({whole}, lambda s: list_transform(string_split(regexp_replace(s, '(?i){L.CLAUSE}', chr(31), 'g'), chr(31)), lambda c: trim(c, ' ,.;:'))))"
    told = rf"list_filter({raw}, lambda c: {n_pieces('c')} >= 3 AND NOT (regexp_matches(c, '(?i)(?:^|{OTHER})(?:{L.PROVENANCE})(?:{OTHER}|$)') AND {n_pieces('c')} <= 6) AND NOT list_contains({listed(L.COPULAS)}, lower(regexp_extract(c, '(\S+)\s*$', 1))))"
    if subject:
        lost = rf"NOT regexp_matches(c, '^\p{{Lu}}') AND NOT list_contains({listed(L.PRONOUNS)}, lower(regexp_extract(c, '^\s*(\S+)', 1)))"
        return f"list_transform({told}, lambda c: regexp_replace(CASE WHEN {lost} THEN {subject} || ' ' || c ELSE c END, '[ ,.]+$', '') || '.')"
    return f"list_transform({told}, lambda c: regexp_replace(c, '[ ,.]+$', '') || '.')"


def strip_hedges(t: str) -> str:
    longest = "|".join(sorted(L.HEDGES, key=lambda w: (-len(w), w)))
    # RE2 has no lookahead: the border behind a word is kept unless it is a space or comma, which go anyway.
    once = lambda x: f"regexp_replace({x}, '(?i)(^|{OTHER})(?:{longest})(?:[ ,]+|$|([^\\p{{L}}\\p{{N}}_ ,]))', '\\1\\2', 'g')"
    tidy = rf"trim(regexp_replace({once(once(t))}, '\s{{2,}}', ' ', 'g'), ' ,')"
    return f"CASE WHEN {n_pieces(tidy)} >= 3 THEN {tidy} ELSE {t} END"


def source_sentences(t: str) -> str:
    cut = rf"list_transform(string_split(regexp_replace(regexp_replace({t}, '([.!?])\s+', '\1' || chr(31), 'g'), '\n+', chr(31), 'g'), chr(31)), lambda s: trim(s))"
    return f"list_filter({cut}, lambda s: {n_pieces('s')} >= 5 AND NOT regexp_matches(s, '(?i){L.ADMIN}'))"


def average_rank(by: str, value: str) -> str:
    part = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return f"(rank() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {value}) + (count(*) OVER ({part}) - 1) / 2.0)::DOUBLE"


def corr(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 2 AND min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END"


def cut(t: str) -> str:
    """Sentences, cut after their mark, trimmed."""
    return rf"list_transform(string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s))"
