"""Operator 3: URL filters.

Host and path rules come first: a rule fits its host and all subdomains where the url's path starts with the rule's; the
longest rule that fits gives the verdict.  Other urls go to a weighted vocabulary: an Aho-Corasick automaton finds every
term in one pass, a hit counts only between characters that are neither letters nor digits, and a url is blocked where
the weights of its distinct terms reach the limit: one strict term does, a soft term alone does not.

Map-only; rules and vocabulary are parameters, so what each task gets has a size that the caller sets.

Defined results: a url that is null or has no ``://`` has empty host and path, so no rule fits; its text still goes to
the vocabulary (null: allow).  Repeated rows give repeated results; other columns, the html among them, aren't read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: One of these is enough.
STRICT = (
    "adult", "bestiality", "camgirl", "camgirls", "casino", "casinos", "escort", "escorts", "hentai", "malware", "milf", "nude", "nudes", "phishing", "porn", "porno", "pornography",
    "ransomware", "sexcam", "spyware", "swingers", "viagra", "warez", "xxx",
)
#: Of these it takes several distinct ones.
SOFT = (
    "ads", "affiliate", "banner", "bet", "bets", "betting", "bonus", "cheap", "clearance", "click", "clickbait", "coupon", "coupons", "crack", "cracked", "dating", "deals", "diet", "discount",
    "doubleclick", "farm", "free", "gambling", "giveaway", "hack", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "nulled", "payday", "pills", "poker", "popup", "prize", "promo", "replica",
    "serial", "sex", "sexy", "slots", "spam", "sponsored", "sweepstakes", "torrent", "torrents", "track", "tracker", "tracking", "weightloss", "win", "winner",
)
#: One strict term reaches LIMIT, and so do two distinct soft ones.
LIMIT = 2
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


class Rules:
    """Looks the rules up by host suffix, so a url costs as many probes as its host has labels."""

    def __init__(self, rules) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((f"/{path}", rule, verdict))

    def __call__(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while host and path and at >= 0:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


class Vocabulary:
    def __init__(self, strict, soft, limit: int) -> None:
        import ahocorasick

        self.strict, self.automaton = frozenset(strict), ahocorasick.Automaton()
        for term, weight in [*((x, 1) for x in soft), *((x, limit) for x in strict)]:
            self.automaton.add_word(term, (term, weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, url: str) -> tuple[int, int, int]:
        """Distinct strict terms, distinct soft terms, and the sum of their weights."""
        low, hits = url.translate(LOWER), {}
        for end, (term, weight) in self.automaton.iter(low) if len(self.automaton) and low else ():
            start = end + 1 - len(term)
            if (start == 0 or low[start - 1] not in INNER) and (end + 1 == len(low) or low[end + 1] not in INNER):
                hits[term] = weight
        strict = sum(x in self.strict for x in hits)
        return strict, len(hits) - strict, sum(hits.values())


def url_filter(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits."""
    schema = "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long"
    made: list = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.extend((Rules(rules), Vocabulary(strict, soft, limit)))
        fit, vocabulary = made
        rows = []
        for url in batch.column(1).to_pylist():
            host, path = parts(url)
            rule = fit(host, path)
            n_strict, n_soft, weight = vocabulary(url or "")
            rows.append((host, path, rule and rule[0], rule[1] if rule else "block" if weight >= limit else "allow", n_strict, n_soft))
        names = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits"]
        types = [pa.string()] * 4 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], ["page_id", *names])

    return by_batch(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), work, schema)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_sql() -> str:
    """The same in DuckDB's SQL: a rule is a test of its own, the longest fitting one is the first in the CASE."""
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = {r: f"((host = {_literal(r.partition('/')[0])} OR ends_with(host, {_literal('.' + r.partition('/')[0])})) AND starts_with(path, {_literal('/' + r.partition('/')[2])}))" for r, _ in RULES}
    order = sorted(RULES, key=lambda x: -len(x[0]))
    hits = lambda terms: " + ".join(f"CAST(regexp_matches({low}, {_literal(f'(^|[^a-z0-9]){t}([^a-z0-9]|$)')}) AS BIGINT)" for t in terms)
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN {_literal(r)}" for r, _ in order) + " END"
    ruled = "CASE rule " + " ".join(f"WHEN {_literal(r)} THEN {_literal(v)}" for r, v in order) + " END"
    return f"""
WITH rest AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT page_id, host, path, {rule} AS rule, {hits(STRICT)} AS strict_hits, {hits(SOFT)} AS soft_hits FROM cut)
SELECT page_id, host, path, rule, coalesce({ruled}, CASE WHEN {LIMIT} * strict_hits + soft_hits >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits FROM hit"""
