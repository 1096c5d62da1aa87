"""Operator 9 [native]: mixing to target weights by soft membership.

1. A naive Bayes classifier learned from the labelled table gives each document a posterior over the domains: low
   quality, toxic, clean.  Its features are, for each domain, the binary order of magnitude of the share of a text's
   distinct words that tell the domain from the others (of all words whose share of the domain's documents is twice that
   of the others' and Z standard errors above it), so that words that come together don't count as if each came by itself,
   and tenths of the shares of symbols, of capitals and of distinct words.  It is fitted on at most ``sample`` labelled
   documents, which bounds the telling words too; counts come from grouped aggregates, and only those words reach the
   driver.
2. Rates r >= 0, one for each document, are fitted by distributed projected gradient: minimise the squared distance of the
   expected domain token totals, sum of r * tokens * posterior, from the targets.  In a pass over the (small) table of
   tokens and posteriors every rate is recomputed from the steps so far, r <- max(0, r - p . step), and one aggregate of a
   few numbers gives the residuals and so the next step.  Steps are Newton's, then projected: they are scaled by the inverse of the domains' moment matrix
   over the documents whose rate isn't zero, plus a small ridge that keeps rates near 1 where domains hardly differ; few
   are needed where no rate reaches zero.  A step that doesn't lower the error is halved.

DataFrame operations only; the driver sees numbers by domain and the vocabulary, whatever the size of the input.  The only
shuffles are of partial aggregates and of the sample.

Tokens are runs of characters other than white space and ``.,;:!?``.

Defined results: a null or empty text has no tokens, its rate follows from its posterior, and it adds nothing to any
total; labels with a null are ignored, and of repeated ones the lowest quality and highest toxicity count; without labels
every posterior is uniform; targets out of reach are met as nearly as nonnegative rates can, with a
warning that names the residuals; equal texts have equal
rates; repeated rows are repeated; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import warnings
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, set_apart, written

DOMAINS = ("low", "toxic", "clean")
#: Shares of all tokens.
TARGETS = {"low": 0.04, "toxic": 0.03, "clean": 0.93}
SYMBOLS = "#$%&*|!"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Marks a feature that isn't a word; standard errors by which a telling word's share differs.
MARK, Z = "\x01", 4.5


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    each = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return each.select("doc_id", F.when(F.col("q") <= 0, 0).when(F.col("t") > 0, 1).otherwise(2).alias("domain"))


def featured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, tokens (their number), seen (distinct words), marks (the other features), and ``more``."""
    trimmed = F.btrim(F.lower("text"), F.lit(" \t\n\x0b\f\r.,;:!?"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D.,;:!?]+"))
    out = docs.select("doc_id", "text", words.alias("words"), F.length("text").alias("n"), *more)
    out = out.select("doc_id", "words", F.array_distinct("words").alias("seen"), "n", F.length(F.translate("text", SYMBOLS, "")).alias("plain"), F.length(F.translate("text", CAPITALS, "")).alias("small"), *more)

    def tenth(name: str, part: Column, whole: Column) -> Column:
        return F.concat(F.lit(f"{MARK}{name}"), F.when(whole > 0, F.least(F.floor(part * 10 / whole), F.lit(9))).otherwise(-1).cast("string"))

    tokens = F.size("words")
    marks = F.array(
        tenth("symbols", F.ceil((F.col("n") - F.col("plain")) * 2.5), F.col("n")),  # finer below: most texts have few
        tenth("capitals", F.col("n") - F.col("small"), F.col("n")),
        tenth("distinct", F.size("seen"), F.when(tokens >= 20, F.least(tokens.cast("double"), 200 + F.pow(tokens.cast("double"), F.lit(0.75)))).otherwise(0.0)),
    )
    return out.select("doc_id", tokens.cast("long").alias("tokens"), "seen", marks.alias("marks"), *more)


def hit_marks(words: dict[str, int]) -> Column:
    """For each domain a mark that tells what share of the distinct words tells it: none, or the power of two of the thousandths.

    A word is looked up in one of many small maps; their literal table is made once, by constant folding.
    """
    size = 1 << max(0, len(words).bit_length())
    table: list[dict] = [{} for _ in range(size)]
    for w, d in sorted(words.items()):
        table[zlib.crc32(w.encode()) % size][w] = d
    found = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "array<map<string,int>>")
    told = F.transform("seen", lambda w: F.try_element_at(F.element_at(found, (F.pmod(F.crc32(w.cast("binary")), F.lit(size)) + 1).cast("int")), w))
    hits = F.filter(told, lambda d: d.isNotNull())

    def mark(found: Column, d: int) -> Column:
        n = F.size(F.filter(found, lambda x: x == d))
        return F.concat(F.lit(f"{MARK}hits{d}:"), F.when(n == 0, -1).otherwise(F.floor(F.log2(1 + 1000.0 * n / F.size("seen")))).cast("string"))

    return F.element_at(F.transform(F.array(hits), lambda x: F.array(*(mark(x, d) for d in range(len(DOMAINS))))), 1)  # hits are found once


def learn(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[float], dict[str, list[float]], dict[str, int]]:
    """Log priors, log likelihoods of each feature by domain, and the domain that each telling word tells."""
    k = len(DOMAINS)
    chosen = domains(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    told = written(featured(docs.join(F.broadcast(chosen), "doc_id"), "domain"), "mix-labelled")
    sizes = {r["domain"]: r["n"] for r in told.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(d, 0) for d in range(k)]
    total = sum(n)
    if not total:
        return [0.0] * k, {}, {}
    by_domain = [F.count(F.when(F.col("domain") == d, 1)).alias(f"c{d}") for d in range(k)]
    everywhere = sum((F.col(f"c{d}") for d in range(1, k)), F.col("c0"))
    counts = told.select("domain", F.explode("seen").alias("f")).groupBy("f").agg(*by_domain)
    tells = []
    for d in range(k):
        inside, outside = (F.col(f"c{d}") + 1) / (n[d] + 2), (everywhere - F.col(f"c{d}") + 1) / (total - n[d] + 2)
        share = (everywhere + 1) / (total + 2)
        z = (inside - outside) / F.sqrt(share * (1 - share) * (1 / max(1, n[d]) + 1 / max(1, total - n[d])))
        tells.append(F.when((inside >= 2 * outside) & (z >= Z), d))
    words = {r["f"]: r["d"] for r in counts.select("f", F.coalesce(*tells).alias("d")).where("d IS NOT NULL").collect()}
    marked = told.select("domain", F.explode(F.concat("marks", hit_marks(words))).alias("f")).groupBy("f").agg(*by_domain)
    weights = {r["f"]: [math.log((r[f"c{d}"] + 0.5) / (n[d] + 1)) for d in range(k)] for r in marked.collect()}
    return [math.log((x + 1) / (total + k)) for x in n], weights, words


def posteriors(docs: DataFrame, labels: DataFrame, sample: int = 10_000, corpus: DataFrame | None = None) -> DataFrame:
    """doc_id, tokens, and p_<domain> for each domain, as learned from the labelled documents of ``corpus`` (else of ``docs``)."""
    base, weights, words = learn(docs if corpus is None else id_text(corpus), labels, sample)
    found = featured(docs).select("doc_id", "tokens", F.concat("marks", hit_marks(words)).alias("features"))

    def log_odds(d: int) -> Column:
        if not weights:
            return F.lit(base[d])
        table = F.create_map(*(F.lit(x) for f, w in weights.items() for x in (f, w[d])))
        return F.aggregate("features", F.lit(base[d]), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))

    found = found.select("doc_id", "tokens", *(log_odds(d).alias(f"l{d}") for d in range(len(DOMAINS))))
    top = F.greatest(*(F.col(f"l{d}") for d in range(len(DOMAINS))))
    found = found.select("doc_id", "tokens", *(F.exp(F.col(f"l{d}") - top).alias(f"e{d}") for d in range(len(DOMAINS))))
    whole = F.col("e0") + F.col("e1") + F.col("e2")
    return found.select("doc_id", "tokens", *((F.col(f"e{d}") / whole).alias(f"p_{name}") for d, name in enumerate(DOMAINS)))


def fitted(table: DataFrame, targets: dict[str, float], relative: bool = False, least: Column | None = None, rounds: int = 30, close: float = 1e-3, ridge: float = 1e-3) -> tuple[Column, list[np.ndarray]]:
    """The rate as a column over ``table`` (tokens, p_<domain>), and the residuals of each round as shares of all tokens.

    ``targets``: shares of all tokens, or, ``relative``, multiples of each domain's own expected tokens.  ``least`` is the
    bound that each rate is projected to, else zero; targets that it puts out of reach are met as nearly as it allows.  The fit ends
    where each domain's residual is at most ``close`` of its own target; where it ends otherwise, a warning names what is left.
    """
    p = [F.col(f"p_{name}") for name in DOMAINS]
    k = len(p)
    tokens = F.col("tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def passed(rate: Column) -> tuple[float, np.ndarray, np.ndarray]:
        """All tokens, the domains' expected totals, and the moments of the documents whose rate isn't zero, as shares."""
        some = F.when(rate > 0, tokens).otherwise(0.0)
        at = table.agg(F.sum(tokens).alias("n"), *(F.sum(rate * tokens * x).alias(f"t{i}") for i, x in enumerate(p)), *(F.sum(some * p[i] * p[j]).alias(f"m{i}{j}") for i, j in pairs)).head()
        n = at["n"] or 0.0
        moments = np.array([[at[f"m{min(i, j)}{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return n, np.array([at[f"t{i}"] or 0.0 for i in range(k)]) / max(n, 1.0), moments / max(n, 1.0)

    rate = F.lit(1.0)
    total, now, moments = passed(rate)
    if not total:
        return rate, []
    wanted = np.array([targets[name] for name in DOMAINS])
    goal = wanted * now if relative else wanted / wanted.sum()
    history, size = [now - goal], 1.0
    for _ in range(rounds):
        if (np.abs(history[-1]) <= close * goal).all() or size < 1 / 64:
            break
        step = size * np.linalg.solve(moments + ridge * np.eye(k), history[-1])
        tried = F.greatest(F.lit(0.0) if least is None else least, rate - sum((x * float(v) for x, v in zip(p[1:], step[1:], strict=True)), p[0] * float(step[0])))
        _, now, active = passed(tried)
        if np.linalg.norm(now - goal) < np.linalg.norm(history[-1]):
            rate, moments, size = tried, active, min(1.0, 2 * size)
            history.append(now - goal)
        else:
            size /= 2
    unmet = {name: f"{r:+.2g} of {g:.2g}" for name, r, g in zip(DOMAINS, history[-1], goal, strict=True) if abs(r) > close * g}
    if unmet:
        warnings.warn(f"rates leave these shares of all tokens above or below their targets: {unmet}", stacklevel=2)
    return rate, history


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, relative: bool = False, sample: int = 10_000) -> DataFrame:
    """doc_id, tokens, p_low, p_toxic, p_clean, rate, expected_tokens."""
    table = written(posteriors(id_text(docs), labels, sample), "mix-posteriors")
    rate, _ = fitted(table, targets or TARGETS, relative)
    return table.select("doc_id", "tokens", *(f"p_{name}" for name in DOMAINS), rate.alias("rate")).withColumn("expected_tokens", F.col("rate") * F.col("tokens"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], relative: bool = True, sample: int = 10_000, corpus: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: its whole part, and once more with its fraction as probability.

    Documents that are clean more likely than not are bound to rates of 1 or more, so none of them goes.
    The chance is the hashed doc_id's, so it is the same in every run; rows of one doc_id get the same number of copies.
    Only rows that don't stay as they are, and few others, are shuffled with their texts.
    """
    table = written(posteriors(id_text(docs), labels, sample, corpus), "mix-posteriors")
    rate, _ = fitted(table, targets, relative, F.when(F.col("p_clean") >= 0.5, 1.0).otherwise(0.0))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = table.select("doc_id", F.floor(rate + chance).cast("int").alias("copies")).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies"))
    copies = written(copies.where("copies <> 1"), "mix-copies")
    untouched, rest = set_apart(docs, copies.select(F.col("id").alias("doc_id")))
    again = rest.join(copies, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("row", F.coalesce("copies", F.lit(1)).alias("copies"))
    again = again.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("one"))
    return untouched.unionByName(again.select("row.*"))
