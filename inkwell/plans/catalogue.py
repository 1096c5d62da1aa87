"""Queries of the library over the driver's tables, each with its oracle in DuckDB's SQL where SQL can express it.

A few invented texts (PROBES) stand beside ``documents``, because those have no hedges and no drama: both engines read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import grounding as G
from ..functions import guards, parsing
from ..functions import lexicons as L
from ..functions import rewards as R
from ..functions import text as T
from ..operators import agreement, cache, datasets, flows, retrieval, scoring, selection, spans, vector_index
from ..sources import files, readers, sinks, synthetic
from ..streaming import best_of_n
from . import fragments as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PROBES = (
    (-1, "Ruth Keller probably worked at the Westmark mill in 1938. She may have left, according to the registry.", "Ruth Keller worked at the Westmark mill."),
    (-2, "It was certainly burned by a mob at dawn; nobody was shot. Everyone always knew.", "The house burned in 1938."),
    (-3, "Focal: a hat\n- one line\n* two lines\nSources: S1\nsee src s12 and [1938, attested]", "a hat"),
    (-4, "The workshop on Brünnergasse, which Josef ran, closed in 1939 and the family left. This account reflects the record.", "Josef ran the workshop on Brünnergasse. It closed in 1939."),
    (-5, "", ""),
    (-6, "Perhaps, perhaps. Likely so.", "x"),
    (-7, "He was seized in Vienna, perhaps in 1942, and deported to the east (registry, 118). Café owner Anna K. was there; she is uncertain.", "Anna K. was seized in Vienna."),
)
SUBJECT = "Ruth Keller"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table of a few files out over all cores, as a file's single row group can't be split; large tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROBES), "doc_id long, text string, source_text string")


PROBE_SQL = "(VALUES " + ", ".join(f"({i}::BIGINT, {D.q(t)}, {D.q(s)})" for i, t, s in PROBES) + ") probes(doc_id, text, source_text)"
TEXTS_SQL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {PROBE_SQL})"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").unionByName(probes(spark).select("doc_id", "text"))


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# ---- Surface features ------------------------------------------------------------------------------------------------


@query("ling_features", f"SELECT doc_id, {D.rounded(D.FEATURES)} FROM (SELECT doc_id, {D.feature_columns('text')} FROM {TEXTS_SQL})")
def ling_features(spark, sf_dir):
    return rounded(X.with_features(texts(spark, sf_dir)).drop("text"), D.FEATURES)


@query(
    "ling_reward_by_lang",
    f"""SELECT lang, quality, count(*) AS docs, round(avg({D.REWARD}), 4) AS reward
    FROM (SELECT lang, quality, {D.feature_columns('text')} FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""",
)
def ling_reward_by_lang(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "lang", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    scored = X.with_features(docs).withColumn("reward", X.linguistic_reward())
    return scored.groupBy("lang", "quality").agg(F.count("*").alias("docs"), F.round(F.avg("reward"), 4).alias("reward"))


_ASCII = r"list_transform(string_split_regex(regexp_replace(text, '\([^)]*\)', ' ', 'g'), '[.;:]\s+'), lambda s: " + D.pieces("s") + ")"


@query(
    "surface_score_v1",
    rf"""SELECT doc_id, len(list_filter(flatten(list_transform(p, lambda s: s[2:])), lambda x: regexp_matches(trim(x, {D.q(L.EDGE)}), '^[A-Z]'))) AS propers,
    len(list_filter(flatten(p), lambda x: regexp_matches(x, '\p{{Nd}}'))) AS numbers, round((propers + numbers) / sqrt(greatest(len(flatten(p)), 1)), 3) AS density
    FROM (SELECT doc_id, {_ASCII} AS p FROM {TEXTS_SQL})""",
)
def surface_score_v1(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", X.surface_score(F.col("text")).alias("s")).select("doc_id", F.col("s.propers").cast("long").alias("propers"), F.col("s.numbers").cast("long").alias("numbers"), "s.density")


@query(
    "hedge_overclaim_counts",
    f"""SELECT doc_id, len(list_filter(c, lambda w: list_contains({D.listed(L.HEDGES)}, w))) AS hedges, len(list_filter(c, lambda w: list_contains({D.listed(L.OVERCLAIM)}, w))) AS overclaims, len(c) AS content_words
    FROM (SELECT doc_id, {D.content('text')} AS c FROM {TEXTS_SQL})""",
)
def hedge_overclaim_counts(spark, sf_dir):
    c = texts(spark, sf_dir).select("doc_id", T.content_words(F.col("text")).alias("c"))
    count = lambda xs: F.size(F.filter("c", lambda w: w.isin(*xs))).cast("long")
    return c.select("doc_id", count(L.HEDGES).alias("hedges"), count(L.OVERCLAIM).alias("overclaims"), F.size("c").cast("long").alias("content_words"))


@query(
    "feature_separation_by_quality",
    f"""WITH f AS (SELECT CASE WHEN toxic = 1 THEN 'false' WHEN quality = 1 THEN 'good' ELSE 'flat' END AS g, {D.feature_columns('text')} FROM documents JOIN labels USING (doc_id)),
    l AS (UNPIVOT f ON {', '.join(D.FEATURES)} INTO NAME feature VALUE v),
    m AS (SELECT feature, avg(v) FILTER (g = 'good') AS good, avg(v) FILTER (g = 'flat') AS flat, avg(v) FILTER (g = 'false') AS false_ FROM l GROUP BY feature)
    SELECT feature, round(good, 5) AS good, round(flat, 5) AS flat, round(false_, 5) AS "false", good > flat + 0.02::DOUBLE AS separates, abs(good - false_) / (abs(good) + 1e-9::DOUBLE) < 0.15::DOUBLE AS blind FROM m""",
)
def feature_separation_by_quality(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    group = F.when(F.col("toxic") == 1, "false").when(F.col("quality") == 1, "good").otherwise("flat")
    return rounded(agreement.separation(X.with_features(docs.select(group.alias("g"), "text")).drop("text"), "g", "good", "flat", "false", list(D.FEATURES)), ("good", "flat", "false"), 5)


# ---- Guards ----------------------------------------------------------------------------------------------------------


@query(
    "format_length_guards",
    f"""SELECT doc_id, {D.format_hits('text')} AS format_hits, round(0::DOUBLE - greatest(0::DOUBLE, ({D.n_pieces('text')} - {L.TARGET_WORDS}) / {L.TARGET_WORDS}.0::DOUBLE), 6) AS length_penalty FROM {TEXTS_SQL}""",
)
def format_length_guards(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", guards.format_hits(F.col("text")).cast("double").alias("format_hits"), F.round(guards.length_penalty(F.col("text")), 6).alias("length_penalty"))


@query(
    "copy_overlap_benchmark",
    f"""WITH d AS (SELECT doc_id, unnest({D.grams('text')}) AS g FROM documents), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
    b AS (SELECT item_id, unnest({D.grams('text')}) AS g FROM benchmark)
    SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(n)::DOUBLE, 6) AS overlap, count(*) / any_value(n)::DOUBLE > {L.COPY_TOLERANCE}::DOUBLE AS exceeds
    FROM d JOIN b USING (g) JOIN n USING (doc_id) GROUP BY ALL""",
)
def copy_overlap_benchmark(spark, sf_dir):
    """The benchmark's n-grams are few; a size-checked join decides whether they go to every task or both sides are dealt out.

    explode_outer, as for explode the optimiser adds a filter that makes the n-grams twice; the join drops the empty ones.
    """
    own = documents(spark, sf_dir, "doc_id", "text").select("doc_id", guards.grams(F.col("text")).alias("gs")).select("doc_id", F.size("gs").alias("n"), F.explode_outer("gs").alias("g"))
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.explode(guards.grams(F.col("text"))).alias("g"))
    met = own.join(bench, "g").groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("shared"))
    overlap = F.col("shared") / F.col("n")
    return met.select("doc_id", "item_id", "shared", F.round(overlap, 6).alias("overlap"), guards.copies_too_much(overlap).alias("exceeds"))


@query("guard_filter_probes", f"""SELECT doc_id, why <> '' AS filtered, why FROM (SELECT doc_id, concat_ws('; ', CASE WHEN {D.format_hits('text')} > 0 THEN 'format' END,
    CASE WHEN len({D.grams('text')}) > 0 AND len(list_intersect({D.grams('text')}, {D.grams('source_text')})) / len({D.grams('text')}) > {L.COPY_TOLERANCE}::DOUBLE THEN 'copy' END) AS why FROM {PROBE_SQL})""")
def guard_filter_probes(spark, sf_dir):
    p = probes(spark)
    out, why = guards.filtered(guards.format_hits(F.col("text")), guards.copy_overlap(F.col("text"), F.col("source_text")))
    return p.select("doc_id", out.alias("filtered"), why.alias("why"))


# ---- Conversations: an assistant's turn is the text, the last user turn before it the record -------------------------

TURNS_SQL = """(SELECT conv_id, turn, text, source_text FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text,
    last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source_text FROM conversations)
    WHERE role = 'assistant' AND source_text IS NOT NULL UNION ALL SELECT doc_id, 0, text, source_text FROM """ + PROBE_SQL + ")"


def turns(spark, sf_dir):
    """Windows are per conversation, which is short."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf_dir, "conversations").withColumn("source_text", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))
    c = c.where("role = 'assistant' AND source_text IS NOT NULL").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), "source_text")
    return c.unionByName(probes(spark).select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text", "source_text"))


@query("sensationalism_exempt", f"SELECT conv_id, turn, round({D.sensationalism('text')}, 6) AS plain, round({D.sensationalism('text', 'source_text')}, 6) AS exempt FROM {TURNS_SQL}")
def sensationalism_exempt(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(R.sensationalism(F.col("text")), 6).alias("plain"), F.round(R.sensationalism(F.col("text"), F.col("source_text")), 6).alias("exempt"))


_FAITH = rf"""SELECT *, len(nm) + len(yr) AS total, len(list_filter(nm, lambda w: list_contains({D.lowered('source_text')}, w))) + len(list_filter(yr, lambda y: list_contains(regexp_extract_all(source_text, '\p{{Nd}}{{3,4}}'), y))) AS ok
    FROM (SELECT *, {D.names_in('text')} AS nm, {D.years('text')} AS yr FROM {TURNS_SQL})"""


def _faithful(df: DataFrame) -> DataFrame:
    known, when = G.index_words(F.col("source_text")), G.index_years(F.col("source_text"))
    held = df.withColumn("_w", known).withColumn("_y", when)
    return held.withColumn("_f", G.lexical_faithfulness(F.col("text"), F.col("_w"), F.col("_y"))).withColumn("F", F.col("_f.F")).withColumn("unsupported", F.col("_f.unsupported")).drop("_f", "_w", "_y")


@query("lexical_faithfulness_turns", f"SELECT conv_id, turn, round(CASE WHEN total > 0 THEN ok / total ELSE 1.0::DOUBLE END, 6) AS F, (total - ok)::INT AS unsupported FROM ({_FAITH})")
def lexical_faithfulness_turns(spark, sf_dir):
    return _faithful(turns(spark, sf_dir)).select("conv_id", "turn", F.round("F", 6).alias("F"), F.col("unsupported").cast("int").alias("unsupported"))


@query(
    "composite_reward_turns",
    f"""SELECT conv_id, turn, round(pow(f, 2) * ((proper_noun_density + number_date_density + concreteness + lexical_density) / 4 + 0.3::DOUBLE * calibration) - 0.5::DOUBLE * u - s, 5) AS composite
    FROM (SELECT conv_id, turn, {D.feature_columns('text')}, {D.sensationalism('text', 'source_text')} AS s, CASE WHEN total > 0 THEN ok / total ELSE 1.0::DOUBLE END AS f, total - ok AS u FROM ({_FAITH}))""",
)
def composite_reward_turns(spark, sf_dir):
    scored = X.with_features(_faithful(turns(spark, sf_dir)).withColumn("s", R.sensationalism(F.col("text"), F.col("source_text"))))
    return scored.select("conv_id", "turn", F.round(R.composite(F.col("F"), F.col("unsupported"), X.quality(), F.col("calibration"), F.col("s")), 5).alias("composite"))


def _dimensions(df: DataFrame) -> DataFrame:
    """The six dimensions; the record's names stand for its salient strings."""
    scored = X.with_features(_faithful(df).withColumn("s", R.sensationalism(F.col("text"), F.col("source_text"))))
    salient = F.array_distinct(G.names_in(F.col("source_text")))
    return scored.select(
        "conv_id", "turn", R.coverage(F.col("text"), salient).alias("coverage"), F.col("concreteness").alias("specificity"), F.col("F").alias("grounding"), F.when(R.names_source(F.col("text")), 1.0).otherwise(0.0).alias("source"),
        R.human_calibration(F.col("calibration")).alias("calibration"), F.greatest(F.lit(0.0), 1 - F.col("s")).alias("restraint"), "unsupported",
    )


_SALIENT = f"list_distinct({D.names_in('source_text')})"
_DIMENSIONS = rf"""SELECT conv_id, turn, len(list_filter({_SALIENT}, lambda s: regexp_matches(text, '(?i)(?:^|{D.OTHER})' || s || '(?:{D.OTHER}|$)'))) / greatest(len({_SALIENT}), 1) AS coverage,
    concreteness AS specificity, CASE WHEN total > 0 THEN ok / total ELSE 1.0::DOUBLE END AS grounding, CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in L.SOURCE_WORDS)} THEN 1 ELSE 0 END AS source,
    greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + 2 * calibration)) AS calibration, greatest(0::DOUBLE, 1 - {D.sensationalism('text', 'source_text')}) AS restraint, total - ok AS unsupported
    FROM (SELECT *, {D.feature_columns('text')} FROM ({_FAITH}))"""
_PERSONAS = "(VALUES " + ", ".join(f"({D.q(k)}, {', '.join(f'{x}::DOUBLE' for x in v)})" for k, v in L.PERSONAS.items()) + ") personas(persona, " + ", ".join(f"w_{d}" for d in (*L.DIMENSIONS, "fab")) + ")"
_HUMAN = " + ".join(f"w_{d} * {d}" for d in L.DIMENSIONS) + " - w_fab * unsupported"


@query("persona_scores", f"SELECT conv_id, turn, persona, round({_HUMAN}, 5) AS human_reward FROM ({_DIMENSIONS}), {_PERSONAS}")
def persona_scores(spark, sf_dir):
    return R.by_persona(_dimensions(turns(spark, sf_dir))).select("conv_id", "turn", "persona", F.round("human_reward", 5).alias("human_reward"))


# ---- Claims ----------------------------------------------------------------------------------------------------------


@query("claims_split", f"SELECT doc_id, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS claim FROM (SELECT doc_id, {D.claims('text', D.q(SUBJECT))} AS c FROM {TEXTS_SQL}) WHERE len(c) > 0")
def claims_split(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.posexplode(T.split_claims(F.col("text"), F.lit(SUBJECT))).alias("pos", "claim")).withColumn("pos", F.col("pos").cast("long"))


_LATER_CLAIM = f"list_transform(({D.pieces('claim')})[2:], lambda x: trim(x, {D.q(L.EDGE)}))"


@query(
    "claim_invented_specific",
    rf"""SELECT conv_id, turn, pos, {D.n_pieces('claim')} >= 5 AND (len(list_filter({_LATER_CLAIM}, lambda x: regexp_full_match(x, '[A-Za-zÀ-ÿ]+') AND regexp_matches(x, '^\p{{Lu}}') AND NOT list_contains({D.listed(L.STOPWORDS)}, lower(x)) AND NOT list_contains(w, lower(x)))) > 0
    OR len(list_filter({D.years('claim')}, lambda y: NOT list_contains(yr, y))) > 0) AS invented
    FROM (SELECT conv_id, turn, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS claim, w, yr FROM (SELECT conv_id, turn, {D.claims('text')} AS c, {D.lowered('source_text')} AS w, {D.years('source_text')} AS yr FROM {TURNS_SQL}) WHERE len(c) > 0)""",
)
def claim_invented_specific(spark, sf_dir):
    held = turns(spark, sf_dir).select("conv_id", "turn", T.split_claims(F.col("text")).alias("c"), G.index_words(F.col("source_text")).alias("w"), G.attested_years(F.col("source_text")).alias("y"))
    each = held.select("conv_id", "turn", "w", "y", F.posexplode("c").alias("pos", "claim"))
    return each.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), G.invented_specific(F.col("claim"), F.col("w"), F.col("y")).alias("invented"))


@query("strip_hedges", f"SELECT doc_id, md5({D.strip_hedges('text')}) AS stripped FROM {TEXTS_SQL}")
def strip_hedges(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.md5(T.strip_hedges(F.col("text"))).alias("stripped"))


@query(
    "verdict_fold",
    rf"""WITH t AS (SELECT conv_id, turn, {D.claims('text')} AS c, list_filter({D.cut('source_text')}, lambda p: p <> '') AS p, {D.lowered('source_text')} AS w, {D.years('source_text')} AS yr FROM {TURNS_SQL}),
    e AS (SELECT conv_id, turn, p, w, yr, unnest(c) AS claim FROM t WHERE len(c) > 0), h AS (SELECT *, list_distinct(regexp_extract_all(lower({D.strip_hedges('claim')}), '[a-zà-ÿ]+')) AS want FROM e),
    s AS (SELECT conv_id, turn, CASE WHEN len(want) = 0 THEN 0 ELSE list_max(list_transform(p, lambda x: len(list_intersect(want, list_distinct(regexp_extract_all(lower(x), '[a-zà-ÿ]+')))))) / len(want) END AS entail,
      {D.n_pieces('claim')} >= 5 AND (len(list_filter({_LATER_CLAIM}, lambda x: regexp_full_match(x, '[A-Za-zÀ-ÿ]+') AND regexp_matches(x, '^\p{{Lu}}') AND NOT list_contains({D.listed(L.STOPWORDS)}, lower(x)) AND NOT list_contains(w, lower(x)))) > 0 OR len(list_filter({D.years('claim')}, lambda y: NOT list_contains(yr, y))) > 0) AS invented FROM h WHERE len(p) > 0),
    n AS (SELECT conv_id, turn, count(*) FILTER (entail >= {L.ENTAIL}) AS ok, count(*) FILTER (entail < {L.ENTAIL} AND invented) AS bad FROM s GROUP BY ALL),
    v AS (SELECT conv_id, turn, len(c) AS c, len(p) AS p, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad FROM t LEFT JOIN n USING (conv_id, turn))
    SELECT conv_id, turn, CASE WHEN c > 0 AND p > 0 AND ok + bad > 0 THEN round(ok / (ok + bad), 6) ELSE 1::DOUBLE END AS F, CASE WHEN c > 0 AND p > 0 THEN bad ELSE 0 END AS unsupported,
    CASE WHEN c = 0 AND p = 0 THEN '{G.NEITHER}' WHEN c = 0 THEN '{G.NO_CLAIMS}' WHEN p = 0 THEN '{G.NO_PREMISES}' WHEN ok + bad > 0 THEN '{G.SCORED}' ELSE '{G.VAGUE}' END AS status FROM v""",
)
def verdict_fold(spark, sf_dir):
    """Claims of a turn against the sentences of its record, by the scorer that needs no model."""
    held = turns(spark, sf_dir).select("conv_id", "turn", "text", T.cut_after(F.col("source_text"), ".!?").alias("premises"), G.index_words(F.col("source_text")).alias("w"), G.attested_years(F.col("source_text")).alias("y"))
    held = held.withColumn("premises", F.filter("premises", lambda p: p != ""))
    return rounded(scoring.entailment_faithfulness(held, ["conv_id", "turn"], "text", "premises", None, "w", "y"), ["F"])


def claim_rows(spark, sf_dir):
    held = turns(spark, sf_dir).select("conv_id", "turn", "text", T.cut_after(F.col("source_text"), ".!?").alias("premises"), G.index_words(F.col("source_text")).alias("w"), G.attested_years(F.col("source_text")).alias("y"))
    return held.withColumn("premises", F.filter("premises", lambda p: p != ""))


@query("verdicts_from_cache", ORACLES["verdict_fold"])
def verdicts_from_cache(spark, sf_dir):
    """The verdicts of all turns, after a run over the even conversations has filled the cache."""
    held, scores = claim_rows(spark, sf_dir), cache.ScoreCache(spark, files.folder(spark, "scores"))
    judged = lambda rows: scoring.entailment_faithfulness(rows, ["conv_id", "turn"], "text", "premises", None, "w", "y", cache=scores)
    judged(held.where("conv_id % 2 = 0"))
    return rounded(judged(held), ["F"])


@query(
    "score_cache_runs",
    f"""WITH t AS (SELECT conv_id, {D.claims('text')} AS c, list_filter({D.cut('source_text')}, lambda p: p <> '') AS p FROM {TURNS_SQL}), e AS (SELECT conv_id, p, unnest(c) AS claim FROM t WHERE len(c) > 0),
    x AS (SELECT conv_id % 2 = 0 AS even, {D.strip_hedges('claim')} AS claim, unnest(p) AS premise FROM e), n AS (SELECT count(DISTINCT (claim, premise)) AS every, count(DISTINCT (claim, premise)) FILTER (even) AS half FROM x)
    SELECT 'even conversations' AS run, half AS asked, half AS scored FROM n UNION ALL SELECT 'all', every, every - half FROM n UNION ALL SELECT 'all again', every, 0 FROM n UNION ALL SELECT 'next version', every, every FROM n""",
)
def score_cache_runs(spark, sf_dir):
    """How many distinct pairs of a premise and a claim each of four runs asks for, and how many of them it has to score."""
    held = claim_rows(spark, sf_dir)
    each = held.select("conv_id", "premises", F.explode(T.split_claims(F.col("text"))).alias("claim"))
    at = files.folder(spark, "claims")
    each.select("conv_id", "premises", T.strip_hedges(F.col("claim")).alias("claim")).write.parquet(at)  # read by every run
    pairs = spark.read.parquet(at).select("conv_id", "claim", F.explode("premises").alias("premise"))
    root, out = files.folder(spark, "scores"), []
    for run, version, rows in (("even conversations", "1", pairs.where("conv_id % 2 = 0")), ("all", "1", pairs), ("all again", "1", pairs), ("next version", "2", pairs)):
        scores = cache.ScoreCache(spark, root, version=version)
        scores.fill(rows)
        out.append((run, scores.asked, scores.scored))
    return spark.createDataFrame(out, "run string, asked long, scored long")


# ---- Retrieval -------------------------------------------------------------------------------------------------------


@query(
    "sentence_retrieval_topk",
    rf"""WITH s AS (SELECT doc_id, list_distinct({D.lowered("s[1]")}) AS asked, s FROM (SELECT doc_id, {D.source_sentences('text')} AS s FROM {TEXTS_SQL}) WHERE len(s) > 0),
    e AS (SELECT doc_id, asked, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM s),
    r AS (SELECT doc_id, pos, len(list_intersect(asked, list_distinct({D.lowered('sentence')}))) AS score FROM e)
    SELECT doc_id, pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM r QUALIFY rank <= 5""",
)
def sentence_retrieval_topk(spark, sf_dir):
    """The first sentence asks."""
    first = F.coalesce(F.try_element_at(T.source_sentences(F.col("text")), F.lit(1)), F.lit(""))
    top = retrieval.top_sentences(texts(spark, sf_dir).withColumn("q", first), "text", "q", 5)
    return top.select("doc_id", F.posexplode("retrieved").alias("rank", "r")).select("doc_id", F.col("r.pos").cast("long").alias("pos"), F.col("r.score").cast("long").alias("score"), (F.col("rank") + 1).cast("long").alias("rank"))


@query(
    "vector_topk",
    """SELECT query_id, vec_id, rank, round(similarity, 4) AS similarity FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
    FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 5""",
)
def vector_topk(spark, sf_dir):
    """Queries: the vectors whose id is divisible by 20, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(retrieval.top_vectors(vectors, asked, 5).withColumn("rank", F.col("rank").cast("long")), ["similarity"], 4)


@query("vector_index_topk", ORACLES["vector_topk"])
def vector_index_topk(spark, sf_dir):
    """The same queries by the inverted file, which proves its results exact."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = vector_index.VectorIndex.build(vectors, most_k=5).search(asked, 5)
    return rounded(found.withColumn("rank", F.col("rank").cast("long")), ["similarity"], 4)


@query("vector_index_recall", "SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, 5 * count(*) FILTER (vec_id % 20 = 0) AS neighbours, true AS enough FROM embeddings")
def vector_index_recall(spark, sf_dir):
    """Recall at 5 where each query looks only into as many cells as held 99 % of the neighbours within the sample, against the exact search; 0.95 is enough (a few queries vary)."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector_index.VectorIndex.build(vectors, most_k=5)
    exact = index.search(asked, 5)
    r = vector_index.recall(index.search(asked, 5, index.probes_for(0.99)), exact)
    return r.select("queries", (5 * F.col("queries")).alias("neighbours"), (F.col("recall") >= 0.95).alias("enough"))


# ---- Candidates: documents, grouped by source; a number is an unsupported claim --------------------------------------

_CAND = rf"""(SELECT record_id, i, text, unsup, 1::DOUBLE / (1 + unsup) AS F, round({D.REWARD}, 6) AS linguistic, round(lexical_density, 6) AS density, round(-greatest(0::DOUBLE, ({D.n_pieces('text')} - 90) / 90.0::DOUBLE), 6) AS length_guard
    FROM (SELECT source || '/' || lang AS record_id, doc_id AS i, text, len(list_filter(regexp_extract_all(text, '{L.TOKEN}'), lambda x: regexp_matches(x, '\p{{Nd}}'))) AS unsup, {D.feature_columns('text')} FROM documents))"""


def candidates(spark, sf_dir):
    docs = X.with_features(documents(spark, sf_dir, "doc_id", "text", "source", "lang"))
    unsup = F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]*\p{Nd}[\p{L}\p{N}_]*")).cast("long")
    return docs.select(
        F.concat("source", F.lit("/"), "lang").alias("record_id"), F.col("doc_id").alias("i"), "text", unsup.alias("unsup"), (1.0 / (1 + unsup)).alias("F"), F.round(X.linguistic_reward(), 6).alias("linguistic"),
        F.round("lexical_density", 6).alias("density"), F.round(guards.length_penalty(F.col("text")), 6).alias("length_guard"),
    )


def _first(order: str, where: str = "true", column: str = "i") -> str:
    return f"first({column} ORDER BY {order}) FILTER ({where})"


@query(
    "best_of_n_pick",
    f"""SELECT record_id, {_first('linguistic + length_guard DESC, i')} AS pick_linguistic, {_first('density + length_guard DESC, i')} AS pick_density,
    {_first('linguistic + length_guard DESC, i', 'unsup <= 1')} AS pick_gated, pick_linguistic <> pick_density AS diverges FROM {_CAND} GROUP BY 1""",
)
def best_of_n_pick(spark, sf_dir):
    return selection.pick(candidates(spark, sf_dir), ["linguistic", "density"]).withColumn("diverges", selection.diverges(["pick_linguistic", "pick_density"]))


@query("best_of_n_increments", ORACLES["best_of_n_pick"])
def best_of_n_increments(spark, sf_dir):
    """The same picks from three batches of candidates, one of them sent twice, folded in between."""
    held = best_of_n.BestOfN(spark, files.folder(spark, "best-of-n"), ["linguistic", "density"])
    for part in (0, 1, 1, 2):
        held.add(candidates(spark, sf_dir).where(F.col("i") % 3 == part), f"part-{part}")
        if part == 1:
            held.compact()
    return held.picks().withColumn("diverges", selection.diverges(["pick_linguistic", "pick_density"]))


@query(
    "reward_pairs",
    f"""WITH c AS {_CAND}, a AS (SELECT record_id, {_first('linguistic DESC, i', 'unsup <= 1')} AS chosen FROM c GROUP BY 1 HAVING count(*) >= 2),
    b AS (SELECT record_id, chosen, {_first('linguistic DESC, i', "unsup >= 2 OR F <= 0.6::DOUBLE")} AS rejected, {_first('linguistic DESC, i', "unsup >= 2 OR F <= 0.6::DOUBLE", 'unsup')} AS u FROM c JOIN a USING (record_id) WHERE i <> chosen GROUP BY ALL)
    SELECT record_id, chosen, rejected, CASE WHEN u >= 2 THEN 'fabrication' ELSE 'flattened' END AS kind FROM b WHERE rejected IS NOT NULL""",
)
def reward_pairs(spark, sf_dir):
    return selection.reward_pairs(candidates(spark, sf_dir)).select("record_id", F.col("chosen.i").alias("chosen"), F.col("rejected.i").alias("rejected"), "kind")


def ratings(spark, sf_dir):
    """Two raters for each labelled document: quality, and freedom from toxicity, from 1 to 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("record_id"))
    met = table(spark, sf_dir, "labels").join(docs, "doc_id")
    raters = F.array(F.struct(F.lit("quality").alias("annotator"), (1 + 4 * F.col("quality")).alias("overall")), F.struct(F.lit("toxicity").alias("annotator"), (5 - 4 * F.col("toxic")).alias("overall")))
    return met.select("record_id", F.col("doc_id").alias("candidate_i"), F.explode(raters).alias("r")).select("record_id", "candidate_i", "r.annotator", "r.overall")


_RATED = f"(SELECT c.*, (1 + 4 * quality + 5 - 4 * toxic) / 2.0::DOUBLE AS rating FROM {_CAND} c JOIN labels ON i = doc_id)"


@query(
    "human_pairs_min_gap",
    f"""SELECT record_id, {_first('rating DESC, i DESC')} AS chosen, {_first('rating, i')} AS rejected, max(rating) AS chosen_rating, min(rating) AS rejected_rating,
    CASE WHEN {_first('rating, i', column='unsup')} >= 2 THEN 'fabrication' ELSE 'low_rated' END AS kind FROM {_RATED} GROUP BY 1 HAVING count(*) >= 2 AND max(rating) - min(rating) >= 1""",
)
def human_pairs_min_gap(spark, sf_dir):
    made = selection.human_pairs(candidates(spark, sf_dir), ratings(spark, sf_dir))
    return made.select("record_id", F.col("chosen.i").alias("chosen"), F.col("rejected.i").alias("rejected"), F.col("chosen.rating").alias("chosen_rating"), F.col("rejected.rating").alias("rejected_rating"), "kind")


@query(
    "authored_pairs",
    f"""WITH w AS (SELECT record_id, {_first('F, i', column='trim(text)')} AS worst FROM {_CAND} GROUP BY 1), a AS (SELECT source || '/' || lang AS record_id, doc_id AS author, trim(text) AS t FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0)
    SELECT record_id, author, CASE WHEN worst <> '' AND worst <> t THEN md5(worst) END AS rejected, CASE WHEN worst <> '' AND worst <> t THEN 'human_vs_machine' ELSE 'sft_only' END AS kind FROM a JOIN w USING (record_id) WHERE t <> ''""",
)
def authored_pairs(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    docs = table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi")
    mine = docs.select(F.concat("source", F.lit("/"), "lang").alias("record_id"), F.col("doc_id").alias("author"), F.lit(5).alias("confidence"), "text")
    return selection.authored_pairs(candidates(spark, sf_dir), mine).select("record_id", "author", F.md5("rejected").alias("rejected"), "kind")


@query(
    "judge_pairs",
    f"""WITH j AS (SELECT conv_id AS record_id, text, greatest(0::DOUBLE, least(10::DOUBLE, 5 + 2.5::DOUBLE * (1 - {D.sensationalism('text')} * 10))) AS judge FROM {TURNS_SQL}),
    t AS (SELECT record_id, first(text ORDER BY judge DESC, text COLLATE "C" DESC) AS top FROM j GROUP BY 1)
    SELECT record_id, md5(top) AS chosen, md5(text) AS rejected FROM j JOIN t USING (record_id) WHERE text <> top""".replace(' COLLATE "C"', ""),
)
def judge_pairs(spark, sf_dir):
    judged = turns(spark, sf_dir).select(F.col("conv_id").alias("record_id"), "text", R.mock_judge(1 - R.sensationalism(F.col("text")) * 10).alias("judge"))
    return selection.judge_pairs(judged).select("record_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


@query("gate_curve", f"SELECT g::INT AS gate, count(*) FILTER (least <= g) AS records FROM (SELECT record_id, min(unsup) AS least FROM {_CAND} GROUP BY 1), range(5) r(g) GROUP BY g")
def gate_curve(spark, sf_dir):
    return selection.gate_curve(candidates(spark, sf_dir))


# ---- Datasets --------------------------------------------------------------------------------------------------------

_PROMPT = "'<|im_start|>user' || chr(10) || source_text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


def pairs(spark, sf_dir):
    """A turn is chosen, the same text cut in half is rejected."""
    t = turns(spark, sf_dir).where("text <> '' AND source_text <> ''")
    return t.select(parsing.chat(F.col("source_text")).alias("prompt"), F.col("text").alias("chosen"), F.expr("substring(text, 1, length(text) div 2)").alias("rejected"))


_PAIRS = f"(SELECT {_PROMPT} AS prompt, text AS chosen, substr(text, 1, len(text) // 2) AS rejected FROM {TURNS_SQL} WHERE text <> '' AND source_text <> '')"


@query("kto_rows", f"SELECT md5(prompt) AS prompt, md5(completion) AS completion, label FROM (SELECT DISTINCT prompt, chosen AS completion, true AS label FROM {_PAIRS} UNION ALL SELECT prompt, rejected, false FROM {_PAIRS})")
def kto_rows(spark, sf_dir):
    return datasets.kto(pairs(spark, sf_dir)).select(F.md5("prompt").alias("prompt"), F.md5("completion").alias("completion"), "label")


@query("sft_rows", f"SELECT md5(prompt) AS prompt, md5(' ' || trim(chosen) || '<|im_end|>') AS completion FROM {_PAIRS}")
def sft_rows(spark, sf_dir):
    return datasets.sft(pairs(spark, sf_dir)).select(F.md5("prompt").alias("prompt"), F.md5(parsing.with_end(F.col("completion"))).alias("completion"))


@query("dpo_rows", f"SELECT md5(prompt) AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected FROM {_PAIRS}")
def dpo_rows(spark, sf_dir):
    return datasets.dpo(pairs(spark, sf_dir)).select(*(F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")))


@query("length_stats", f"SELECT min(n)::INT AS shortest, median(n)::DOUBLE AS median, (list(n ORDER BY n))[count(*) // 2 + 1]::INT AS upper_median, max(n)::INT AS longest FROM (SELECT {D.n_pieces('text')} AS n FROM {TEXTS_SQL})")
def length_stats(spark, sf_dir):
    return datasets.lengths(texts(spark, sf_dir), "text")


# ---- Agreement -------------------------------------------------------------------------------------------------------


@query(
    "length_quality_correlation",
    f"""WITH d AS (SELECT lang, n_chars::DOUBLE AS x, (quality * 2 - toxic)::DOUBLE AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT lang, x, y, {D.average_rank('lang', 'x')} AS rx, {D.average_rank('lang', 'y')} AS ry FROM d)
    SELECT lang, count(*) AS n, round({D.corr('x', 'y')}, 6) AS pearson, round({D.corr('rx', 'ry')}, 6) AS rho FROM r GROUP BY lang""",
)
def length_quality_correlation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("x")).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("y", (F.col("quality") * 2 - F.col("toxic")).cast("double"))
    r = d.groupBy("lang").agg(F.round(agreement.pearson("x", "y"), 6).alias("pearson"))
    return rounded(agreement.spearman(d, ["lang"], "x", "y").join(r, "lang"), ["rho"])


_EVENT_RATINGS = "(SELECT user_id AS annotator, event_type, extract(day FROM ts) AS d, avg(value) AS rating FROM events GROUP BY ALL)"


def event_ratings(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("annotator"), "event_type", F.dayofmonth("ts").alias("d")).agg(F.avg("value").alias("rating"))


@query(
    "inter_annotator",
    f"""WITH p AS (SELECT a.annotator AS a, b.annotator AS b, a.rating AS x, b.rating AS y FROM {_EVENT_RATINGS} a JOIN {_EVENT_RATINGS} b ON a.event_type = b.event_type AND a.d = b.d AND a.annotator < b.annotator),
    r AS (SELECT a, b, {D.average_rank('a, b', 'x')} AS rx, {D.average_rank('a, b', 'y')} AS ry FROM p), c AS (SELECT a, b, {D.corr('rx', 'ry')} AS rho FROM r GROUP BY ALL HAVING count(*) >= 3)
    SELECT count(*) AS pairs, round(avg(rho), 5) AS mean_rho, round(min(rho), 5) AS min_rho, round(max(rho), 5) AS max_rho FROM c""",
)
def inter_annotator(spark, sf_dir):
    return rounded(agreement.inter_annotator(event_ratings(spark, sf_dir), ["event_type", "d"]), ("mean_rho", "min_rho", "max_rho"), 5)


_LONG_RATED = f"(UNPIVOT (SELECT record_id, i, rating AS human, linguistic, density, length_guard FROM {_RATED}) ON linguistic, density, length_guard INTO NAME reward VALUE score)"
_REWARDS = ["linguistic", "density", "length_guard"]


def rated_candidates(spark, sf_dir):
    return candidates(spark, sf_dir).select("record_id", "i", *_REWARDS), ratings(spark, sf_dir).select("record_id", F.col("candidate_i").alias("i"), "annotator", F.col("overall").cast("double").alias("rating"))


@query(
    "reward_agreement",
    f"""WITH r AS (SELECT reward, {D.average_rank('reward', 'score')} AS rx, {D.average_rank('reward', 'human')} AS ry FROM {_LONG_RATED}) SELECT reward, count(*) AS n, round({D.corr('rx', 'ry')}, 5) AS rho FROM r GROUP BY reward""",
)
def reward_agreement(spark, sf_dir):
    return rounded(agreement.reward_agreement(*rated_candidates(spark, sf_dir), _REWARDS, ["record_id", "i"]), ["rho"], 5)


@query(
    "reward_by_annotator",
    f"""WITH l AS (SELECT reward, annotator, score, overall FROM (UNPIVOT (SELECT i, linguistic, density, length_guard FROM {_CAND}) ON linguistic, density, length_guard INTO NAME reward VALUE score)
      JOIN (SELECT doc_id, 'quality' AS annotator, 1 + 4 * quality AS overall FROM labels UNION ALL SELECT doc_id, 'toxicity', 5 - 4 * toxic FROM labels) ON i = doc_id),
    r AS (SELECT reward, annotator, {D.average_rank('reward, annotator', 'score')} AS rx, {D.average_rank('reward, annotator', 'overall')} AS ry FROM l), c AS (SELECT reward, annotator, {D.corr('rx', 'ry')} AS rho FROM r GROUP BY ALL HAVING count(*) >= 3)
    SELECT reward, count(*) AS annotators, round(avg(rho), 5) AS mean_rho, round(max(rho) - min(rho), 5) AS spread FROM c WHERE rho IS NOT NULL GROUP BY reward""",
)
def reward_by_annotator(spark, sf_dir):
    return rounded(agreement.reward_by_annotator(*rated_candidates(spark, sf_dir), _REWARDS, ["record_id", "i"]), ("mean_rho", "spread"), 5)


@query(
    "top_pick_agreement",
    f"""WITH e AS (SELECT reward, record_id, count(*) AS n, {_first('human DESC, i')} AS h, {_first('score DESC, i')} AS r, min(score) < max(score) AS varied FROM {_LONG_RATED} GROUP BY ALL)
    SELECT reward, count(*) FILTER (varied AND h = r) AS hits, count(*) AS records, count(*) FILTER (NOT varied) AS flat FROM e WHERE n >= 2 GROUP BY reward""",
)
def top_pick_agreement(spark, sf_dir):
    return agreement.top_pick_agreement(*rated_candidates(spark, sf_dir), _REWARDS)


@query(
    "prf_token_sets",
    f"""SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0::DOUBLE END, 6) AS f1 FROM (SELECT doc_id,
    CASE WHEN len(g) = 0 AND len(w) = 0 THEN 1::DOUBLE WHEN len(g) = 0 THEN 0::DOUBLE ELSE len(list_intersect(g, w)) / len(g) END AS p, CASE WHEN len(g) = 0 AND len(w) = 0 THEN 1::DOUBLE WHEN len(w) = 0 THEN 0::DOUBLE ELSE len(list_intersect(g, w)) / len(w) END AS r
    FROM (SELECT doc_id, list_distinct({D.lowered('text[:len(text) // 2]')}) AS g, list_distinct({D.lowered('text')}) AS w FROM {TEXTS_SQL}))""",
)
def prf_token_sets(spark, sf_dir):
    """The words of a text's first half against those of the whole."""
    half = F.expr("substring(text, 1, length(text) div 2)")
    made = texts(spark, sf_dir).select("doc_id", agreement.precision_recall(T.lowered(half), T.lowered(F.col("text"))).alias("s")).select("doc_id", "s.*")
    return rounded(made, ("precision", "recall", "f1"))


# ---- Text operators --------------------------------------------------------------------------------------------------


@query(
    "chunk_words_150",
    f"""SELECT doc_id, k AS chunk, len(w) AS n, md5(array_to_string(w, ' ')) AS text_md5 FROM (SELECT doc_id, k, (p)[k * 150 + 1:k * 150 + 150] AS w FROM (SELECT doc_id, {D.pieces('text')} AS p FROM {TEXTS_SQL}), range(100000) r(k) WHERE k * 150 < len(p)) WHERE len(w) >= 20""".replace(
        "range(100000) r(k) WHERE k * 150 < len(p)", "LATERAL (SELECT unnest(range((len(p) + 149) // 150)) AS k)"
    ),
)
def chunk_words_150(spark, sf_dir):
    each = texts(spark, sf_dir).select("doc_id", F.explode(T.chunked(F.col("text"))).alias("c"))
    return each.select("doc_id", F.col("c.chunk").cast("long").alias("chunk"), T.n_pieces(F.col("c.text")).cast("long").alias("n"), F.md5("c.text").alias("text_md5"))


@query(
    "focal_mode_entity",
    f"""WITH e AS (SELECT doc_id, generate_subscripts(n, 1) AS place, unnest(n) AS name FROM (SELECT doc_id, {D.names_in("text")} AS n FROM {TEXTS_SQL}) WHERE len(n) > 0), c AS (SELECT doc_id, name, count(*) AS k, min(place) AS place FROM e GROUP BY ALL)
    SELECT doc_id, first(name ORDER BY k DESC, place) AS name, max(k) AS times FROM c GROUP BY doc_id""",
)
def focal_mode_entity(spark, sf_dir):
    named = texts(spark, sf_dir).select("doc_id", F.posexplode(G.names_in(F.col("text"))).alias("at", "name"))
    return agreement.most_frequent(named, ["doc_id"], "name", "at")


@query(
    "degree_focal",
    """WITH e AS (SELECT l_orderkey, unnest(['part ' || l_partkey, 'supplier ' || l_suppkey]) AS node, l_linenumber AS place FROM lineitem), c AS (SELECT l_orderkey, node, count(*) AS k, min(place) AS place FROM e GROUP BY ALL)
    SELECT l_orderkey, first(node ORDER BY k DESC, place, node DESC) AS node, max(k) AS degree FROM c GROUP BY 1""",
)
def degree_focal(spark, sf_dir):
    """The node of an order's part-supplier edges with the most edges; ties: the first line, then the greater name."""
    ends = F.array(F.concat(F.lit("part "), "l_partkey"), F.concat(F.lit("supplier "), "l_suppkey"))
    each = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(ends).alias("node"), F.col("l_linenumber").alias("at"))
    counts = each.groupBy("l_orderkey", "node").agg(F.count("*").alias("k"), F.min("at").alias("at"))
    return counts.groupBy("l_orderkey").agg(F.max_by("node", F.struct("k", -F.col("at"), "node")).alias("node"), F.max("k").alias("degree"))


@query(
    "redact_names",
    """SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(t, '(^|[^\\p{L}\\p{N}_])Customer($|[^\\p{L}\\p{N}_])', '\\1[unit]\\2', 'gi'), '(^|[^\\p{L}\\p{N}_])' || c_mktsegment || '($|[^\\p{L}\\p{N}_])', '\\1[unit]\\2', 'gi'), '\\[unit\\](?:[,\\s]+\\[unit\\])+', '[unit]', 'g') AS redacted
    FROM (SELECT *, 'customer ' || c_mktsegment || ' of ' || c_name || ', a Customers club' AS t FROM customer)""",
)
def redact_names(spark, sf_dir):
    """Focal name: "Customer" and the market segment."""
    t = F.concat(F.lit("customer "), "c_mktsegment", F.lit(" of "), "c_name", F.lit(", a Customers club"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.redact(t, F.concat_ws(" ", F.lit("Customer"), "c_mktsegment")).alias("redacted"))


_LINK = r"\s+"


@query(
    "html_records",
    r"""SELECT page_id, title, n_paragraphs, md5(block) AS block FROM (SELECT page_id, title, len(p) AS n_paragraphs, 'Unit: ' || CASE WHEN title <> '' THEN title ELSE url END || CASE WHEN title <> '' THEN chr(10) || 'Title: ' || url ELSE '' END || chr(10) || 'Source: web' || chr(10) || 'Subjects: ' || array_to_string(p[1:20], '; ') AS block
    FROM (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, regexp_extract_all(url, '[a-z]+') AS p FROM pages))""".replace("array_to_string(p[1:20], '; ')", "array_to_string(list_transform(list_filter(list_zip(p, range(1, len(p) + 1)), lambda z: list_position(p, z[1]) = z[2]), lambda z: z[1])[1:20], '; ')"),
)
def html_records(spark, sf_dir):
    """Pages in the record shape: the title as unit, words of the address as subjects."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), r"\s+", " "))
    held = table(spark, sf_dir, "pages").select("page_id", "url", title.alias("title"), F.regexp_extract_all("url", F.lit("[a-z]+"), F.lit(0)).alias("p"))
    none = F.array().cast("array<struct<name:string,type:string>>")
    unit = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url"))
    block = parsing.record_block(unit, F.col("url"), F.lit("web"), none, None, F.col("p"))
    return held.select("page_id", "title", F.size("p").cast("long").alias("n_paragraphs"), F.md5(block).alias("block"))


def _tags(spark, sf_dir):
    """Tags for the tokens of a document, as arrays: runs of capitalised words are persons, numbers are dates; an I that fits nothing now and then."""
    kind = lambda x: F.when(x.rlike(r"^\p{Lu}"), "PERS").when(x.rlike(r"^\p{Nd}"), "DATE")

    def tagged(h):
        def tag(k, i):
            goes_on = F.get(h["kinds"], i - 1).eqNullSafe(k) | (i % 7 == 3)
            return F.when(k.isNull(), "O").when(goes_on, F.concat(F.lit("I-"), k)).otherwise(F.concat(F.lit("B-"), k))

        return F.struct(h["tokens"].alias("tokens"), F.transform(h["kinds"], tag).alias("tags"))

    found = T.let(T.tokens(F.col("text")), lambda t: T.let(F.struct(t.alias("tokens"), F.transform(t, kind).alias("kinds")), tagged))
    return texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), found.alias("x")).select("doc_id", "x.tokens", "x.tags")


_TOKENS = f"(SELECT doc_id::VARCHAR AS doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{L.TOKEN}') AS t FROM {TEXTS_SQL}) WHERE len(t) > 0)"
_TAGS = rf"""(SELECT *, CASE WHEN kind IS NULL THEN 'O' WHEN lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) = kind OR pos % 7 = 3 THEN 'I' ELSE 'B' END AS bio FROM (SELECT *, CASE WHEN regexp_matches(token, '^\p{{Lu}}') THEN 'PERS' WHEN regexp_matches(token, '^\p{{Nd}}') THEN 'DATE' END AS kind FROM {_TOKENS}))"""
_COMMON = "CASE k WHEN 'PERS' THEN 'PERSON' ELSE 'DATE' END"


@query(
    "iob_spans",
    f"""WITH p AS (SELECT *, sum(len(token) + 1) OVER o - 1 AS e, sum((bio = 'B')::INT) OVER o AS span FROM {_TAGS} WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT *, first_value(kind) OVER w AS k FROM p WHERE span > 0 WINDOW w AS (PARTITION BY doc_id, span ORDER BY pos)), b AS (SELECT *, sum((NOT coalesce(bio = 'B' OR (bio = 'I' AND kind = k), false))::INT) OVER (PARTITION BY doc_id, span ORDER BY pos ROWS UNBOUNDED PRECEDING) AS broken FROM g)
    SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS surface, any_value({_COMMON}) AS type, first(e - len(token) ORDER BY pos)::INT AS start, max(e)::INT AS "end" FROM b WHERE broken = 0 GROUP BY doc_id, span""",
)
def iob_spans(spark, sf_dir):
    return readers.iob_entities(_tags(spark, sf_dir), "offsets")


@query(
    "iob_sets",
    f"""WITH o AS (SELECT *, CASE WHEN bio = 'B' OR (bio = 'I' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM kind) THEN 1 ELSE 0 END AS opens FROM {_TAGS}),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span FROM o) SELECT DISTINCT doc_id, entity, {_COMMON} AS type FROM (SELECT doc_id, span, string_agg(token, ' ' ORDER BY pos) AS entity, any_value(kind) AS k FROM s WHERE kind IS NOT NULL GROUP BY ALL)""",
)
def iob_sets(spark, sf_dir):
    return readers.iob_entities(_tags(spark, sf_dir), "set")


#: No shorter surface ends as a longer one begins, so the leftmost match of the alternation, longest first, is the longest that wins.
_SURFACES = "Apache License|MIT License|License|the and|the|and|2\\.0"
_FIXED = [("the", "org"), ("the and", "place"), ("and", "person"), ("Apache License", "org"), ("License", "org"), ("2.0", "date"), ("MIT License", "org")]


def marked(spark, sf_dir, surfaces, *more):
    return spans.with_mentions_of(texts(spark, sf_dir), "text", surfaces, "m", ("doc_id", *more))


def mention_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.start", "m.end", "m.surface", "m.type")


@query(
    "mention_longest_match",
    f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{_SURFACES}') AS m, list_transform(string_split_regex(text, '{_SURFACES}'), lambda g: len(g)) AS g FROM {TEXTS_SQL}),
    e AS (SELECT doc_id, unnest(m) AS surface, unnest(g[:len(m)]) AS gap, generate_subscripts(m, 1) AS k FROM m WHERE len(m) > 0), p AS (SELECT *, (sum(gap + len(surface)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING))::INT AS "end" FROM e)
    SELECT doc_id, ("end" - len(surface))::INT AS start, "end", surface, CASE surface WHEN 'the and' THEN 'place' WHEN 'and' THEN 'person' WHEN '2.0' THEN 'date' ELSE 'org' END AS type FROM p""",
)
def mention_longest_match(spark, sf_dir):
    """Mentions of fixed surfaces in every document; of those that overlap the longest surface wins."""
    return mention_rows(marked(spark, sf_dir, _FIXED))


#: Surfaces that overlap each other in many ways: the longest takes its places first, among equally long ones the first named.
_CLASHING = [("he", "person"), ("the", "org"), ("ther", "place"), ("hern", "person"), ("ern", "date"), ("er", "org"), ("and", "person"), ("nd th", "place"), ("d the", "org"), ("n", "date"), ("in", "place"), ("ing", "org"), ("nin", "person"), ("anan", "date"), ("sts", "org"), (". ", "date")]


def _takes(surface: str, taken: list[str]) -> str:
    """Where ``surface`` stands, from left to right, each place unless it overlaps a taken one of equally long or longer surfaces."""
    own = f"list_transform((string_split(text, {D.q(surface)}))[:-2], lambda g: len(g))"  # -2: all but the last
    places = f"list_transform(range(len({own})), lambda k: list_sum(({own})[:k + 1])::BIGINT + k * {len(surface)})"
    clash = " OR ".join(f"len(list_filter({c}, lambda o: s < o + {n} AND o < s + {len(surface)})) > 0" for c, n in taken)
    return f"list_filter({places}, lambda s: NOT ({clash}))" if clash else places


def _clash_sql() -> str:
    """A step for each surface, longest first."""
    order = sorted(range(len(_CLASHING)), key=lambda k: (-len(_CLASHING[k][0]), k))
    at, taken = f"(SELECT doc_id, text FROM {TEXTS_SQL})", []
    for k in order:
        at = f"(SELECT *, {_takes(_CLASHING[k][0], taken)} AS c{k} FROM {at})"
        taken.append((f"c{k}", len(_CLASHING[k][0])))
    return "(" + " UNION ALL ".join(f"SELECT doc_id, unnest(c{k})::INT AS start, {D.q(s)} AS surface, {D.q(t)} AS type FROM x" for k, (s, t) in enumerate(_CLASHING)) + ")", at


_CLASHES, _STEPS = _clash_sql()


@query("mention_conflicts", f"WITH x AS MATERIALIZED {_STEPS} SELECT doc_id, start, start + len(surface)::INT AS \"end\", surface, type FROM {_CLASHES}")
def mention_conflicts(spark, sf_dir):
    """Mentions of surfaces that overlap each other at many places."""
    return mention_rows(marked(spark, sf_dir, _CLASHING))


_SHORT_SQL = "CASE type " + " ".join(f"WHEN '{kind}' THEN '{short}'" for kind, short in spans.SHORT.items()) + " END"


@query(
    "tagged_mentions",
    rf"""WITH x AS MATERIALIZED {_STEPS}, m AS (SELECT doc_id, start, start + len(surface) AS stop, type FROM {_CLASHES}),
    p AS (SELECT doc_id, regexp_extract_all(text, '{L.TOKEN}|\s+') AS p FROM {TEXTS_SQL}), t AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS token FROM p WHERE len(p) > 0),
    e AS (SELECT *, (sum(len(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM t)
    SELECT e.doc_id, coalesce(CASE WHEN m.stop < e.stop THEN NULL WHEN e.stop - len(token) = m.start THEN 'B-' ELSE 'I-' END || {_SHORT_SQL}, 'O') AS tag, count(*) AS tokens
    FROM e ASOF LEFT JOIN m ON e.doc_id = m.doc_id AND e.stop - len(token) >= m.start WHERE NOT regexp_full_match(token, '\s+') GROUP BY ALL""",
)
def tagged_mentions(spark, sf_dir):
    """How many tokens of each document get each tag from its mentions."""
    tags = sinks.tagged_tokens(marked(spark, sf_dir, _CLASHING, "text"), "doc_id", "text", "m")
    return tags.groupBy("doc_id", "tag").agg(F.count("*").alias("tokens"))


@query(
    "judge_parse_score",
    """SELECT event_id, (CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN 7 WHEN 2 THEN 0 WHEN 3 THEN 4.5 WHEN 4 THEN 9 ELSE 0 END)::DOUBLE AS score FROM events""",
)
def judge_parse_score(spark, sf_dir):
    """Answers in six shapes: fenced JSON, a loose score, nothing, reasoning with a later object, several objects, broken JSON."""
    v = F.col("value").cast("string")
    raw = (
        F.when(F.col("event_id") % 6 == 0, F.concat(F.lit('```json\n{"score": '), v, F.lit("}\n```")))
        .when(F.col("event_id") % 6 == 1, F.lit("I would say score: 7 of ten"))
        .when(F.col("event_id") % 6 == 2, F.lit(" "))
        .when(F.col("event_id") % 6 == 3, F.lit('First {a thought} and then {"score": "4.5", "reason": "x"}'))
        .when(F.col("event_id") % 6 == 4, F.lit('{"score": 1} no, {"score": 9} {"other": 2}'))
        .otherwise(F.lit('{"scor: }'))
    )
    return table(spark, sf_dir, "events").select("event_id", parsing.judge_score(raw).alias("score"))


@query("dedupe_content_hash", "SELECT sha1(text || chr(0)) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text".replace("chr(0)", "'\\0'"))
def dedupe_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(G.cache_key(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


ORACLES["dedupe_content_hash"] = "SELECT sha1(encode(text) || '\\x00'::BLOB) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text"


@query("json_props_extract", """SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1""")
def json_props_extract(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("html_escape_dates", """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS html FROM """ + TEXTS_SQL)
def html_escape_dates(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.md5(T.html_escape(F.col("text"))).alias("html"))


@query("prompt_digest", f"""SELECT doc_id, md5(replace(replace(replace({D.q(L.INSTRUCTION)}, '{{unit}}', {D.q(SUBJECT)}), '{{register}}', CASE WHEN lang = 'en' THEN 'finding-aid' ELSE 'archival-micro-narrative' END), '{{record}}', source)) AS prompt FROM documents""")
def prompt_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(parsing.prompt(F.lit(SUBJECT), F.when(F.col("lang") == "en", "finding_aid"), F.col("source"))).alias("prompt"))


@query("join_diagnostics", """SELECT count(*) FILTER (l AND r) AS both, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only FROM (SELECT bool_or(l) AS l, bool_or(NOT l) AS r FROM (SELECT doc_id, true AS l FROM documents UNION ALL SELECT doc_id, false FROM labels) GROUP BY doc_id)""")
def join_diagnostics(spark, sf_dir):
    return datasets.overlap_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


# ---- The synthetic grid ----------------------------------------------------------------------------------------------


def scored_grid(spark) -> DataFrame:
    g = X.with_features(synthetic.grid(spark)).withColumn("linguistic", X.linguistic_reward(digits=4))
    g = g.withColumn("_w", G.index_words(F.col("blob"))).withColumn("_y", G.index_years(F.col("blob"))).withColumn("f", G.lexical_faithfulness(F.col("text"), F.col("_w"), F.col("_y")))
    g = g.withColumn("s", R.sensationalism(F.col("text"), G.premise_text(F.col("facts"))))
    return g.withColumn("composite", R.composite(F.col("f.F"), F.col("f.unsupported"), X.quality(), F.col("calibration"), F.col("s"), 4))


#: Means that the grid must have: oracle and surface score by profile.
_GRID = (("good", 0.85, 2.573), ("flattened", 0.075, 1.134), ("fabricated", -0.275, 2.984))


@query("grid_means", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', 16::BIGINT, {o}::DOUBLE, {s}::DOUBLE)" for p, o, s in _GRID) + ") t(profile, texts, oracle, linguistic)")
def grid_means(spark, sf_dir):
    return rounded(scored_grid(spark).groupBy("profile").agg(F.count("*").alias("texts"), F.avg("oracle_score").alias("oracle"), F.avg("linguistic").alias("linguistic")), ("oracle", "linguistic"), 3)


@query("grid_win_counts", "SELECT * FROM (VALUES ('oracle_score', 16::BIGINT, 16::BIGINT), ('linguistic', 16, 0), ('composite', 16, 16)) t(reward, cells, wins)")
def grid_win_counts(spark, sf_dir):
    long = scored_grid(spark).unpivot(["case_id", "register", "profile"], ["oracle_score", "linguistic", "composite"], "reward", "score")
    of = lambda p: F.max(F.when(F.col("profile") == p, F.col("score")))
    cells = long.groupBy("reward", "case_id", "register").agg(of("good").alias("a"), of("fabricated").alias("b"))
    return cells.groupBy("reward").agg(F.count("*").alias("cells"), F.count_if(F.col("a") > F.col("b")).alias("wins"))


@query("grid_arm_agreement", "SELECT * FROM (VALUES ('flattened', 16::BIGINT, 16::BIGINT), ('fabricated', 16, 0)) t(other, cells, agree)")
def grid_arm_agreement(spark, sf_dir):
    return flows.arm_agreement(scored_grid(spark), ["case_id", "register"], "oracle_score", "linguistic")


@query("grid_judge_counters", "SELECT 16::BIGINT AS cells, 16::BIGINT AS good_top, 16::BIGINT AS good_over_fabricated, 16::BIGINT AS fabricated_under_flattened, 0::BIGINT AS ties")
def grid_judge_counters(spark, sf_dir):
    """The oracle as its own judge."""
    return flows.judge_counters(scored_grid(spark), ["case_id", "register"], "oracle_score")


@query("best_of_n_flow")
def best_of_n_flow(spark, sf_dir):
    """Records of the synthetic cases, their renderings as candidates, to picks."""
    order = F.row_number().over(Window.partitionBy("case_id").orderBy("register", "profile")) - 1  # six of each case
    cands = synthetic.grid(spark).select(F.col("case_id").alias("record_id"), order.alias("i"), "text")
    return flows.best_of_n(flows.scored_candidates(cands, synthetic.records(spark)))


@query("reward_by_case")
def reward_by_case(spark, sf_dir):
    """Renderings as completions of their case's prompt."""
    g = synthetic.grid(spark)
    done = g.select(F.concat_ws("-", "case_id", "register", "profile").alias("completion_id"), "case_id", F.array(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))).alias("messages"))
    return flows.reward_by_case(done, g.select("case_id", "blob", "facts").dropDuplicates(["case_id"]))


@query("grid_personas")
def grid_personas(spark, sf_dir):
    """persona, ordering of the profiles by their mean human reward."""
    g = scored_grid(spark)
    d = g.select(
        "profile", R.coverage(F.col("text"), F.col("salient")).alias("coverage"), F.col("concreteness").alias("specificity"), F.col("f.F").alias("grounding"), F.when(R.names_source(F.col("text"), F.col("references")), 1.0).otherwise(0.0).alias("source"),
        R.human_calibration(F.col("calibration")).alias("calibration"), F.greatest(F.lit(0.0), 1 - F.col("s")).alias("restraint"), F.col("f.unsupported").alias("unsupported"),
    )
    means = R.by_persona(d).groupBy("persona", "profile").agg(F.round(F.avg("human_reward"), 6).alias("m"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("minus"), "profile")))
    return means.groupBy("persona").agg(F.array_join(F.transform(order, lambda x: x["profile"]), " > ").alias("ordering"))


@query("grid_round_trip", "SELECT 16::BIGINT AS texts, 16::BIGINT AS iob_equal, 16::BIGINT AS tei_equal")
def grid_round_trip(spark, sf_dir):
    """Good texts to token tags and TEI and back: how many give the entity sets they came from."""
    good = synthetic.grid(spark).where("profile = 'good'").select(F.concat_ws("-", "case_id", "register").alias("doc_id"), F.col("focal_name").alias("title"), F.lit("").alias("references"), "text", "gold")
    good = spans.with_mentions(good, "text", "gold").drop("gold")
    table_ = F.create_map(*(F.lit(x) for kind, _, _, common in L.TYPES for x in (kind, common)))
    gold = good.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", T.normal(F.col("m.surface")).alias("entity"), F.element_at(table_, F.col("m.type")).alias("type")).distinct()
    tags = sinks.iob_text(sinks.tagged_tokens(good, "doc_id", "text", "mentions"), "doc_id")
    iob = readers.iob_entities(readers.tag_arrays(tags.select(F.col("doc_id").alias("name"), "value")), "set")
    files = sinks.tei_texts(good, "doc_id")
    tei = files.mapInArrow(_tei_sets, "doc_id string, entity string, type string")
    sets = lambda df, n: df.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("entity", "type"))).alias(n))
    met = sets(gold, "g").join(sets(iob, "i"), "doc_id", "left").join(sets(tei, "t"), "doc_id", "left")
    return met.agg(F.count("*").alias("texts"), F.count_if(F.col("g").eqNullSafe(F.col("i"))).alias("iob_equal"), F.count_if(F.col("g").eqNullSafe(F.col("t"))).alias("tei_equal"))


def _tei_sets(batches):
    import re

    import pyarrow as pa

    token = re.compile(r"\w+|[^\w\s]")
    for b in batches:
        rows = {(d, " ".join(token.findall(s)), t) for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, t, _, _ in readers.tei_spans(x)[1]}
        d, e, t = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()), pa.array(e, pa.string()), pa.array(t, pa.string())], ["doc_id", "entity", "type"])
