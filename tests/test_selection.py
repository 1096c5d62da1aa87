import pytest
from pyspark.sql import functions as F

from inkwell.operators import agreement, datasets, scoring, selection

CAND = "record_id string, i int, text string, F double, unsup int, linguistic double, judge double, length_guard double"


@pytest.fixture(scope="module")
def cand(spark):
    nan = float("nan")
    return spark.createDataFrame(
        [
            ("a", 0, "t0", 1.0, 0, 2.0, nan, 0.0), ("a", 1, "t1", 0.4, 3, 2.0, 5.0, 0.0), ("a", 2, "t2", 0.9, 1, 2.0, 5.0, 0.0),
            ("b", 0, "u0", 0.2, 5, 1.0, nan, 0.0), ("b", 1, "u1", 0.2, 4, 3.0, nan, 0.0), ("c", 0, "v0", 1.0, 0, 1.0, 1.0, 0.0),
        ],
        CAND,
    )


def test_ties_go_to_the_first(cand):
    got = {r.record_id: r for r in selection.pick(cand, ["linguistic", "judge"]).collect()}
    assert (got["a"].pick_linguistic, got["a"].pick_judge, got["a"].pick_gated) == (0, 1, 0)
    assert got["b"].pick_judge is None and got["b"].pick_gated is None and got["b"].pick_linguistic == 1


def test_reward_pairs(cand):
    got = selection.reward_pairs(cand).collect()
    assert [(r.record_id, r.chosen.i, r.rejected.i, r.kind) for r in got] == [("a", 0, 1, "fabrication")]


def test_reward_pairs_compute_candidates_once(spark, cand):
    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = selection.reward_pairs(cand.mapInArrow(once, cand.schema)).collect()
    assert [(r.record_id, r.chosen.i, r.rejected.i, r.kind) for r in got] == [("a", 0, 1, "fabrication")]
    assert seen.value == cand.count()


def test_human_pairs_ties(spark, cand):
    ratings = spark.createDataFrame([("a", 0, "x", 2), ("a", 1, "x", 2), ("a", 2, "x", 4), ("b", 0, "x", 3), ("b", 1, "x", 3), ("c", 0, "x", 5)], "record_id string, candidate_i int, annotator string, overall int")
    got = selection.human_pairs(cand, ratings).collect()
    assert [(r.record_id, r.chosen.i, r.rejected.i, r.kind) for r in got] == [("a", 2, 0, "low_rated")]
    assert [(r.chosen.i, r.rejected.i) for r in selection.human_pairs(cand, ratings, min_gap=0).where("record_id = 'b'").collect()] == [(1, 0)]


def test_authored_pairs(spark, cand):
    mine = spark.createDataFrame([("a", "h", 5, " good "), ("b", "h", 4, "u0"), ("z", "h", 4, "x"), ("a", "k", None, " ")], "record_id string, author string, confidence int, text string")
    got = {(r.record_id, r.author): (r.chosen, r.rejected, r.kind) for r in selection.authored_pairs(cand, mine).collect()}
    assert got == {("a", "h"): ("good", "t1", "human_vs_machine"), ("b", "h"): ("u0", None, "sft_only")}


def test_judge_pairs(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", 0.5), ("a", "y", 0.1)], "record_id string, text string, judge double")
    assert sorted((r.chosen, r.rejected) for r in selection.judge_pairs(rows).collect()) == [("y", "x"), ("y", "z")]


def test_gate_curve(cand):
    assert [r.records for r in selection.gate_curve(cand).orderBy("gate").collect()] == [2, 2, 2, 2, 3]


def test_attempts(spark):
    tries = spark.createDataFrame([("a", 1, "no", False), ("a", 2, "yes", True), ("a", 3, "late", True), ("b", 1, "", True)], "record_id string, attempt int, text string, accepted boolean")
    base = spark.createDataFrame([("a", "ta"), ("b", "tb"), ("c", "tc")], "record_id string, text string")
    assert {r.record_id: (r.text, r.source) for r in selection.attempts(tries, base).collect()} == {"a": ("yes", "llm"), "b": ("tb", "template"), "c": ("tc", "template")}


def test_kto(spark):
    pairs = spark.createDataFrame([("p", "good", "flat"), ("p", "good", "false"), ("p", "good", "false")], "prompt string, chosen string, rejected string")
    assert sorted((r.completion, r.label) for r in datasets.kto(pairs).collect()) == [("false", False), ("false", False), ("flat", False), ("good", True)]
    assert datasets.equal_pairs(pairs).head()[0] == 0
    ok, bad = datasets.sound(pairs.unionByName(spark.createDataFrame([("p", " ", "x")], pairs.schema)))
    assert (ok.count(), bad.count()) == (3, 1)


def test_lengths(spark):
    rows = spark.createDataFrame([("a",), ("a b",), ("a b c d",), ("a b c d e f",)], "t string")
    assert datasets.lengths(rows, "t").head().asDict() == {"shortest": 1, "median": 3.0, "upper_median": 4, "longest": 6}


def test_spearman_with_ties_and_constants(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 2.0), ("a", float("nan"), 9.0)], "g string, x double, y double")
    got = {r.g: (r.n, r.rho) for r in agreement.spearman(rows, ["g"], "x", "y").collect()}
    assert got["a"][0] == 3 and abs(got["a"][1] - 0.8660254) < 1e-6 and got["b"] == (2, None) and got["c"] == (1, None)


def test_top_pick_counts_flat_records(spark):
    scores = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 1.0), ("c", 0, 1.0)], "record_id string, i int, r double")
    ratings = spark.createDataFrame([("a", 0, "x", 1.0), ("a", 1, "x", 3.0), ("b", 0, "x", 1.0), ("b", 1, "x", 2.0), ("c", 0, "x", 1.0)], "record_id string, i int, annotator string, rating double")
    assert agreement.top_pick_agreement(scores, ratings, ["r"]).head().asDict() == {"reward": "r", "hits": 1, "records": 2, "flat": 1}


def test_precision_recall(spark):
    f = lambda a, b: spark.range(1).select(agreement.precision_recall(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")).alias("r")).head()["r"].asDict()
    assert f([], []) == {"precision": 1.0, "recall": 1.0, "f1": 1.0}
    assert f(["a", "a", "b"], ["a"]) == {"precision": 0.5, "recall": 1.0, "f1": 2 / 3}
    assert f([], ["a"]) == {"precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_failing_scorer_gives_null(spark):
    @scoring.scorer("broken")
    def broken():
        def score(pairs):
            raise RuntimeError("no model")

        return score

    got = scoring.scored_pairs(spark.createDataFrame([("p", "c")], "premise string, claim string"), "broken").head()
    assert got.entail is None and "no model" in got.error
    with pytest.raises(ValueError):
        scoring.scored_pairs(spark.range(1).selectExpr("'a' AS premise", "'b' AS claim"), "unknown")


def test_chat_tries_again(spark):
    def call():
        seen = []

        def ask(prompt):
            seen.append(prompt)
            if len(seen) < 2:
                raise OSError("later")
            return prompt.upper()

        return ask

    got = scoring.chat_column(spark.createDataFrame([("a",)], "p string"), "p", "answer", call, wait=0).head()
    assert (got.answer, got.answer_status) == ("A", "ok")
