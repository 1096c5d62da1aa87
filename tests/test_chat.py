"""Calls of chat models: pace, back-off, deadlines, and counters of a pass."""

import time

from pyspark.sql import functions as F

from inkwell.operators import flows, scoring


def _slow():
    def ask(p):
        at = time.time()
        time.sleep(0.05)
        return f"{p}!{at}"

    return ask


def test_rate_over_tasks(spark):
    """1000 prompts at 50 ms: one by one they would take 50 s; 250 a second are kept to within 5 %."""
    df = spark.range(2000).select((F.col("id") % 1000).cast("string").alias("p"), "id")
    rows = scoring.chat_column(df, "p", "answer", _slow, at_once=16, per_second=250, tasks=4).select("p", "id", "answer", "answer_status").distinct().collect()
    assert len(rows) == 2000 and {r.answer_status for r in rows} == {"ok"} and all(r.answer.split("!")[0] == r.p for r in rows)
    at = sorted(float(x.split("!")[1]) for x in {r.answer for r in rows})  # the clock is coarse: two calls may have the same time
    assert len(at) == 1000 and 250 * 0.7 < 999 / (at[-1] - at[0]) < 250 * 1.05


def _moody():
    tried = {}

    def ask(p):
        tried[p] = tried.get(p, 0) + 1
        if p.startswith("late"):
            time.sleep(5)
        if p.startswith("bad") or (p.startswith("twice") and tried[p] < 3):
            raise ValueError(p)
        return "" if p.startswith("empty") else p.upper()

    return ask


def test_answers_without_order(spark):
    """What fails for good, what is late and what says nothing has a status; the others' answers don't depend on how many calls are open."""
    df = spark.createDataFrame([(x,) for x in ("late", "bad", "twice", "empty", None, *"abc")], "p string")
    seen = []
    for at_once, tasks in ((1, 1), (8, 3)):
        rows = scoring.chat_column(df, "p", "a", _moody, wait=0.01, at_once=at_once, per_second=500, tasks=tasks, deadline=0.3).collect()
        seen.append({r.p: (r.a, (r.a_status or "").split(":")[0]) for r in rows})
    assert seen[0] == seen[1] and seen[0]["late"] == (None, "failed") and seen[0]["bad"] == (None, "failed") and seen[0]["twice"] == ("TWICE", "ok") and seen[0]["empty"][1] == "empty" and seen[0]["b"] == ("B", "ok")


def test_back_off():
    pace = scoring.Pace(100)
    start = time.monotonic()
    for _ in range(11):
        pace.wait()
    assert 0.09 < time.monotonic() - start < 0.3
    free = scoring.Pace(None)
    free.wait()


def test_counters_of_one_pass(spark):
    status = F.element_at(F.array(*map(F.lit, ("scored", "unscoreable:no-claims", "fallback:lexical", "failed: x", "vague-only"))), (F.col("id") % 5 + 1).cast("int"))
    scored = spark.range(52).select("id", F.when(F.col("id") < 50, status).alias("status"))
    rows, seen = scoring.observed(scored)
    got = {r.status: r.rows for r in flows.diagnostics(scored).collect()}
    assert rows.count() == 52
    assert seen.get == {"rows": 52, "scored": got["scored"], "vacuous": got["unscoreable:no-claims"], "fallback": got["fallback:lexical"], "failed": got["failed: x"]}
