import pytest
from pyspark.sql import functions as F

from inkwell.operators import flows, retrieval
from inkwell.plans import catalogue, library
from inkwell.sources import synthetic


@pytest.fixture(scope="module")
def scored(spark):
    cands = synthetic.grid(spark).where("register = 'testimony'").select(F.col("case_id").alias("record_id"), F.when(F.col("profile") == "good", 0).when(F.col("profile") == "flattened", 1).otherwise(2).alias("i"), "text")
    return flows.scored_candidates(cands, synthetic.records(spark)).cache()


def test_prompts(spark):
    rows = {r.id: r for r in flows.open_book_prompts(synthetic.records(spark)).collect()}
    p = rows["synth_case_001"].prompt
    assert "about Marta Hellinger, in the style of testimony" in p and "Excerpt: Marta Hellinger was" in p and p.endswith("MICRO-NARRATIVE:")


def test_scores_and_picks(scored):
    rows = {(r.record_id, r.i): r for r in scored.collect()}
    assert len(rows) == 24
    assert all(rows[c, 0].F == 1 and rows[c, 2].unsup > 0 for c, i in rows if i == 0)
    assert all(rows[c, 0].guard_reason == "copy" for c, i in rows if i == 0)  # the good text is the source
    picks = flows.best_of_n(scored, guarded=False).collect()
    assert all(r.pick_composite == 0 for r in picks) and flows.divergence(flows.best_of_n(scored, guarded=False)).head().records == 8
    assert "F=" in flows.score_line(scored, ["record_id", "i"]).head().line
    assert flows.diagnostics(scored).head().rows == 24 and flows.mean_row(scored).head().F < 1


def test_training_rows(spark, scored):
    prompts = flows.open_book_prompts(synthetic.records(spark))
    sft, pairs = flows.training_rows(scored, prompts)
    assert sft.count() == pairs.count() > 0 and all(r.completion.startswith(" ") for r in sft.collect())
    ratings = spark.createDataFrame([("synth_case_001", 0, "a", 5), ("synth_case_001", 2, "a", 1)], "record_id string, candidate_i int, annotator string, overall int")
    _, human = flows.training_rows(scored, prompts, "human", ratings=ratings)
    assert [r.kind for r in human.collect()] == ["fabrication"]
    mine = spark.createDataFrame([("synth_case_002", "h", 5, "Text.")], "record_id string, author string, confidence int, text string")
    sft, _ = flows.training_rows(scored, prompts, "authored", authored=mine)
    assert [r.completion for r in sft.collect()] == [" Text."]
    with pytest.raises(ValueError):
        flows.training_rows(scored, prompts, "other")


def test_three_methods(spark):
    df = spark.createDataFrame([(1, "In Graz Anna met Otto in 1938.", ["Anna met Otto in Graz."], "Anna", ["anna", "graz"], ["1938"])], "k int, text string, premises array<string>, subject string, attested_words array<string>, attested_years array<string>")
    assert flows.faithfulness(df, ["k"]).head().unsupported == 1
    assert flows.faithfulness(df, ["k"], "nli").head().status == "scored"
    answer = flows.faithfulness(df, ["k"], "llm", judge=lambda: lambda p: 'so {"unsupported": 1, "total": 4}', wait=0).head()
    assert (answer.F, answer.unsupported, answer.status) == (0.75, 1, "scored")
    assert flows.faithfulness(df, ["k"], "llm", judge=lambda: lambda p: "no idea", wait=0).head().status == "fallback:lexical"
    with pytest.raises(ValueError):
        flows.faithfulness(df, ["k"], "other")


def test_reward_by_case(spark, sf):
    rows = {r.completion_id: r for r in catalogue.QUERIES["reward_by_case"](spark, sf).collect()}
    grid = {f"{r.case_id}-{r.register}-{r.profile}": r.composite for r in catalogue.scored_grid(spark).collect()}
    assert {k: r.reward for k, r in rows.items()} == grid
    unknown = spark.createDataFrame([("x", "none", "text")], "completion_id string, case_id string, text string")
    assert flows.reward_by_case(unknown, synthetic.grid(spark)).head().total == 0


def test_reports(spark):
    rows = spark.createDataFrame([("good", 1.0, 0), ("good", 0.5, 2), ("fabricated", 0.5, 1), ("flattened", 1.0, 0)], "style string, F double, unsup int")
    assert {r.style: r.accepted for r in flows.acceptance(rows).collect()} == {"good": 1, "fabricated": 1, "flattened": 1}
    assert flows.label_balance(spark.createDataFrame([(True,), (False,), (False,)], "label boolean")).where("NOT label").head().rows == 2


def _six():
    return lambda prompt: '{"score": 6}' if "RECORD" in prompt else ""


def test_rewards_by_case_of_every_kind(spark):
    g = synthetic.grid(spark).withColumn("record", F.col("blob"))
    done = g.select(F.concat_ws("-", "case_id", "register", "profile").alias("completion_id"), "case_id", "text")
    cases = g.select("case_id", "blob", "facts", "salient", "references", "record").dropDuplicates(["case_id"])
    human = {r.completion_id: r.reward for r in flows.reward_by_case(done, cases, "human").collect()}
    wins = [human[f"{k}-good"] > human[f"{k}-fabricated"] for k in {x.rpartition("-")[0] for x in human}]
    assert len(wins) == 16 and all(wins)
    assert {r.reward for r in flows.reward_by_case(done, cases, "judge", judge=_six, tries=1, wait=0.0).collect()} == {6.0}
    with pytest.raises(ValueError):
        flows.reward_by_case(done, cases, "other")
    with pytest.raises(ValueError):
        flows.reward_by_case(done, cases, "judge")


def test_prompts_of_cases(spark):
    rows = flows.case_prompts(synthetic.cases(spark), synthetic.entity(F.col("focal"))["name"], synthetic.case_block()).collect()
    assert len(rows) == 16 and {r.register for r in rows} == {"testimony", "finding_aid"} and all("Focal: " in r.prompt for r in rows)


def test_downstream_and_extractor(spark):
    df = spark.createDataFrame([(1, "Then Anna met Josef in Vienna in 1938. Later Anna left."), (2, "")], "id long, text string")
    got = {r.id: r.downstream for r in flows.downstream(df, ["id"], "text").collect()}
    assert got[1] == 1.0 and got[2] == 1.0  # nothing in the off-record statement is attested
    names = flows.extracted(df, "text", flows.name_extractor, tries=1, wait=0.0).orderBy("id").head().extraction.entities
    assert [e.entity_text for e in names] == ["Anna", "Josef", "Vienna"]


def _broken():
    raise OSError("no model")


def test_encoder_and_its_fallback(spark):
    text = "The red house stood by the old mill. A miller lived there with two sons. The red house burned in that winter."
    df = spark.createDataFrame([(1, text, "red house winter")], "id long, text string, q string")
    lexical = retrieval.top_sentences(df, "text", "q", 2).head().retrieved
    assert retrieval.top_encoded(df, "text", "q", 2, _broken).head().retrieved == lexical == retrieval.top_encoded(df, "text", "q", 2).head().retrieved
    near = retrieval.top_encoded(df, "text", "q", 3, library._letters).head().retrieved
    assert len(near) == 3 and [r.score for r in near] == sorted((r.score for r in near), reverse=True)


def test_vectors_in_several_passes(spark):
    from inkwell.operators import retrieval

    v = spark.createDataFrame([(k, [float(k % 7), float(k % 3), 1.0]) for k in range(90)] + [(5, [5.0, 2.0, 1.0]), (99, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    q = v.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = lambda most: sorted(map(tuple, retrieval.top_vectors(v, q, 4, most).drop("similarity").collect()))
    assert rows(1000) == rows(3) and len(rows(1000)) == 80


def test_ranks_in_ranges(spark):
    from inkwell.operators import agreement

    rows = [("a" if k % 4 else "b", float(k * 37 % 101 // 2)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, x double")
    for parts in (2, 64):
        got = {(r.g, r.x): r.rank for r in agreement.average_ranks(df, ["g"], "x", "rank", parts).collect()}
        for g in "ab":
            xs = sorted(x for h, x in rows if h == g)
            assert all(got[g, x] == xs.index(x) + (xs.count(x) + 1) / 2 for x in set(xs))


def _plain_rho(x, y):
    rank = lambda v: [sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v]
    p, q = ([r - (len(x) + 1) / 2 for r in rank(v)] for v in (x, y))
    spread = (sum(r * r for r in p) * sum(r * r for r in q)) ** 0.5
    return round(sum(r * s for r, s in zip(p, q, strict=True)) / spread, 9) if spread else None


def test_annotators_in_blocks(spark):
    """Blocks, tiles and annotators too wide for a block give what plain loops give; repeats count by their mean, null and NaN not at all."""
    from inkwell.operators import agreement

    rows = [(f"n{a}", i, float((a * 7 + i * i * (1 + a % 3)) % 5)) for a in range(12) for i in range(8 + 30 * (a in (3, 9))) if (a + i) % 4]
    rows += [("n1", 2, 9.0), ("n1", 2, 0.0), ("n2", 3, float("nan")), (None, 1, 1.0), ("n4", 5, None), ("flat", 0, 1.0), ("flat", 1, 1.0), ("flat", 2, 1.0), ("flat", 3, 1.0), ("alone", 99, 1.0)]
    df = spark.createDataFrame(rows, "annotator string, item int, rating double").withColumn("low", F.lit(1)).withColumn("tile", F.lit("x"))
    seen = {}
    for a, i, r in rows:
        if a is not None and r is not None and r == r:
            seen.setdefault(a, {}).setdefault(i, []).append(r)
    mean = {a: {i: sum(r) / len(r) for i, r in x.items()} for a, x in seen.items()}
    want = {}
    for a in mean:
        for b in mean:
            common = sorted(mean[a].keys() & mean[b].keys())
            if a < b and len(common) >= 3:
                want[a, b] = len(common), _plain_rho([mean[a][i] for i in common], [mean[b][i] for i in common])
    for block, most, tile in ((100, 10**6, 1000), (3, 10**6, 4), (5, 120, 3), (100, 60, 10)):
        got = {(r.a, r.b): (r.n, None if r.rho is None else round(r.rho, 9) + 0.0) for r in agreement.annotator_pairs(df, ["item"], 3, block, most, tile).collect()}
        assert got == want, (block, most, tile)
    assert len(want) > 40 and agreement.annotator_pairs(df.where("false"), ["item"]).collect() == []


def _picky():
    """Letters, but no text with an x, and no more than four texts to a call."""
    count = library._letters()

    def model(xs):
        if len(xs) > 4 or any("x" in t for t in xs):
            raise ValueError("too much")
        return count(xs)

    return model


def test_copies_of_annotators_count_without_pairs(spark, monkeypatch):
    """Copies of raters give what all pairs give, though only one rater of each class is ranked."""
    import random

    from inkwell.operators import agreement

    r = random.Random(5)
    base = {f"{k}": [(f"i{i}", 3 if k == 0 else r.randint(1, 5)) for i in range(12) if k == 0 or r.random() < 0.8] for k in range(4)} | {"few": [("i0", 1), ("i1", 2)]}
    rows = [(f"{name}-{c}", i, v) for name, held in base.items() for c in range(4) for i, v in held]
    df = spark.createDataFrame(rows, "annotator string, item string, rating int")
    want = agreement.annotator_pairs(df, ["item"]).agg(F.count("*"), F.avg("rho"), F.min("rho"), F.max("rho")).head()
    met, real = [], agreement.annotator_pairs
    monkeypatch.setattr(agreement, "annotator_pairs", lambda ratings, *a: met.append(ratings.select("annotator").distinct().count()) or real(ratings, *a))
    got = agreement.inter_annotator(df, ["item"]).head()
    assert met == [5] and got[0] == want[0] and all(abs(x - y) < 1e-12 for x, y in zip(got[1:], want[1:], strict=True))
    none = agreement.inter_annotator(df.where("false"), ["item"]).head()
    assert tuple(none) == (0, None, None, None)


def test_pairs_of_annotators_stay_in_their_tasks(spark, tmp_path, monkeypatch):
    """Annotators that all differ: nothing written or shuffled grows with their pairs, wide ones excepted, and the sums are those of the pairs."""
    import random
    import uuid
    from pathlib import Path

    from inkwell.operators import agreement

    r = random.Random(7)
    rows = [(f"n{a}", i, float(r.randint(1, 9 if a else 1))) for a in range(120) for i in r.sample(range(16), 12)]
    df = spark.createDataFrame(rows, "annotator string, item int, rating double")
    want = agreement.annotator_pairs(df, ["item"]).agg(F.count("*"), F.avg("rho"), F.min("rho"), F.max("rho")).head()
    monkeypatch.setattr(agreement.files, "folder", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    got = agreement.inter_annotator(df, ["item"]).head()
    written = [spark.read.parquet(f"file://{x}").count() for top in Path(tmp_path).iterdir() for x in top.iterdir()]
    assert got[0] == want[0] == 120 * 119 // 2 and all(abs(x - y) < 1e-12 for x, y in zip(got[1:], want[1:], strict=True))
    assert written and max(written) <= len(rows)
    ones = df.withColumn("w", F.lit(2))
    for most in (10**6, 80):  # 80: all are wide
        at = agreement.annotator_pairs(ones, ["item"], 3, 100, most, 10, "w").agg(F.sum("n"), F.sum("total"), F.sum("some"), F.min("low"), F.max("high")).head()
        assert at[0] == 4 * want[0] and at[2] == 4 * 119 * 118 // 2 and all(abs(x - y) < 1e-12 for x, y in zip((at[1] / at[2], at[3], at[4]), want[1:], strict=True))


def test_ranks_by_signs_and_by_sorting(monkeypatch):
    """Both ways to rank give what plain loops give, within a block and between two, over more annotators than are taken at once."""
    import random

    import pyarrow as pa

    from inkwell.operators import agreement

    r = random.Random(3)
    held = [dict.fromkeys(sorted(r.sample(range(30), r.randint(0, 14)))) for _ in range(40)]
    held = [{i: r.randint(1, 4 if k % 5 else 1) for i in x} for k, x in enumerate(held)]
    monkeypatch.setattr(agreement, "LINES", 7)
    monkeypatch.setattr(agreement, "COLUMNS", 5)
    monkeypatch.setattr(agreement, "AT_ONCE", 50)
    for low, high in ((0, 0), (0, 1)):
        second = [low != high and k % 3 == 0 for k in range(40)]
        rows = pa.table({"annotator": list(range(40)), "w": [1.0] * 40, "items": pa.array([list(x) for x in held], pa.list_(pa.int16())), "ranks": pa.array([list(x.values()) for x in held], pa.list_(pa.int16())), "low": [low] * 40, "high": [high] * 40, "second": second})
        want = {}
        for a in range(40):
            for b in range(a + 1, 40):
                common = sorted(held[a].keys() & held[b].keys())
                if len(common) >= 3 and (low == high or second[a] != second[b]):
                    want[a, b] = len(common), _plain_rho([held[a][i] for i in common], [held[b][i] for i in common])
        for few in (512, 0):
            monkeypatch.setattr(agreement, "FEW_ITEMS", few)
            got = {(min(x["x"], x["y"]), max(x["x"], x["y"])): (x["n"], None if x["rho"] is None else round(x["rho"], 9) + 0.0) for x in agreement._listed(rows, 3).to_pylist()}
            assert got == want, (low, high, few)


def test_encoder_by_batch(spark):
    """A text that the encoder fails on sends its own row to the fallback and no other."""
    one = "The mill stood by the river for years. The river ran past the old mill. Nobody ever wrote about it again."
    rows = [(1, one, "the river mill"), (2, one + " An exile came back here later.", "the river mill"), (3, None, "q"), (4, one, None), (5, one, "the river mill")]
    df = spark.createDataFrame(rows, "id long, text string, q string").repartition(1)
    lexical = {r.id: r.retrieved for r in retrieval.top_encoded(df, "text", "q", 2).collect()}
    plain = {r.id: r.retrieved for r in retrieval.top_encoded(df, "text", "q", 2, library._letters).collect()}
    for at_once in (4, 256):
        got = {r.id: r for r in retrieval.top_encoded(df, "text", "q", 2, _picky, at_once).collect()}
        assert {i: r.retrieved_status for i, r in got.items()} == {i: retrieval.FALLBACK if i == 2 else retrieval.ENCODED for i in range(1, 6)}
        assert got[2].retrieved == lexical[2] and all(got[i].retrieved == plain[i] for i in (1, 3, 4, 5))
    assert {r.retrieved_status for r in retrieval.top_encoded(df, "text", "q", 2, _broken).collect()} == {retrieval.FALLBACK}
    assert retrieval.top_encoded(df.where("false"), "text", "q", 2, _picky).collect() == []
