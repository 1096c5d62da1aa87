"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables, both sides of every bound."""

import bisect
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import alignment, divergence, pivots
from tests.llm.test_operators import CLASH, texts

# ---- 11 --------------------------------------------------------------------------------------------------------------


def brute_top(rows, every, k):
    held = defaultdict(list)
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held[i].append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = {}
    for q in held:
        if q % every == 0:
            best = sorted((-max(score(a, b) for a in held[q] for b in held[c]), c) for c in held if c != q)[:k]
            out[q] = [(c, -s) for s, c in best]
    return {q: x for q, x in out.items() if x}


def vectors(spark, n, width, seed, more=()):
    r = random.Random(seed)
    rows = [(i, [r.uniform(-1, 1) for _ in range(width)]) for i in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(30)]  # copies, which tie
    rows += [*more]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "d", "cell", "query_id", "score", "rank", "query", "label")})
    return rows, df.repartition(5)


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


ODD = [(1000, None), (1001, [0.5, None]), (1002, [float("nan"), 0.1]), (1050, [float("inf")]), (None, [0.5, 0.5]), (1100, []), (1150, [0.25]), (1200, [0.0] * 9), (50, [0.9] * 8), (50, [0.9] * 8), (7, [0.3] * 8)]


@pytest.mark.parametrize("settings", [{}, {"pivots": 1, "sample": 3}, {"pass_bytes": 500}, {"pivots": 200, "k": 40}, {"k": 1000}])
def test_top_scores(spark, settings):
    rows, df = vectors(spark, 300, 8, 1, ODD + [rows_again for rows_again in [(11, [0.125] * 8)] * 50])
    assert found(pivots.top_scores(df, **settings)) == brute_top(rows, 50, settings.get("k", 5))


def test_top_scores_few_and_none(spark):
    rows, df = vectors(spark, 300, 8, 2)
    assert pivots.top_scores(df.where("false")).collect() == [] and pivots.top_scores(df.where("vec_id = 50")).collect() == []
    assert pivots.top_scores(df.where("vec_id % 50 <> 0")).collect() == []
    assert found(pivots.top_scores(df.where("vec_id IN (50, 51)"))) == brute_top([r for r in rows if r[0] in (50, 51)], 50, 5)
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(120)], "vec_id long, embedding array<float>")
    assert found(pivots.top_scores(same)) == {q: [(c, 2 * 128 * 128) for c in range(6) if c != q][:5] for q in (0, 50, 100)}
    zero = spark.createDataFrame([(i, []) for i in range(3)], "vec_id long, embedding array<float>")
    assert found(pivots.top_scores(zero)) == {0: [(1, 0), (2, 0)]}


def test_large_components(spark):
    """Products beyond 53 bits stay exact; beyond 62 they are refused."""
    big = [(0, [3.0e5, 1.0, -7.5e4]), (1, [2.99e5, 1.5, 1.0]), (2, [3.0e5, 1.0, 5.5e4]), (3, [3.0e5, 1.25, 5.5e4])]
    big = [(i, [x * 2 for x in v]) for i, v in big]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    assert found(pivots.top_scores(df)) == brute_top([(i, [float(x) for x in v]) for i, v in big], 50, 5)
    with pytest.raises(ValueError, match="64 bits"):
        pivots.top_scores(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"))


def test_pivots_rule_candidates_out():
    """In clusters most candidates are never multiplied, and a far batch isn't looked at; the bound never lies below a score."""
    r = np.random.default_rng(5)
    centres = r.integers(-2000, 2000, (20, 16))
    x = (centres[np.arange(4000) % 20] + r.integers(-20, 20, (4000, 16))).astype(np.int64)
    space = pivots.Space(x[:500], float((x * x).sum(axis=1).max()), 24)
    d, ids = space.distances(space.lifted(x)), np.arange(4000)
    order = np.argsort(d.argmin(axis=1), kind="stable")
    q = ids[::50]
    near = d_of(space, x[q])
    least = np.array([pivots.kth(s, ids[:500], i, 5) for s, i in zip(x[q] @ x[:500].T, q, strict=True)])
    search = pivots.Search(q, x[q], near, least, space, 5)
    for at in range(0, 4000, 400):
        some = order[at : at + 400]
        search.take(ids[some], x[some], d[some])
    assert search.products < 0.2 * len(q) * 4000
    for k, i in enumerate(q):
        s = x @ x[i]
        assert (space.ceiling(search.squared[k], np.abs(d - near[k]).max(axis=1)) >= s).all()
        want = sorted((-int(v), j) for j, v in enumerate(s) if j != i)[:5]
        assert list(zip((-search.found[k][0]).tolist(), search.found[k][1].tolist(), strict=True)) == want


def d_of(space, x):
    return space.distances(np.column_stack([x.astype(float), np.zeros(len(x))]))


def test_matrix_fills_up():
    got = pivots.matrix(pa.array([[1, 2], [], [3, 4, 5]], pa.list_(pa.int64())), 3)
    assert got.tolist() == [[1, 2, 0], [0, 0, 0], [3, 4, 5]]


# ---- 12 --------------------------------------------------------------------------------------------------------------

ALIGN = [None, "", " ", "  ", "a", "a ", " a", "a  b", "tab\tand\r\nlines \n end", "né 漢字漢字 ありがとう", "don't <|endoftext|> it's <s> </s> <unk> <0x41>", "a literal ▁ mark", "nul \x00 and \x07", "x" * 3000, "wher. " * 300, "é ﬁ   　 ½", "👩‍👩‍👧 smile 🙂🙂", "12 345 6,789.01 - -- ---", "Āɐ ok", "…  — “quoted” »so«"]


def brute_alignment(rows, links):
    t = alignment.tokenizers_of(*alignment.default_files())
    each = []
    for text in rows:
        raw = (" " + (text or "")).encode()
        a, b = (t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)) if text else ([], [])
        if not text or b"".join(t.bytes_a[i] for i in a) != raw or b"".join(t.bytes_b[i] for i in b) != raw:
            each.append(None)
            continue
        spans = []
        for ids, size in ((a, t.size_a), (b, t.size_b)):
            ends = np.cumsum(size[ids]).tolist()
            spans.append(list(zip([0, *ends], ends, ids, strict=False)))
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[], []] for _ in shared]
        for side, s in enumerate(spans):
            for x in s:
                groups[bisect.bisect_left(shared, x[1])][side].append(x)
        if links == "ends":
            ending = {e: i for _, e, i in spans[1]}
            pairs = [(i, ending[e]) for _, e, i in spans[0] if e in ending]
        elif links == "overlaps":
            pairs = [(x[2], y[2]) for g in groups for x in g[0] for y in g[1] if x[0] < y[1] and y[0] < x[1]]
        else:
            pairs = [(x[2], y[2]) for g in groups for x in g[0] for y in g[1]]
        shown = ";".join("|".join(",".join(str(x[2]) for x in s) for s in g) for g in groups)
        each.append((len(a), len(b), len(groups), pairs, hashlib.sha256(shown.encode()).hexdigest()))
    counts = Counter(p for x in each if x for p in x[3])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(x[0], x[1], x[2], len(x[3]), sum(counts[p] == top[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) if x else (0, 0, 0, 0, 0, 0, "") for x in each]


@pytest.mark.parametrize(("links", "hot"), [("ends", 1 << 16), ("ends", 8), ("overlaps", 100), ("groups", 1 << 16)])
def test_alignment(spark, links, hot):
    rows = [*ALIGN, *(x for x in texts() if not x or len(x) < 20_000), *["the same row again and again"] * 40]
    df = spark.createDataFrame([(k if k != 5 else None, x) for k, x in enumerate(rows)], "doc_id long, text string").withColumns({c: F.lit(7) for c in [*CLASH, "keys", "times", "groups", "key", "count", "best", "n_a", "lang"]})
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.token_alignment(df.repartition(3), links=links, hot=hot).collect()}
    assert len(got) == len(rows)
    for k, want in enumerate(brute_alignment(rows, links)):
        assert got[k if k != 5 else None] == want, rows[k]
    assert alignment.token_alignment(df.where("false")).collect() == []


def test_alignment_of_repeated_and_long_rows(spark):
    long = " ".join(random.Random(1).choice(["the", "word", "Straße", "naïve", "x1,", "end.\n"]) for _ in range(50_000))
    df = spark.createDataFrame([(3, "one two three")] * 3 + [(4, long)], "doc_id long, text string")
    got = alignment.token_alignment(df).collect()
    (want,) = set(brute_alignment(["one two three"], "ends"))
    assert len(got) == 4 and all(r.count_sum == 3 * want[5] for r in got if r.doc_id == 3)
    assert next(r for r in got if r.doc_id == 4).groups_sha256 == brute_alignment([long], "ends")[0][6]


def test_alignment_itself(spark):
    """The operator's own result are the groups; cutting texts into pieces changes nothing."""
    t = alignment.tokenizers_of(*alignment.default_files())
    (r,) = alignment.alignments(spark.createDataFrame([(1, "Straße naïve  tokens don't")], "doc_id long, text string")).collect()
    a, b = (";".join(r.groups.split(";")).replace("|", ";").split(";")[k::2] for k in (0, 1))
    raw = lambda parts, table: b"".join(table[int(i)] for x in parts for i in x.split(","))
    assert raw(a, t.bytes_a) == raw(b, t.bytes_b) == " Straße naïve  tokens don't".encode() and sum(r.times) == r.n_links == r.n_groups
    with pytest.raises(ValueError, match="no such links"):
        alignment.Aligner(t, "nearly")


def result(work, rows):
    sizes, groups, ends, keys, times = work(rows)
    sums = [times[low:high].sum() for low, high in zip([0, *ends], ends, strict=False)]
    assert sums == sizes[3].tolist() and len(keys) == len(times) == (ends[-1] if len(ends) else 0)
    return [(*x, hashlib.sha256(g.encode()).hexdigest() if g else "") for *x, g in zip(*sizes.tolist(), groups, strict=True)]


@pytest.mark.parametrize("links", alignment.LINKS)
def test_alignment_with_a_full_table(monkeypatch, links):
    """Forgetting, long pieces and those encoded together change nothing."""
    for name, value in {"MOST_KEPT": 30, "KEPT_CHARS": 6, "NEW": 7, "TOGETHER": 3}.items():
        monkeypatch.setattr(alignment, name, value)
    work, r = alignment.Aligner(alignment.tokenizers_of(*alignment.default_files()), links), random.Random(4)
    words = [w for x in ALIGN if x for w in x.split(" ")] + ["the", "of", "Ende.\nUnd", "naïve,", "été", "▁", "a▁b", "  ", "\n"]
    rows = [x or "" for x in ALIGN] + [" ".join(r.choices(words, k=r.randint(1, 12))) for _ in range(300)]
    want = [(*x[:4], x[6]) for x in brute_alignment(rows, links)]
    assert result(work, ["", ""]) == [(0, 0, 0, 0, "")] * 2
    for _ in range(3):
        some = r.sample(range(len(rows)), 40)
        assert result(work, [rows[k] for k in some]) == [want[k] for k in some]
    assert result(work, rows) == want


def test_alignment_keeps_the_most_used(monkeypatch):
    """A full table forgets rare pieces only, and long ones leave nothing behind."""
    monkeypatch.setattr(alignment, "MOST_KEPT", 40)
    work, seen, plain = alignment.Aligner(alignment.tokenizers_of(*alignment.default_files()), "ends"), Counter(), alignment.align
    monkeypatch.setattr(alignment, "align", lambda t, pieces, links: seen.update(pieces) or plain(t, pieces, links))
    for k in range(50):
        list(work([f"the of and the of and rare{k} seldom{k}x " + "漢字" * 500]))
    assert [seen[x] for x in (" the", " of", " and")] == [1, 1, 1] and seen[" rare0"] == 1
    assert len(work.kept.shown) == len(work.kept.row) <= 45 and max(map(len, work.kept.row)) < 20


def test_alignment_encodes_together(monkeypatch):
    """Pieces that may stand together are one text for A, and few for B, with the ids of each by itself; one that isn't spelled leaves the others so."""
    t, calls = alignment.tokenizers_of(*alignment.default_files()), []
    pieces = [f" {w}{k}{end}" for k in range(100) for w, end in (("über", "ß"), ("the", ","), (" two", ""), ("Ende.\nUnd", "é"))]
    plain = t.encode
    single = [plain([p]) for p in pieces]
    assert plain(pieces, 50) == plain(pieces) == tuple([i for x in single for i in x[k]] for k in (0, 1))
    monkeypatch.setattr(t, "encode", lambda pieces, together=1: calls.append(together) or plain(pieces, together))
    sizes, shown, pairs = alignment.align(t, [*pieces, " a▁b"], "ends")
    assert calls == [alignment.TOGETHER] and sizes[:, -1].tolist() == [-1] * 4 and sizes[:2, :-1].tolist() == [[len(x[k]) for x in single] for k in (0, 1)]
    monkeypatch.setattr(alignment, "MARK", "\0")
    again = alignment.align(t, [*pieces, " a▁b"], "ends")
    assert again[0].tolist() == sizes.tolist() and again[1] == shown and again[2].tolist() == pairs.tolist() and len(calls) < 25


def test_intervals():
    cut = alignment.Intervals(np.array([2, 5, 9]), np.array([3, 5, 6, 9]))
    assert cut.ends.tolist() == [2, 3, 5, 6, 9] and cut.closed.tolist() == [5, 9]
    assert [x.tolist() for x in cut.links("overlaps")] == [[0, 1, 1, 2, 2], [0, 0, 1, 2, 3]]
    assert [x.tolist() for x in cut.links("ends")] == [[1, 2], [1, 3]]
    assert [x.tolist() for x in cut.links("groups")] == [[0, 0, 1, 1, 2, 2], [0, 1, 0, 1, 2, 3]]


# ---- 13 --------------------------------------------------------------------------------------------------------------


def brute_divergence(rows, least, top):
    docs = [(a or "", b or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]) for t, a, b in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        of = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in of.items() if n >= least}
        count = defaultdict(Counter)
        for _, source, words in mine:
            count[source].update(w for w in words if w in kept)
        whole = sum(count.values(), Counter())
        share = lambda c, w, v=len(kept): 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * v)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in count:
            pair = [(x, sum(f(share(count[s], w), share(count[x], w)) for w in kept)) for x in count if x != s]
            term = [(w, f(share(count[s], w), share(whole, w))) for w in kept if count[s][w] and share(count[s], w) > share(whole, w)]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def sources(spark):
    r = random.Random(9)
    words = ["Alpha", "beta", "gamma's", "Größe", "ÄRGER", "x1y", "the", "漢字", "e-mail", "zé", "ſt", "\U0001f642"]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", "\U00010000", "￿", "", None])) for _ in range(250)]
    rows += [(None, "fr", "only"), ("", "fr", None), ("word " * 5000, "en", "a"), ("1 2 3", "it", "none")] + [("same same row", "en", "b")] * 60
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(7) for c in [*CLASH, "doc_id", "term", "n", "docs", "total", "tile", "tiles", "block", "blocks", "v", "item", "value", "rank", "group_n"]})
    return rows, df.repartition(4)


@pytest.mark.parametrize(("least", "settings"), [(10, {}), (3, {"block_terms": 2}), (1, {"tile_groups": 2, "block_terms": 3}), (10, {"tile_groups": 1}), (10_000, {"tile_groups": 2}), (2, {"top": 1})])
def test_divergence(sources, least, settings):
    rows, df = sources
    got = sorted(tuple(r) for r in divergence.source_divergence(df, least, **settings).collect())
    assert got == brute_divergence(rows, least, settings.get("top", 10))


def test_divergence_of_nothing(sources):
    assert divergence.source_divergence(sources[1].where("false")).collect() == []


def test_terms_in_stretches(monkeypatch):
    text = "Aé b2c, " * 500 + "d" * 5000 + " End"
    want = [w.translate(divergence.LOWER) for w in divergence.TERM.findall(text)]
    for stretch in (1, 7, 64):
        monkeypatch.setattr(divergence, "STRETCH", stretch)
        assert [w for some in divergence.terms(text) for w in some] == want


def test_shares_are_exact():
    """Also where 10^9 times the count runs over 64 bits."""
    r = random.Random(4)
    for _ in range(300):
        total = r.randint(0, 10 ** r.randint(1, 15))
        count, kept = r.randint(0, total), r.randint(1, 10**6)
        got = divergence.shares(np.array([count]), np.array([total]), np.int64(kept))[0]
        assert got == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def test_counts_are_handed_on_when_many_are_held(sources, monkeypatch):
    rows, _ = sources
    monkeypatch.setattr(divergence, "MOST_HELD", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([x or "" for x in c], pa.string()) for c in zip(*[(b, c, a) for a, b, c in rows], strict=True)], ["lang", "source", "text"])
    out = list(divergence._counts(iter([batch, batch])))
    assert len(out) > 3
    sums = Counter()
    for b in out:
        for lang, _, term, n, _ in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            sums[lang, term] += n
    assert sums["en", "the"] == 2 * sum((t or "").split().count("the") for t, lang, _ in rows if lang == "en")


@pytest.mark.parametrize("stretch", [1, 2, 3, 50, 1 << 20])
def test_byte_terms_are_the_matches(monkeypatch, stretch):
    """UTF-8 cut at ASCII bytes gives the terms that the pattern finds, whole characters at any stretch."""
    r = random.Random(stretch)
    monkeypatch.setattr(divergence, "STRETCH", stretch)
    for _ in range(500):
        text = "".join(r.choice("aZé🙂 [`{\x7f\x00@Bİß9_\n  ") for _ in range(r.randint(0, 30)))
        assert [x.decode() for some in divergence.byte_terms(text.encode()) for x in some] == [x.translate(divergence.LOWER) for x in divergence.TERM.findall(text)]
