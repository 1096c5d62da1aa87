"""Operator 2: substring dedup by level-wise doubling.

A word is removed where a window of ``window`` words covers it whose word sequence also starts in a document with a
smaller doc_id.  Windows are judged on the input.

Exact copies go first: of equal texts only the one with the smallest doc_id needs to be compared; the others lose every
word if they have a full window, else none.  Rows that repeat a doc_id with its text are compared once, and what goes is
met by all of them, so their number adds to the work as any other row's would.

The levels are the lengths 13, 25 and 50 (the window halved, rounded up, as long as that leaves LEAST words; one halving
at least).  At each level every full window that is still a candidate is stood for by one shorter window within it: at the
first level the one of the smallest hash (winnowing, Schleimer et al. 2003), at each further one that one extended to twice
the length, to its right where that stays within the full window, else to its left.  Which ones these are depends on the
full window's words alone, so equal full windows have equal shorter ones wherever they stand, and none is missed.
What stands in one document alone at one length ends there with the full windows it stands for; what repeats across
documents is extended to twice the length, until the full length is reached or no candidates survive.  Consecutive full
windows with the same shorter ones are kept as one run.

At the full length the stretch of words that a run covers is its hull.  Of each distinct hull the smallest doc_id is
found.  Documents with a larger one lose the whole hull.  What is left to compare is one copy of each distinct hull, and
only where several hulls share their shorter windows: their full windows go out one by one, and each distinct one gets its
smallest doc_id.

So copies, however many, meet in grouped minima with map-side combination, never in a list.  Hashes are 64-bit
polynomials of 64-bit word hashes; a hull is identified by its own and its shorter window's, a window by two with different
bases.  A text is known by doc_id and a hash of 64 bits.

The shuffles: a row of 48 bytes for each run (one in about 12 words), fewer at each level, and the texts of the documents
that have hulls left.  Which texts those are is told by a bitmap that grows with the ids it holds.

Defined results: a null or empty text has no words; a document shorter than a window loses nothing; rows with one doc_id
are one document's parts that are each judged on their own, and never removed for each other; rows without a doc_id are
compared with no other and keep all words; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, marked_ids, scratch, written

#: Odd multipliers of the polynomials.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Words of the shortest windows that halving leads to.
LEAST = 8
U = np.uint64


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.. mod 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.ones(1, dtype=U)
        while len(a) < size:
            a = np.concatenate([a, a * U(pow(b, len(a), 1 << 64))])
        out.append(a)
    return out[0], out[1]


def powers(base: int, n: int):
    return _powers(base, 1 << max(12, n.bit_length()))


class Words:
    """64-bit hashes of words; the table of those already seen is emptied when it is full."""

    def __init__(self, most: int = 200_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=U, count=len(words))


def prefix(h: np.ndarray, base: int) -> np.ndarray:
    up, _ = powers(base, len(h))
    out = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * up[: len(h)], out=out[1:])
    return out


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def spans(p: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans start..end, as if each stood at 0."""
    return mix((p[end] - p[start]) * powers(base, len(p))[1][start])


def lengths(window: int) -> list[int]:
    """Of the levels, ascending; each is at most twice the one before."""
    out = [window]
    while len(out) == 1 or -(-out[0] // 2) >= LEAST:
        out.insert(0, -(-out[0] // 2))
    return out


def smallest(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the rightmost smallest of x[low..high] stands, for each pair of bounds, by minima over doubled widths."""
    at = [np.arange(len(x))]
    depth = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    for k in range(int(depth.max(initial=0))):
        a, b = at[-1][: -(1 << k)], at[-1][1 << k :]
        at.append(np.where(x[b] <= x[a], b, a))
    out = np.empty(len(low), dtype=np.int64)
    for k in range(len(at)):
        here = np.flatnonzero(depth == k)
        a, b = at[k][low[here]], at[k][high[here] - (1 << k) + 1]
        out[here] = np.where(x[b] <= x[a], b, a)
    return out


def runs(h: np.ndarray, window: int) -> list[np.ndarray]:
    """For a document's word hashes: of each run the hash of its shorter window at each level, its hull's, its first full window and their number."""
    p, n = prefix(h, BASE_A), len(h) - window + 1
    start, steps = np.arange(n), lengths(window)
    at = np.arange(len(h) - steps[0] + 1)
    gram = spans(p, BASE_A, at, at + steps[0])
    chosen = smallest(gram, start, start + window - steps[0])
    grams = [(chosen, gram)]
    for shorter, length in zip(steps[:-2], steps[1:-1], strict=True):
        chosen = np.where(chosen + length <= start + window, chosen, chosen + shorter - length)
        at = np.arange(len(h) - length + 1)
        grams.append((chosen, spans(p, BASE_A, at, at + length)))
    new = functools.reduce(np.logical_or, (np.diff(c, prepend=-1) != 0 for c, _ in grams))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    return [*(gram[c[first]] for c, gram in grams), spans(p, BASE_A, first, first + count - 1 + window), first, count]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _run_rows(window: int):
    """The runs of rows (doc_id, key, text)."""
    names = [*(f"g{k}" for k in range(len(lengths(window)) - 1)), "hull", "at", "n", "doc_id", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words()
        for batch in batches:
            made = []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                if len(words) >= window:
                    x = runs(table(words), window)
                    made.append([*x, np.full(len(x[0]), doc_id, dtype=np.int64), np.full(len(x[0]), key, dtype=np.int64)])
            if made:
                *hashes, at, n, ids, keys = (np.concatenate(x) for x in zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([*map(signed, hashes), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(ids), pa.array(keys)], names)

    return run


def _window_rows(window: int):
    """Full windows of the hulls that are left, for rows (doc_id, text, hulls of (hull, at, n))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words()
        for batch in batches:
            made = []
            for doc_id, text, hulls in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                h = table(text.as_py().encode().split())
                hull, at, n = (np.array([x[c] for x in hulls.as_py()], dtype=np.int64) for c in ("hull", "at", "n"))
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(at, n) + offset
                made.append((spans(prefix(h, BASE_A), BASE_A, start, start + window), spans(prefix(h, BASE_B), BASE_B, start, start + window), np.repeat(hull, n), offset.astype(np.int32), np.full(len(start), doc_id, dtype=np.int64)))
            if made:
                w1, w2, hull, offset, ids = (np.concatenate(c) for c in zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([signed(w1), signed(w2), pa.array(hull), pa.array(offset), pa.array(ids)], ["w1", "w2", "hull", "offset", "first"])

    return run


def _outcome(window: int, with_text: bool):
    """(doc_id, n_words, n_removed, kept_sha256, kept) for rows (doc_id, text, copy, gone): runs (at, n) whose windows go, all or those at ``offsets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copy, gone in zip(*(batch.column(k) for k in range(1, 4)), strict=True):
                words = text.as_py().encode().split()
                n, gone = len(words), gone.as_py()
                if n >= window and copy.as_py():
                    words = []
                elif gone:
                    covered = np.zeros(n + 1, dtype=np.int64)
                    for x in gone:
                        first = np.array([0] if x["offsets"] is None else x["offsets"]) + x["at"]
                        np.add.at(covered, first, 1)
                        np.add.at(covered, first + window + (x["n"] - 1 if x["offsets"] is None else 0), -1)
                    keep = np.cumsum(covered[:n]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                left = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
            if out:
                n, removed, digest, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def survivors(rows: DataFrame, levels: int) -> DataFrame:
    """Of runs (g0, g1, .., doc_id, ..) those whose windows repeat across documents at each level, level by level."""
    for k in range(levels):
        repeated = rows.groupBy(f"g{k}").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(f"g{k}")
        rows = written(rows.join(written(repeated, f"substr-level{k}"), f"g{k}"), f"substr-left{k}")
        if rows.isEmpty():
            break
    return rows


def _repeated(sure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, t2) of the texts that a smaller doc_id has too, and of those that several rows of one doc_id hold."""
    mark = sure.select("doc_id", F.col("key").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    groups = mark.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    each = mark.join(written(groups, "substr-equal"), ["t1", "t2"]).groupBy("doc_id", "t1", "t2").agg(F.min("first").alias("first"), F.count("*").alias("rows"))
    each = written(each, "substr-copy")
    out = each.where("doc_id > first").drop("first", "rows"), each.where("doc_id = first AND rows > 1").drop("first", "rows")
    out[0].written_to = each.written_to
    return out


def _repeats(sure: DataFrame, copies: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, gone): the runs of each text whose windows start in a document with a smaller doc_id too."""
    levels = len(lengths(window)) - 1
    schema = "".join(f"g{k} long, " for k in range(levels)) + "hull long, at int, n int, doc_id long, key long"
    judged = marked_ids(sure, copies.select("doc_id").unionByName(repeated.select("doc_id")))
    # Rows that the bitmap stops without being copies are let in by the anti-join; of those that repeat each other one goes on.
    named = F.struct("doc_id", F.col("key").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    again = judged.where("maybe").withColumn("same", named).join(copies.select(F.struct("doc_id", "t1", "t2").alias("same")), "same", "left_anti").dropDuplicates(["same"])
    rows = [written(x.select("doc_id", "key", "text").mapInArrow(_run_rows(window), schema), "substr-runs") for x in (judged.where("NOT maybe"), again)]
    last = f"g{levels - 1}"
    left = survivors(rows[0].unionByName(rows[1]), levels)
    hulls = written(left.groupBy(last, "hull").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("high")), "substr-hulls")

    # One copy of each of several hulls of one shorter window, window by window.
    several = written(hulls.groupBy(last).agg(F.count("*").alias("m")).where("m > 1").select(last), "substr-several")
    several = written(hulls.join(several, last).select(last, "hull", "first"), "substr-several")
    own = left.join(several.withColumnRenamed("first", "doc_id"), [last, "hull", "doc_id"])
    own = written(own.select("doc_id", "key", "hull", "at", "n"), "substr-own")
    one = own.groupBy("doc_id", "hull").agg(F.min(F.struct("key", "at", "n")).alias("x"))
    wanted = written(one.groupBy("doc_id", "x.key").agg(F.collect_list(F.struct("hull", "x.at", "x.n")).alias("hulls")), "substr-wanted")
    texts = marked_ids(sure, wanted.select("doc_id")).where("maybe").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "text")
    windows = texts.join(wanted, ["doc_id", "key"]).select("doc_id", "text", "hulls").mapInArrow(_window_rows(window), "w1 long, w2 long, hull long, offset int, first long")
    windows = written(windows, "substr-windows")
    low = written(windows.groupBy("w1", "w2").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("w1", "w2", "low"), "substr-smallest")
    part = windows.join(low, ["w1", "w2"]).where("low < first").groupBy(F.col("first").alias("doc_id"), "hull").agg(F.collect_set("offset").alias("offsets"))
    part = own.join(part, ["doc_id", "hull"]).select("doc_id", "key", "at", "n", "offsets")

    whole = left.join(hulls.where("first < high").select(last, "hull", "first"), [last, "hull"]).where("doc_id > first")
    whole = whole.select("doc_id", "key", "at", "n", F.lit(None).cast("array<int>").alias("offsets"))
    return written(whole.unionByName(part).groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "n", "offsets")).alias("gone")), "substr-gone")


def substring_dedup(docs: DataFrame, window: int = 50, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept: the words that stay, joined by one space (null unless ``with_text``)."""
    docs = id_text(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")
    sure = docs.where("doc_id IS NOT NULL")
    with scratch(docs.sparkSession) as keep:
        copies, repeated = _repeated(sure)
        keep(copies)
        gone = keep(_repeats(sure, copies, repeated, window))

    # Texts that lose some words meet what goes; all others are finished where they are read.
    judged = marked_ids(sure, gone.select("doc_id").unionByName(copies.select("doc_id")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    nothing = [F.lit(False).alias("copy"), F.lit(None).cast(gone.schema["gone"].dataType).alias("gone")]
    plain = judged.where("NOT maybe").select("doc_id", "text", *nothing).unionByName(docs.where("doc_id IS NULL").select("doc_id", "text", *nothing))
    tell = gone.join(copies.groupBy("doc_id", F.col("t1").alias("key")).agg(F.collect_set("t2").alias("t2")), ["doc_id", "key"], "full")
    met = judged.where("maybe").select("doc_id", "key", "text").join(tell, ["doc_id", "key"], "left")
    copy = F.coalesce(F.array_contains("t2", F.xxhash64(F.lit(1), "text")), F.lit(False))
    met = met.select("doc_id", "text", copy.alias("copy"), "gone")
    return plain.mapInArrow(_outcome(window, with_text), schema).unionByName(met.mapInArrow(_outcome(window, with_text), schema))
