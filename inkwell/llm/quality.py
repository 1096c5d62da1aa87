"""Operator 8: quality classifier, ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(f(x) - theta_k) with one weight vector f for all grades and ordered thresholds theta_0 < theta_1
< ...; it gives the expected grade and every tail probability.  The grade comes from the labels: 0 is toxic, 1 is low
quality, 2 is good and clean.  (Toxic is the lowest, as many toxic words may add up without bound.)  x is hashed text:
presence of each word (lower case, outer punctuation off), the share of each word shape (``Of%%%`` has shape ``Aa%``),
and the tenth into which the share of distinct words falls.

The model is fitted in numpy on the driver with at most ``sample`` labelled documents, those with the smallest hashed
ids; their features are counted on the executors, and their distinct words are all that is sent.  Scoring is map-only.

Defined results: a null or empty text has no words and scores as the intercept says; labels with a null are ignored, and
of repeated ones the lowest quality and highest toxicity count; with no labels, or of a single grade, every document has
that grade's (or the highest) probability and is kept; repeated rows give repeated results; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, per_document, texts

#: log2 of the word and of the shape buckets; one-hot tenths of distinct words.
WORD_BITS, SHAPE_BITS, TENTHS = 18, 12, 12
GRADES = 3
EDGE = b".,;:!?*&%$#|()[]\"'"
UPPER, LOWER, DIGIT = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")
RUN = re.compile(rb"(.)\1+", re.S)


class Features:
    def __init__(self, most: int = 100_000) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def code(self, word: bytes) -> int:
        """Bucket of the word and bucket of its shape in one number."""
        shape = RUN.sub(rb"\1", DIGIT.sub(b"0", LOWER.sub(b"a", UPPER.sub(b"A", word))))
        bare = word.strip(EDGE).lower()
        return (zlib.crc32(bare) & ((1 << WORD_BITS) - 1)) << SHAPE_BITS | zlib.crc32(shape) & ((1 << SHAPE_BITS) - 1)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Distinct word buckets; shape buckets and their shares; the tenth."""
        words = text.encode().split()
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), TENTHS - 1
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.code(w)
        x = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        each = np.unique(x)
        shape, count = np.unique(x & ((1 << SHAPE_BITS) - 1), return_counts=True)
        # Long texts repeat words anyway, so distinct words are counted against the square root's growth.
        tenth = min(TENTHS - 2, int(10 * len(each) / min(len(words), 200 + len(words) ** 0.75))) if len(words) >= 20 else TENTHS - 2
        return np.unique(each >> SHAPE_BITS), shape, count / len(words), tenth


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    tenths: np.ndarray
    thetas: np.ndarray
    #: P(highest grade) from which a document is kept.
    least: float = 0.5

    def tails(self, x) -> np.ndarray:
        """P(grade > k) for each k."""
        words, shape, share, tenth = x
        f = float(self.words[words].sum() + self.shapes[shape] @ share + self.tenths[tenth])
        return 1 / (1 + np.exp(np.clip(self.thetas - f, -60, 60)))


def families(xs: list, hashes: int = 64, band: int = 4, alike: float = 0.5) -> np.ndarray:
    """A number for each document, the same for texts whose sets of words are equal or nearly so.

    Texts meet where ``band`` of their ``hashes`` smallest hashed words agree, and join where a share of ``alike`` does.
    """
    rng = np.random.default_rng(0)
    by, plus = rng.integers(1, 2**31 - 1, hashes), rng.integers(0, 2**31 - 1, hashes)
    sketches = np.full((len(xs), hashes), 2**31, dtype=np.int64)
    for k, (words, *_) in enumerate(xs):
        for i in range(0, len(words), 4096):
            sketches[k] = np.minimum(sketches[k], ((words[i : i + 4096, None] * by + plus) % (2**31 - 1)).min(axis=0))
    parent = list(range(len(xs)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for i in range(0, hashes, band):
        first: dict[bytes, int] = {}
        for k, key in enumerate(map(bytes, np.ascontiguousarray(sketches[:, i : i + band]))):
            j = first.setdefault(key, k)
            if j != k and (sketches[j] == sketches[k]).mean() >= alike:
                parent[root(k)] = root(j)
    return np.array([root(k) for k in range(len(xs))], dtype=np.int64)


def telling_words(xs: list, grades: np.ndarray, least: int, z: float) -> np.ndarray:
    """Whether each bucket's word tells any grade and those above it from those below, by families of near-copies."""
    n_words = 1 << WORD_BITS
    family = families(xs)
    words, doc = np.concatenate([np.zeros(0, dtype=np.int64), *(x[0] for x in xs)]), np.repeat(np.arange(len(xs)), [len(x[0]) for x in xs])
    telling = np.zeros(n_words, dtype=bool)
    for k in range(GRADES - 1):
        above = grades > k
        a, b = (np.bincount(np.unique(family[doc[at]] * n_words + words[at]) % n_words, minlength=n_words) for at in (above[doc], ~above[doc]))
        na, nb = max(1, len(np.unique(family[above]))), max(1, len(np.unique(family[~above])))
        share = (a + b + 1) / (na + nb + 2)
        ratio = np.maximum((a + 1) / (na + 2), (b + 1) / (nb + 2)) / np.minimum((a + 1) / (na + 2), (b + 1) / (nb + 2))
        telling |= (a + b >= least) & (ratio >= 2) & (np.abs(a / na - b / nb) >= z * np.sqrt(share * (1 - share) * (1 / na + 1 / nb)))
    return telling


def fit(xs: list, grades: np.ndarray, least: int = 5, z: float = 4.5, steps: int = 2000, rate: float = 0.1, l2: float = 1e-4, recall: float = 0.998) -> Model:
    """Penalised maximum likelihood by Adam.

    Words are screened first: only those get a weight that stand in ``least`` or more distinct texts, near-copies counted
    once, and whose share among the texts above some grade differs from that among the others twofold and by ``z`` standard
    errors; the rest would fit noise, the lengths of texts, or families of copies.  How common a word is over all doesn't
    count, so the words of a smaller language pass too.  ``least`` is then set so that ``recall`` of the sampled good and
    clean are kept.
    """
    n_words, n_shapes = 1 << WORD_BITS, 1 << SHAPE_BITS
    top = GRADES - 1
    if len(set(grades.tolist())) < 2:
        at = float(grades[0]) if len(grades) else top
        return Model(np.zeros(n_words, dtype=np.float32), np.zeros(n_shapes), np.zeros(TENTHS), np.where(np.arange(top) < at, -10.0, 10.0))
    best = grades == top
    telling = telling_words(xs, grades, least, z)
    rows, cols, vals = [], [], []
    for k, (words, shape, share, tenth) in enumerate(xs):
        words = words[telling[words]]
        cols += [words, shape + n_words, np.array([tenth + n_words + n_shapes])]
        vals += [np.ones(len(words)), share, np.ones(1)]
        rows.append(np.full(len(words) + len(shape) + 1, k))
    rows, cols, vals = np.concatenate(rows), np.concatenate(cols).astype(np.int64), np.concatenate(vals)
    ids, cols = np.unique(cols, return_inverse=True)
    n, d = len(xs), len(ids)
    # Parameters: weights, first threshold, log gaps.
    theta = np.concatenate([np.zeros(d), [-2.0], np.full(top - 1, 0.5)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    bounds = np.concatenate([np.full((n, 1), np.inf), np.zeros((n, top)), np.full((n, 1), -np.inf)], axis=1)
    upper, lower = grades, grades + 1  # P(grade = g) = S(g) - S(g + 1), S(0) = 1, S(top + 1) = 0
    each = np.arange(n)
    for step in range(1, steps + 1):
        f = np.bincount(rows, vals * theta[cols], minlength=n)
        cuts = theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])
        bounds[:, 1:-1] = f[:, None] - cuts[None, :]
        s = 1 / (1 + np.exp(-np.clip(bounds, -40, 40)))
        s[:, 0], s[:, -1] = 1.0, 0.0
        slope = s * (1 - s)
        p = np.maximum(s[each, upper] - s[each, lower], 1e-9)
        du, dl = slope[each, upper] / p, slope[each, lower] / p  # of -log p to the bounds: -du, +dl
        df = (dl - du) / n
        per_cut = np.zeros(top + 2)
        np.add.at(per_cut, upper, du / n)
        np.add.at(per_cut, lower, -dl / n)
        dcut = per_cut[1:-1]
        gaps = np.exp(theta[d + 1 :])
        grad = np.concatenate([np.bincount(cols, vals * df[rows], minlength=d) + l2 * theta[:d], [dcut.sum()], gaps * np.cumsum(dcut[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(n_words + n_shapes + TENTHS)
    weights[ids] = theta[:d]
    cuts = theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))])
    model = Model(weights[:n_words].astype(np.float32), weights[n_words : n_words + n_shapes], weights[n_words + n_shapes :], cuts)
    model.least = float(np.clip(np.quantile([model.tails(x)[-1] for x, g in zip(xs, best, strict=True) if g], 1 - recall, method="lower"), 0.05, 0.95))
    return model


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade), one row for each labelled document."""
    each = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return each.select("doc_id", F.when(F.col("t") > 0, 0).when(F.col("q") <= 0, 1).otherwise(2).cast("int").alias("grade"))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    work = Features()
    for batch in batches:
        xs = [work(t) for t in texts(batch.column(1))]
        columns = [[x[0].astype(np.int32) for x in xs], [x[1].astype(np.int32) for x in xs], [x[2].astype(np.float32) for x in xs]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.list_(t)) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float32()), strict=True)), pa.array([x[3] for x in xs], pa.int32())], ["doc_id", "grade", "words", "shapes", "shares", "tenth"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> Model:
    """The model fitted on at most ``sample`` labelled rows, those with the smallest hashed ids; a broadcast of as many ids picks them."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade").mapInArrow(_sampled, "doc_id long, grade int, words array<int>, shapes array<int>, shares array<float>, tenth int")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", F.size("words"), "tenth").limit(sample).toArrow()  # repeated rows can make it more than the sample
    arrays = [got.column(k).combine_chunks() for k in range(got.num_columns)]
    xs = [(arrays[2][k].values.to_numpy().astype(np.int64), arrays[3][k].values.to_numpy().astype(np.int64), arrays[4][k].values.to_numpy().astype(np.float64), arrays[5][k].as_py()) for k in range(got.num_rows)]
    return fit(xs, np.array(arrays[1].to_pylist(), dtype=np.int64))


def quality(docs: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """doc_id, expected_grade, p_ge1, p_ge2, keep: whether P(grade = 2), good and clean, is ``least`` (else the model's) or more."""
    least = model.least if least is None else least

    def make():
        features = Features()

        def work(text: str):
            tails = model.tails(features(text))
            return round(float(tails.sum()), 6), round(float(tails[0]), 6), round(float(tails[-1]), 6), bool(tails[-1] >= least)

        return work

    return per_document(id_text(docs), make, "doc_id long, expected_grade double, p_ge1 double, p_ge2 double, keep boolean")


def keep_good(docs: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """The rows of the documents that the classifier keeps, all columns as they are; map-only."""
    least = model.least if least is None else least
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield batch.filter(pa.array([bool(model.tails(features(t))[-1] >= least) for t in texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
