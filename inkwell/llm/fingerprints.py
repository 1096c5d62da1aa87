"""Operator 4: document fingerprints from prefix polynomial hashes.

Each text gets modular prefix arrays P[i] = c[0]*B^0 + ... + c[i-1]*B^(i-1) mod p, for two primes.  They answer any span
equality in O(1), give the hash of an edited text without hashing it again (prefix of one, shifted prefix of the other),
and locate longest common extensions by binary search.  The hashes of all 16-character spans come from the same arrays.
Spans are also taken where they reach over an end of the text, and are shorter there, so a text of n characters has n + 15,
and a text of less than 16 characters is known by its beginnings and ends.  The smallest distinct hashes form a sketch
whose overlap estimates the share of spans that two texts have in common.

A fingerprint reads ``n_chars-whole hash-sketch``.  The likeness of two fingerprints is 1 where they are equal, else the
share of the SKETCH smallest values of both sketches' union that are in both: 0 to 1, in steps of 1/64, exact for texts of
few spans, else with a standard error of 0.06 at most.

The next document in descending doc_id is found without a global window: ids are cut into ranges of about PART_BYTES of
text at quantiles, one shuffle brings each range to a task in order, and the first row of each range is sent to the range
above as well.  The last of all gets the first of all.  An id that fills a range alone (no id, or one repeated very often)
is cut further by the hash of its texts.

Defined results: a null or empty text has the fingerprint of the empty text; a single document is its own next; rows of
one doc_id follow each other by the hash of their text; a null doc_id sorts after all others; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, scratch, written

#: Characters of a span, values of a sketch, primes and bases.
SPAN, SKETCH = 16, 64
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1299709)
#: Bytes of text of a range of ids, and the most ranges that quantiles give.
PART_BYTES, MOST_PARTS = 16 << 20, 20_000


@functools.lru_cache(maxsize=1)
def _powers_cache() -> dict:
    return {}


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """B^0..B^n and B^-0..B^-n for each prime; grown by doubling, so a worker holds as many as its longest text has characters."""
    cache = _powers_cache()
    if cache.get("n", 0) < n + 1:
        size, out = 1 << max(12, (n + 1).bit_length()), []
        for p, b in zip(PRIMES, BASES, strict=True):
            both = []
            for base in (b, pow(b, -1, p)):
                a = np.ones(1, dtype=np.uint64)
                while len(a) < size:
                    a = np.concatenate([a, a * np.uint64(pow(base, len(a), p)) % np.uint64(p)])
                both.append(a)
            out.append(tuple(x.astype(np.uint32) for x in both))  # all below 2^31
        cache["n"], cache["p"] = size, out
    return cache["p"]


class Prefix:
    """The code points of a text and their prefix arrays."""

    def __init__(self, text: str) -> None:
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        self.n = len(self.codes)
        self.arrays = []
        for (up, _), p in zip(powers(self.n), PRIMES, strict=True):
            p = np.uint64(p)
            # A term is below 2^31, so a sum of up to 2^32 of them stays below 2^63.
            sums = np.cumsum((self.codes + np.uint64(1)) * up[: self.n] % p) % p
            self.arrays.append(np.concatenate([np.zeros(1, dtype=np.uint64), sums]))

    def span(self, k: int, i: int, j: int) -> int:
        """Hash of the span i..j under prime k, as if it stood at 0."""
        p, a = PRIMES[k], self.arrays[k]
        return (int(a[j]) - int(a[i])) % p * int(powers(self.n)[k][1][i]) % p

    def whole(self) -> tuple[int, int]:
        return int(self.arrays[0][self.n]), int(self.arrays[1][self.n])

    @functools.cached_property
    def spans(self) -> np.ndarray:
        """Mixed hashes of the spans k - SPAN + 1 .. k + 1 for k = 0, 1, .., as far as they lie within the text."""
        if not self.n:
            return np.zeros(0, dtype=np.uint32)
        first = np.arange(1 - SPAN, self.n)
        i, j = np.maximum(first, 0), np.minimum(first + SPAN, self.n)
        return mixed(*((a[j] + np.uint64(p) - a[i]) % np.uint64(p) * down[i] % np.uint64(p) for a, p, (_, down) in zip(self.arrays, PRIMES, powers(self.n), strict=True)))


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """32 well-mixed bits of two hashes."""
    z = (x << np.uint64(31)) ^ y
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


def sketch(*spans: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct values, ascending."""
    x = spans[0] if len(spans) == 1 else np.concatenate(spans)
    size = 4 * SKETCH
    while len(x) > size:
        low = np.unique(np.partition(x, size)[:size])
        if len(low) >= SKETCH:
            return low[:SKETCH]
        size *= 8  # many repeats
    return np.unique(x)[:SKETCH]


def fingerprint(n: int, whole: tuple[int, int], low: np.ndarray) -> str:
    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-{low.astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = (set(np.frombuffer(bytes.fromhex(s.rpartition("-")[2]), dtype=">u4").tolist()) for s in (a, b))
    low = sorted(x | y)[:SKETCH]
    return sum(v in x and v in y for v in low) / len(low) if low else 0.0


def same(a: Prefix, i: int, j: int, b: Prefix, u: int, v: int) -> bool:
    """Whether a[i:j] and b[u:v] are the same text."""
    return j - i == v - u and all(a.span(k, i, j) == b.span(k, u, v) for k in (0, 1))


def common_prefix(a: Prefix, b: Prefix) -> int:
    """Longest common extension from the start of both, by binary search."""
    low, high = 0, min(a.n, b.n)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if all(a.arrays[k][mid] == b.arrays[k][mid] for k in (0, 1)) else (low, mid - 1)
    return low


def common_suffix(a: Prefix, b: Prefix) -> int:
    low, high = 0, min(a.n, b.n)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if same(a, a.n - mid, a.n, b, b.n - mid, b.n) else (low, mid - 1)
    return low


def edited(a: Prefix, b: Prefix) -> tuple[int, tuple[int, int], np.ndarray]:
    """Length, whole hash and sketch of a's text with its second half replaced by the start of b's; only spans across the seam or the new end are hashed anew."""
    head = a.n - a.n // 2
    tail = min(a.n // 2, b.n)
    total = head + tail
    first = np.unique(np.concatenate([np.arange(head - SPAN + 1, head), np.arange(total - SPAN + 1, total)]))
    first = first[(first > -SPAN) & (first < total) & (total > 0)]
    i, j = np.maximum(first, 0), np.minimum(first + SPAN, total)
    whole, seam = [], []
    for k, prime in enumerate(PRIMES):
        p, x, y, (up, down) = np.uint64(prime), a.arrays[k], b.arrays[k], powers(max(a.n, b.n))[k]
        whole.append((int(x[head]) + int(up[head]) * int(y[tail])) % prime)
        i_a, i_b = np.minimum(i, head), np.maximum(i - head, 0)
        of_a = (x[np.minimum(j, head)] + p - x[i_a]) % p * down[i_a] % p
        of_b = (y[np.maximum(j - head, 0)] + p - y[i_b]) % p * down[i_b] % p
        seam.append((of_a + of_b * up[np.maximum(head - i, 0)]) % p)
    return total, tuple(whole), sketch(a.spans[:head], mixed(*seam), b.spans[SPAN - 1 : max(SPAN - 1, tail)])


def judged(doc_id, text: str, a: Prefix, fp: str, after: str, b: Prefix, after_fp: str) -> tuple:
    half = a.n // 2
    changed = text[: a.n - half] + after[:half]
    fp_edited = fingerprint(*edited(a, b))
    return doc_id, a.n, hashlib.sha256(changed.encode()).hexdigest(), fp, fp_edited, likeness(fp, fp_edited), likeness(fp, after_fp), common_prefix(a, b), common_suffix(a, b)


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "prefix_next", "suffix_next")
TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
FLUSH = 2000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, borrowed, doc_id, text) by part, then in order; a part ends with the borrowed first rows of the part below it."""
    rows: list[tuple] = []
    held, part, done = None, None, False  # the document that waits for its next one

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], list(NAMES))
        rows.clear()
        return made

    for batch in batches:
        for k in range(batch.num_rows):
            at, borrowed, doc_id, text = (batch.column(c)[k].as_py() for c in range(4))
            if at != part:
                part, held, done = at, None, False
            if done:
                continue
            prefix = Prefix(text)
            now = doc_id, text, prefix, fingerprint(prefix.n, prefix.whole(), sketch(prefix.spans))
            if held is not None:
                rows.append(judged(*held, *now[1:]))
                if len(rows) >= FLUSH:
                    yield out()
            held, done = now, borrowed
    if rows:
        yield out()


def _located(edges: list[int], slices: list[int], lends: dict[tuple[int, int], int]):
    """For (id, hash): its part, and the part above that borrows it (-1: none), in one number."""
    starts = np.concatenate([[0], np.cumsum(slices)]).astype(np.int64)
    cuts, n, most = np.array(edges, dtype=np.int64), np.array(slices, dtype=np.int64), int(starts[-1]) + 1

    @F.pandas_udf("long")
    def located(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        i, h = ids.to_numpy(), hashes.to_numpy()
        at = np.searchsorted(cuts, i, side="right")
        own = starts[at] + np.minimum((h.astype(np.float64) / 2.0**64 + 0.5) * n[at], n[at] - 1).astype(np.int64)
        lent = np.fromiter((lends.get(x, -1) for x in zip(i.tolist(), h.tolist(), strict=True)), dtype=np.int64, count=len(i))
        return pd.Series(own + most * (lent + 1))

    return located, most


def fingerprints(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the common extensions with the next document.

    ``part_bytes``: text of a range of ids; quantiles, sizes and first rows of the ranges, a few numbers for each, are all
    that the driver sees.
    """
    docs = id_text(docs).withColumn("null_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))
    with scratch(docs.sparkSession):
        ids = written(docs.select("doc_id", "h", (F.octet_length("text") + 64).alias("size")), "fingerprint-ids")
        size = ids.agg(F.sum("size")).head()[0] or 0
        parts = int(min(MOST_PARTS, max(1, -(-size // part_bytes))))
        found = ids.select(F.percentile_approx("doc_id", F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(20 * parts)).alias("e")).head()["e"] if parts > 1 else []
        # An id that is an edge several times fills ranges: it gets one of its own.
        edges = sorted({*(found or []), *(x + 1 for x, y in zip(found or [], (found or [])[1:], strict=False) if x == y and x < 2**63 - 1)})
        ranges = len(edges) + 1
        at = _located(edges, [1] * ranges, {})[0]
        sized = ids.groupBy(at("doc_id", "h").alias("code")).agg(F.sum("size").alias("size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()
        slices = [1] * ranges
        for r in sized:
            if r["low"] == r["high"]:
                slices[r["code"] % (ranges + 1)] = int(min(MOST_PARTS, max(1, -(-r["size"] // part_bytes))))
        at, most = _located(edges, slices, {})
        tops = {r["part"]: r["top"] for r in ids.groupBy((at("doc_id", "h") % most).alias("part")).agg(F.max(F.struct("doc_id", "h")).alias("top")).collect()}
    order = sorted(tops, reverse=True)
    #: The first row of each part, and the part above that borrows it; the first of all goes to the last part.
    lends = dict(zip([tuple(tops[p]) for p in order], [*order[-1:], *order[:-1]], strict=True))
    at, most = _located(edges, slices, lends)
    code = docs.withColumn("code", at("doc_id", "h"))
    own, lent = F.struct((F.col("code") % most).alias("part"), F.lit(False).alias("borrowed")), F.floor(F.col("code") / most) - 1
    to = F.when(lent < 0, F.array(own)).otherwise(F.array(own, F.struct(lent.alias("part"), F.lit(True).alias("borrowed"))))
    dealt = code.withColumn("to", F.explode(to)).select(F.col("to.part").cast("int").alias("part"), F.col("to.borrowed").alias("borrowed"), F.col("doc_id").alias("id"), "h", F.when(~F.col("null_id"), F.col("doc_id")).alias("doc_id"), "text")
    dealt = dealt.repartitionById(max(1, most - 1), F.col("part")) if hasattr(dealt, "repartitionById") else dealt.repartition(max(1, most - 1), "part")
    dealt = dealt.sortWithinPartitions("part", "borrowed", F.desc("id"), F.desc("h")).select("part", "borrowed", "doc_id", "text")
    return dealt.mapInArrow(_in_order, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_next long, suffix_next long")
