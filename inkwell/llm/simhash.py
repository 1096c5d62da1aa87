"""Operator 10: SimHash near-dedup by bit-sliced comparison.

Fingerprints: XXH64 (seed 42) of every shingle, repeats included; a bit is 1 if it is set in over half of them.

Comparison: equal fingerprints are merged first.  The 64 bits are cut into BLOCKS blocks; two fingerprints that differ
in at most ``radius`` bits agree in BLOCKS - radius of them, so each fingerprint goes to a bucket for every such choice.
A bucket of more than CELL is refined: its members may differ in the remaining blocks only, and by the same argument two
that are near agree in half of those blocks' halves, so each member goes to C(2 radius, radius) smaller buckets, however
large the bucket is.  Distinct fingerprints that agree in the bits of both levels differ in the 19 or so others, so what
is still larger than CELL is bounded; it is dealt out over cells, one for each pair of its slices.

Every comparison is bit-sliced.  The fingerprints of a run of whole cells, sorted by cell, are stored as vertical bit
planes, 64 to a machine word, so a word may hold many small cells.  A block is one fingerprint against one word; its
lanes are the word's fingerprints that come after it in its own cell.  XOR of each plane, a tree of carry-save adders into
bit-sliced counters, and a block is abandoned once all of its lanes exceed the radius.  A run emits only a spanning forest
of the links it finds, never all pairs.  Components of the forest's edges are found by alternating stars.

At 3 bits and 5 blocks a bucket is keyed by 25 or 26 bits, so for N distinct fingerprints the shuffle is 10 N rows of 24
bytes, and a random bucket holds N / 2^25.

``keep_one`` also links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, which 64 bits are
too few to tell.  It compares SimHash fingerprints of 512 bits with the same planes and adders.  At a similarity of 0.8 an
expected 78 bits differ, with a standard error of 8; WIDE_RADIUS is four such errors more, and wider for texts of at most FEW
shingles, whose bits vary more.  What is within it is then held against the sets themselves, so no two texts below 0.8 are
linked.  Texts meet in buckets where one of BANDS bands of ROWS minima of their hashed shingles agrees (98 % of pairs at
0.8).  Only texts that share a bucket have their sets made and shuffled.

Defined results: a null or empty text has fingerprint zero and is linked like any other; equal texts have equal
fingerprints; repeated rows are repeated; a null doc_id keeps its row and names no component unless the component has
no other id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, marked_ids, partitions, per_document, scratch, set_apart, texts, written
from .components import components

#: Blocks of the fingerprint, and fingerprints of a slice of a large bucket.
BLOCKS, CELL = 5, 2048
STEP = 4096
#: Blocks of the comparison that are in memory at a time.
AT_ONCE = 1 << 14
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, size: int) -> tuple[bytes, list[int], int]:
    """Lower-cased (A-Z) words joined by one space, where each word starts, and the number of shingles."""
    words = text.encode().lower().split()  # bytes: exactly the six white characters
    ends = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    return b" ".join(words), ends, max(len(words) - size + 1, min(1, len(words)))


def hashed(joined: bytes, ends: list[int], size: int, first: int, last: int) -> np.ndarray:
    """XXH64 of the shingles first..last."""
    import xxhash

    digest, size = xxhash.xxh64_intdigest, min(size, len(ends) - 1)
    return np.fromiter((digest(joined[i : j - 1], 42) for i, j in zip(ends[first:last], ends[first + size : last + size])), dtype="<u8", count=last - first)  # noqa: B905  two slices of one length


def tally(h: np.ndarray) -> np.ndarray:
    """How many rows of ``h`` (n, words of 64 bits) have each bit set; 255 rows at a time are added up in bytes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
    return sum(bits[i : i + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255))


def fingerprint(text: str, shingle: int = 3) -> int:
    joined, ends, n = shingles(text, shingle)
    if not n:
        return 0
    counts = sum(tally(hashed(joined, ends, shingle, at, min(n, at + STEP))[:, None]) for at in range(0, n, STEP))
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def cuts(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def masks(radius: int, blocks: int) -> list[int]:
    """Of the bits that a bucket's members share, one for each choice of blocks."""
    ones = [((1 << n) - 1) << at for at, n in cuts(blocks)]
    return [sum(x) for x in itertools.combinations(ones, blocks - radius)]


def refined(radius: int, blocks: int) -> list[list[int]]:
    """For each of ``masks``, those of the buckets that one of its buckets is refined into."""
    out = []
    for held in itertools.combinations(range(blocks), blocks - radius):
        whole = sum(((1 << n) - 1) << at for at, n in (cuts(blocks)[k] for k in held))
        halves = [h for k in range(blocks) if k not in held for at, n in [cuts(blocks)[k]] for h in (((1 << n // 2) - 1) << at, ((1 << n - n // 2) - 1) << at + n // 2)]
        out.append([whole | sum(x) for x in itertools.combinations(halves, radius)])
    return out


# ---- Bit-sliced comparison -------------------------------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """(bits, words) of ``fps`` (n, words of 64 bits): bit j of fingerprint i is bit i % 64 of word i // 64 of plane j; the last word is filled with zeros."""
    bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((-len(fps) % 64, bits.shape[1]), dtype=np.uint8)])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(fps: np.ndarray, sliced: np.ndarray, q: np.ndarray, w: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For blocks of fingerprint ``q`` against word ``w`` of the planes: those with a lane at most ``radius`` bits away, as (q, w, lanes).

    Eight planes at a time go through a tree of carry-save adders; the counters are bit-sliced too.  Blocks whose
    ``lanes`` all exceed the radius leave the comparison after each eight planes.
    """
    counts = [np.zeros(len(q), dtype=np.uint64) for _ in range(max(2, radius.bit_length() + 1))]
    over = ~lanes  # of lanes that don't count and of counters that ran over
    for first in range(0, len(sliced), 8):
        own = fps[q, first // 64] >> np.uint64(first % 64)
        x = [sliced[first + k][w] ^ (np.uint64(0) - (own >> np.uint64(k) & np.uint64(1))) for k in range(8)]
        for weight, bits in _eight(x):
            for k in range(weight, len(counts)):
                counts[k], bits = counts[k] ^ bits, counts[k] & bits
            over |= bits
        keep = (over | _exceeds(counts, radius)) != ONES
        if not keep.all():
            q, w, over, counts = q[keep], w[keep], over[keep], [x[keep] for x in counts]
        if not len(q):
            break
    return q, w, ~(over | _exceeds(counts, radius))


def _add(a, b, c):
    """Carry-save adder: three words of weight w to a sum of weight w and a carry of weight 2w."""
    u = a ^ b
    return u ^ c, a & b | u & c


def _eight(x) -> list[tuple[int, np.ndarray]]:
    """Eight words of weight 1 to one of each weight: [(log2 of the weight, word)]."""
    s1, c1 = _add(x[0], x[1], x[2])
    s2, c2 = _add(x[3], x[4], x[5])
    s3, c3 = _add(s1, s2, x[6])
    one, c4 = s3 ^ x[7], s3 & x[7]
    t1, d1 = _add(c1, c2, c3)
    two, d2 = t1 ^ c4, t1 & c4
    return [(0, one), (1, two), (2, d1 ^ d2), (3, d1 & d2)]


def _exceeds(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Words of those whose counter is above the radius."""
    more, equal = np.zeros_like(counts[0]), np.full_like(counts[0], ONES)
    for k in range(len(counts) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counts[k]
        else:
            more, equal = more | equal & counts[k], equal & ~counts[k]
    return more


def near(fps: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), low[i] <= j < high[i], of fingerprints at most ``radius`` bits apart, some at a time."""
    sliced, rows = planes(fps), np.flatnonzero(high > low)
    first = low[rows] // 64
    words = (high[rows] - 1) // 64 - first + 1
    ends, step = np.cumsum(words), AT_ONCE // fps.shape[1]
    for top in range(0, int(ends[-1]) if len(ends) else 0, step):
        at = np.arange(top, min(top + step, int(ends[-1])))
        k = np.searchsorted(ends, at, side="right")
        q, w = rows[k], first[k] + at - (ends[k] - words[k])
        # The lanes low..high of the word.
        a, b = np.clip(low[q] - 64 * w, 0, 63).astype(np.uint64), np.clip(64 * (w + 1) - high[q], 0, 63).astype(np.uint64)
        q, w, found = within(fps, sliced, q, w, ONES << a & ONES >> b, radius)
        block, lane = np.nonzero(np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield q[block], 64 * w[block] + lane


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], judge: tuple[Callable, Callable] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs among 0..n-1; with ``judge`` (a screen for arrays of pairs, a test for one) only of those that pass both."""
    root, out = np.arange(n), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return int(i)

    for a, b in pairs:
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if judge:
            good = judge[0](a, b)
            a, b = a[good], b[good]
        else:  # one pair of each two trees will do
            _, one = np.unique(root[a] * n + root[b], return_index=True)
            a, b = a[one], b[one]
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y and (not judge or judge[1](i, j)):
                root[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def partners(cell: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of rows that each row is compared with, rows being sorted by cell and side: side 0 with side 1, or, where a cell has side 0 alone, with what comes after it."""
    n = len(cell)
    new = np.concatenate([[True], cell[1:] != cell[:-1]])
    which = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    second = ends - np.add.reduceat(side, starts)
    low = np.where(second[which] < ends[which], second[which], np.arange(n) + 1)
    return low, np.where(side > 0, low, ends[which])


def _cells(radius: int, judge: Callable | None = None):
    """Rows (cell, side, node) and the fingerprints, if they aren't the nodes, sorted by cell and side: spanning links (u, v) of nodes.

    ``judge`` makes what ``forest`` takes as such of the rows.
    """

    def linked(held: pa.Table) -> pa.RecordBatch:
        cell, side, node = (held.column(k).to_numpy() for k in range(3))
        if held.num_columns > 3:
            fps = held.column(3).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        else:
            fps = node.view(np.uint64)[:, None]
        links = forest(len(node), near(fps, *partners(cell, side.astype(np.int64)), radius), judge and judge(held))
        x = node[np.array(links, dtype=np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            cell = batch.column(0).to_numpy()
            change = np.flatnonzero(cell[1:] != cell[:-1])
            if held and batch.num_rows and held[-1].column(0)[-1].as_py() != cell[0]:
                yield linked(pa.Table.from_batches(held))
                held = []
            if len(change):  # whole cells up to the last one, which other batches may go on with
                cut = int(change[-1]) + 1
                yield linked(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield linked(pa.Table.from_batches(held))

    return run


def dealt(rows: DataFrame, keys: list[str], cell: int, *more: str) -> DataFrame:
    """(cell, side, node, ``more``) sorted by cell and side within partitions, for rows (keys, n, node, more) of buckets of n.

    A bucket of more than ``cell`` is cut into slices: one meets itself in cell (k, k), and every other one in the cell of
    the pair, the smaller number as side 0.
    """
    slices = F.ceil(F.col("n") / cell).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), slices).cast("int")
    out = rows.select(*keys, "node", *more, slices.alias("slices"), own.alias("own"))
    out = out.select(*keys, "node", *more, "own", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    out = out.select(F.xxhash64(*keys, low, high).alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", *more)
    return out.repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell", "side")


def shared(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """The rows whose keys stand in several, with n, their number or, if that is more, ``weight``; both sides of the join have plain exchanges."""
    count = F.count("*")
    sizes = rows.groupBy(*keys).agg(count.alias("several"), (count if weight is None else F.greatest(count, weight)).alias("n"))
    return rows.join(written(sizes.where("several > 1").drop("several"), "simhash-buckets"), keys)


def near_links(fps: DataFrame, radius: int = 3, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Spanning links (u, v) of all pairs of the distinct ``fp`` (long) at most ``radius`` bits apart."""

    def key(which, mask) -> Column:
        return F.struct(which.alias("which"), F.col("node").bitwiseAND(mask).alias("bits"))

    def literal(mask: int) -> Column:
        return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)

    keys = ["which", "bits"]
    nodes = fps.select(F.col("fp").alias("node"))
    rows = nodes.select("node", F.explode(F.array(*(key(F.lit(k), literal(m)) for k, m in enumerate(masks(radius, blocks))))).alias("key"))
    rows = shared(rows.select("node", "key.*"), keys)
    finer = refined(radius, blocks)
    table = F.array(*(F.array(*map(literal, m)) for m in finer))
    again = rows.where(F.col("n") > cell).select("node", "which", F.posexplode(F.element_at(table, F.col("which") + 1)).alias("k", "mask"))
    again = again.select("node", key((F.col("which") + 1) * len(finer[0]) + len(finer) + F.col("k"), F.col("mask")).alias("key")).select("node", "key.*")
    rows = rows.where(F.col("n") <= cell).unionByName(shared(again, keys))
    return dealt(rows, keys, cell).mapInArrow(_cells(radius), "u long, v long")


# ---- Similar sets of shingles ----------------------------------------------------------------------------------------

#: Words of a shingle, and the similarity from which texts are near-duplicates.
WIDE_SHINGLE, ALIKE = 5, 0.8
#: Words of 64 bits of a wide fingerprint; the most bits in which two near ones differ, and where one has few shingles.
WIDE, WIDE_RADIUS, LOOSE_RADIUS, FEW = 8, 110, 160, 64
#: Shingles that count as one row when a bucket is cut into slices.
ROW_SHINGLES = 512
#: Bands of so many minima.
BANDS, ROWS = 8, 4


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def seeds() -> tuple[np.ndarray, np.ndarray]:
    """Added before mixing for each word of a wide fingerprint; odd multipliers for the minima."""
    x = mix(np.arange(1, WIDE + BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:WIDE], x[WIDE:] | np.uint64(1)


def hashes(text: str) -> np.ndarray:
    """The set of hashed five-word shingles, in order."""
    joined, ends, n = shingles(text, WIDE_SHINGLE)
    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *(hashed(joined, ends, WIDE_SHINGLE, at, min(n, at + STEP)) for at in range(0, n, STEP))]))


def wide(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of hashed shingles: the wide fingerprint and the hashed bands.  An empty one has no band."""
    if not len(h):
        return np.zeros(WIDE, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    plus, by = seeds()
    counts, low = np.zeros(64 * WIDE, dtype=np.int64), np.full(BANDS * ROWS, ONES)
    for at in range(0, len(h), STEP):
        part = h[at : at + STEP, None]
        counts += tally(mix(part + plus))
        low = np.minimum(low, (part * by).min(axis=0))
    bands = mix((mix(low).reshape(BANDS, ROWS) * by[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8"), bands


def digest(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes(), 42)


def _alike(held: pa.Table) -> tuple[Callable, Callable]:
    """Whether rows (cell, side, node, wide, set) are near-duplicates: a screen by sizes and distance, and a test by the sets."""
    fps = held.column(3).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(held.num_rows, -1)
    sets = held.column(4).combine_chunks()
    size, at, values = sets.value_lengths().to_numpy(), sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)

    def screen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        # Sets of sizes low < high have a similarity of low / high at most.
        return (low >= ALIKE * high) & (np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) <= np.where(low <= FEW, LOOSE_RADIUS, WIDE_RADIUS))

    def sure(i: int, j: int) -> bool:
        x, y = values[at[i] : at[i + 1]], values[at[j] : at[j + 1]]
        both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
        return both >= ALIKE * (len(x) + len(y) - both)

    return screen, sure


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [hashes(t) for t in texts(batch.column(1))]
        if sets:
            columns = [pa.array([signed(digest(h)) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["node", "digest", "set"])


def wide_links(marks: DataFrame, docs: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (u, v) of the ids ``component_id`` of rows (doc_id, component_id, wide, size, digest, bands) that are near-duplicates.

    Rows of equal sets are merged first.  Only of those that share a bucket are sets made anew from ``docs`` (doc_id, text).
    """
    lows = [F.min(c).alias(name) for c, name in (("doc_id", "node"), ("component_id", "first"), ("size", "size"), ("bands", "bands"))]
    each = written(marks.groupBy("wide", "digest").agg(*lows), "simhash-wide")
    rows = written(shared(each.select("node", "size", F.explode("bands").alias("band")), ["band"], F.ceil(F.sum("size") / ROW_SHINGLES)), "simhash-bands")
    nodes = written(each.join(rows.select("node").distinct(), "node", "left_semi").select("node", "digest", "wide"), "simhash-nodes")
    again = marked_ids(docs, nodes.select(F.col("node").alias("doc_id"))).where("maybe").select("doc_id", "text")
    sets = again.mapInArrow(_set_rows, "node long, digest long, set array<long>").join(nodes, ["node", "digest"])
    rows = rows.select("node", "band", "n").join(written(sets.dropDuplicates(["node", "digest"]), "simhash-sets"), "node")
    links = dealt(rows, ["band"], cell, "wide", "set").mapInArrow(_cells(LOOSE_RADIUS, _alike), "u long, v long")
    ends = each.select("node", "first")
    links = links.join(ends.toDF("u", "a"), "u").join(ends.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = marks.join(each.select("wide", "digest", "first"), ["wide", "digest"]).select(F.col("component_id").alias("u"), F.col("first").alias("v"))
    return links.unionByName(same.distinct()).where("u <> v")


# ---- Documents -------------------------------------------------------------------------------------------------------


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    return per_document(id_text(docs), lambda: lambda text: (signed(fingerprint(text)),), "doc_id long, fp long")


def _wide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for text in texts(batch.column(1)):
            h = hashes(text)
            made.append((signed(fingerprint(text)), len(h), signed(digest(h)), *(x.view(np.int64) for x in wide(h))))
        if made:
            columns = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "fp", "size", "digest", "wide", "bands"])


def grouped(marked: DataFrame, radius: int, blocks: int, cell: int) -> DataFrame:
    """(fp, component_id) of rows (doc_id, fp)."""
    with scratch(marked.sparkSession) as keep:
        first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
        tree = components(near_links(first.select("fp"), radius, blocks, cell))  # by fingerprint
        member = first.join(tree.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
        low = member.groupBy("root").agg(F.min("first").alias("component_id"))
        return keep(written(member.join(written(low, "simhash-low"), "root").select("fp", "component_id"), "simhash-named"))


def near_duplicates(docs: DataFrame, radius: int = 3, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    marked = written(fingerprints(docs), "simhash-fp")
    named = grouped(marked, radius, blocks, cell)
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, radius: int = 3, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """(doc_id, component_id) by near fingerprints or similar sets of shingles; rows without a doc_id are in no group."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        docs = id_text(docs).where("doc_id IS NOT NULL")
        marked = written(docs.mapInArrow(_wide_rows, "doc_id long, fp long, size long, digest long, wide array<long>, bands array<long>"), "simhash-marks")
        marked = written(marked.join(grouped(marked.select("doc_id", "fp"), radius, blocks, cell), "fp").drop("fp"), "simhash-marks")
        tree = components(wide_links(marked.where(F.size("bands") > 0), docs, cell))
        found = marked.select("doc_id", "component_id").join(tree.toDF("component_id", "low"), "component_id", "left")
        return keep(written(found.select("doc_id", F.coalesce("low", "component_id").alias("component_id")), "simhash-groups"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of one document of each group of near-duplicates, the one with the smallest doc_id, with all their columns.

    Rows that repeat that doc_id collapse to one.  Rows without a doc_id can't be named: of those that have equal texts one
    stays.  Only rows that may have to go are shuffled with their texts.
    """
    found = similar_groups(docs, **settings).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    found = written(found.where("n > 1 OR doc_id <> component_id"), "simhash-found")
    named = docs.where("doc_id IS NOT NULL")
    untouched, rest = set_apart(named, found.select("doc_id"))
    gone = found.where("doc_id <> component_id").select("doc_id")
    kept = rest.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"]).select("row.*")
    return untouched.unionByName(kept).unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"]))
