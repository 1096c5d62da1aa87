"""Operator 13: how far the sources of a language diverge, and which terms set each apart.

Terms are runs of ASCII letters and of characters beyond ASCII, only A-Z lower-cased.  A language keeps the V terms that
stand in ``least_docs`` or more of its documents.  A group (lang, source) or a whole language gives each kept term, also
one that it never holds, p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being its occurrences of kept terms, and two
groups differ at a term by floor((p - q)^2 / (p + q)).

Counting: a task sums (lang, source, term) in a table of MOST_HELD entries at most before anything is shuffled, so a hot
source or a common term gives a row for each task and flush.  Counts then meet in grouped sums with map-side combination.

Comparing: the kept terms of a language are dealt over blocks of about BLOCK_TERMS by their hash, and its groups over tiles
of about TILE_GROUPS.  A cell is a block for a pair of tiles; it gets a header row for each group of the two and a row for
each count.  Within a cell the counts make a dense group-by-term matrix of 64-bit integers, a group's row is broadcast
against all others, and the sums over the block's terms are one partial pair matrix; the block's terms that stand in neither
tile add their share by number, as they all have count 0.  Partial matrices add up in a grouped
sum.  The cell of a tile with itself also gives each group's ``top`` best terms of the block, and these few meet in the
group's final ranking.  So memory is bounded by a cell, however many terms and groups there are; only the result itself,
a row for each pair of a language's groups, grows with their square.

All arithmetic is exact: p is found by long division in steps of 1000, which holds for N + 2 V below 9 x 10^15.

Defined results: null text, lang and source count as ''; a group without terms stands in the result, and where V is 0 all
its values are 0; a language's only source has no row of part ``pair``; repeated rows and rows without a doc_id each count
as a document; ties in value go by the item's UTF-8 bytes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: For each byte of UTF-8: A-Z lower-cased, what no term holds as a space; characters beyond ASCII have bytes from 128 on and stay.
BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
#: Entries that a task sums up before it hands them on; bytes of a text that are split at a time.
MOST_HELD, STRETCH = 200_000, 1 << 20
#: Terms of a block and groups of a tile, about: a cell has two tiles at most, so its matrix takes some 4 MB.
BLOCK_TERMS, TILE_GROUPS = 1024, 256
SCALE = 1_000_000_000


def byte_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a stretch of it at a time; stretches end where a term does."""
    at, end = 0, len(text)
    while at < end:
        cut = min(at + STRETCH, end)
        some = text[at:cut].translate(BYTES)
        while cut < end and some[-1] != 32:  # up to the end of the term that the stretch would cut
            more = text[cut : cut + STRETCH].translate(BYTES)
            stop = more.find(b" ")
            some, cut = some + (more if stop < 0 else more[: stop + 1]), min(end, cut + (len(more) if stop < 0 else stop + 1))
        yield some.split()
        at = cut


def terms(text: str) -> Iterator[list[str]]:
    """The same of a string: the matches of TERM, lower-cased by LOWER."""
    for some in byte_terms(text.encode()):
        yield [x.decode() for x in some]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to sums (lang, source, term, n, docs); the term '' marks that a group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flushed() -> pa.RecordBatch:
        """Group after group; the counters of occurrences and of documents have the same terms, if not in one order."""
        sizes = [len(n) + 1 for n, _ in held.values()]
        group = pa.array(np.repeat(np.arange(len(held)), sizes))
        lang, source = (pa.array(list(x), pa.string()).take(group) for x in zip(*held, strict=True))
        term, n, docs = [], [], []  # terms are whole characters: bytes of one never hold a space
        for of, of_docs in held.values():
            term += [b"", *of]
            n += [0, *of.values()]
            docs += [0, *map(of_docs.__getitem__, of)]
        held.clear()
        return pa.RecordBatch.from_arrays([lang, source, pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
            group = (lang.as_py(), source.as_py())
            if group not in held:
                held[group] = Counter(), Counter()
                size += 1
            n, docs = held[group]
            before, seen = len(n), set()
            for some in byte_terms(text.as_py()):
                n.update(some)  # counts within C, as the next one does
                seen.update(some)
            docs.update(seen)
            size += len(n) - before
            if size > MOST_HELD:
                yield flushed()
                size = 0
    if held:
        yield flushed()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; the term '' stands for the group itself."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    part = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """p = 1 + floor(SCALE (count + 2) / (total + 2 kept)), exactly, by long division in three steps of 1000."""
    by = total + 2 * kept
    whole, rest = np.divmod(count + 2, by)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, by)
        whole = whole * 1000 + more
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _cell(top: int):
    """A cell's rows to rows (lang, source, part, item, value): partial sums of pairs, each pair once, and the best terms of the block."""

    def run(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
        lang, _, first, second = (x.as_py() for x in key)
        side, source, term = (cell.column(c) for c in ("tile", "source", "term"))
        count, total, n, lang_n, v, block_v = (cell.column(c).to_numpy() for c in ("n", "total", "group_n", "lang_n", "v", "block_v"))
        heads = np.flatnonzero(source.is_valid().to_numpy() & term.is_null().to_numpy())
        # Groups by tile, then by name; the rows of one group share a number.
        tiles, names = side.to_numpy(), source.to_pylist()
        heads = sorted(heads.tolist(), key=lambda i: (tiles[i], names[i]))
        at = {names[i]: k for k, i in enumerate(heads)}
        own = [names[i] for i in heads]
        kept = int(v[heads[0]])
        rows = np.flatnonzero(term.is_valid().to_numpy())
        words = term.take(pa.array(rows)).combine_chunks().dictionary_encode()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        column, vocabulary = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
        dense = np.zeros((len(own), len(vocabulary)), dtype=np.int64)
        line = np.fromiter((at[names[i]] for i in rows.tolist()), dtype=np.int64, count=len(rows))
        dense[line, column] = count[rows]
        totals = n[heads]
        pairs: list[tuple[str, str, int]] = []
        p = shares(dense, totals[:, None], np.int64(kept)) if kept else dense + 1
        none = shares(np.zeros_like(totals), totals, np.int64(kept)) if kept else np.ones_like(totals)
        unseen = int(block_v[heads[0]]) - len(vocabulary)
        edge = sum(1 for i in heads if tiles[i] == first)
        for i in range(edge):
            others = slice(i + 1 if first == second else edge, len(own))
            sums = divergence(p[i], p[others]).sum(axis=1) + unseen * divergence(none[i], none[others])
            pairs += [(own[i], x, int(s)) for x, s in zip(own[others], sums.tolist(), strict=True)]
        best: list[tuple[str, str, int]] = []
        if first == second and len(vocabulary):
            whole = np.zeros(len(vocabulary), dtype=np.int64)
            whole[column] = total[rows]
            q = shares(whole, lang_n[heads[0]], np.int64(kept))
            rank = np.empty(len(vocabulary), dtype=np.int64)
            rank[sorted(range(len(vocabulary)), key=lambda j: vocabulary[j].encode())] = np.arange(len(vocabulary))
            for i in range(len(own)):
                held = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                value = divergence(p[i, held], q[held])
                some = held[order := np.lexsort((rank[held], -value))[:top]]
                best += [(own[i], vocabulary[j], s) for j, s in zip(some.tolist(), value[order].tolist(), strict=True)]
        out = pairs + best
        parts = ["pair"] * len(pairs) + ["term"] * len(best)
        source, item, value = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(parts, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def _both(tile: Column, tiles: Column) -> Column:
    """The pairs of tiles that ``tile`` is in, as an array of (first, second)."""
    return F.transform(F.sequence(F.lit(0), tiles - 1), lambda x: F.struct(F.least(tile, x).alias("first"), F.greatest(tile, x).alias("second")))


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, block_terms: int = BLOCK_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of its language by divergence, and the ``top`` terms that a source has more of than its language."""
    with scratch(docs.sparkSession) as keep:
        counts = written(term_counts(docs), "div-counts")
        kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("total")).where(F.col("in_docs") >= least_docs)
        kept = written(kept.select("lang", "term", "total"), "div-kept")
        held = written(counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "div-held")

        # One row for each language: few beside the counts, yet joined by Spark's own choice, as nothing bounds them.
        of_lang = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("v"))
        groups = counts.where("term = ''").select("lang", "source")
        sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile_groups).cast("int").alias("tiles")).join(of_lang, "lang", "left").na.fill(0, ["lang_n", "v"])
        sizes = written(sizes.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).cast("int")), "div-langs")
        own = held.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
        heads = groups.join(own, ["lang", "source"], "left").na.fill(0, ["group_n"]).join(sizes, "lang")
        heads = heads.select("lang", "source", "group_n", "lang_n", "v", "tiles", tile, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
        of_block = kept.join(sizes.select("lang", "blocks"), "lang").groupBy("lang", block).agg(F.count("*").alias("block_v"))
        heads = heads.join(written(of_block, "div-blocks"), ["lang", "block"], "left").na.fill(0, ["block_v"])
        blank = lambda c, kind="long": F.lit(None).cast(kind).alias(c)
        heads = heads.select("lang", "block", F.explode(_both(F.col("tile"), F.col("tiles"))).alias("of"), "tile", "source", blank("term", "string"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), "group_n", "lang_n", "v", "block_v")
        rows = held.join(sizes.select("lang", "tiles", "blocks"), "lang").select("lang", "source", "term", "n", "total", "tiles", tile, block)
        nothing = [F.lit(0).cast("long").alias(c) for c in ("group_n", "lang_n", "v", "block_v")]
        rows = rows.select("lang", "block", F.explode(_both(F.col("tile"), F.col("tiles"))).alias("of"), "tile", "source", "term", "n", "total", *nothing)
        cells = heads.unionByName(rows).select("lang", "block", F.col("of.first").alias("first"), F.col("of.second").alias("second"), "tile", "source", "term", "n", "total", "group_n", "lang_n", "v", "block_v")
        made = written(cells.groupBy("lang", "block", "first", "second").applyInArrow(_cell(top), "lang string, source string, part string, item string, value long"), "div-cells")

        sums = written(made.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "div-pairs")
        turned = sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        pairs = sums.unionByName(turned).withColumn("part", F.lit("pair"))
        every = pairs.unionByName(made.where("part = 'term'"), allowMissingColumns=True)
        order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        ranked = every.select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' OR rank <= {int(top)}")
        return keep(written(ranked, "div-ranked"))


def divergence_sql(least_docs: int = 10, top: int = 10) -> str:
    """The same in DuckDB's SQL."""
    p = lambda n, total: f"(1 + {SCALE}::HUGEINT * ({n} + 2) // ({total} + 2 * v))"
    f = lambda a, b: f"(({a} - {b}) * ({a} - {b}) // ({a} + {b}))"
    upper, lower = "".join(map(chr, LOWER)), "".join(map(chr, LOWER.values()))
    return rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d), e AS (SELECT lang, source, row, unnest(t) AS term FROM (SELECT *, row_number() OVER () AS row FROM d)),
    k AS (SELECT lang, term, count(*) AS total FROM e GROUP BY ALL HAVING count(DISTINCT row) >= {least_docs}),
    l AS (SELECT lang, sum(total)::HUGEINT AS lang_n, count(*)::HUGEINT AS v FROM k GROUP BY lang),
    c AS (SELECT e.lang, source, term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY ALL),
    o AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS group_n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    m AS (SELECT o.lang, o.source, term, total, coalesce(n, 0) AS n, group_n, lang_n, v FROM o JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
    s AS (SELECT *, {p('n', 'group_n')} AS p, {p('total', 'lang_n')} AS q FROM m),
    x AS (SELECT a.lang, a.source, b.source AS item, sum({f('a.p', 'b.p')})::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, {f('p', 'q')}::BIGINT FROM s WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM y)
    SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {top}"""
