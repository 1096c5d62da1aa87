"""Operator 12: cross-tokenizer alignment by elementary intervals.

Two tokenizers cut the same bytes, A (byte-level BPE, a tokenizers file) and B (pieces, a sentencepiece model).  The union of both
arrays of token ends cuts the bytes into elementary intervals; ``searchsorted`` names the A and the B token that own each.
Every interval is one overlap of two tokens; one that ends where both its owners end closes a group.  LINKS says which
occurrences count as linked: ``ends`` (byte ranges that end together), ``overlaps`` (every interval) or ``groups`` (the
product of each group's A and B tokens).

A text is read as a space and the text.  It is cut at places where neither tokenizer can have a token that spans them: before
a space that follows a Latin letter, a digit or an ASCII sign.  A's pre-splitting pattern has white space only at the start
of a match or alone, and no piece of B has its space mark after another character (checked when the model is read).  So both
tokenizers end a token there, groups never reach across, and a text is aligned piece by piece.  For the same reason pieces that
end in such a character can be encoded as one text; that they spell it and that tokens end where they do is checked each time.
Pieces repeat, so a worker keeps the outcome of about MOST_KEPT of them (of at most KEPT_CHARS characters), the most used
half of them when there are more, and aligns the new ones of some texts all at once, as one stretch of bytes.

The counts: each text's distinct linked id pairs with their numbers are written once.  Grouped sums with map-side
combination give each pair's count.  At most HOT pairs can hold 1 / HOT of all links each; those go to every task, all
others meet their rows in a join of plain exchanges, which adaptive execution can split.

Defined results: a null or empty text, and one whose tokens' bytes don't spell it (a literal U+2581), has no tokens and
zeros; a special token's name is ordinary text; repeated rows are rows of their own, each counted; a row without a doc_id is
kept and counted; other columns are ignored; an empty table gives an empty result.  A text without a place to cut, such as
one long run of Chinese, is one piece however long.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, scratch, texts, written

#: Pieces whose outcome a worker keeps, the characters of the longest of those, and new ones aligned at a time; characters of the texts cut at a time.
MOST_KEPT, KEPT_CHARS, NEW, AT_ONCE = 300_000, 64, 5000, 1 << 20
#: Pieces that B encodes as one text.
TOGETHER = 50
#: What B writes for a space.  Its tokens stand for spaces, so none spells a text's own.
MARK = "▁"
#: A pair with at least one in HOT of all links goes to every task: there are at most HOT such pairs.
HOT = 1 << 16
LINKS = ("ends", "overlaps", "groups")
#: Spaces and what follows them, up to the next space that follows a character of this class.
PIECE = re.compile("[ ]+[^ ]*(?:(?<![!-~À-ɏ])[ ]+[^ ]*)*")
#: That class: a piece that ends in one of these can have any other behind it.
CLOSING = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x250)]))


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Flat:
    """Byte strings as one array."""

    def __init__(self, each: list[bytes]) -> None:
        self.size = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        self.first, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(each), dtype=np.uint8)

    def spell(self, raw: np.ndarray, ids: np.ndarray) -> bool:
        """Whether the strings ``ids``, which have as many bytes, spell ``raw``; some are compared at a time."""
        at = 0
        for k in range(0, len(ids), 1 << 16):
            own = self.bytes[spread(self.first[ids[k : k + (1 << 16)]], self.size[ids[k : k + (1 << 16)]])]
            if not np.array_equal(own, raw[at : at + len(own)]):
                return False
            at += len(own)
        return True


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of consecutive runs, given where each begins and its length."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, json_file: str, model_file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(json_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_file)
        byte, size = byte_of(), self.a.get_vocab_size()
        special = {i for i, t in self.a.get_added_tokens_decoder().items()}
        named = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [named[i].encode() if i in special else bytes(byte[c] for c in named[i]) if i in named else b"" for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has its space mark after another character: texts can't be cut before spaces")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(MARK)
        self.held_a, self.held_b = Flat(self.bytes_a), Flat(self.bytes_b)
        self.size_a, self.size_b = self.held_a.size, self.held_b.size
        # Bits of a B id, and of a pair of ids.
        self.bits_b = max(1, (len(pieces) - 1).bit_length())
        self.bits = self.bits_b + max(1, (size - 1).bit_length())
        # Decimal ids with what follows them within a group, and at the end of the group's A or B part: A's, then B's.
        shown = [f"{i}{mark}" for marks, n in ((",|", size), (",;", len(pieces))) for mark in marks for i in range(n)]
        self.shown, self.shown_size = np.array(shown, dtype=object), np.fromiter(map(len, shown), dtype=np.int64, count=len(shown))

    def encode(self, pieces: list[str], together: int = 1) -> tuple[list[int], list[int]]:
        """Ids of pieces that each begin with a space, one after another.  B adds one itself, but for an empty rest.

        With ``together`` as many pieces are one text for B, and all for A: each but the last has to end in a character of CLOSING.
        """
        joined = pieces if together == 1 else ["".join(pieces[at : at + together]) for at in range(0, len(pieces), together)]
        a = self.a.encode_batch_fast(joined if together == 1 else ["".join(pieces)], add_special_tokens=False)
        b = self.b.encode([p[1:] for p in joined], num_threads=1)
        ids_b = itertools.chain.from_iterable(ids if len(p) > 1 else [self.space] for ids, p in zip(b, joined, strict=True))
        return list(itertools.chain.from_iterable(x.ids for x in a)), list(ids_b)


@functools.lru_cache(maxsize=2)
def tokenizers_of(json_file: str, model_file: str) -> Tokenizers:
    return Tokenizers(json_file, model_file)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Intervals:
    """The elementary intervals of two partitions of the same bytes, given by their ends."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        self.ends = both[np.append(both[1:] != both[:-1], True)] if len(both) else both
        self.a, self.b = np.searchsorted(ends_a, self.ends), np.searchsorted(ends_b, self.ends)
        self.closes = (ends_a[self.a] == self.ends) & (ends_b[self.b] == self.ends) if len(self.ends) else np.zeros(0, dtype=bool)
        self.closed = self.ends[self.closes]
        self.group_a, self.group_b = np.searchsorted(self.closed, ends_a), np.searchsorted(self.closed, ends_b)

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the linked A and B tokens, in order."""
        if kind == "ends":
            return self.a[self.closes], self.b[self.closes]
        if kind == "overlaps":
            return self.a, self.b
        n_a, n_b = (np.bincount(g, minlength=len(self.closed)) for g in (self.group_a, self.group_b))
        first_a, first_b, each = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
        group = np.repeat(np.arange(len(each)), each)
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return first_a[group] + k // n_b[group], first_b[group] + k % n_b[group]


def with_room(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, or a longer copy, so that its last axis has at least ``n`` places."""
    if x.shape[-1] >= n:
        return x
    out = np.zeros((*x.shape[:-1], max(n, 2 * x.shape[-1])), dtype=x.dtype)
    out[..., : x.shape[-1]] = x
    return out


class Table:
    """What has been found for pieces, by row: numbers of tokens and groups, the groups as text, and the linked id pairs."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}  # in the order of the rows
        self.shown: list[str] = []
        self.sizes = np.zeros((4, 0), dtype=np.int64)  # A tokens, B tokens, groups, links; -1 where the tokens don't spell the piece
        self.first = np.zeros(1, dtype=np.int64)  # where each row's pairs begin
        self.pairs = np.zeros(0, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int64)

    def add(self, pieces: list[str], sizes: np.ndarray, shown: list[str], pairs: np.ndarray) -> None:
        old, new = len(self.shown), len(self.shown) + len(pieces)
        self.row.update(zip(pieces, range(old, new), strict=True))
        self.shown += shown
        self.sizes, self.used, self.first = with_room(self.sizes, new), with_room(self.used, new), with_room(self.first, new + 1)
        self.sizes[:, old:new], self.used[old:new] = sizes, 0
        self.first[old + 1 : new + 1] = self.first[old] + np.cumsum(np.maximum(sizes[3], 0))
        self.pairs = with_room(self.pairs, self.first[new])
        self.pairs[self.first[old] : self.first[new]] = pairs

    def without(self, n: int) -> None:
        """Forgets the last ``n`` rows."""
        for _ in range(n):
            self.row.popitem()
            self.shown.pop()

    def most_used(self, n: int) -> Table:
        """The ``n`` most used rows, in a table of their own; earlier uses count by half from now on."""
        rows = np.sort(np.argsort(-self.used[: len(self.shown)], kind="stable")[:n])
        out, pieces, sizes = Table(), list(self.row), self.sizes[:, rows]
        pairs = self.pairs[spread(self.first[rows], np.maximum(sizes[3], 0))]
        out.add([pieces[k] for k in rows.tolist()], sizes, [self.shown[k] for k in rows.tolist()], pairs)
        out.used[: len(rows)] = self.used[rows] // 2
        return out


def passing(piece: str) -> int:
    """0 for a piece to be kept; 1 for a long one, 2 or 3 where only the text's end closes it.  Pieces are aligned in this order."""
    return (len(piece) > KEPT_CHARS) + 2 * (piece[-1] not in CLOSING)


def spelled(t: Tokenizers, pieces: list[str], a: list[int], b: list[int]) -> tuple[np.ndarray, ...] | None:
    """Of A and of B the ids, their ends in bytes and how many end up to each piece's end; None if they don't spell the pieces or cross such an end."""
    raw, out = np.frombuffer("".join(pieces).encode(), dtype=np.uint8), []
    stops = np.cumsum(np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in pieces), dtype=np.int64, count=len(pieces)))
    for ids, held in ((a, t.held_a), (b, t.held_b)):
        ids = np.array(ids, dtype=np.int64)
        ends = np.cumsum(held.size[ids])
        if not len(ends) or ends[-1] != len(raw) or not held.spell(raw, ids):
            return None
        at = np.searchsorted(ends, stops)
        if not np.array_equal(ends[at], stops):
            return None
        out += [ids, ends, at + 1]
    return tuple(out)


def align(t: Tokenizers, pieces: list[str], links: str) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Sizes, groups as text and linked pairs of the pieces, aligned all at once as one stretch of bytes; those that end in CLOSING come first."""
    sizes, shown, none = np.full((4, len(pieces)), -1, dtype=np.int64), [""] * len(pieces), np.zeros(0, dtype=np.int64)
    good = [k for k, p in enumerate(pieces) if MARK not in p]
    some = [pieces[k] for k in good]
    if not some:
        return sizes, shown, none
    closed = next((k for k, p in enumerate(some) if p[-1] not in CLOSING), len(some))
    each = [t.encode(part, together) for part, together in ((some[:closed], TOGETHER), (some[closed:], 1)) if part]
    found = spelled(t, some, *(list(itertools.chain.from_iterable(x)) for x in zip(*each, strict=True)))
    if found is None and len(some) == 1:
        return sizes, shown, none
    if found is None:  # each half by itself, down to the piece that isn't spelled
        sizes, shown, pairs = zip(*(align(t, part, links) for part in (pieces[: len(pieces) // 2], pieces[len(pieces) // 2 :])), strict=True)
        return np.concatenate(sizes, axis=1), shown[0] + shown[1], np.concatenate(pairs)
    ids_a, ends_a, stop_a, ids_b, ends_b, stop_b = found
    cut = Intervals(ends_a, ends_b)
    # Tokens in the order of the groups, A's first: with the mark of a list, or of the end of a group's part.
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (cut.group_a, cut.group_b))
    marked = np.concatenate([ids_a + last_a * len(t.bytes_a), ids_b + last_b * len(t.bytes_b) + 2 * len(t.bytes_a)])
    marked = marked[np.argsort(np.concatenate([2 * cut.group_a, 2 * cut.group_b + 1]), kind="stable")]
    whole, stops = "".join(t.shown[marked].tolist()), np.cumsum(t.shown_size[marked])[stop_a + stop_b - 1].tolist()
    for k, low, high in zip(good, [0, *stops], stops, strict=False):
        shown[k] = whole[low:high]
    x, y = cut.links(links)
    sizes[:, good] = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0), np.diff(cut.group_a[stop_a - 1], prepend=-1), np.diff(np.searchsorted(x, stop_a), prepend=0)
    return sizes, shown, ids_a[x] << t.bits_b | ids_b[y]


class Aligner:
    """Aligns texts; keeps what was found for short pieces, and of a full table the most used half."""

    def __init__(self, t: Tokenizers, links: str) -> None:
        if links not in LINKS:
            raise ValueError(f"no such links {links!r}; there are {LINKS}")
        self.t, self.links = t, links
        self.kept = Table()

    def __call__(self, some: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups and n_links of each text, its groups as text, where its distinct pairs end, the pairs' keys, their numbers."""
        cut = [PIECE.findall(" " + x) if x else [] for x in some]
        if len(self.kept.shown) > MOST_KEPT:
            self.kept = self.kept.most_used(MOST_KEPT // 2)
        table, pieces = self.kept, list(itertools.chain.from_iterable(cut))
        rows = np.fromiter(map(table.row.get, pieces, itertools.repeat(-1)), dtype=np.int64, count=len(pieces))
        missing = np.flatnonzero(rows < 0)
        asked = [pieces[k] for k in missing.tolist()]
        new = sorted(dict.fromkeys(asked), key=passing)
        for at in range(0, len(new), NEW):
            part = new[at : at + NEW]
            table.add(part, *align(self.t, part, self.links))
        rows[missing] = np.fromiter(map(table.row.__getitem__, asked), dtype=np.int64, count=len(asked))
        table.used[: len(table.shown)] += np.bincount(rows, minlength=len(table.shown))
        out = self.texts(rows, np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)))
        table.without(len(new) - bisect.bisect_left(new, 1, key=passing))
        return out

    def texts(self, rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The result for texts of ``count`` pieces each, given the rows of all pieces."""
        table, text = self.kept, np.repeat(np.arange(len(count)), count)
        bad = np.zeros(len(count), dtype=bool)
        bad[text[table.sizes[0, rows] < 0]] = True
        if bad.any():
            rows, text, count = rows[~bad[text]], text[~bad[text]], np.where(bad, 0, count)
        stop, sizes = np.cumsum(count), table.sizes[:, rows]
        sums = np.concatenate([np.zeros((4, 1), dtype=np.int64), np.cumsum(sizes, axis=1)], axis=1)
        listed, stops = rows.tolist(), stop.tolist()
        shown = ["".join(map(table.shown.__getitem__, listed[low:high]))[:-1] for low, high in zip([0, *stops], stops, strict=False)]
        # Each text's pairs in order, equal ones side by side.
        pairs = np.sort(np.repeat(text, sizes[3]) << self.t.bits | table.pairs[spread(table.first[rows], sizes[3])])
        begin = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else pairs
        times, pairs = np.diff(np.append(begin, len(pairs))), pairs[begin]
        ends = np.searchsorted(pairs >> self.t.bits, np.arange(len(count)), side="right")
        a, b = (pairs & (1 << self.t.bits) - 1) >> self.t.bits_b, pairs & (1 << self.t.bits_b) - 1
        return sums[:, stop] - sums[:, stop - count], shown, ends, a << 32 | b, times


def _stretches(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, about AT_ONCE characters at a time."""
    some, size = [], 0
    for x in texts(column):
        some.append(x)
        size += len(x)
        if size >= AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


@functools.lru_cache(maxsize=1)
def aligner_of(json_file: str, model_file: str, links: str) -> Aligner:
    """A worker's own, with what was found in its earlier tasks."""
    return Aligner(tokenizers_of(json_file, model_file), links)


def _rows(files: tuple[str, str], links: str, digest: bool):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "keys", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner_of(*files, links)
        for batch in batches:
            at = 0
            for some in _stretches(batch.column(1)):
                sizes, groups, ends, keys, times = work(some)
                if digest:
                    groups = [hashlib.sha256(x.encode()).hexdigest() if x else x for x in groups]
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(x)) for x in (keys, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *map(pa.array, sizes), pa.array(groups, pa.string()), *lists], names)
                at += len(some)

    return run


def alignments(docs: DataFrame, files: tuple[str, str] | None = None, links: str = "ends", digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, keys, times of every whole text.

    ``groups`` is the alignment itself, ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its SHA-256; ``keys`` are the distinct linked
    pairs, A's id times 2^32 plus B's, and ``times`` how many links of the text hold each.
    """
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, keys array<long>, times array<long>"
    return id_text(docs).mapInArrow(_rows(files or default_files(), links, digest), schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(key, count, best): links of the corpus that hold each id pair, and whether it is the highest of its B id's."""
    each = found.select(F.explode(F.arrays_zip("keys", "times")).alias("x")).select("x.*")
    counts = written(each.groupBy(F.col("keys").alias("key")).agg(F.sum("times").alias("count")), "align-counts")
    own = F.col("key").bitwiseAND(0xFFFFFFFF).alias("b")
    top = counts.groupBy(own).agg(F.max("count").alias("top"))
    return counts.select("key", "count", own).join(top, "b").select("key", "count", (F.col("count") == F.col("top")).alias("best"))


def token_alignment(docs: DataFrame, files: tuple[str, str] | None = None, links: str = "ends", hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text."""
    with scratch(docs.sparkSession) as keep:
        found = keep(written(alignments(docs, files, links, digest=True).withColumn("row", F.monotonically_increasing_id()), "align-texts"))
        counts = written(pair_counts(found), "align-pairs")
        least = (counts.agg(F.sum("count")).head()[0] or 0) / hot
        each = found.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("n"))
        met = each.join(F.broadcast(counts.where(F.col("count") >= least)), "key", "left")
        sure = met.where("count IS NOT NULL").select("row", "n", "count", "best")
        rest = met.where("count IS NULL").select("row", "key", "n").join(counts.where(F.col("count") < least), "key").select("row", "n", "count", "best")
        sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
        of_row = keep(written(sure.unionByName(rest).groupBy("row").agg(*sums), "align-sums"))
    out = found.drop("keys", "times").join(of_row, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
