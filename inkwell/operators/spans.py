"""Spans within a row: surfaces found in texts, tokens tagged from spans, entities folded from tags.  All run over Arrow batches, with no shuffle;
a batch is worked on in parts of bounded rows and bytes, as a text may hold hundreds of mentions or tokens.
The functions are marked as not deterministic, so that Spark computes each once where several columns or filters read it.

Finding: one Aho-Corasick automaton over all surfaces of a batch reads each text once.  Of the occurrences of one surface
those count that a search from left to right finds, which don't overlap each other.  Longer surfaces take their places
first, among equally long ones the one named first, and an occurrence that overlaps a taken place is dropped: the taken places
are a sorted list of intervals, looked up by bisection.

Folding: B opens an entity and I of its type goes on with it.  The tags of all texts of a batch are one array: a token goes on where
its predecessor has the same type in the same text, so an entity ends at the first token after it that doesn't.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import lexicons as L
from .batches import parts

MENTION = "array<struct<start:int,end:int,surface:string,type:string>>"
_MENTION = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("type", pa.string())]))
SHORT = {kind: short for kind, _, short, _ in L.TYPES}
COMMON = {short: common for _, _, short, common in L.TYPES}


class Taken:
    """Intervals that don't overlap, sorted."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Takes the interval unless one that is there overlaps it."""
        at = bisect_left(self.starts, end)  # of the intervals that begin before ``end`` the last one reaches farthest
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


class Surfaces:
    """An automaton over surfaces; empty ones and nulls match nothing."""

    def __init__(self, surfaces: Iterable[str | None]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for s in surfaces:
            if s:
                self.automaton.add_word(s, s)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> dict[str, list[int]]:
        """Where each surface starts, from left to right, without those that overlap one of its own before them."""
        out: dict[str, list[int]] = {}
        if len(self.automaton) and text:
            for last, s in self.automaton.iter(text):
                start = last + 1 - len(s)
                if (at := out.get(s)) is None:
                    out[s] = [start]
                elif start >= at[-1] + len(s):
                    at.append(start)
        return out

    def mentions(self, text: str | None, kinds: dict[str, tuple[int, str | None]]) -> list[tuple[int, int, str, str | None]]:
        """(start, end, surface, type) of the surfaces in ``kinds`` (to their place in the order and type)."""
        found = self.found(text or "")
        taken, out = Taken(), []
        for s in sorted(found.keys() & kinds.keys(), key=lambda s: (-len(s), kinds[s][0])):
            out += [(at, at + len(s), s, kinds[s][1]) for at in found[s] if taken.take(at, at + len(s))]
        return sorted(out, key=lambda m: m[0])


def _ordered(candidates: Iterable[tuple[str | None, str | None]]) -> dict[str, tuple[int, str | None]]:
    """Each surface's place and type; a surface named again adds nothing, as its first naming has taken all its places."""
    out: dict[str, tuple[int, str | None]] = {}
    for k, (surface, kind) in enumerate(candidates):
        if surface:
            out.setdefault(surface, (k, kind))
    return out


def _arrow(made: list[list[tuple] | None], kind: pa.DataType) -> pa.Array:
    """Lists of tuples as lists of structs, column by column."""
    sizes = np.cumsum([0, *(len(x or ()) for x in made)]).astype(np.int32)
    flat = [t for x in made if x for t in x]
    fields = list(kind.value_type)
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(sizes), values)


def _joined(made: Iterable[pa.Array]) -> pa.Array:
    return pa.concat_arrays([_arrow([], _MENTION), *made])


def _own(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """The mentions of each text's own candidates."""
    asked = [_ordered((c["surface"], c["type"]) for c in row or ()) for row in wanted.to_pylist()]
    automaton = Surfaces(dict.fromkeys(s for kinds in asked for s in kinds))
    return _arrow([automaton.mentions(t.as_py(), kinds) for t, kinds in zip(texts, asked, strict=True)], _MENTION)


def mentions(text: Column, candidates: Column) -> Column:
    """The mentions of each row's own candidates, an array of (surface, type)."""

    @F.arrow_udf(MENTION)
    def mark(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        return _joined(_own(part.column(0), part.column(1)) for part in parts(pa.RecordBatch.from_arrays([texts, wanted], ["text", "wanted"])))

    return mark.asNondeterministic()(text, candidates)


def with_mentions(df: DataFrame, text: str, candidates: str, name: str = "mentions") -> DataFrame:
    """Adds ``mentions`` as a column, as a step of its own; for a table that is then joined with itself, where Spark may fail to plan the function."""
    at = [df.columns.index(text), df.columns.index(candidates)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in parts(batch)):
            yield pa.RecordBatch.from_arrays([*part.columns, _own(part.column(at[0]), part.column(at[1]))], [*part.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` {MENTION}").fields]))


def with_mentions_of(df: DataFrame, text: str, surfaces: Sequence[tuple[str, str]], name: str = "mentions", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds ``mentions_of`` to the columns (or to ``keep``), as a step of its own: what is found leaves Python part by part, where a function has to return a batch's mentions at once."""
    kinds, at = _ordered(surfaces), df.columns.index(text)
    own = [df.columns.index(c) for c in (df.columns if keep is None else keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Surfaces(kinds)
        for part in (x for batch in batches for x in parts(batch)):
            found = _arrow([automaton.mentions(t.as_py(), kinds) for t in part.column(at)], _MENTION)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in own), found], [*(names[k] for k in own), name])

    names = df.columns
    return df.mapInArrow(run, StructType([*(df.schema.fields[k] for k in own), *StructType.fromDDL(f"`{name}` {MENTION}").fields]))


def mentions_of(text: Column, surfaces: Sequence[tuple[str, str]], most: int = 1_000_000) -> Column:
    """The mentions of surfaces (surface, type) that are the same for all rows; they go to each worker once, ``most`` at most."""
    if len(surfaces) > most:
        raise ValueError(f"more than {most} surfaces: name the candidates of each row instead")
    kinds, made = _ordered(surfaces), []

    @F.arrow_udf(MENTION)
    def mark(texts: pa.Array) -> pa.Array:
        if not made:  # once in a worker
            made.append(Surfaces(kinds))
        found = (part.column(0) for part in parts(pa.RecordBatch.from_arrays([texts], ["text"])))
        return _joined(_arrow([made[0].mentions(t.as_py(), kinds) for t in some], _MENTION) for some in found)

    return mark.asNondeterministic()(text)


def _rows(lists: pa.ListArray) -> np.ndarray:
    """The row of each value of ``lists.flatten()``."""
    return np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))


def _tags(pieces: pa.ListArray, marks: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Row, place, token and tag of each piece that isn't white space; a text's mentions are in order and don't overlap."""
    flat, row, own, at = pieces.flatten(), _rows(pieces), marks.flatten(), _rows(marks)
    length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    start, first = np.cumsum(length) - length, np.searchsorted(row, row, side="left")
    start = start - start[first]
    begins, ends = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    m = np.searchsorted((at << 32) + begins, (row << 32) + start, side="right") - 1
    inside = m >= 0
    inside[inside] = (at[m[inside]] == row[inside]) & ((start + length)[inside] <= ends[m[inside]])
    kinds = own.field(3).dictionary_encode()
    kind = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)[m[inside]]
    used = np.unique(kind).tolist()
    names = [None if k < 0 else kinds.dictionary[k].as_py() for k in used]
    code = np.zeros(len(flat), dtype=np.int64)
    code[inside] = 1 + 2 * np.searchsorted(used, kind) + (start[inside] != begins[m[inside]])
    tags = pa.array(["O", *(f"{x}-{SHORT[n]}" for n in names for x in "BI")])
    distinct = flat.dictionary_encode()
    blank = np.array([x.isspace() for x in distinct.dictionary.to_pylist()], dtype=bool)
    kept = np.flatnonzero(~blank[distinct.indices.to_numpy(zero_copy_only=False)])
    return row[kept], (np.arange(len(flat)) - first)[kept], flat.take(pa.array(kept)), tags.take(pa.array(code[kept]))


def tagged(df: DataFrame) -> DataFrame:
    """(key, pos, token, tag) of rows (key, parts, marks), a text cut into tokens and white space and its mentions: what lies in a mention is tagged, B where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in parts(batch)):
            row, pos, token, tag = _tags(part.column(1), part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), token, tag], [key, "pos", "token", "tag"])

    key = df.columns[0]
    return df.mapInArrow(run, StructType([df.schema[key], *StructType.fromDDL("pos int, token string, tag string").fields]))


def _fold(tokens: pa.ListArray, tags: pa.ListArray, blank_ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, pa.Array, np.ndarray]:
    """Row, first and last token (exclusive) and type of each entity, the flat tokens, and where each token starts in its text.

    ``blank_ends``: a null token ends an entity and an I that fits none opens one; else null tokens are as if they weren't there
    and such an I is nothing.
    """
    flat_tokens, flat_tags = tokens.flatten(), tags.flatten()
    row = _rows(tokens)
    if not blank_ends:
        there = flat_tokens.is_valid()
        flat_tokens, flat_tags, row = flat_tokens.filter(there), flat_tags.filter(there), row[there.to_numpy(zero_copy_only=False)]
    coded = flat_tags.dictionary_encode()
    names = [x or "O" for x in coded.dictionary.to_pylist()]
    opens = np.array([*(x.startswith("B-") for x in names), False])
    tagged_ = np.array([*(x[:2] in ("B-", "I-") for x in names), False])
    kinds = {x: k for k, x in enumerate(dict.fromkeys(x[2:] for x in names if x[:2] in ("B-", "I-")))}
    kind_of = np.array([*(kinds[x[2:]] if x[:2] in ("B-", "I-") else -1 for x in names), -1])
    code = coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
    kind, begins, within = kind_of[code], opens[code], tagged_[code]
    goes_on = within & ~begins
    if len(goes_on):
        goes_on &= np.concatenate([[False], (row[1:] == row[:-1]) & (kind[1:] == kind[:-1])])
    starts = np.flatnonzero(within & ~goes_on if blank_ends else begins)
    stops = np.append(np.flatnonzero(~goes_on), len(code))
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    length = pc.utf8_length(flat_tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    place = np.cumsum(length) - length
    first = np.searchsorted(row, row, side="left") if len(row) else row
    place = place - place[first] if len(row) else place
    return row[starts], starts, ends, [COMMON.get(list(kinds)[k]) for k in kind[starts].tolist()], flat_tokens, place


def _entities(mode: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in parts(whole)):
            row, starts, ends, kinds, tokens, place = _fold(batch.column(1), batch.column(2), mode == "set")
            names = batch.column(0).take(pa.array(row))
            words = [" ".join(tokens.slice(a, b - a).to_pylist()) if b > a + 1 else tokens[a].as_py() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            if mode == "set":
                seen = dict.fromkeys(zip(row.tolist(), words, kinds, strict=True))
                sizes = np.bincount(np.fromiter((x[0] for x in seen), dtype=np.int64, count=len(seen)), minlength=batch.num_rows)
                values = pa.StructArray.from_arrays([pa.array([x[k] for x in seen], pa.string()) for k in (1, 2)], ["entity", "type"])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), values)], ["doc_id", "found"])
            else:
                stop = place[ends - 1] + pc.utf8_length(tokens.take(pa.array(ends - 1))).to_numpy(zero_copy_only=False) if len(ends) else ends
                yield pa.RecordBatch.from_arrays([names, pa.array(words, pa.string()), pa.array(kinds, pa.string()), pa.array(place[starts].astype(np.int32)), pa.array(np.asarray(stop).astype(np.int32))], ["doc_id", "surface", "type", "start", "end"])

    return run


def entities(tags: DataFrame, mode: str = "offsets") -> DataFrame:
    """Entities of rows (doc_id, tokens, tags), two arrays of one length; a null token is a blank line.

    ``offsets``: doc_id, surface, type, start, end in the text of all tokens joined by spaces.  ``set``: doc_id, found, an array
    of (entity, type), each once.  Null arrays count as empty.
    """
    if mode not in ("offsets", "set"):
        raise ValueError(f"no mode {mode!r}")
    schema = "doc_id string, surface string, type string, start int, end int" if mode == "offsets" else "doc_id string, found array<struct<entity:string,type:string>>"
    none = F.array().cast("array<string>")
    return tags.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("tokens", none).alias("tokens"), F.coalesce("tags", none).alias("tags")).mapInArrow(_entities(mode), schema)
