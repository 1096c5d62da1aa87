"""Guards against texts that game a reward: length, verbatim copies, and the record's own layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T


def length_penalty(text: Column, target: int = L.TARGET_WORDS, weight: float = L.W_LENGTH) -> Column:
    """Only of what is longer than the target."""
    return -weight * F.greatest(F.lit(0.0), (T.n_pieces(text) - target) / target)


def grams(text: Column, n: int = L.COPY_N) -> Column:
    return T.ngrams(T.pieces(F.lower(text)), n)


def copy_overlap(text: Column, source: Column, n: int = L.COPY_N) -> Column:
    """Share of the text's distinct n-grams that the source has; 0 where it has none."""
    own = grams(text, n)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, grams(source, n))) / F.size(own)).otherwise(0.0)


def copy_penalty(overlap: Column, tolerance: float = L.COPY_TOLERANCE, weight: float = L.W_COPY) -> Column:
    return -weight * F.greatest(F.lit(0.0), overlap - tolerance)


def copies_too_much(overlap: Column, tolerance: float = L.COPY_TOLERANCE) -> Column:
    return overlap > tolerance


def format_hits(text: Column) -> Column:
    """Marks of a record's layout, and half a hit for each line break after the first."""
    scaffold = F.regexp_count(text, F.lit("(?im)" + "|".join(L.SCAFFOLD)))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return scaffold + 0.5 * F.greatest(F.lit(0), breaks - 1)


def format_penalty(hits: Column, weight: float = L.W_FORMAT) -> Column:
    return -weight * hits


def filtered(hits: Column, overlap: Column) -> tuple[Column, Column]:
    """Whether a candidate is out, and why."""
    why = F.concat_ws("; ", F.when(hits > 0, F.lit("format")), F.when(copies_too_much(overlap), F.lit("copy")))
    return why != "", why
