"""Writers: JSON lines, token tags, TEI, blind rating sheets, authoring sheets, a short report."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators.spans import mentions, tagged

__all__ = ["authoring_sheet", "iob_text", "jsonl", "mentions", "rating_sheet", "report", "tagged_tokens", "tei_document", "tei_texts"]

ELEMENTS = {kind: element for kind, element, _, _ in L.TYPES}


def jsonl(df: DataFrame, path: str, nulls: bool = True) -> None:
    """One object a line, in UTF-8; ``nulls``: with explicit nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", not nulls).json(path)


def tagged_tokens(df: DataFrame, key: str, text: str, marks: str) -> DataFrame:
    """key, pos, token, tag: tokens inside a mention are tagged, B where a mention starts.  Within the row, without a shuffle."""
    parts = F.filter(F.regexp_extract_all(F.col(text), F.lit(rf"{L.TOKEN}|\s+"), F.lit(0)), lambda x: x != "")
    return tagged(df.select(key, parts.alias("parts"), marks))


def iob_text(tags: DataFrame, key: str) -> DataFrame:
    """key, value: a line for each token, and a blank one after the end of a sentence."""
    line = F.concat(F.col("token"), F.lit(" "), F.col("tag"), F.when(F.col("token").isin(".", "!", "?"), "\n").otherwise(""))
    made = tags.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"))
    return made.select(key, F.concat(F.rtrim(F.regexp_replace(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), r"\s+$", "")), F.lit("\n")).alias("value"))


def _dated(value: str) -> str:
    parts = [p.strip() for p in value.replace("–", "-").split("-")]
    if len(parts) == 2 and all(p.isdigit() for p in parts):
        return f" from={quoteattr(parts[0])} to={quoteattr(parts[1])}"
    return f" when={quoteattr(value.strip())}" if value.strip().isdigit() else ""


def tei_document(title: str, references: str, text: str, marks: list[dict]) -> str:
    body, at = [], 0
    for m in marks:
        element = ELEMENTS[m["type"]]
        body += [escape(text[at : m["start"]]), f"<{element}{_dated(m['surface']) if m['type'] == 'date' else ''}>", escape(text[m["start"] : m["end"]]), f"</{element}>"]
        at = m["end"]
    body.append(escape(text[at:]))
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<TEI xmlns="http://www.tei-c.org/ns/1.0">\n  <teiHeader>\n    <fileDesc>\n'
        f"      <titleStmt>\n        <title>{escape(title)}</title>\n      </titleStmt>\n"
        "      <publicationStmt>\n        <p>Fictional synthetic data — not a real archival record.</p>\n      </publicationStmt>\n"
        f"      <sourceDesc>\n        <p>Synthetic; nominal source refs: {escape(references)}</p>\n      </sourceDesc>\n"
        f"    </fileDesc>\n  </teiHeader>\n  <text>\n    <body>\n      <p>{''.join(body)}</p>\n    </body>\n  </text>\n</TEI>\n"
    )


def tei_texts(df: DataFrame, key: str) -> DataFrame:
    """key, value from rows (key, title, references, text, mentions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tei_document(*r) for r in rows], pa.string())], [key, "value"])

    return df.select(F.col(key).cast("string").alias(key), "title", "references", "text", "mentions").mapInArrow(run, f"{key} string, value string")


def rating_sheet(candidates: DataFrame, seed: int = 7) -> DataFrame:
    """record_id, label, i, html: candidates in an order drawn from the seed, named A, B, C ..., without their scores.

    The order is that of the SHA-256 of ``seed:record_id:i``, so any engine can draw it again.
    """
    drawn = F.sha2(F.concat_ws(":", F.lit(seed), F.col("record_id").cast("string"), F.col("i").cast("string")), 256)
    order = F.row_number().over(Window.partitionBy("record_id").orderBy(drawn, "i", "text"))
    return candidates.select("record_id", F.char(64 + order).alias("label"), "i", T.html_escape(F.col("text")).alias("html"))


def authoring_sheet(records: DataFrame, excerpt: int = 1200) -> DataFrame:
    """id, title, unit, excerpt, html: the start of the source text for those who write."""
    start = F.substring("source_text", 1, excerpt)
    return records.select("id", "title", "unit", start.alias("excerpt"), T.html_escape(start).alias("html"))


def report(means: list[tuple[str, float, float]], cells: int, pairs: int) -> str:
    """Markdown from a few aggregated numbers: (profile, oracle mean, surface mean)."""
    by = {p: (o, s) for p, o, s in means}
    good, flat, false = (by[p] for p in ("good", "flattened", "fabricated"))
    checks = [("the reference judge ranks good first", good[0] > max(flat[0], false[0])), ("the surface score is fooled by invented detail", false[1] >= good[1] * 0.85)]
    lines = ["# Synthetic grid", "", f"{cells} texts, {pairs} preference pairs.", "", "| profile | oracle | surface |", "|-|-|-|", *(f"| {p} | {o:.3f} | {s:.3f} |" for p, o, s in means), ""]
    return "\n".join([*lines, *(f"- {'PASS' if ok else 'FAIL'}: {what}" for what, ok in checks)]) + "\n"
