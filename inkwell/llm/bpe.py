"""Operator 1: byte-level BPE encoding and decoding.

The tiktoken library with a local rank file.  Each match of the pre-splitting pattern is encoded separately, without
special tokens.  Long texts are first cut at safe boundaries, between an ASCII letter and a space or line feed, so that no
regex run or merge list is larger than a piece.  A pattern that is passed in must not match across such a boundary.

Map-only: no shuffle, and memory is bounded by one Arrow batch and one text.

Defined results: a null or empty text has no ids (n_tokens 0, hashes of the empty string); a special token's name in a
text is ordinary text; repeated rows give repeated results; a null doc_id is kept; other columns are ignored; runs of white
space may have any length (the library by itself fails at a million).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import id_text, per_document

#: Texts are encoded in pieces of about so many characters.
PIECE = 1 << 16
#: No match of a pattern of this family, where white space comes first in a match or alone, holds an ASCII letter followed by a space or line feed.
SAFE = re.compile(r"(?<=[A-Za-z])(?=[ \n])")
#: Longer runs of white space are matched apart: the library's engine keeps a step for each character to go back by, and fails at a million.
LONG_RUN = 1 << 16
SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Takes a whole text as one match.
WHOLE = r"(?s:.+)"


def default_ranks() -> tuple[str, str]:
    """Rank file and pre-splitting pattern of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:  # installed with the library on every machine, as the library itself is
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE):
    """Cuts at the first safe boundary after each ``size`` characters; where there is none, the rest stays whole."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def matches_apart(piece: str, pattern: str, longest: int = LONG_RUN):
    """(part, pattern to encode it with): the matches within runs of more than ``longest`` white spaces, each whole, and what is between them.

    The last match of a run may take what follows; it stays with the rest.
    """
    at = 0
    if len(piece) > longest:
        for run in SPACES.finditer(piece):
            if run.end() - run.start() > longest:
                import regex

                if at < run.start():
                    yield piece[at : run.start()], pattern
                at = run.start()
                for match in regex.finditer(pattern, piece[at : run.end() + 1]):
                    if run.start() + match.end() > run.end():
                        break
                    yield match[0], WHOLE
                    at = run.start() + match.end()
    if not at or at < len(piece):
        yield piece[at:], pattern


def encode(text: str, rank_file: str, pattern: str, size: int = PIECE, longest: int = LONG_RUN) -> np.ndarray:
    """Ids as unsigned 32-bit integers."""
    parts = [np.asarray(encoding(rank_file, p).encode_ordinary(y), dtype="<u4") for x in pieces(text, size) for y, p in matches_apart(x, pattern, longest)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, rank_file: str, pattern: str) -> bytes:
    """The raw bytes of the ids, which need not be valid UTF-8 for a slice of a text's ids."""
    return encoding(rank_file, pattern).decode_bytes(ids.tolist())


def bpe_documents(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; ``with_ids`` adds the ids as little-endian bytes."""
    default = default_ranks() if rank_file is None or pattern is None else ("", "")
    rank_file, pattern = rank_file or default[0], pattern or default[1]

    def make():
        encoding(rank_file, pattern)

        def work(text: str):
            ids = encode(text, rank_file, pattern)
            raw = ids.tobytes()
            out = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest())
            return (*out, raw) if with_ids else out

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return per_document(id_text(docs), make, schema)
