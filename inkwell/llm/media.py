"""Operator 7: media columns by signature sniffing.

A payload of bytes is stored losslessly as 8-bit mono samples in a RIFF/WAVE container and read back from the stored
bytes.  The sniffer trusts no declared type: an Aho-Corasick automaton locates every magic number in one pass, the
validator of its format confirms structure and lengths, the type found at offset 0 corrects the declared one, and valid
media further in are carved out by their own lengths.

Map-only: no shuffle, and memory is bounded by one Arrow batch, one payload and what its validators remember, which grows
with the payload.  What many signatures share is walked once: marks, chains of blocks and of chunks, checksums.  (A gzip
member has to be inflated from its own start, so nested false members cost a pass each.)

``declared`` is one type for all rows or a column with each row's own.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts of equal declared type give equal values;
a null declared type counts as application/octet-stream; repeated rows give repeated results; a null doc_id is kept; other
columns are ignored; an empty table gives an empty result.  Magic numbers without a valid structure behind them
(a text that says GIF89a) are counted as false signatures and carve nothing.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, id_text, texts

UNIT, RATE = 64, 8000
UNKNOWN = "application/octet-stream"


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM; a payload of odd length gets the container's pad byte."""
    size = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + size + size % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", size)
    return head + payload + bytes(size % 2)


def chunks(media: bytes, at: int, end: int):
    """(name, start, length) of each RIFF chunk."""
    while at + 8 <= end:
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def samples(media: bytes) -> bytes:
    """The payload, read back from a stored WAVE."""
    return next(media[start : start + size] for name, start, size in chunks(media, 12, len(media)) if name == b"data")


class Payload(bytes):
    """Bytes that remember what validators found, so that many false magic numbers cost one pass for each format in all."""

    def memo(self, name: str) -> dict:
        return self.__dict__.setdefault(name, {})

    def crc(self, start: int, end: int) -> int:
        """CRC-32 of start..end; long spans are taken from the checksums of prefixes, one for each CRC_STEP bytes."""
        if end - start <= 2 * CRC_STEP:
            return zlib.crc32(self[start:end])
        return self._prefix_crc(end) ^ crc_moved(self._prefix_crc(start), end - start)

    def _prefix_crc(self, end: int) -> int:
        sums = self.__dict__.setdefault("sums", [0])
        k, view = end // CRC_STEP, memoryview(self)
        while len(sums) <= k:
            at = (len(sums) - 1) * CRC_STEP
            sums.append(zlib.crc32(view[at : at + CRC_STEP], sums[-1]))
        return zlib.crc32(view[k * CRC_STEP : end], sums[k])

    def places(self, mark: bytes) -> list[int]:
        known = self.__dict__.setdefault("known", {})
        if mark not in known:
            known[mark], at = [], self.find(mark)
            while at >= 0:
                known[mark].append(at)
                at = self.find(mark, at + 1)
        return known[mark]

    def after(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, or -1."""
        places = self.places(mark)
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def before(self, mark: bytes, at: int, end: int) -> bool:
        """Whether ``mark`` stands whole within at..end."""
        return 0 <= self.after(mark, at) <= end - len(mark)


#: Bytes between two remembered checksums; the reflected polynomial of CRC-32.
CRC_STEP, POLYNOMIAL = 4096, 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; bit 31 is the constant term."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


@functools.lru_cache(maxsize=64)
def _doubled(k: int) -> int:
    """x^(8 * 2^k)."""
    return 1 << 23 if k == 0 else _times(_doubled(k - 1), _doubled(k - 1))


def crc_moved(crc: int, n: int) -> int:
    """What the checksum of some bytes contributes to that of the same bytes and ``n`` more."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            crc = _times(crc, _doubled(k))
    return crc


def chained(at: int, end: int, known: dict, step) -> int:
    """Where the chain at, step(at), .. gets to ``end`` or to a place that step calls final, -1 - x for x; all on the way remember it."""
    way = []
    while 0 <= at < end and at not in known:
        way.append(at)
        at = step(at)
    out = known.get(at, at)
    known.update(dict.fromkeys(way, out))
    return out


class Chunks:
    """The chain of RIFF chunks from any place of a payload, shared between chains that meet.

    A chunk holds the next one, one further on (so that a chain is searched in logarithmic time), and the first format and
    data chunks from it on.
    """

    def __init__(self, data: bytes) -> None:
        self.data, self.known = data, {}

    def _size(self, at: int) -> int:
        return int.from_bytes(self.data[at + 4 : at + 8], "little")

    def chain(self, at: int) -> None:
        way, n = [], len(self.data)
        while at + 8 <= n and at not in self.known:
            way.append(at)
            size = self._size(at)
            at += 8 + size + size % 2
        for here in reversed(way):
            name = self.data[here : here + 4]
            depth, jump, form, sound = 0, at, n, n
            if at in self.known:
                _, d, j, form, sound = self.known[at]
                depth = d + 1
                if j in self.known and self.known[j][2] in self.known and d - self.known[j][1] == self.known[j][1] - self.known[self.known[j][2]][1]:
                    jump = self.known[j][2]
            self.known[here] = (at, depth, jump, here if name == b"fmt " else form, here if name == b"data" else sound)
            at = here

    def sound(self, at: int, end: int) -> bool:
        """Whether the chunks from ``at`` on fill the span up to ``end`` (pad bytes may be lacking), a format and data among them."""
        if at + 8 > end:
            return False
        self.chain(at)
        _, _, _, form, sound = self.known[at]
        if max(form, sound) + 8 > end or self._size(form) < 16:
            return False
        last = at
        while True:  # the last chunk that starts before the end
            after, _, jump, *_ = self.known[last]
            if jump + 8 <= end and jump in self.known:
                last = jump
            elif after + 8 <= end and after in self.known:
                last = after
            else:
                return last + 8 + self._size(last) <= end


# Validators: (payload, offset of the magic number) to the medium's length, or 0 where its structure is not sound.


def wav_length(data: Payload, at: int) -> int:
    """Whole chunks up to the length in the head, the first format chunk of 16 bytes or more, and data."""
    end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if data[at + 8 : at + 12] != b"WAVE" or end > len(data):
        return 0
    memo = data.memo("riff")
    if not memo:
        memo["chunks"] = Chunks(data)
    return end - at if memo["chunks"].sound(at + 12, end) else 0


def png_length(data: Payload, at: int) -> int:
    """IHDR first and once, every checksum right, IEND last."""

    def chunk(here: int) -> int:
        """The next chunk's place; final: the end of the medium, or 0 for an unsound one."""
        size, name = int.from_bytes(data[here : here + 4], "big"), data[here + 4 : here + 8]
        end = here + 12 + size
        if end > len(data) or data.crc(here + 4, end - 4) != int.from_bytes(data[end - 4 : end], "big"):
            return -1
        return -1 - end if name == b"IEND" else -1 if name == b"IHDR" and here != at + 8 else end

    if data[at + 12 : at + 16] != b"IHDR" or (second := chunk(at + 8)) < 0:
        return 0
    end = -1 - chained(second, len(data) - 11, data.memo("png"), chunk)
    return end - at if end > 0 else 0


def gif_length(data: Payload, at: int) -> int:
    """Walks the colour tables and blocks to the trailer."""
    size = len(data)
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0

    def blocks(here: int) -> int:
        """The place after a chain of blocks, or the payload's end."""
        end = chained(here, size, data.memo("gif blocks"), lambda k: k + 1 + data[k] if data[k] else -1 - (k + 1))
        return -1 - end if end < 0 else size

    def part(here: int) -> int:
        kind = data[here]
        if kind == 0x3B:
            return -1 - (here + 1)
        if kind == 0x21:
            return blocks(here + 2)
        return blocks(here + 11 + table(data[here + 9])) if kind == 0x2C and here + 10 <= size else -1

    if at + 13 > size or not int.from_bytes(data[at + 6 : at + 8], "little"):
        return 0
    end = -1 - chained(at + 13 + table(data[at + 10]), size, data.memo("gif parts"), part)
    return end - at if end > 0 else 0


def jpeg_length(data: Payload, at: int) -> int:
    """Segments by their lengths up to the scan, then to the end marker."""
    here = at + 2
    while here + 4 <= len(data) and data[here] == 0xFF:
        kind, size = data[here + 1], int.from_bytes(data[here + 2 : here + 4], "big")
        if size < 2 or here + 2 + size > len(data):
            return 0
        here += 2 + size
        if kind == 0xDA:
            return end + 2 - at if (end := data.after(b"\xff\xd9", here)) >= 0 else 0
    return 0


def pdf_length(data: Payload, at: int) -> int:
    """A version digit, a cross-reference pointer and the end mark."""
    end = data.after(b"%%EOF", at)
    return end + 5 - at if end >= 0 and data[at + 5 : at + 6].isdigit() and data.before(b"startxref", at, end) else 0


def zip_length(data: Payload, at: int) -> int:
    """A central directory whose end record points back at this first entry."""
    end = data.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return 0
    size, offset, note = struct.unpack("<IIH", data[end + 12 : end + 22])
    return end + 22 + note - at if offset + size == end - at and end + 22 + note <= len(data) else 0


def gzip_length(data: bytes, at: int) -> int:
    """The whole member inflates and its checksum holds; no more than 64 KB of it is held at a time."""
    unpack, rest = zlib.decompressobj(31), memoryview(data)[at:]
    try:
        unpack.decompress(rest, 1 << 16)
        while unpack.unconsumed_tail and not unpack.eof:
            unpack.decompress(unpack.unconsumed_tail, 1 << 16)
    except zlib.error:
        return 0
    return len(rest) - len(unpack.unused_data) if unpack.eof else 0


#: Magic numbers, the types they stand for, and validators.
FORMATS = (
    (b"RIFF", "audio/wav", wav_length), (b"\x89PNG\r\n\x1a\n", "image/png", png_length), (b"GIF87a", "image/gif", gif_length), (b"GIF89a", "image/gif", gif_length),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_length), (b"%PDF-", "application/pdf", pdf_length), (b"PK\x03\x04", "application/zip", zip_length), (b"\x1f\x8b\x08", "application/gzip", gzip_length),
)


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        out.add_word(magic.decode("latin-1"), k)  # bytes as characters of the same numbers
    out.make_automaton()
    return out


def sniff(data: bytes) -> tuple[str | None, list[tuple[str, int, int]], int]:
    """Type at offset 0 (None: unknown), the (type, offset, length) of valid media carved further in, false signatures."""
    data, whole, carved, false = Payload(data), None, [], 0
    for end, k in automaton().iter(data.decode("latin-1")):
        magic, kind, length = FORMATS[k]
        at = end + 1 - len(magic)
        if not (size := length(data, at)):
            false += 1
        elif at == 0:
            whole = kind
        elif not carved or at >= carved[-1][1] + carved[-1][2]:
            carved.append((kind, at, size))
    return whole, carved, false


def features(media: bytes, declared: str) -> tuple[bytes, str]:
    """The payload read back, and the feature string: corrected type, sample statistics, carved media."""
    kind, carved, false = sniff(media)
    payload = samples(media)
    x = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    mean = int(counts @ np.arange(256)) / max(1, len(x))
    p = counts[counts > 0] / max(1, len(x))
    found = ",".join(f"{k}@{a}+{n}" for k, a, n in carved) or "-"
    return payload, f"type={kind or declared};corrected={int(kind is not None and kind != declared)};rate={RATE};mean={mean:.4f};entropy={max(0.0, -float(p @ np.log2(p))):.4f};carved={found};false={false}"


def media_columns(docs: DataFrame, declared: str | Column = UNKNOWN) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    column = F.lit(declared) if isinstance(declared, str) else declared
    rows = id_text(docs, F.coalesce(column.cast("string"), F.lit(UNKNOWN)).alias("declared"))
    longs, names = {"n_bytes", "payload_bytes", "tail_crc32", "media_bytes"}, ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def work(text: str, declared: str) -> tuple:
        data = text.encode()
        media = to_wav(padded(data))
        payload, feature = features(media, declared)
        return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        made = zip(*map(work, texts(rows.column(1)), texts(rows.column(2))), strict=True)
        columns = [pa.array(x, pa.int64() if name in longs else pa.string()) for name, x in zip(names, made, strict=True)]
        return pa.RecordBatch.from_arrays([rows.column(0), *columns], ["doc_id", *names])

    return by_batch(rows, batch, "doc_id long, " + ", ".join(f"{x} {'long' if x in longs else 'string'}" for x in names))
