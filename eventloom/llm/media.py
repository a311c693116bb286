"""Media columns: what bytes really are, by signatures and structure; embedded media carved out.

An Aho-Corasick automaton finds every magic number in one pass; a validator for each format then confirms the
structure and measures the length, so chance hits are passed over.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, text_bytes

BLOCK = 576


def _png(d: memoryview, at: int) -> int | None:
    i = at + 8
    first = True
    while i + 12 <= len(d):
        size, kind = int.from_bytes(d[i : i + 4], "big"), bytes(d[i + 4 : i + 8])
        if i + 12 + size > len(d) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(d[i + 4 : i + 8 + size]) != int.from_bytes(d[i + 8 + size : i + 12 + size], "big"):
            return None
        i, first = i + 12 + size, False
        if kind == b"IEND":
            return i - at
    return None


def _gif(d: memoryview, at: int) -> int | None:
    def blocks(i: int) -> int | None:
        while i < len(d):
            if not d[i]:
                return i + 1
            i += d[i] + 1
        return None

    if at + 13 > len(d):
        return None
    i = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0)
    images = 0
    while i < len(d):
        if d[i] == 0x3B:
            return i + 1 - at if images else None
        if d[i] == 0x21:
            nxt = blocks(i + 2)
        elif d[i] == 0x2C and i + 11 <= len(d):
            images += 1
            nxt = blocks(i + 11 + (3 << (d[i + 9] & 7) + 1 if d[i + 9] & 0x80 else 0))
        else:
            return None
        if nxt is None:
            return None
        i = nxt
    return None


def _jpeg(d: memoryview, at: int) -> int | None:
    i, seen = at + 2, False
    while i + 4 <= len(d):
        if d[i] != 0xFF:
            return None
        kind = d[i + 1]
        if kind == 0xD9:
            return i + 2 - at if seen else None
        size = int.from_bytes(d[i + 2 : i + 4], "big")
        if kind < 0xC0 or size < 2 or i + 2 + size > len(d):
            return None
        i += 2 + size
        if kind == 0xDA:  # entropy-coded bytes run to the next marker that is not a stuffed or restart one
            seen = True
            j = d.obj.find(b"\xff", i)
            while j >= 0 and j + 1 < len(d) and (d[j + 1] == 0 or 0xD0 <= d[j + 1] <= 0xD7):
                j = d.obj.find(b"\xff", j + 2)
            if j < 0 or j + 1 >= len(d):
                return None
            i = j
            if d[i + 1] == 0xD9:
                return i + 2 - at
    return None


def _riff(d: memoryview, at: int) -> int | None:
    """RIFF with whole chunks that fill the declared size."""
    if at + 12 > len(d):
        return None
    end = at + 8 + int.from_bytes(d[at + 4 : at + 8], "little")
    i = at + 12
    if end > len(d) or end < i + 8:
        return None
    while i + 8 <= end:
        size = int.from_bytes(d[i + 4 : i + 8], "little")
        i += 8 + size + (size & 1)
    return end - at if i in (end, end + 1) else None


def _wav(d: memoryview, at: int) -> int | None:
    return _riff(d, at) if bytes(d[at + 8 : at + 12]) == b"WAVE" else None


def _webp(d: memoryview, at: int) -> int | None:
    return _riff(d, at) if bytes(d[at + 8 : at + 12]) == b"WEBP" else None


def _bmp(d: memoryview, at: int) -> int | None:
    if at + 54 > len(d):
        return None
    size, zero, start, head, wide, high, planes, bits = struct.unpack_from("<IIIIiiHH", d, at + 2)
    if zero or head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or wide <= 0 or not high:
        return None
    need = start + (wide * bits + 31) // 32 * 4 * abs(high)
    return size if start >= 14 + head and size >= need and at + size <= len(d) else None


def _pdf(d: memoryview, at: int) -> int | None:
    if not bytes(d[at + 5 : at + 8]).replace(b".", b"").isdigit():
        return None
    whole, low = d.obj, at + 8
    high = whole.find(b"%PDF-", low)
    high = len(whole) if high < 0 else high
    end = whole.rfind(b"%%EOF", low, high)
    while end >= 0:  # the last end of file whose reference table is there: saved changes come after earlier ends
        said = whole.rfind(b"startxref", low, end)
        number = whole[said + 9 : end].strip() if said >= 0 else b""
        if number.isdigit():
            table_at = at + int(number)
            if whole.startswith(b"xref", table_at) or whole[table_at : table_at + 20].split(b" ")[0].isdigit():
                return end + 5 - at
        end = whole.rfind(b"%%EOF", low, end)
    return None


def _gzip(d: memoryview, at: int) -> int | None:
    if at + 18 > len(d) or d[at + 2] != 8 or d[at + 3] & 0xE0:
        return None
    one = zlib.decompressobj(31)
    try:
        i = at
        while i < len(d) and not one.eof:
            one.decompress(d[i : i + 65_536])
            i += 65_536
    except zlib.error:
        return None
    return min(i, len(d)) - len(one.unused_data) - at if one.eof else None


def _zip_ends(whole: bytes) -> dict[int, int]:
    """End of the archive that each end-of-directory record says to begin somewhere, by that place; of several the last."""
    ends, at = {}, whole.find(b"PK\x05\x06")
    while at >= 0 and at + 22 <= len(whole):
        count, size, start, note = struct.unpack_from("<HIIH", whole, at + 10)
        if count and whole.startswith(b"PK\x01\x02", at - size) and at + 22 + note <= len(whole):
            ends[at - size - start] = at + 22 + note
        at = whole.find(b"PK\x05\x06", at + 4)
    return ends


def _zip(d: memoryview, at: int, ends: dict[int, int] | None = None) -> int | None:
    end = (_zip_ends(d.obj) if ends is None else ends).get(at)
    return None if end is None else end - at


#: Magic numbers, their types and validators.
FORMATS: dict[bytes, tuple[str, Callable[[memoryview, int], int | None]]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"RIFF": ("audio/wav", _wav),
    b"RIFF\0": ("image/webp", _webp),
    b"BM": ("image/bmp", _bmp),
    b"%PDF-": ("application/pdf", _pdf),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"PK\x03\x04": ("application/zip", _zip),
}


class Sniffer:
    """Finds valid media in bytes: (offset, length, type), outermost first, none inside another."""

    def __init__(self):
        self.search = ahocorasick.Automaton()
        for magic in {m.rstrip(b"\0") if m == b"RIFF\0" else m for m in FORMATS}:
            self.search.add_word(magic.decode("latin-1"), magic)
        self.search.make_automaton()
        self.by_magic: dict[bytes, list] = {}
        for magic, what in FORMATS.items():
            self.by_magic.setdefault(b"RIFF" if magic == b"RIFF\0" else magic, []).append(what)

    def __call__(self, data: bytes) -> list[tuple[int, int, str]]:
        view, found, covered, zips = memoryview(data), [], 0, None
        hits = sorted((end - len(magic) + 1, magic) for end, magic in self.search.iter(data.decode("latin-1")))
        for at, magic in hits:
            if at < covered:
                continue
            for kind, measure in self.by_magic[magic]:
                if measure is _zip:
                    zips = _zip_ends(data) if zips is None else zips
                    size = _zip(view, at, zips)
                else:
                    size = measure(view, at)
                if size:
                    found.append((at, size, kind))
                    covered = at + size
                    break
        return found


def sniff(df: DataFrame, column: str = "media", declared: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus media_type and embedded: array of (offset, length, type, bytes).

    media_type is the validated type of what starts at byte 0, else the declared one, else
    application/octet-stream; embedded lists valid media that start later (or after an unknown start). Null
    bytes have neither. Columns of ``df`` that are called media_type or embedded are replaced. Formats: png, gif, jpeg, wav, webp, bmp, pdf, gzip, zip.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in (column, declared)]
    fields = [f for f in df.schema.fields if f.name in keep and f.name not in ("media_type", "embedded")]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "media_type string", "embedded array<struct<offset:bigint,length:bigint,type:string,bytes:binary>>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Sniffer()
        for pdf in batches:
            out, kinds, inside = pdf[names].copy(), [], []
            said = pdf["_declared"]
            for data, was in zip(pdf["_media"], said, strict=True):
                if data is None:
                    kinds.append(None)
                    inside.append(None)
                    continue
                data = bytes(data)
                found = find(data)
                first = found[0][2] if found and found[0][0] == 0 else None
                kinds.append(first or (was if isinstance(was, str) else "application/octet-stream"))
                inside.append([(a, n, kind, data[a : a + n]) for a, n, kind in found if not (a == 0 and first)])
            out["media_type"], out["embedded"] = kinds, inside
            yield out

    return df.select(*names, F.col(column).alias("_media"), (F.col(declared) if declared else F.lit(None).cast("string")).alias("_declared")).mapInPandas(run, schema)


def wav(samples: bytes, rate: int = 16_000) -> bytes:
    """A WAVE file of unsigned 8-bit mono samples."""
    pad = len(samples) & 1
    return b"".join([struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)), samples, b"\0" * pad])


def wav_samples(data: bytes) -> bytes:
    """The samples of a WAVE file, found by walking its chunks."""
    i = 12
    while i + 8 <= len(data):
        kind, size = data[i : i + 4], int.from_bytes(data[i + 4 : i + 8], "little")
        if kind == b"data":
            return data[i + 8 : i + 8 + size]
        i += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload_of(text: str | None) -> bytes:
    """The text in UTF-8 (null: empty), filled with bytes 255 up to a positive multiple of 576."""
    data = text_bytes(text)
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a WAVE file of the padded text), declared (always the generic type)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                part = pdf.iloc[a : a + 200]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(text_bytes(t)) for t in part["text"]], "media": [wav(payload_of(t)) for t in part["text"]], "declared": "application/octet-stream"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary, declared string")


def media_features(docs: DataFrame) -> DataFrame:
    """Digests and features of every document's stored media, read back through the sniffer.

    The media are written to a table in the shared folder and read from there. The stored form is taken for what its bytes are (the declared type is generic), its samples are read and
    described: type, number of samples, their mean and spread, and what media the samples themselves hold.
    Equal texts give equal values; null and empty texts give one block of 255s. A null doc_id stays null.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Sniffer()
        for pdf in batches:
            rows = []
            for doc_id, n, media in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"], strict=True):
                media = bytes(media)
                found = find(media)
                if not found or found[0] != (0, len(media), "audio/wav"):
                    raise ValueError("the stored media is not a whole WAVE file")
                samples = wav_samples(media)
                values = np.frombuffer(samples, np.uint8)
                inner = ",".join(f"{kind}@{a}+{size}" for a, size, kind in find(samples))
                feature = f"audio/wav;samples={len(values)};mean={int(values.sum(dtype=np.int64)) * 1000 // len(values)};low={values.min()};high={values.max()};embedded=[{inner}]"
                rows.append((None if pd.isna(doc_id) else int(doc_id), n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    return table(as_media(docs), "media").mapInPandas(run, schema)
