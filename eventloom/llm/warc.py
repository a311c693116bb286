"""WARC archives with per-record Zstandard frames under a dictionary that each archive carries itself.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame a record. The
dictionary is built from the archive's own records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, join_once, new_dir, table, text_bytes, write_whole

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs
#: Bytes of records from which an archive's dictionary is built, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 2_000_000, 65_536


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str, *revisit) -> str:
    """Of a response, by page and payload, so that revisits can name it; of a revisit also by its place."""
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, ':'.join(map(str, ('page', page_id, digest, *revisit))))}>"


def target_uri(url: str | None, page_id) -> str:
    return " ".join((url or "").split()) or f"urn:page:{page_id}"


def record(page_id, url: str | None, payload: bytes, refers_to, refers_url, date: str, place: str = "") -> bytes:
    """A response record, or, when it refers to a page, a revisit record without the payload."""
    revisit, digest = refers_to is not None, digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, *([place] if revisit else []))}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target_uri(url, page_id)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {target_uri(refers_url, refers_to)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
    body = http if revisit else http + payload
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """From whole records spread evenly over the archive, about SAMPLE_BYTES; empty where there is too little to learn from."""
    sizes = np.array([len(r) for r in records], np.int64)
    step = max(1, -(-int(sizes.sum()) // SAMPLE_BYTES))
    sample = [r[a : a + 32_768] for r in records[::step] for a in range(0, len(r), 32_768)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 4), sample, level=3).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], level: int = 3) -> Iterator[bytes]:
    """The bytes of an archive: the dictionary in its skippable frame, then a frame for each record."""
    data = build_dictionary(records)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data
    shared = zstandard.ZstdCompressionDict(data) if data else None
    if shared:
        shared.precompute_compress(level=level)
    compress = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True).compress
    for r in records:
        yield compress(r)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its headers (RFC 8878)."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3]
    at += (1 if single else 0, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * (flags >> 2 & 1)


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time, with the dictionary that it carries."""
    view, at, shared = memoryview(data), 0, None
    reader = zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic == DICTIONARY_MAGIC:
            shared = zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])) if size else None
            reader = zstandard.ZstdDecompressor(dict_data=shared)
            at += 8 + size
        elif magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(view, at)
            yield reader.decompress(view[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) plus refers_to and refers_url: the page whose response a revisit repeats, else null.

    Of pages whose payload (the html in UTF-8; null counts as empty) is equal and at least ``least_bytes`` long,
    the one with the largest page_id responds; of rows that repeat this page_id with this payload, one with the largest
    url, and the others revisit it. A page_id with different payloads is as many pages. Rows with a null page_id are
    left out. Payloads count as equal when length, SHA-1 and a second hash are.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where("page_id is not null")
    key = F.concat_ws(":", F.sha1(payload), F.xxhash64(payload).cast("string"), F.length(payload).cast("string"))
    keyed = rows.select("page_id", "url", key.alias("k"), F.length(payload).alias("bytes"))
    first = F.max(F.struct("page_id", "url"))
    # a page once with its number of rows, then a payload once: both combine before the shuffle
    each = keyed.where(F.col("bytes") >= least_bytes).groupBy("k", "page_id").agg(first.alias("chief"), F.count(F.lit(1)).alias("rows"))
    chiefs = each.groupBy("k").agg(F.max(F.struct("chief", "rows")).alias("top"), F.sum("rows").alias("n")).where("n > 1")
    chiefs = table(chiefs.select("k", "top.chief", F.col("top.rows").alias("times"), "n"), "chiefs")
    told = join_once(keyed.select("page_id", "k"), chiefs, "k").where((F.col("page_id") < F.col("chief.page_id")) | (F.col("times") > 1))
    told = told.select("page_id", "k", F.col("chief.page_id").alias("refers_to"), F.col("chief.url").alias("refers_url")).distinct()
    out = rows.withColumn("k", key).join(told, ["page_id", "k"], "left").select("page_id", "url", "html", "refers_to", "refers_url")
    if chiefs.where("times > 1").isEmpty():
        return out
    # rows that repeat the responding page: all but one of them revisit it
    twice = out.where("page_id = refers_to").groupBy("page_id", "url", "refers_to", "refers_url", "html").agg(F.count(F.lit(1)).alias("n"))
    copy = twice.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    responds = (F.col("i") == 1) & F.col("url").eqNullSafe(F.col("refers_url"))
    copy = copy.select("page_id", "url", "html", *[F.when(~responds, F.col(c)).alias(c) for c in ("refers_to", "refers_url")])
    return out.where("refers_to is null or page_id <> refers_to").unionByName(copy)


def write_archives(pages: DataFrame, out: str, least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z", archive_bytes: int = 32_000_000) -> DataFrame:
    """Write every page as a record; returns the written manifest (path, n_records, bytes).

    ``archive_bytes`` of payload a file bounds memory: a task starts another archive beyond it. A task that runs
    again writes the same names. Null urls get a urn of the page; rows with a null page_id are left out.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pd.DataFrame:
            uri = f"{out}/part-{task:05d}-{number:05d}.warc.zst"
            return pd.DataFrame({"path": [uri], "n_records": [len(held)], "bytes": [write_whole(uri, archive(held))]})

        for pdf in batches:
            for page_id, url, html, refers, refers_url in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], pdf["refers_url"], strict=True):
                one = record(int(page_id), url, text_bytes(html), None if pd.isna(refers) else int(refers), refers_url, date, f"{task}-{number}-{len(held)}")
                held.append(one)
                size += len(one)
                if size >= archive_bytes:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return table(with_revisits(pages, least_bytes).mapInPandas(write, "path string, n_records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives listed in ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    A revisit's payload is null; its digest and length are those of the full payload, which its headers carry.
    Digests of responses are computed from the bytes read and held against their headers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    data = f.read()
                rows = []
                for raw in records_of(data):
                    head, body = parsed(raw)
                    http, _, payload = body.partition(b"\r\n\r\n")
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    if kind == "response" and (digest_of(payload) != digest or len(payload) != size):
                        raise ValueError(f"{uri}: record of page {head['X-Page-Id']} does not match its digest")
                    refers = head.get("X-Refers-To-Page")
                    rows.append((int(head["X-Page-Id"]), size, digest, kind, int(refers) if refers else None, head["WARC-Target-URI"], payload if kind == "response" else None))
                    if len(rows) >= 1000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]).astype({"refers_to": "Int64"})


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to fresh archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, new_dir(pages.sparkSession, "warc")))
