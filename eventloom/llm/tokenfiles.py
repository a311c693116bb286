"""Token-id files: documents in ascending id order, ids coded by the context-mixing range coder.

A file holds, after the magic ``CMIX1`` and a JSON header of fixed-width length, a compressed index (doc ids and
lengths, little-endian 64-bit) and the blocks: for each its number of ids, crc32 and coded size as little-endian
32-bit integers, then the coded bytes. Every block starts from a fresh model, so any can be decoded alone.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rangecoder import decode_blocks, encode_blocks
from .shared import file_system, new_dir, table, write_whole
from .tokens import encoder, tokenizer_path

MAGIC = b"CMIX1\0\0\0"
#: Ids a file at most holds at about; bounds what a task keeps in memory.
FILE_IDS = 1 << 23
#: Bytes of text a range partition is meant to have: about one file.
PART_BYTES = 22_000_000


def file_bytes(doc_ids: list[int], documents: list[bytes], vocabulary: int) -> Iterator[bytes]:
    """The file of documents given as little-endian 32-bit ids."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    index = zlib.compress(np.array([doc_ids, [len(d) // 4 for d in documents]], "<i8").tobytes(), 1)
    blocks = encode_blocks(ids, vocabulary)
    head = json.dumps({"vocabulary": vocabulary, "documents": len(doc_ids), "ids": len(ids), "blocks": len(blocks), "index_bytes": len(index), "index_crc32": zlib.crc32(index)}).encode()
    yield MAGIC + struct.pack("<I", len(head)) + head + index
    for n, crc, coded in blocks:
        yield struct.pack("<III", n, crc, len(coded)) + coded


def parse_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, all ids) of a file; ValueError where a checksum fails."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack_from("<I", data, 8)
    head = json.loads(data[12 : 12 + size])
    at = 12 + size
    index = data[at : at + head["index_bytes"]]
    if zlib.crc32(index) != head["index_crc32"]:
        raise ValueError("the index does not match its checksum")
    doc_ids, lengths = np.frombuffer(zlib.decompress(index), "<i8").reshape(2, -1)
    at, blocks = at + len(index), []
    for _ in range(head["blocks"]):
        n, crc, size = struct.unpack_from("<III", data, at)
        blocks.append((n, crc, data[at + 12 : at + 12 + size]))
        at += 12 + size
    ids = decode_blocks(blocks, head["vocabulary"])
    if len(ids) != head["ids"] or lengths.sum() != len(ids):
        raise ValueError("the file is not whole")
    return doc_ids, lengths, ids


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = 2) -> DataFrame:
    """Encode whole texts, write them in ascending doc_id order; returns the manifest (part, number, path, n_docs, n_ids, bytes).

    Documents are range-partitioned by id; a task writes its documents as one or more files of about FILE_IDS ids.
    Null texts count as empty; rows with a null doc_id are left out. Rows of one id follow each other by text.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        vocabulary = max(encode.tokenizer.get_vocab_size(), end_id + 1)
        part, number, doc_ids, documents, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pd.DataFrame:
            uri = f"{out}/part-{part:05d}-{number:05d}.cmix"
            return pd.DataFrame({"part": [part], "number": [number], "path": [uri], "n_docs": [len(doc_ids)], "n_ids": [size // 4], "bytes": [write_whole(uri, file_bytes(doc_ids, documents, vocabulary))]})

        for pdf in batches:
            for doc_id, ids in zip(pdf["doc_id"].tolist(), encode(pdf["text"]), strict=True):
                doc_ids.append(doc_id)
                documents.append(ids + end)
                size += len(ids) + 4
                if size >= 4 * FILE_IDS:
                    yield close()
                    number, doc_ids, documents, size = number + 1, [], [], 0
        if doc_ids:
            yield close()

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-total // PART_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")
    return table(ordered.mapInPandas(write, "part int, number int, path string, n_docs long, n_ids long, bytes long"), "token-manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids as binary)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    # one row a file: the running total is over the manifest, not over documents
    placed = manifest.select("path", (F.sum("n_ids").over(Window.orderBy("part", "number")) - F.col("n_ids")).alias("base"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, base in zip(pdf["path"], pdf["base"], strict=True):
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    doc_ids, lengths, ids = parse_file(f.read())
                starts = np.cumsum(lengths) - lengths
                raw = memoryview(ids.tobytes())
                pieces = [raw[4 * a : 4 * (a + n)] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": doc_ids, "start": starts + base, "n_tokens": lengths, "ids_crc32": [zlib.crc32(p) for p in pieces]})
                if with_ids:
                    out["ids"] = [bytes(p) for p in pieces]
                yield out

    return placed.repartition(max(1, manifest.count()), "path").mapInPandas(read, schema)


def stored_tokens(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write token files into the shared folder and read them back."""
    return read_token_files(write_token_files(docs, new_dir(docs.sparkSession, "tokens"), path or tokenizer_path(), end_id))
