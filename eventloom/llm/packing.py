"""Best-fit decreasing packing of token pieces into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, table
from .tokens import encoder, tokenizer_path


class OpenBins:
    """Open bins by remaining capacity under a segment tree: the tightest that fits is found in O(log capacity)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaf = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaf)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        i = self.leaf + room
        while i:
            self.count[i] += by
            i >>= 1

    def add(self, room: int, number: int) -> None:
        if room:
            self.bins[room].append(number)
            self._change(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest open bin with room for length, which leaves the tree; None if there is none."""
        count, i = self.count, self.leaf + length
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaf:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaf
        number = self.bins[room].pop()
        self._change(room, -1)
        return room, number


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in descending order (ties by position)."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = OpenBins(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        if found is None:
            found, n = (capacity, n), n + 1
        room, number = found
        bins[i], offsets[i] = number, capacity - room
        tree.add(room - size, number)
    return bins, offsets


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Whole texts as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids as binary).

    Each text's ids are followed by ``end_id``, so null and empty texts make one piece of one id.
    Only documents longer than ``capacity`` are cut; repeated rows are packed as often as they occur.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, step = encoder(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], encode(pdf["text"]), strict=True):
                ids += end
                for piece, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    rows.append((None if pd.isna(doc_id) else int(doc_id), piece, a // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
            yield out.astype({"doc_id": "Int64"})
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, schema)


def pack(pieces: DataFrame, capacity: int = 4096, shard_rows: int = 100_000) -> DataFrame:
    """``pieces`` (any table with doc_id, piece, length) plus sequence_id and offset.

    Rows are dealt evenly, by hash, to shards of about ``shard_rows``, and each shard is packed by best-fit
    decreasing; a shard wastes at most part of one sequence beyond that method, so the loss does not grow
    with the data. Memory a task is bounded by ``shard_rows``. An empty table gives no rows.
    """
    shards = max(1, -(-pieces.count() // shard_rows))
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)[names]
        # the order, and so the result, does not depend on how rows arrived
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        yield pdf.assign(sequence_id=bins + (TaskContext.get().partitionId() << 32), offset=offsets)

    return pieces.select(*names).repartition(shards, F.xxhash64("doc_id", "piece")).mapInPandas(shard, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and pack them: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack(table(token_pieces(docs, path or tokenizer_path(), capacity, end_id, with_ids), "pieces"), capacity)
