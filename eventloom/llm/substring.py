"""Removal of passages that repeat across documents, by FM-indexes over shards of candidate text.

Windows of 50 words are routed by content: the least hash among a window's 8-word groups is its key, so equal
windows share a key and meet in one shard, however the corpus is split. Runs of neighbouring windows with one
key form a segment; segments whose key occurs in one document only go no further. Each shard indexes its
segments in a compressed FM-index and streams them through it; a window's rows give the smallest document in
which it starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex, streamed_matches
from .shared import WordHashes, hashed_words, in_groups, mix, table, text_bytes

WINDOW, GROUP = 50, 8
#: Windows a segment at most; words an index holds at about; segments of a key beyond which windows are routed singly.
RUN, SHARD_WORDS, HOT_SEGMENTS = 64, 1_500_000, 20_000

_P = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
_INV = pow(_P, -1, 1 << 64)


def _sliding(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


class Routed:
    """Windows of many documents with their keys and hashes."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        n = len(words)
        self.words, count = words, max(0, n - WINDOW + 1)
        grams, step = words, 1
        while step < GROUP:
            grams = grams[:-step] * np.uint64(pow(_P, step, 1 << 64)) + grams[step:] if len(grams) > step else grams[:0]
            step *= 2
        keys = _sliding(mix(grams), WINDOW - GROUP + 1) if count else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        whole = doc[:count] == doc[WINDOW - 1 :] if count else np.empty(0, bool)
        self.at = np.flatnonzero(whole)
        self.key, self.doc = keys[self.at], doc[self.at]
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = np.uint64(_P)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(powers)[:n], dtype=np.uint64)))
        powers[1:] = np.uint64(_INV)
        self.back = np.cumprod(powers)

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64-bit hashes of word sequences."""
        return mix((self.sums[start + size] - self.sums[start]) * self.back[start] + size.astype(np.uint64))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First window (index into ``at``) and number of windows of each segment."""
        if not len(self.at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        new = np.concatenate(([True], (self.key[1:] != self.key[:-1]) | (self.at[1:] != self.at[:-1] + 1) | (self.doc[1:] != self.doc[:-1])))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(self.at)))
        pieces = -(-sizes // RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(starts, pieces) + nth * RUN
        return first, np.minimum(RUN, np.repeat(starts + sizes, pieces) - first)


_SEGMENT = "key long, seg long, doc_id long, tkey long, start int, n int"


def segments(rows: DataFrame) -> DataFrame:
    """(key, seg, doc_id, tkey, start, n) of (doc_id, tkey, text): n windows of one key from word ``start``; seg hashes key and words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            for a in range(0, len(pdf), 400):
                part = pdf.iloc[a : a + 400]
                words, ends = hashed_words(part["text"], known)
                r = Routed(words, ends)
                first, n = r.runs()
                at, doc = r.at[first], r.doc[first]
                seg = mix(r.hashes(at, n + WINDOW - 1) ^ mix(r.key[first]))
                yield pd.DataFrame({"key": r.key[first].view(np.int64), "seg": seg.view(np.int64), "doc_id": part["doc_id"].to_numpy()[doc], "tkey": part["tkey"].to_numpy()[doc], "start": (at - ends[doc]).astype(np.int32), "n": n.astype(np.int32)})

    return rows.mapInPandas(run, _SEGMENT)


def _candidates(found: DataFrame) -> DataFrame:
    """Segments whose key occurs in more than one document."""
    shared = found.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    return found.join(shared, "key", "left_semi")


def _per_document(rows: DataFrame, listed: DataFrame, run, schema: str, how: str = "inner") -> DataFrame:
    """``run`` over documents beside the list of their own entries, which is bounded by the document's length."""
    packed = listed.groupBy("doc_id", "tkey").agg(F.collect_list("entry").alias("entries"))
    return rows.join(packed, ["doc_id", "tkey"], how).mapInPandas(run, schema)


def _single_windows(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Segments of very frequent keys cut into single windows, each routed by the hash of all its 50 words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            for doc_id, tkey, text, entries in zip(pdf["doc_id"], pdf["tkey"], pdf["text"], pdf["entries"], strict=True):
                words, ends = hashed_words([text], known)
                r = Routed(words, ends)
                at = np.concatenate([np.arange(e["start"], e["start"] + e["n"]) for e in entries])
                key = r.hashes(at, np.full(len(at), WINDOW))
                yield pd.DataFrame({"key": key.view(np.int64), "seg": mix(key).view(np.int64), "doc_id": doc_id, "tkey": tkey, "start": at.astype(np.int32), "n": np.int32(1)})

    return _per_document(rows, hot.select("doc_id", "tkey", F.struct("start", "n").alias("entry")), run, _SEGMENT)


def _cut_words(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, seg, doc_id, n, words) of chosen segments; a word takes five bytes of its hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in batches:
            out = []
            for doc_id, text, entries in zip(pdf["doc_id"], pdf["text"], pdf["entries"], strict=True):
                words, _ = hashed_words([text], known)
                raw = np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :5])
                out += [(e["key"], e["seg"], doc_id, e["n"], raw[e["start"] : e["start"] + e["n"] + WINDOW - 1].tobytes()) for e in entries]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["key", "seg", "doc_id", "n", "words"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["key", "seg", "doc_id", "n", "words"])

    return _per_document(rows, chosen.select("doc_id", "tkey", F.struct("key", "seg", "start", "n").alias("entry")), run, "key long, seg long, doc_id long, n int, words binary")


def search_block(docs: np.ndarray, counts: np.ndarray, words: list[bytes], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(stream, offset, windows, smallest document) for all windows of a block's streams, in runs, through one FM-index."""
    wide = [np.frombuffer(w, np.uint8).reshape(-1, 5) for w in words]
    sizes = np.array([len(w) for w in wide], np.int64)
    full = np.zeros((int(sizes.sum()), 8), np.uint8)
    full[:, :5] = np.concatenate(wide)
    symbols = np.unique(full.view(np.uint64).ravel(), return_inverse=True)[1] + 1
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # a 0 ends each stream
    text = np.zeros(int(starts[-1]), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(symbols)) + owner] = symbols
    index = FMIndex(text, window)
    low, high = streamed_matches(index, text, starts[:-1], counts, window)
    of_row = np.repeat(docs, sizes + 1)[index.order]
    # rows of different windows are disjoint, so each interval's least document is one reduction
    firsts, where = np.unique(low, return_inverse=True)
    lasts = np.zeros(len(firsts), np.int64)
    lasts[where] = high
    edges = np.column_stack((firsts, lasts)).ravel()
    least = np.minimum.reduceat(np.append(of_row, np.iinfo(np.int64).max), edges)[::2][where]
    stream = np.repeat(np.arange(len(counts)), counts)
    new = np.flatnonzero(np.concatenate(([True], (stream[1:] != stream[:-1]) | (least[1:] != least[:-1]))))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return list(zip(stream[new].tolist(), (new - offsets[stream[new]]).tolist(), np.diff(np.append(new, len(stream))).tolist(), least[new].tolist(), strict=True))


def _searched(cut: DataFrame) -> DataFrame:
    """(seg, off, w, least): for w windows from window ``off`` of a segment, the smallest document in which they start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def block() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            seg = pdf["seg"].to_numpy()
            rows = search_block(pdf["doc_id"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), pdf["words"].tolist())
            return pd.DataFrame([(seg[i], a, n, d) for i, a, n, d in rows], columns=["seg", "off", "w", "least"])

        for _, pdf in in_groups(batches, ["key"]):
            held.append(pdf)
            size += int(pdf["n"].sum()) + WINDOW * len(pdf)
            if size >= SHARD_WORDS:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    total = cut.agg(F.sum(F.col("n") + WINDOW)).first()[0] or 0
    return cut.repartition(max(1, -(-total // SHARD_WORDS)), "key").sortWithinPartitions("key").mapInPandas(run, "seg long, off int, w int, least long")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, tkey, text) and the spans (doc_id, tkey, start, n) of n windows that start in a smaller document.

    tkey tells rows apart that repeat a doc_id with another text. Rows with a null doc_id are left out.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("true").select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    found = table(_candidates(table(segments(rows), "segments")), "candidates")
    # a segment with the same words in several documents is searched once, for the smallest of them
    first = F.min(F.struct("doc_id", "tkey", "start", "n"))
    distinct = table(found.groupBy("key", "seg").agg(first.alias("r")), "distinct")
    hot = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_SEGMENTS).select("key")
    if not hot.isEmpty():
        hot = table(hot, "hot")
        singles = _candidates(table(_single_windows(rows, found.join(hot, "key", "left_semi")), "windows"))
        found = table(found.join(hot, "key", "left_anti").unionByName(singles), "candidates")
        distinct = table(found.groupBy("key", "seg").agg(first.alias("r")), "distinct")
    cut = table(_cut_words(rows, distinct.select("key", "seg", "r.*")), "words")
    runs = table(_searched(cut), "matches")
    spans = found.join(runs, "seg").where("least < doc_id").select("doc_id", "tkey", (F.col("start") + F.col("off")).alias("start"), F.col("w").alias("n"))
    return rows, spans


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay, joined by a space).

    A word goes when a window of 50 words that covers it also starts in a document with a smaller doc_id,
    judged on the input. Null texts have no words; texts under 50 words lose none.
    """
    rows, spans = repeated_spans(docs)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, entries in zip(pdf["doc_id"], pdf["text"], pdf["entries"], strict=True):
                words = text_bytes(text).split()
                kept = words
                if entries is not None and len(entries):
                    cover = np.zeros(len(words) + 1, np.int64)
                    for e in entries:
                        cover[e["start"]] += 1
                        cover[e["start"] + e["n"] + WINDOW - 1] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                joined = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *([joined.decode("utf-8", "surrogatepass")] if with_text else [])))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return _per_document(rows, spans.select("doc_id", "tkey", F.struct("start", "n").alias("entry")), run, schema, "left")
