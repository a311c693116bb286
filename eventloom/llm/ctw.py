"""Language-model scores by context-tree weighting over bytes, beside a unigram base over words.

A byte is coded as eight binary decisions. For every context of 0 to DEPTH preceding bytes and every prefix of
the byte's bits there is a node with counts of zeros and ones; its Krichevsky-Trofimov estimate is weighted
against what its longer contexts say, at every depth. The tree is built bottom up by grouped aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, crc_mod, file_system, new_dir, table, text_bytes

DEPTH = 5  # 6 at most: a node (context and bits) is one signed 64-bit number
#: Grams and words that a task holds at most: the most frequent ones (12 and 16 bytes each); others are joined.
HELD_GRAMS, HELD_WORDS = 1 << 23, 1 << 22
END = b"\n"
_END_WORD = np.uint64(0x9E3779B97F4A7C15)  # the end token's hash


def coded(text: str | None) -> tuple[list[bytes], bytes]:
    """The words of a text with A-Z lowered, and the bytes that stand for it: words joined by spaces, then one end byte."""
    words = text_bytes(text).lower().split()
    return words, b" ".join(words) + END


def grams(parts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each part, it and its ``depth`` predecessors as one number (the part starts after END bytes); offsets."""
    data = np.frombuffer(b"".join(END * depth + p for p in parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    rolled = data[: len(data) - depth].astype(np.uint64)
    for j in range(1, depth + 1):
        rolled <<= np.uint64(8)
        rolled |= data[j : len(data) - depth + j].astype(np.uint64)
    at = np.arange(ends[-1]) + np.repeat(np.arange(len(parts)) * depth, sizes)
    return rolled[at], ends


def _parts(texts: pd.Series, most: int = 1_500_000) -> Iterator[tuple[int, int, list[tuple[list[bytes], bytes]]]]:
    """Runs of texts (first, end, coded forms) of about ``most`` bytes."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        held.append(coded(text))
        size += len(held[-1][1])
        if size >= most:
            yield first, i + 1, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, first + len(held), held


class _Counter:
    """Counts of 64-bit keys; merges what it has gathered when that grows."""

    def __init__(self, merge_at: int = 1_500_000):
        self.keys, self.counts, self.size, self.merge_at = [], [], 0, merge_at

    def add(self, keys: np.ndarray) -> None:
        codes, keys = pd.factorize(keys)
        self.keys.append(keys)
        self.counts.append(np.bincount(codes, minlength=len(keys)))
        self.size += len(keys)
        if self.size > max(self.merge_at, 2 * len(self.keys[0])):  # the first holds what is merged already
            self.merge()

    def merge(self) -> None:
        if not self.keys:
            self.keys, self.counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        elif len(self.keys) > 1:
            codes, keys = pd.factorize(np.concatenate(self.keys))
            counts = np.bincount(codes, weights=np.concatenate(self.counts), minlength=len(keys)).astype(np.int64)
            self.keys, self.counts, self.size = [keys], [counts], len(keys)

    def frames(self, kind: int) -> Iterator[pd.DataFrame]:
        self.merge()
        for a in range(0, len(self.keys[0]), 100_000):
            yield pd.DataFrame({"kind": np.int32(kind), "key": self.keys[0][a : a + 100_000].view(np.int64), "n": self.counts[0][a : a + 100_000]})


def gathered(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n) over whole training texts: kind 0 counts byte grams, kind 1 words (by 64-bit hash) and ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bytes_seen, words_seen, hashes = _Counter(), _Counter(), WordHashes()
        for pdf in batches:
            for _, _, both in _parts(pdf["text"]):
                bytes_seen.add(grams([b for _, b in both], depth)[0])
                ids = [np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w, _ in both]
                words_seen.add(np.concatenate([*ids, np.full(len(both), _END_WORD)]))
        yield from bytes_seen.frames(0)
        yield from words_seen.frames(1)

    return docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def ln_gamma(x: Column) -> Column:
    """Stirling's series, moved up by six."""
    y, low = x + 6, x
    for i in range(1, 6):
        low = low * (x + i)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.ln(low)


def kt(zeros: Column, ones: Column) -> Column:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return ln_gamma(zeros + 0.5) + ln_gamma(ones + 0.5) - math.log(math.pi) - ln_gamma(zeros + ones + 1.0)


def _node(depth: int) -> Column:
    """The node (context << 8 | bits so far) of ``depth`` bytes that bit j of the gram ``key`` is coded in."""
    context = F.shiftright("key", 8).bitwiseAND((1 << 8 * depth) - 1)
    return context * 256 + F.expr("shiftleft(1L, j)") + F.expr("shiftright(key & 255, 8 - j)")


def tree(counts: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """By depth, every node (node, n, p) of gram counts (key, n): how often it is seen, and the weighted probability of a one.

    p is what the node says together with all shorter contexts, so a decision needs its deepest node only: that
    stands for what is below it.
    """
    bits = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")
    spread = counts.select("key", "n", bits)
    bit = F.expr("shiftright(key & 255, 7 - j) & 1")
    level = spread.select(_node(depth).alias("node"), (F.col("n") * (1 - bit)).alias("z"), (F.col("n") * bit).alias("o")).groupBy("node").agg(F.sum("z").cast("double").alias("z"), F.sum("o").cast("double").alias("o"))
    level = level.withColumn("k", kt(F.col("z"), F.col("o"))).withColumn("w", F.col("k"))
    levels = []
    for d in range(depth, -1, -1):
        level = table(level, f"tree{d}")
        levels.insert(0, level)
        if d:
            up = level.select(_shorter(d).alias("node"), "z", "o", "w").groupBy("node").agg(F.sum("z").alias("z"), F.sum("o").alias("o"), F.sum("w").alias("s"))
            up = up.withColumn("k", kt(F.col("z"), F.col("o")))
            high = F.greatest("k", "s")
            level = up.select("node", "z", "o", "k", (high + F.ln(F.exp(F.col("k") - high) + F.exp(F.col("s") - high)) - math.log(2)).alias("w"))
    out: list[DataFrame] = []
    for d in range(depth + 1):
        # the share of this node's own estimate; a deepest node has all of it
        weight = F.lit(1.0) if d == depth else F.exp(F.col("k") - math.log(2) - F.col("w"))
        rows = levels[d].select("node", (F.col("z") + F.col("o")).cast("long").alias("n"), ((F.col("o") + 0.5) / (F.col("z") + F.col("o") + 1)).alias("one"), weight.alias("weight"))
        if d:
            above = out[-1].select(F.col("node").alias("parent"), "said", "rest")
            rows = rows.withColumn("parent", _shorter(d)).join(above, "parent")
        else:
            rows = rows.select("*", F.lit(0.0).alias("said"), F.lit(1.0).alias("rest"))
        passed = [] if d == depth else [(F.col("said") + F.col("rest") * F.col("weight") * F.col("one")).alias("said"), (F.col("rest") * (1 - F.col("weight"))).alias("rest")]
        out.append(table(rows.select("node", "n", (F.col("said") + F.col("rest") * F.col("one")).alias("p"), *passed), f"nodes{d}"))
    return out


def _shorter(depth: int) -> Column:
    """The node of one byte less that a ``node`` of this depth is below."""
    return F.shiftright("node", 8).bitwiseAND((1 << 8 * (depth - 1)) - 1) * 256 + F.col("node").bitwiseAND(255)


def looked_up(keys: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, log10) of distinct grams (key): the log10 probability of the last byte, each bit by its deepest node of all."""
    left = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    found = None
    for d in range(len(levels) - 1, -1, -1):
        got = table(left.withColumn("node", _node(d)).join(levels[d].select("node", "p"), "node", "left").select("key", "j", "p"), f"looked{d}")
        hits, left = got.where("p is not null"), got.where("p is null").select("key", "j")
        found = hits if found is None else found.unionByName(hits)
    found = found.unionByName(left.withColumn("p", F.lit(0.5)))  # without any node: an even guess
    bit = F.expr("shiftright(key & 255, 7 - j) & 1")
    return found.groupBy("key").agg(F.sum(F.log10(F.when(bit == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("log10"))


def told(counts: DataFrame, deepest: DataFrame, depth: int) -> DataFrame:
    """(key, n, log10) of the grams (key, n) that were learnt from: all their decisions have nodes of full depth."""
    bits = counts.select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).withColumn("node", _node(depth))
    bit = F.expr("shiftright(key & 255, 7 - j) & 1")
    return bits.join(deepest.select("node", "p"), "node").groupBy("key").agg(F.first("n").alias("n"), F.sum(F.log10(F.when(bit == 1, F.col("p")).otherwise(1 - F.col("p")))).alias("log10"))


def least_held(counts: DataFrame, most: int) -> int:
    """The smallest count, on a scale of quarters of powers of two, that at most ``most`` rows (n) reach."""
    step = F.floor(4 * F.log2(F.col("n").cast("double"))).cast("int").alias("step")
    left = most
    for r in sorted(counts.groupBy(step).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r.step):
        left -= r.rows
        if left < 0:
            return math.floor(2 ** ((r.step + 1) / 4)) + 1
    return 1


class _Held:
    """Sorted keys and their values, read inside a task from a table that was written in order of keys."""

    def __init__(self, path: str, value: str):
        import pyarrow.dataset as ds

        fs, where = file_system(path)
        keys, values = [np.empty(0, np.int64)], []
        for part in sorted(ds.dataset(where, filesystem=fs, format="parquet").get_fragments(), key=lambda f: f.path):
            rows = part.to_table(columns=["key", value])
            keys.append(rows["key"].to_numpy())
            values.append(rows[value].to_numpy())
        self.keys, self.values = np.concatenate(keys), np.concatenate(values) if values else np.empty(0)
        if (self.keys[1:] < self.keys[:-1]).any():
            order = np.argsort(self.keys)
            self.keys, self.values = self.keys[order], self.values[order]
        pa.default_memory_pool().release_unused()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key (0 where it is not held), and whether it is held."""
        codes, distinct = pd.factorize(keys)
        order = np.argsort(distinct)
        at = np.searchsorted(self.keys, distinct[order])
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == distinct[order]) if len(self.keys) else np.zeros(len(at), bool)
        value, held = np.zeros(len(at)), np.zeros(len(at), bool)
        value[order], held[order] = (np.where(hit, self.values[at], 0.0) if len(self.keys) else 0.0), hit
        return value[codes], held[codes]


_LOADED: dict[str, tuple[_Held, _Held]] = {}


def _held(grams_at: str, words_at: str) -> tuple[_Held, _Held]:
    if grams_at not in _LOADED:
        _LOADED.clear()
        _LOADED[grams_at] = _Held(grams_at, "log10"), _Held(words_at, "n")
    return _LOADED[grams_at]


def _in_order(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "zstd").parquet(path)


def scores(docs: DataFrame, training: DataFrame, depth: int = DEPTH, held_grams: int = HELD_GRAMS, held_words: int = HELD_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score.

    score is log10 of the context tree's probability of the text (words with A-Z lowered, joined by one space,
    then an end); -score / n_bytes / log10(2) is its code length in bits a byte. base_score is the add-one unigram
    over words and ends. Everything is counted over all of ``training``, whole texts. Null and empty texts consist
    of the end only; rows with a null doc_id are scored, too. An empty training table gives every binary decision
    probability 1/2.

    The log probability of a byte after its context is worked out once for every distinct gram of the training texts.
    A task holds those of the ``held_grams`` most frequent grams and the ``held_words`` most frequent words (as many
    whole steps of a quarter of a power of two as fit), a bound whatever the corpus. Rarer ones are resolved exactly by
    joins, and grams that training has not seen by their deepest nodes in the whole tree. Words are told apart by 64-bit
    hashes.
    """
    spark = docs.sparkSession
    seen = table(gathered(training, depth), "counts")
    sums = {r["kind"]: r for r in seen.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tokens, kinds = (sums[1]["n"], sums[1]["v"]) if 1 in sums else (0, 0)
    grams_seen, lower = seen.where("kind = 0").select("key", "n"), math.log10(tokens + kinds + 1)
    levels = tree(grams_seen, depth)
    known = table(told(grams_seen, levels[depth], depth), "grams")
    words_seen = seen.where("kind = 1").select("key", "n", (F.log10(F.col("n") + 1.0) - lower).alias("base"))
    grams_at, words_at = new_dir(spark, "held-grams"), new_dir(spark, "held-words")
    least, often = least_held(known, held_grams), least_held(words_seen, held_words)
    _in_order(known.where(F.col("n") >= least).select("key", F.col("log10").cast("float").alias("log10")), grams_at)
    _in_order(words_seen.where(F.col("n") >= often).select("key", F.col("n").cast("double").alias("n")), words_at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told_grams, told_words = _held(grams_at, words_at)
        hashes, row = WordHashes(), TaskContext.get().partitionId() << 40
        for pdf in batches:
            for first, end, both in _parts(pdf["text"]):
                part = pdf.iloc[first:end]
                wide, ends = grams([b for _, b in both], depth)
                value, held = told_grams.find(wide.view(np.int64))
                open_grams = _split(wide[~held].view(np.int64), ~held, ends)
                n = np.array([len(w) + 1 for w, _ in both], np.int64)
                starts = np.concatenate(([0], np.cumsum(n)))
                words = np.concatenate([np.append(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)), _END_WORD) for w, _ in both]).view(np.int64)
                times, common = told_words.find(words)
                base = np.where(common, np.log10(times + 1) - lower, 0.0)
                yield pd.DataFrame({
                    "row": row + np.arange(len(part)), "doc_id": part["doc_id"].astype("Int64").to_numpy(), "n_bytes": np.diff(ends), "n_tokens": n, "known": np.add.reduceat(common.astype(np.int64), starts[:-1]),
                    "base": np.add.reduceat(base, starts[:-1]), "score": np.add.reduceat(value, ends[:-1]), "rare": _split(words[~common], ~common, starts), "grams": open_grams,
                })
                row += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = table(rows.mapInPandas(run, "row long, doc_id long, n_bytes long, n_tokens long, known long, base double, score double, rare array<long>, grams array<long>"), "scored")
    times = F.count(F.lit(1)).alias("times")
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(times).join(words_seen.where(F.col("n") < often), "key", "left")
    rest = rare.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.coalesce("base", F.lit(-lower))).alias("less"))
    open_grams = table(scored.select("row", F.explode("grams").alias("key")).groupBy("row", "key").agg(times), "open-grams")
    asked = open_grams.select("key").distinct().join(known.where(F.col("n") < least).select("key", "log10"), "key", "left")
    asked = table(asked, "asked")
    new = asked.where("log10 is null").select("key")
    resolved = asked.where("log10 is not null")
    if not new.isEmpty():
        resolved = resolved.unionByName(looked_up(new, levels))
    deep = open_grams.join(resolved, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("log10")).alias("deep"))
    out = scored.drop("rare", "grams").join(rest, "row", "left").join(deep, "row", "left")
    return out.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("less", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"),
    )


def _split(values: np.ndarray, chosen: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The chosen values of each of the stretches that ``ends`` bounds."""
    return np.split(values, np.cumsum(np.add.reduceat(chosen.astype(np.int64), ends[:-1]))[:-1])


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learnt from: crc32 of the id as text, modulo 7, is not 2."""
    return docs.where(crc_mod("doc_id", 7) != 2)
