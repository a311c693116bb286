"""Near-duplicates: circulant MinHash, banding, exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import WordHashes, fresh, give_back, hashed_words, in_groups, mix, table

WIDTH = 5  # words a shingle
ROWS, BANDS = 4, 16  # a pair at similarity 0.85 shares no band with probability 8e-6, one at 0.8 with 2e-4
#: Documents, and shingles, that one task verifies against each other at once.
GROUP_DOCS, GROUP_SHINGLES = 2000, 3_000_000
#: Documents that a hub does not reach and that meet a part of their family at once.
BLOCK_DOCS = 500

_P = np.uint64(0x9E3779B97F4A7C55)


def shingle_sets(texts, hashes: WordHashes) -> list[np.ndarray]:
    """Each text's set of 5-word shingles as sorted distinct 64-bit hashes.

    Lower-cases A-Z. With fewer than five words the whole sequence is one shingle; without words the set is empty.
    """
    words, ends = hashed_words(texts, hashes, lower=True)
    n = len(words)
    if n >= WIDTH:
        rolled = words[: n - WIDTH + 1].copy()
        for j in range(1, WIDTH):
            rolled *= _P
            rolled += words[j : n - WIDTH + 1 + j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            one = np.sort(rolled[a : b - WIDTH + 1])
            out.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = np.uint64((int(short) * int(_P) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of [0, 2**32): a bijective mixer."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], k: int = ROWS * BANDS) -> np.ndarray:
    """Circulant MinHash: coordinate i is the least value of the second permutation, shifted circularly by i, on the first.

    Only two permutations of the universe [0, 2**32) exist: the first scatters the hashed shingles, the
    second is one fixed bijection whose argument is shifted by i modulo 2**32. Sets must not be empty.
    """
    out = np.empty((len(sets), k), np.uint32)
    at = 0
    while at < len(sets):  # blocks of documents that fit the processor's cache
        end, size = at, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= 60_000):
            size += len(sets[end])
            end += 1
        first = (mix(np.concatenate(sets[at:end]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64))).astype(np.int64)
        for i in range(k):
            out[at:end, i] = np.minimum.reduceat(_second(first + np.uint32(i)), starts)
        at = end
    return out


def band_keys(sign: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    n, k = sign.shape
    keys = np.empty((n, k // rows), np.uint64)
    for b in range(k // rows):
        key = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * _P + sign[:, b * rows + r].astype(np.uint64))
        keys[:, b] = key
    return keys.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of whole texts; bands is null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500]
                sets = shingle_sets(part["text"], hashes)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, band_keys(signatures([sets[i] for i in full])), strict=True):
                        bands[i] = row
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_shingles": [len(s) for s in sets], "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "bands": bands})
        give_back()

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def linked_groups(sets: list[np.ndarray], percent: int, asked: np.ndarray | None = None) -> np.ndarray:
    """A group number for each set: sets are linked when 100 x intersection >= percent x union, groups are what links reach.

    Breadth first, each set against those not reached yet, so a group of copies costs about one pass.
    With ``asked``, only links with one end in it are looked for.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    group, has, next_group = np.full(n, -1, np.int64), np.zeros(len(values), bool), 0
    left = np.arange(n)
    for first in range(n):
        if group[first] >= 0:
            continue
        group[first], queue = next_group, [first]
        left = left[group[left] < 0]
        while queue and len(left):
            x = queue.pop()
            fits = left[(100 * np.minimum(sizes[left], sizes[x]) >= percent * np.maximum(sizes[left], sizes[x]))]
            if asked is not None and not asked[x]:
                fits = fits[asked[fits]]
            if not len(fits):
                continue
            own = flat[starts[x] : starts[x + 1]]
            has[own] = True
            lens = sizes[fits]
            offs = np.concatenate(([0], np.cumsum(lens)[:-1]))
            where = np.arange(lens.sum()) - np.repeat(offs, lens) + np.repeat(starts[fits], lens)
            both = np.add.reduceat(has[flat[where]].astype(np.int64), offs)
            has[own] = False
            hit = fits[100 * both >= percent * (lens + sizes[x] - both)]
            if len(hit):
                group[hit] = next_group
                queue += hit.tolist()
                left = left[group[left] < 0]
        next_group += 1
    return group


def _verified(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join what is linked inside each (family, part) of (family, part, asked, id, shingles)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, pdf in in_groups(batches, ["family", "part"]):
            pdf = pdf.drop_duplicates("id")
            if len(pdf) < 2:
                continue
            ids = pdf["id"].to_numpy()
            asked = pdf["asked"].to_numpy(dtype=bool)
            group = linked_groups([np.frombuffer(s, np.uint64) for s in pdf["shingles"]], percent, None if asked.all() else asked)
            least = pd.Series(ids).groupby(group).transform("min").to_numpy()
            yield pd.DataFrame({"a": ids, "b": least})[ids != least]
        give_back()

    return members.repartition("family", "part").sortWithinPartitions("family", "part", "id").mapInPandas(run, "a long, b long")


def near_groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 x intersection >= percent x union of their full shingle sets; component_id is
    the smallest doc_id that links reach. Null, empty and wordless texts have an empty set, linked with nothing.
    Rows with a null doc_id are left out; repeated rows come back as often as they occur.

    Steps: equal sets become one representative; representatives that share a band with others form candidate
    families (components of the stars around each bucket's least member, so no pairs are listed); each family's
    full sets meet in one task, where links are confirmed exactly. A family too large for a task is dealt into
    parts that all hold the same hub; members that the hub does not reach in their part then meet every part,
    in blocks, so no link is lost and no group has to fit one task.
    """
    sketch = table(sketches(docs), "sketches")
    distinct = sketch.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    banded = sketch.where("n_shingles > 0").select("doc_id", "set_key", "bands").join(distinct.select(F.col("set_key").alias("k"), "id"), (F.col("k") == F.col("set_key")) & (F.col("id") == F.col("doc_id")), "left_semi").dropDuplicates(["doc_id"])
    keys = table(banded.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band")), "bands")
    buckets = keys.groupBy("band").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = table(keys.join(buckets, "band").groupBy("id", "least").agg(F.sum("n").alias("weight")), "stars")
    families = components(stars.select(F.col("id").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("family"))

    sizes = sketch.select(F.col("doc_id").alias("id"), "n_shingles").dropDuplicates(["id"])
    weight = stars.groupBy("id").agg(F.sum("weight").alias("weight"))
    member = table(families.join(sizes, "id").join(weight, "id"), "families")
    whole = member.groupBy("family").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_DOCS), F.ceil(F.sum("n_shingles") / GROUP_SHINGLES)).cast("int").alias("parts"),
        F.max(F.struct("weight", "id"))["id"].alias("hub"),  # in the fullest buckets: the most central copy
    )
    member = table(member.join(whole, "family").select("id", "family", "parts", "hub"), "members")

    wanted = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = table(_full_sets(wanted.join(member, "id").dropDuplicates(["id"])), "sets")
    part = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    dealt = sets.select("family", "id", "shingles", F.lit(True).alias("asked"), F.explode(part).alias("part"))
    edges = table(_verified(dealt.select("family", "part", "asked", "id", "shingles"), percent), "links")
    if not member.where("parts > 1").isEmpty():
        edges = edges.unionByName(_beyond_hubs(sets, edges, percent))

    copies = sketch.where("n_shingles > 0").join(distinct, "set_key").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = components(edges.unionByName(copies)).select(F.col("node").alias("doc_id"), "component")
    out = sketch.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _full_sets(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = pdf.drop(columns="text")
            out["shingles"] = [s.tobytes() for s in shingle_sets(pdf["text"], hashes)]
            yield out

    return rows.select("id", "family", "parts", "hub", "text").mapInPandas(run, "id long, family long, parts int, hub long, shingles binary")


def _beyond_hubs(sets: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Links of families in several parts that do not run through the hub."""
    large = sets.where("parts > 1")
    reached = components(edges).select(F.col("node").alias("id"), "component")
    state = large.select("id", "family", "parts", "hub").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    main = state.where("id = hub").select("family", F.col("component").alias("main"))
    rest = table(state.join(main, "family").where("component <> main").select("id"), "unreached")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_DOCS)).cast("int")
    block = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), blocks).cast("int")
    asked = large.join(rest, "id", "left_semi")
    number = asked.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.join(number, "family").select("family", "parts", "id", "shingles", block.alias("block"), blocks.alias("blocks"))
    blocks = asked.select("family", "blocks").distinct()
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")
    sought = asked.select("family", every, "block", F.lit(True).alias("asked"), "id", "shingles")
    held = large.join(blocks, "family").select("family", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asked"), "id", "shingles")
    # one row an id in a group: an asked one stands for itself in its own block, and is held for the other blocks
    both = sought.unionByName(held.join(asked.select("id", "block"), ["id", "block"], "left_anti"))
    return _verified(both.select("family", (F.col("p").cast("long") * (1 << 20) + F.col("block")).alias("part"), "asked", "id", "shingles"), percent)


def keep_one_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all their columns."""
    name = fresh(docs, "kept_id")
    kept = near_groups(docs, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"] == kept[name], "left_semi")
