"""Helpers of the corpus operators: the shared folder, written tables, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space that separates words in every operator here.
SPACE = r"[\x20\x09-\x0D]"


#: Paths written by this process, for ``forget``.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode, where that is unset, a local one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="eventloom-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def forget(spark: SparkSession) -> int:
    """Delete all tables and files that the operators wrote in this process, once no DataFrame over them is used any more."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_once(rows: DataFrame, once: DataFrame, key: str, n: str = "n", total: int | None = None, share: int = 1000) -> DataFrame:
    """Inner join with a table that has each key once, with the number ``n`` of rows that have it (``total``: of all keys).

    Keys of at least a ``share``-th of all counted rows are at most ``share``: they are broadcast, so their rows stay where they
    are, and no key of the shuffled rest has more than a ``share``-th.
    """
    least = max(2, (once.agg(F.sum(n)).first()[0] or 0) if total is None else total) / share
    hot = once.where(F.col(n) >= least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(once.where(F.col(n) < least), key))


def file_system(uri: str):
    """pyarrow's file system and plain path of a URI; used inside tasks to write and read binary formats."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, chunks) -> int:
    """Write a file so that it appears whole or not at all; a repeated task replaces it by the same bytes."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(part, path)
    return size


def give_back() -> None:
    """Return what a task no longer uses to the machine, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed_words(texts, hashes: WordHashes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in one array, and each text's offsets in it.

    bytes.split() without arguments splits at exactly these six bytes, and bytes.lower() changes A-Z only.
    """
    parts, ends = [], [0]
    get = hashes.__getitem__
    for text in texts:
        data = text_bytes(text)
        words = (data.lower() if lower else data).split()
        parts.append(np.fromiter(map(get, words), dtype=np.uint64, count=len(words)))
        ends.append(ends[-1] + len(words))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(ends, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def in_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of a partition that is sorted by ``keys``, also where one spans several Arrow batches."""
    held: list[pd.DataFrame] = []
    held_key: tuple | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        codes = pdf[keys].ne(pdf[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(codes)
        starts = starts if len(starts) and starts[0] == 0 else np.insert(starts, 0, 0)
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            key = tuple(pdf[k].iat[a] for k in keys)
            if held and key != held_key:
                yield held_key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held_key = key
            held.append(pdf.iloc[a:b])
    if held:
        yield held_key, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id gives 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n), F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
