"""Quality by compression: Zstandard dictionaries of good and bad labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, fresh, give_back, table, text_bytes

#: Texts are compressed in chunks of so many bytes, so that the dictionaries matter for all of a long text.
CHUNK = 4096


@dataclass
class CompressionModel:
    """Two dictionaries and the two numbers that turn the size difference into a probability."""

    good: bytes
    bad: bytes
    slope: float
    bias: float
    level: int = 3

    def difference(self) -> "Difference":
        return Difference(self)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.bias, -30, 30)))


class Difference:
    """Normalised compressed-size difference of a text: (bad - good) / (bad + good), 0 for an empty text."""

    def __init__(self, model: CompressionModel):
        def compressor(data: bytes):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=model.level)
            return zstandard.ZstdCompressor(dict_data=d, level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = compressor(model.good).compress, compressor(model.bad).compress

    def __call__(self, text: str | None) -> float:
        data = memoryview(text_bytes(text))
        good = bad = 0
        for a in range(0, len(data), CHUNK):
            part = data[a : a + CHUNK]
            good += len(self.good(part))
            bad += len(self.bad(part))
        return (bad - good) / (bad + good) if good + bad else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias by Newton's method with a small ridge; the bias alone where x says nothing."""
    a, b = 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - 1e-3 * a, (y - p).sum() - 1e-3 * b])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _dictionary(chunks: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, chunks).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples: their plain bytes serve as a raw dictionary
        return b"".join(chunks)[-size:] or b"\0" * 8


def fit(documents: DataFrame, labels: DataFrame, rows_per_class: int = 3000, chunks_per_class: int = 3000, dictionary_bytes: int = 112_640) -> CompressionModel:
    """Fit on a bounded sample of labelled rows: at most ``rows_per_class`` of each label, chosen by a hash of the id.

    ``labels`` has doc_id and quality (0 or 1; null labels are passed over; an id with several labels counts
    once, with the largest; of an id with several texts the largest counts). Two thirds of the rows build the
    dictionaries: their whole texts are cut into CHUNK bytes, of which ``chunks_per_class`` of each label, chosen by a
    hash, come to the driver. One third, unseen by the dictionaries, calibrates: whole texts are compressed in tasks, and
    two numbers a row come to the driver. Without labels of both kinds every score is the same constant.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = None
    for q in (0, 1):
        some = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 x rows_per_class rows of two numbers: a proven bound, so they may be broadcast
    sample = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "doc_id")
    sample = table(sample.groupBy("doc_id", "quality").agg(F.max("text").alias("text")).withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0), "labelled")
    size = F.octet_length("text")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(CHUNK)))
    chunks = sample.where("not calibrates").select("doc_id", "quality", F.col("text").cast("binary").alias("data"), F.explode(starts).alias("at"))
    chunks = chunks.select("quality", F.substring("data", F.col("at") + 1, CHUNK).alias("chunk"), F.xxhash64("doc_id", "at").alias("h"), "doc_id", "at")
    dictionaries = [_dictionary([bytes(r.chunk) for r in chunks.where(F.col("quality") == q).orderBy("h", "doc_id", "at").limit(chunks_per_class).collect()], dictionary_bytes) for q in (0, 1)]
    model = CompressionModel(dictionaries[1], dictionaries[0], 0.0, 0.0)
    pairs = _differences(sample.where("calibrates").select("quality", "text"), model).collect()
    x, y = np.array([r.x for r in pairs]), np.array([r.quality for r in pairs], dtype=float)
    if len(set(y)) == 2:
        # the sample holds the classes evenly: weight back to their true shares by shifting the bias
        n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
        model.slope, model.bias = _logistic(x, y)
        model.bias += float(np.log(n[1] / n[0]) - np.log((y == 1).sum() / (y == 0).sum()))
    elif len(y):
        model.bias = 10.0 if y[0] else -10.0
    return model


def _differences(rows: DataFrame, model: CompressionModel) -> DataFrame:
    """(quality, x) of (quality, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = model.difference()
        for pdf in batches:
            yield pd.DataFrame({"quality": pdf["quality"].astype("int64"), "x": [size(t) for t in pdf["text"]]})

    return rows.mapInPandas(run, "quality long, x double").orderBy("x", "quality")


def score(documents: DataFrame, model: CompressionModel, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns (default doc_id) plus the score as ``name``, over whole texts; null and empty texts get the score of no evidence.

    A kept column that is called ``name`` gives way to the score. The model (two dictionaries of bounded size) goes out
    with the task closure.
    """
    keep = keep or ["doc_id"]
    fields = [f for f in documents.schema.fields if f.name in keep and f.name != name]
    names, text = [f.name for f in fields], fresh(documents, "text_")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` double"])
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = model.difference()
        for batch in batches:
            x = np.array([size(t) for t in batch.column(text).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(model.probability(x))], names=[*names, name])
        give_back()

    return documents.select(*names, F.col("text").cast("string").alias(text)).mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(crc_mod("doc_id", 3) != 1)


def keep_good(documents: DataFrame, model: CompressionModel, least: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose score reaches ``least``, with all their columns."""
    name = fresh(documents, "quality_score")
    return score(documents, model, documents.columns, name).where(F.col(name) >= least).select(*documents.columns)
