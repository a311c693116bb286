"""Exact deduplication by stateful streaming, DataFrame functions only.

A digest stream is folded by a keyed streaming aggregation whose state lies in RocksDB on disk and never
expires. Per digest the state holds the best copy so far (its length, stable identifier and content
locator) and the number of copies. Whenever a digest is hit again, the full bytes of the hit are compared
with those at the retained locator before the two count as copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, fresh, join_once, new_dir, table

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The session's settings while the stream starts: state on disk, without preallocated files for each of many small stores.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: Hits on one retained copy that are compared in one task.
HITS = 2000


def normalised(text: Column) -> Column:
    """The text without any of the six ASCII white-space characters; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def fold_stream(digests: DataFrame, out: str, checkpoint: str):
    """Start the stateful stream over (digest, doc_id, n_chars, locator): every update of the state is appended to ``out``.

    The query is restartable from ``checkpoint``: a repeated micro-batch writes its own folder again.
    """
    best = F.max(F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("neg"), F.col("locator")))
    state = digests.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after removal of white space. The copy with most code points stays, then
    that with the smallest doc_id. Null texts count as empty and so are copies of each other. Rows with a
    null doc_id have no stable identifier and are left out; rows that repeat a doc_id count as copies each.
    Texts that share a digest but not their bytes are told apart (``digest`` can be weakened to test that).
    """
    spark = docs.sparkSession
    norm = normalised(F.col("text"))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = rows.select(
        "doc_id",
        digest(norm).alias("digest"),
        sha256(norm).alias("text_sha256"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.xxhash64("text").alias("locator"),  # with the id, finds the row again
    )
    path, updates = new_dir(spark, "digests"), new_dir(spark, "digest-state")
    listed.write.option("compression", "zstd").parquet(path)
    schema = listed.schema

    held = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)
        fold_stream(stream, updates, new_dir(spark, "digest-checkpoint")).awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = table(_last_state(spark, updates), "digest-last")

    listed = spark.read.schema(schema).parquet(path)
    joined = join_once(listed, state, "digest", "copies")
    off = table(_unequal(rows, joined, norm, digest).distinct(), "unequal")
    # A digest that stands for several texts is resolved by the texts themselves; others keep the state's answer.
    plain = joined.join(off, "digest", "left_anti").select("doc_id", F.col("keep").alias("keep_id"), F.col("copies").alias("group_size"), "text_sha256", "n_chars")
    if off.isEmpty():
        return _answer(plain)
    texts = rows.select("doc_id", norm.alias("norm"), digest(norm).alias("digest"), sha256(norm).alias("text_sha256"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    split = texts.join(off, "digest", "left_semi")
    best = split.groupBy("digest", "norm").agg((-F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg")))["neg"]).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    told = split.join(best, ["digest", "norm"]).select("doc_id", "keep_id", "group_size", "text_sha256", "n_chars")
    return _answer(plain.unionByName(told))


def _answer(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def _last_state(spark: SparkSession, updates: str) -> DataFrame:
    schema = "digest string, best struct<n_chars:bigint,neg:bigint,locator:bigint>, copies bigint, batch int"
    if not _exists(spark, updates):
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.schema(schema).parquet(updates)
    last = F.max(F.struct("batch", "best", "copies"))
    return found.groupBy("digest").agg(last.alias("s")).select("digest", (-F.col("s.best.neg")).alias("keep"), F.col("s.best.locator").alias("keep_at"), F.col("s.copies").alias("copies"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _unequal(rows: DataFrame, joined: DataFrame, norm: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests of which a hit's full bytes differ from the retained copy's.

    The retained copy goes to one task for every HITS hits, so a group that holds a third of all rows is
    compared in many tasks.
    """
    hit = joined.where("copies > 1")
    parts = F.ceil(F.col("copies") / HITS).cast("int")
    texts = rows.select("doc_id", F.xxhash64("text").alias("locator"), norm.alias("norm"))
    wanted = hit.select("doc_id", "locator", "digest", "copies", (F.col("doc_id") == F.col("keep")).alias("held")).distinct()
    found = table(texts.join(wanted, ["doc_id", "locator"]), "hits")  # the only time that texts are moved
    kept = found.where("held").groupBy("digest").agg(F.first("norm").alias("kept_norm"), F.first("copies").alias("copies"))
    kept = kept.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    seen = found.where("not held").select("digest", "norm", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
    return seen.join(kept, ["digest", "part"]).where(F.col("norm") != F.col("kept_norm")).select("digest")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat an id with equal text, one stays."""
    name, key = fresh(docs, "kept_id"), fresh(docs, "norm_key")
    groups = exact_groups(docs)
    kept = groups.where("kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(key)).distinct()
    keyed = docs.withColumn(key, sha256(normalised(F.col("text").cast("string"))))
    stay = keyed.join(kept.withColumnRenamed(key, key + "_"), (keyed["doc_id"] == kept[name]) & (F.col(key) == F.col(key + "_")), "left_semi")
    return stay.dropDuplicates(["doc_id", key]).drop(key)
