"""The append-only event log: published batches of Parquet files, uniqueness checks, payload codec."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.query import EventQuery

SCHEMA = "id string, name string, time_ns bigint, ts timestamp_ntz, aggregate_name string, aggregate_id string, aggregate_version int, data string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


class Conflict(Exception):
    """An append repeats an id or an entity's version."""


class NotFound(Exception):
    pass


def events_from(spark: SparkSession, rows: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def schema_problems(df: DataFrame) -> list[str]:
    """Missing and mistyped columns of what should be an event table."""
    have = dict(df.dtypes)
    return [f"missing {f.name}" if f.name not in have else f"{f.name} is {have[f.name]}, not {f.dataType.simpleString()}" for f in T.StructType.fromDDL(SCHEMA).fields if have.get(f.name) != f.dataType.simpleString()]


def keyed(events: DataFrame) -> DataFrame:
    """Events whose entity and version must be unique."""
    return events.where("aggregate_name <> '' and aggregate_id is not null and aggregate_version > 0")


def conflicts(batch: DataFrame, log: DataFrame, optimistic: bool = False) -> DataFrame:
    """(kind, id) of events of a batch that repeat an id or a version, inside the batch or against the log.

    With ``optimistic`` also kind stale: an entity's first new version must lie above all that the log holds of it, so a
    free version below them does not count as free.
    """
    key = ["aggregate_name", "aggregate_id", "aggregate_version"]
    doubled = batch.groupBy("id").count().where("count > 1").select(F.lit("id").alias("kind"), "id")
    known = batch.join(log.select("id"), "id", "left_semi").select(F.lit("id").alias("kind"), "id")
    versions = keyed(batch)
    again = versions.join(versions.groupBy(*key).count().where("count > 1"), key, "left_semi").select(F.lit("version").alias("kind"), "id")
    taken = versions.join(keyed(log), key, "left_semi").select(F.lit("version").alias("kind"), "id")
    found = doubled.unionByName(known).unionByName(again).unionByName(taken)
    if optimistic:
        top = keyed(log).groupBy(*key[:2]).agg(F.max("aggregate_version").alias("top"))
        low = versions.groupBy(*key[:2]).agg(F.min_by("id", "aggregate_version").alias("id"), F.min("aggregate_version").alias("low"))
        found = found.unionByName(low.join(top, key[:2]).where("top >= low").select(F.lit("stale").alias("kind"), "id"))
    return found.distinct()


class EventLog:
    """A log in a folder of Parquet files. A batch is written aside, checked against the log, then moved into place.

    Readers and streams see ``batches`` only, so an append appears whole or not at all, and a refused one never. The number
    of a batch is claimed by creating a file, which one writer can. Deleted events are listed in ``deleted`` and left out
    on reading; streams, which read the files, still see them. Files are sorted by entity, so that reads of an entity skip
    row groups by their statistics; the check of an append reads ids and keys only, and of those the ranges that the
    batch spans (ids that start with their time, and few entity names, leave little).
    """

    def __init__(self, spark: SparkSession, path: str, before: Callable[[DataFrame], None] | None = None, after: Callable[[DataFrame], None] | None = None, optimistic: bool = True):
        self.spark, self.path, self.before, self.after, self.optimistic = spark, path.rstrip("/"), before, after, optimistic
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("batches", "claims"):
            self._fs.mkdirs(self._at(f"{self.path}/{folder}"))

    def _next(self) -> int:
        return 1 + max((int(s.getPath().getName()) for s in self._fs.listStatus(self._at(f"{self.path}/claims"))), default=0)

    def _claim(self, number: int) -> None:
        try:
            self._fs.create(self._at(f"{self.path}/claims/{number:012d}"), False).close()
        except Exception as e:
            raise Conflict(f"number {number} was claimed by another writer") from e

    def _move(self, staged: str, to: str) -> None:
        self._fs.mkdirs(self._at(to.rsplit("/", 1)[0]))
        if not self._fs.rename(self._at(staged), self._at(to)):
            raise OSError(f"{staged} could not be moved to {to}")

    def _files(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA + ", batch bigint").option("recursiveFileLookup", "true").parquet(f"{self.path}/batches")

    def read(self) -> DataFrame:
        events = self._files()
        if self._fs.exists(self._at(f"{self.path}/deleted")):
            gone = self.spark.read.schema("id string, before bigint").option("recursiveFileLookup", "true").parquet(f"{self.path}/deleted").groupBy(F.col("id").alias("_id")).agg(F.max("before").alias("_before"))
            events = events.join(gone, (F.col("id") == F.col("_id")) & (F.col("batch") < F.col("_before")), "left_anti")
        return events.drop("batch")

    def query(self, query: EventQuery | None = None) -> DataFrame:
        return (query or EventQuery()).apply(self.read())

    def find(self, id: str):
        row = self.read().where(F.col("id") == id).first()
        if row is None:
            raise NotFound(id)
        return row

    def insert(self, batch: DataFrame) -> None:
        """Append all events or none; Conflict when an id or version is taken or, if the log is optimistic, stale."""
        number = self._next()
        if self.before:
            self.before(batch)
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows = batch.select(*T.StructType.fromDDL(SCHEMA).fieldNames(), F.lit(number).cast("bigint").alias("batch"))
        rows.sortWithinPartitions("aggregate_name", "aggregate_id", "aggregate_version").write.parquet(staged)
        written = self.spark.read.schema(SCHEMA).parquet(staged)
        low, high = written.agg(F.min("id"), F.max("id")).first()
        names = [r[0] for r in written.select("aggregate_name").where("aggregate_name is not null").distinct().limit(101).collect()]
        held = self.read()
        touched = F.col("id").between(low, high) | (F.col("aggregate_name").isin(*names) if 0 < len(names) <= 100 else F.lit(len(names) > 100))
        found = conflicts(written, held.where(touched), self.optimistic).limit(5).collect() if low is not None else []
        if found:
            self._fs.delete(self._at(staged), True)
            raise Conflict(", ".join(f"{r.kind} of {r.id}" for r in found))
        self._claim(number)
        place = f"{self.path}/batches/{number:012d}"
        self._move(staged, place)
        if self.after:
            self.after(self.spark.read.schema(SCHEMA).parquet(place))

    def insert_with_retry(self, make: Callable[[DataFrame], DataFrame], tries: int = 3, wait: Callable[[int], float] = lambda n: 0.05 * 2**n * (0.5 + random.random())) -> None:
        """Rebuild a batch from the current log and append it, again after a conflict; ``wait`` gives the seconds before try n."""
        for n in range(tries):
            try:
                return self.insert(make(self.read()))
            except Conflict:
                if n + 1 == tries:
                    raise
                time.sleep(wait(n))

    def delete(self, gone: DataFrame) -> None:
        """Remove events by id: they are listed, no file is written again. Unknown ids are ignored; a deleted id may come again."""
        number, staged = self._next(), f"{self.path}/staged/{uuid.uuid4().hex}"
        gone.select("id").where("id is not null").distinct().withColumn("before", F.lit(number).cast("bigint")).write.parquet(staged)
        self._claim(number)
        self._move(staged, f"{self.path}/deleted/{number:012d}")

    def delete_entity(self, name: str, id: str) -> None:
        self.delete(self.read().where((F.col("aggregate_name") == name) & (F.col("aggregate_id") == id)))

    def stream(self, query: EventQuery | None = None) -> DataFrame:
        """Published events as a stream, from the first one; with a query those that it accepts (its order does not count)."""
        events = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.path}/batches")
        return events if query is None else events.where(query.predicate())


class Codec:
    """Payload types by event name. Unknown names are errors; hooks replace the default JSON form."""

    def __init__(self):
        self.types: dict[str, tuple[str, Callable | None]] = {}

    def register(self, name: str, ddl: str, decode: Callable | None = None) -> None:
        self.types[name] = (ddl, decode)

    def decode(self, events: DataFrame, name: str) -> DataFrame:
        """Events of a name plus payload and decode_error, which holds the data that could not be read."""
        if name not in self.types:
            raise KeyError(f"no payload type for {name}")
        ddl, hook = self.types[name]
        rows = events.where(F.col("name") == name)
        if hook:
            return rows.withColumn("payload", hook(F.col("data"))).withColumn("decode_error", F.lit(None).cast("string"))
        with_error = T.StructType([*T.StructType.fromDDL(ddl).fields, T.StructField("_bad", T.StringType())])
        read = F.from_json("data", with_error, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        plain = F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in with_error.fields[:-1]])
        return rows.withColumn("_p", read).withColumn("payload", plain).withColumn("decode_error", F.col("_p._bad")).drop("_p")

    @staticmethod
    def encode(payload) -> F.Column:
        return F.to_json(payload)


def read_jdbc(spark: SparkSession, url: str, table: str, bounds: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """An event table in a database; ``bounds`` (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if bounds:
        column, low, high, parts = bounds
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def write_jdbc(events: DataFrame, url: str, table: str, **options: str) -> None:
    events.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


class Models:
    """Models by key: the last saved version of each. ``encode`` and ``decode`` turn models into rows and back."""

    def __init__(self, keys: list[str], encode: Callable[[object], dict] | None = None, decode: Callable[[dict], object] | None = None, order: str | None = None):
        self.keys, self.encode, self.decode, self.order = keys, encode or (lambda m: m), decode or (lambda r: r), order

    def rows(self, spark: SparkSession, models: list, schema: str) -> DataFrame:
        return spark.createDataFrame([self.encode(m) for m in models], schema)

    def upsert(self, held: DataFrame, saved: DataFrame) -> DataFrame:
        """Of saved rows with one key, that with the largest ``order`` column (or, without one, the largest row) stays."""
        others = [c for c in saved.columns if c not in self.keys]
        rank = F.struct(*([F.col(self.order)] if self.order else []), *others)
        last = saved.groupBy(*self.keys).agg(F.max_by(F.struct(*others), rank).alias("_m")).select(*self.keys, "_m.*") if others else saved.distinct()
        return held.join(saved.select(*self.keys), self.keys, "left_anti").unionByName(last)

    def delete(self, held: DataFrame, gone: DataFrame) -> DataFrame:
        return held.join(gone.select(*self.keys), self.keys, "left_anti")

    def fetch(self, held: DataFrame, make: dict | None = None, **key):
        """The model of a key; where there is none, one made of ``make``, or NotFound."""
        found = held
        for k, v in key.items():
            found = found.where(F.col(k).eqNullSafe(F.lit(v)))
        row = found.first()
        if row is None and make is None:
            raise NotFound(str(key))
        return self.decode(row.asDict(recursive=True) if row else {**make, **key})
