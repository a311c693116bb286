"""Projections on Structured Streaming: continuous, debounced and triggered jobs, stored progress, overviews."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.query import EntityQuery, EventQuery, accept_all


@dataclass(frozen=True)
class Progress:
    """The newest time that was applied, the ids at that time, and the last micro-batch of a stream."""

    time_ns: int = -1
    ids: tuple[str, ...] = ()
    batch: int = -1

    def unseen(self, events: DataFrame) -> DataFrame:
        """Events that are not among those applied at the newest time. Older ones pass: they may be late."""
        return events.where((F.col("time_ns") != self.time_ns) | ~F.col("id").isin(*self.ids)) if self.ids else events

    def remaining(self, events: DataFrame) -> DataFrame:
        """What a run over a whole log reads: from the newest applied time on (the bound reaches the scan), without those applied."""
        return self.unseen(events.where(F.col("time_ns") >= self.time_ns))

    def after(self, applied: DataFrame, batch: int | None = None) -> Progress:
        """The driver receives the ids of one instant."""
        number = self.batch if batch is None else batch
        top = applied.agg(F.max("time_ns")).first()[0]
        if top is None or top < self.time_ns:
            return Progress(self.time_ns, self.ids, number)
        ids = {r.id for r in applied.where(F.col("time_ns") == top).select("id").distinct().collect()}
        return Progress(top, tuple(sorted(ids | set(self.ids if top == self.time_ns else ()))), number)


class ProgressFile:
    """Progress kept beside a projection's target, so that it outlives the process. The newest of two files counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.at = spark, spark._jvm.org.apache.hadoop.fs.Path
        self.path, self.fs = path, self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def load(self) -> Progress:
        for name in (self.path, self.path + ".old"):
            if self.fs.exists(self.at(name)):
                with_ids = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(self.fs.open(self.at(name)), "UTF-8"))
                return Progress(with_ids["time_ns"], tuple(with_ids["ids"]), with_ids["batch"])
        return Progress()

    def save(self, progress: Progress) -> None:
        """The old file stands until the new one is whole."""
        new = self.at(self.path + ".new")
        out = self.fs.create(new, True)
        out.write(bytearray(json.dumps(asdict(progress)).encode()))
        out.close()
        old = self.at(self.path + ".old")
        self.fs.delete(old, False)
        if self.fs.exists(self.at(self.path)):
            self.fs.rename(self.at(self.path), old)
        self.fs.rename(new, self.at(self.path))


@dataclass
class Job:
    """Events of one run of a projection; queries of it share what is cached."""

    events: DataFrame
    progress: Progress
    filters: tuple[EventQuery, ...] = ()
    before: Callable[[DataFrame], DataFrame] | None = None  # (events) -> rows with _of, the id of the event that each stands before
    reset: bool = False
    live: bool = False  # events of a stream: late ones are applied, too
    entities: EntityQuery | None = None

    def pending(self) -> DataFrame:
        """Events to apply; with ``before`` in their order of time, each after the rows put before it (column _sub: 0, 1, ... ; events have the highest)."""
        rows = accept_all(self.events, *self.filters)
        if self.entities is not None:
            rows = rows.where(self.entities.events().predicate())
        if not self.reset:
            rows = (self.progress.unseen if self.live else self.progress.remaining)(rows)
        return rows if self.before is None else before_each(rows, self.before(rows))

    def of(self, *names: str) -> DataFrame:
        return self.pending().where(F.col("aggregate_name").isin(*names))

    def named(self, *names: str) -> DataFrame:
        return self.pending().where(F.col("name").isin(*names))

    def first_entities(self, *names: str) -> DataFrame:
        """Distinct entities in the order in which they were first seen."""
        rows = self.of(*names) if names else self.pending()
        return rows.where("aggregate_id is not null").groupBy("aggregate_name", "aggregate_id").agg(F.min(F.struct("time_ns", "id")).alias("first")).orderBy("first")


def before_each(events: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (event columns plus _of, and _nth among those of one event) put before the events that they belong to.

    Columns _time, _of and _sub give the order: by the event's time and id, then the rows before it, then itself.
    """
    last = 1 << 30
    own = events.select(*events.columns, F.col("time_ns").alias("_time"), F.col("id").alias("_of"), F.lit(last).alias("_sub"))
    time = events.select(F.col("id").alias("_of"), F.col("time_ns").alias("_time"))
    more = rows.join(time, "_of").select(*events.columns, "_time", "_of", F.col("_nth").cast("int").alias("_sub"))
    return own.unionByName(more)


class Projection:
    """``apply(rows, reset)`` folds a run's events into a target.

    Progress is loaded from and saved to ``store``. A run that fails after its apply and before its save is applied again;
    micro-batches that were saved are passed over when a stream repeats them.
    """

    def __init__(self, apply: Callable[[DataFrame, bool], None], guard: Column | None = None, progress: Progress = Progress(), store: ProgressFile | None = None):
        self._apply, self.guard, self.store = apply, guard, store
        self.progress = store.load() if store else progress

    def run(self, job: Job, batch: int | None = None) -> int:
        if batch is not None and batch <= self.progress.batch:
            return 0
        rows = job.pending()
        rows = (rows if self.guard is None else rows.where(self.guard)).persist()
        try:
            n = rows.count()
            if n or job.reset:
                self._apply(rows, job.reset)
            self.progress = (Progress() if job.reset else self.progress).after(rows, batch)
            if self.store:
                self.store.save(self.progress)
            return n
        finally:
            rows.unpersist()


def named(stream: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return stream if "*" in names else stream.where(F.col("name").isin(*names))


def continuously(stream: DataFrame, projection: Projection, checkpoint: str, names: tuple[str, ...] = ("*",), every: str | None = None, query: EventQuery | None = None, before: Callable[[DataFrame], DataFrame] | None = None):
    """Run the projection on every micro-batch of new events, late ones included; ``every`` (an interval) makes it periodic.

    A new stream starts with all published events, which is the startup replay; from its checkpoint it goes on.
    """

    def batch(rows: DataFrame, number: int) -> None:
        projection.run(Job(rows, projection.progress, (query,) if query else (), before=before, live=True), number)

    writer = named(stream, names).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def quiet(stream: DataFrame, silence_ms: int, most_ms: int | None = None) -> DataFrame:
    """A row (n, first_ns, waited_ms) once no event came for ``silence_ms``, or once ``most_ms`` passed since the first that waits.

    By default at most 5 s, or twice the silence where that is over 2.5 s. Tasks hand on one row an Arrow batch, and the state
    is four numbers.
    """
    most_ms = most_ms if most_ms is not None else (2 * silence_ms if silence_ms > 2500 else 5000)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"k": [0], "n": [len(pdf)], "first_ns": [pdf["time_ns"].min()]})

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        n, first, since, last = state.get if state.exists else (0, 1 << 62, now, now)
        if not state.hasTimedOut:
            for pdf in rows:
                n, first, last = n + int(pdf["n"].sum()), min(first, int(pdf["first_ns"].min())), now
        due = min(last + silence_ms, since + most_ms)
        if now >= due and n:
            yield pd.DataFrame({"n": [n], "first_ns": [first], "waited_ms": [now - since]})
            state.remove()
        else:
            state.update((n, first, since, last))
            state.setTimeoutDuration(max(1, due - now))

    counts = stream.select("time_ns").mapInPandas(counted, "k int, n long, first_ns long")
    return counts.groupBy("k").applyInPandasWithState(step, "n long, first_ns long, waited_ms long", "n long, first_ns long, since long, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def debounced(stream: DataFrame, read: Callable[[], DataFrame], projection: Projection, checkpoint: str, silence_ms: int, most_ms: int | None = None, names: tuple[str, ...] = ("*",), tick: str = "200 milliseconds"):
    """A job over ``read()`` (the log) from the first waiting event on, whenever a burst of events has ended or has lasted too long."""

    def batch(due: DataFrame, number: int) -> None:
        first = due.agg(F.min("first_ns")).first()[0]
        if first is not None:
            held = projection.progress
            rows = named(read(), names).where(F.col("time_ns") >= min(first, held.time_ns))
            projection.run(Job(rows, held, live=True), number)

    return quiet(named(stream, names), silence_ms, most_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=tick).foreachBatch(batch).start()


def triggered(log: DataFrame, projection: Projection, query: EventQuery | None = None, reset: bool = False, entities: EntityQuery | None = None, filters: tuple[EventQuery, ...] = ()) -> int:
    """One run over the whole log, from the projection's progress or, with ``reset``, from the start."""
    return projection.run(Job(log, projection.progress, (*((query,) if query else ()), *filters), reset=reset, entities=entities))


def overview(stream: DataFrame, overlap: str = "1 minute") -> DataFrame:
    """Running counts by name of a stream in which late events are read again: an id counts once within the overlap."""
    timed = stream.withColumn("_ts", F.col("ts").cast("timestamp")).withWatermark("_ts", overlap)
    return timed.dropDuplicatesWithinWatermark(["id"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def run_overview(stream: DataFrame, out: str, checkpoint: str, overlap: str = "1 minute") -> None:
    """Run ``overview`` over what is there; every update is appended to ``out`` (name, n, batch), a repeated batch again."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    overview(stream, overlap).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def await_first(stream: DataFrame, names: tuple[str, ...], checkpoint: str, seconds: float = 30.0):
    """The first event of these names that the stream brings, by micro-batch, then time and id; None when it takes too long."""
    found: list = []

    def batch(rows: DataFrame, number: int) -> None:
        if not found:
            found.extend(rows.orderBy("time_ns", "id").limit(1).collect())

    running = named(stream, names).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(processingTime="200 milliseconds").start()
    try:
        waited = 0.0
        while not found and waited < seconds and not running.awaitTermination(0.2):
            waited += 0.2
        return found[0] if found else None
    finally:
        running.stop()


def handlers(table: dict[str, list[Callable[[DataFrame], None]]], broken: Callable[[DataFrame, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function that gives each handler the events of its name.

    A handler that fails stops the stream; with ``broken`` the events go there with the error instead, and the others go on.
    """

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for name, functions in table.items():
                rows = held if name == "*" else held.where(F.col("name") == name)
                for f in functions:
                    try:
                        f(rows)
                    except Exception as e:
                        if broken is None:
                            raise
                        broken(rows, f"{type(e).__name__}: {e}")
        finally:
            held.unpersist()

    return run


def handled(stream: DataFrame, table: dict[str, list[Callable[[DataFrame], None]]], checkpoint: str, replay: Callable[[], DataFrame] | None = None, broken: Callable[[DataFrame, str], None] | None = None, every: str | None = None):
    """Handlers on a stream; ``replay`` gives past events that they get first, by time."""
    run = handlers(table, broken)
    if replay is not None:
        past = replay()
        run((past if "*" in table else past.where(F.col("name").isin(*table))).orderBy("time_ns", "id"), -1)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def quarantined(rows: DataFrame, step: Callable[[dict], dict], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows mapped one by one: (those that ``step`` could map, those that it could not, with the error)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, row in enumerate(pdf.to_dict("records")):
                try:
                    out.append({**{n: None for n in names}, **step(row), "_error": None, "_row": None})
                except Exception as e:  # what a row's failure says is kept beside it
                    out.append({**{n: None for n in names}, "_error": f"{type(e).__name__}: {e}", "_row": pdf.iloc[i].to_json()})
            yield pd.DataFrame(out, columns=[*names, "_error", "_row"])

    both = rows.mapInPandas(run, f"{schema}, _error string, _row string")
    return both.where("_error is null").drop("_error", "_row"), both.where("_error is not null").select(F.col("_row").alias("row"), F.col("_error").alias("error"))
