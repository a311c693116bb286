"""Entities as folded logs: saving with checks, hooks and snapshots, fetching from snapshots, typed and cached forms."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.query import EntityQuery, EventQuery, unique
from ..sources.log import Conflict, EventLog, NotFound
from .entities import ENTITY, after_snapshots, deleted, entities, latest_snapshots, snapshot_due, violations


class Inconsistent(Exception):
    pass


class Deleted(Exception):
    pass


@dataclass
class Model:
    """How an entity folds: a state to begin with, reducers by event name, and how states are kept in snapshots."""

    schema: str
    zero: Callable[[], dict]
    reducers: dict[str, Callable[[dict, dict], None]]
    marshal: Callable[[dict], str] = json.dumps
    unmarshal: Callable[[str], dict] = json.loads


def fold_from(events: DataFrame, snapshots: DataFrame, model: Model) -> DataFrame:
    """(aggregate_name, aggregate_id, version, state columns, state): the fold of events onto the entity's snapshot, or onto zero.

    Events that a snapshot holds already must have been left out; entities with a snapshot only keep its state. One task
    takes an entity's events above its snapshot, so snapshots bound what it holds.
    """

    def run(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        state, version = (model.unmarshal(held["state"].iat[0]), int(held["aggregate_version"].iat[0])) if len(held) else (model.zero(), 0)
        for row in rows.sort_values(["aggregate_version", "time_ns", "id"], kind="stable").to_dict("records"):
            if row["name"] in model.reducers:
                model.reducers[row["name"]](state, row)
            version = max(version, int(row["aggregate_version"]))
        return pd.DataFrame([{"aggregate_name": key[0], "aggregate_id": key[1], "version": version, **state, "_state": model.marshal(state)}])

    left, right = events.where("aggregate_id is not null").groupBy(*ENTITY), snapshots.groupBy(*ENTITY)
    return left.cogroup(right).applyInPandas(run, f"aggregate_name string, aggregate_id string, version int, {model.schema}, _state string")


@dataclass
class Hooks:
    before: list[Callable[[DataFrame], None]] = field(default_factory=list)
    after: list[Callable[[DataFrame], None]] = field(default_factory=list)
    failed: list[Callable[[DataFrame, Exception], None]] = field(default_factory=list)
    deleted: list[Callable[[str, str], None]] = field(default_factory=list)
    queries: list[Callable[[EventQuery], EventQuery]] = field(default_factory=list)


@dataclass
class Repository:
    """Entities of a log. ``snapshots`` is a folder of Parquet snapshots; one is written when versions pass a multiple of ``every``."""

    log: EventLog
    model: Model
    snapshots: str | None = None
    every: int = 100
    hooks: Hooks = field(default_factory=Hooks)

    def held_snapshots(self) -> DataFrame:
        schema = "aggregate_name string, aggregate_id string, aggregate_version int, time_ns bigint, state string"
        spark = self.log.spark
        if self.snapshots is None or not self.log._fs.exists(self.log._at(self.snapshots)):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.snapshots)

    def save(self, changes: DataFrame) -> None:
        """Append changes of entities; Inconsistent or Conflict where they do not follow what is held, and then nothing is."""
        try:
            bad = violations(changes).limit(5).collect()
            if bad:
                raise Inconsistent(", ".join(f"{r.kind} of {r.aggregate_name}({r.aggregate_id}) at {r['index']}" for r in bad))
            for hook in self.hooks.before:
                hook(changes)
            self.log.insert(changes)
        except Exception as e:
            for hook in self.hooks.failed:
                hook(changes, e)
            raise
        for hook in self.hooks.after:
            hook(changes)
        if self.snapshots is not None:
            self._snapshot(changes)

    def _snapshot(self, changes: DataFrame) -> None:
        span = changes.groupBy(*ENTITY).agg((F.min("aggregate_version") - 1).alias("old"), F.max("aggregate_version").alias("new"), F.max("time_ns").alias("time_ns"))
        due = span.where(snapshot_due(F.col("old"), F.col("new"), self.every))
        if due.isEmpty():
            return
        states = self._folded(self.log.read().join(due.select(*ENTITY), ENTITY, "left_semi"), self.held_snapshots().join(due.select(*ENTITY), ENTITY, "left_semi"))
        rows = states.join(due.select(*ENTITY, "time_ns"), ENTITY).select(*ENTITY, F.col("version").alias("aggregate_version"), "time_ns", F.col("_state").alias("state"))
        rows.write.mode("append").parquet(self.snapshots)

    def _folded(self, events: DataFrame, snapshots: DataFrame) -> DataFrame:
        return fold_from(after_snapshots(events, snapshots), latest_snapshots(snapshots), self.model)

    def fetch(self, name: str, id: str, version: int | None = None) -> dict:
        """The state of an entity, at a version if given, from its latest snapshot below; Deleted if its last marker there is a deletion."""
        of = lambda df: df.where((F.col("aggregate_name") == name) & (F.col("aggregate_id") == id))
        events, snaps = of(self.log.read()), of(self.held_snapshots())
        if version is not None:
            events, snaps = events.where(F.col("aggregate_version") <= version), snaps.where(F.col("aggregate_version") <= version)
        rest = after_snapshots(events, snaps)
        if not deleted(rest).isEmpty():
            raise Deleted(f"{name}({id})")
        row = fold_from(rest, latest_snapshots(snaps), self.model).first()
        if row is None or (version is not None and row.version != version):
            raise NotFound(f"{name}({id})" + ("" if version is None else f" at {version}"))
        return {k: v for k, v in row.asDict().items() if k != "_state"}

    def query(self, query: EntityQuery, with_deleted: bool = False) -> DataFrame:
        """States of all consistent entities of a query that are not deleted."""
        events = self.log.read()
        asked = query.events()
        for change in self.hooks.queries:
            asked = change(asked)
        rows = entities(events.where(asked.predicate()), query, with_deleted=with_deleted)
        return fold_from(rows, self.held_snapshots().limit(0), self.model).drop("_state")

    def use(self, make: Callable[[DataFrame], DataFrame], tries: int = 3) -> None:
        """Build changes from the current log and save them, again after a conflict."""
        for n in range(tries):
            try:
                return self.save(make(self.log.read()))
            except Conflict:
                if n + 1 == tries:
                    raise

    def delete(self, name: str, id: str) -> None:
        self.log.delete_entity(name, id)
        for hook in self.hooks.deleted:
            hook(name, id)

    def typed(self, name: str) -> Typed:
        return Typed(self, name)


@dataclass
class Typed:
    """A repository of one kind of entity."""

    of: Repository
    name: str

    def fetch(self, id: str, version: int | None = None) -> dict:
        return self.of.fetch(self.name, id, version)

    def query(self, query: EntityQuery = EntityQuery()) -> DataFrame:
        return self.of.query(replace(query, names=unique((*query.names, self.name)))).where(F.col("aggregate_name") == self.name)

    def delete(self, id: str) -> None:
        self.of.delete(self.name, id)


class Cached:
    """A typed repository that keeps fetched states until they are cleared, at most ``most`` of them."""

    def __init__(self, of: Typed, most: int = 1000):
        self.of, self.most, self.held = of, most, {}

    def fetch(self, id: str) -> dict:
        if id not in self.held:
            while len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
            self.held[id] = self.of.fetch(id)
        return self.held[id]

    def clear(self, *ids: str) -> None:
        for id in ids or tuple(self.held):
            self.held.pop(id, None)


def delete_commands(log: EventLog, commands: DataFrame, event: str = "deleted") -> None:
    """Carry out commands (command_id, aggregate_name, aggregate_id, time_ns): an entity's events go, an event without entity tells of it."""
    gone = commands.groupBy(*ENTITY).agg(F.min("command_id").alias("command_id"), F.min("time_ns").alias("time_ns"))
    log.delete(log.read().join(gone, ENTITY, "left_semi"))
    told = gone.select(
        F.col("command_id").cast("string").alias("id"), F.lit(event).alias("name"), "time_ns", F.timestamp_micros(F.floor(F.col("time_ns") / 1000).cast("long")).cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast("string").alias("aggregate_name"), F.lit(None).cast("string").alias("aggregate_id"), F.lit(None).cast("int").alias("aggregate_version"), F.to_json(F.struct(*ENTITY)).alias("data"),
    )
    log.insert(told)


def failures(rows: DataFrame) -> DataFrame:
    """Rows whose ``error`` (JSON of code, message, details and messages by language) is read into a struct; other texts are its message."""
    read = F.from_json("error", "code int, message string, details array<string>, localized map<string,string>")
    plain = F.struct(F.lit(0).alias("code"), F.col("error").alias("message"), F.array().cast("array<string>").alias("details"), F.create_map().cast("map<string,string>").alias("localized"))
    return rows.withColumn("failure", F.when(F.col("error").isNotNull(), F.coalesce(F.when(read["message"].isNotNull(), read), plain)))
