"""Declarative event queries, compiled to DataFrame predicates.

Values inside one field are alternatives, fields restrict each other, an empty field restricts nothing.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(values) -> tuple:
    """Values once each, in their order."""
    return tuple(dict.fromkeys(values))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class Bounds:
    """Constraints on a number. Of several minima the smallest counts, of several maxima the largest."""

    exact: tuple[int, ...] = ()
    ranges: tuple[tuple[int, int], ...] = ()
    mins: tuple[int, ...] = ()
    maxs: tuple[int, ...] = ()

    def compile(self, column: Column) -> list[Column]:
        out = []
        if self.exact:
            out.append(column.isin(*self.exact))
        if self.ranges:
            out.append(any_of([column.between(a, b) for a, b in self.ranges]))
        if self.mins:
            out.append(column >= min(self.mins))
        if self.maxs:
            out.append(column <= max(self.maxs))
        return out

    def includes(self, *values: int) -> bool:
        """Whether each kind of constraint is met by at least one of the values."""
        return (
            (not self.exact or any(v in self.exact for v in values))
            and (not self.ranges or any(a <= v <= b for v in values for a, b in self.ranges))
            and (not self.mins or any(v >= min(self.mins) for v in values))
            and (not self.maxs or any(v <= max(self.maxs) for v in values))
        )

    def merged(self, other: Bounds, last_wins: bool = False) -> Bounds:
        pick = lambda a, b: (b or a) if last_wins else unique((*a, *b))
        return Bounds(unique((*self.exact, *other.exact)), unique((*self.ranges, *other.ranges)), pick(self.mins, other.mins), pick(self.maxs, other.maxs))


@dataclass(frozen=True)
class Ref:
    """An entity's name and id; without id, every entity of the name."""

    name: str
    id: str | None = None

    def __str__(self) -> str:
        return f"{self.name}({self.id or ''})"

    @staticmethod
    def parse(text: str) -> Ref:
        name, opened, rest = text.partition("(")
        if not name or not opened or not rest.endswith(")") or "(" in rest or ")" in rest[:-1] or not rest[:-1]:
            raise ValueError(f"not a reference: {text!r}")
        return Ref(name, rest[:-1])


@dataclass(frozen=True)
class EventQuery:
    names: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    aggregate_names: tuple[str, ...] = ()
    aggregate_ids: tuple[str, ...] = ()
    refs: tuple[Ref, ...] = ()
    version: Bounds = field(default_factory=Bounds)
    time: Bounds = field(default_factory=Bounds)
    sort: tuple[tuple[str, bool], ...] = ()  # (time | name | id | version, ascending)

    def before(self, time_ns: int) -> EventQuery:
        return replace(self, time=replace(self.time, maxs=(time_ns - 1,)))

    def after(self, time_ns: int) -> EventQuery:
        return replace(self, time=replace(self.time, mins=(time_ns + 1,)))

    def since(self, time_ns: int) -> EventQuery:
        return replace(self, time=replace(self.time, mins=(time_ns,)))

    def until(self, time_ns: int) -> EventQuery:
        return replace(self, time=replace(self.time, maxs=(time_ns,)))

    def predicate(self) -> Column:
        """Null names count as empty and null versions as 0. Bounds of time are also put on the microsecond column, which scans push down."""
        name, version = F.coalesce("aggregate_name", F.lit("")), F.coalesce("aggregate_version", F.lit(0))
        parts: list[Column] = []
        for column, values in ((F.col("name"), self.names), (F.col("id"), self.ids), (F.col("aggregate_name"), self.aggregate_names), (F.col("aggregate_id"), self.aggregate_ids)):
            if values:
                parts.append(column.isin(*values))
        if self.refs:
            parts.append(any_of([(name == r.name) & (F.lit(True) if r.id is None else F.col("aggregate_id").eqNullSafe(r.id)) for r in self.refs]))
        parts += self.version.compile(version) + self.time.compile(F.col("time_ns"))
        return all_of(parts + self._micros())

    def _micros(self) -> list[Column]:
        """The bounds of time on the microsecond column, rounded outwards."""
        at = lambda us: F.timestamp_micros(F.lit(us)).cast("timestamp_ntz")
        down, up, ts = lambda ns: at(ns // 1000), lambda ns: at(-(-ns // 1000)), F.col("ts")
        parts = [ts.between(down(min(self.time.exact)), up(max(self.time.exact)))] if self.time.exact else []
        parts += [any_of([ts.between(down(a), up(b)) for a, b in self.time.ranges])] if self.time.ranges else []
        parts += [ts >= down(min(self.time.mins))] if self.time.mins else []
        return parts + ([ts <= up(max(self.time.maxs))] if self.time.maxs else [])

    def order(self) -> list[Column]:
        """Sort keys, each column once, with the id last so that the order is total."""
        names = {"time": "time_ns", "name": "aggregate_name", "id": "aggregate_id", "version": "aggregate_version"}
        keys = {}
        for key, up in self.sort:
            keys.setdefault(key, F.col(names[key]).asc_nulls_first() if up else F.col(names[key]).desc_nulls_last())
        return [*keys.values(), F.col("id").asc()]

    def apply(self, events: DataFrame) -> DataFrame:
        found = events.where(self.predicate())
        return found.orderBy(*self.order()) if self.sort else found


BY_AGGREGATE = (("name", True), ("id", True), ("version", True))
BY_TIME = (("time", True),)


def merge(*queries: EventQuery) -> EventQuery:
    """The query that accepts the union of every field's values; the last minimum and maximum of time count."""
    out = EventQuery()
    for q in queries:
        lists = {f.name: unique((*getattr(out, f.name), *getattr(q, f.name))) for f in fields(EventQuery) if f.name not in ("version", "time")}
        out = EventQuery(**lists, version=out.version.merged(q.version), time=out.time.merged(q.time, last_wins=True))
    return out


def accept_all(events: DataFrame, *queries: EventQuery) -> DataFrame:
    """Events that every query accepts; without queries all of them."""
    return events.where(all_of([q.predicate() for q in queries]))


@dataclass(frozen=True)
class EntityQuery:
    """Which entities, and up to which version, to fold. ``tags``: any of them."""

    names: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    version: Bounds = field(default_factory=Bounds)
    tags: tuple[str, ...] = ()

    def events(self) -> EventQuery:
        """What to read: exact versions, range ends and maxima all bound from above; minima cannot, as a fold needs its prefix."""
        tops = (*self.version.exact, *(b for _, b in self.version.ranges), *self.version.maxs)
        return EventQuery(aggregate_names=self.names, aggregate_ids=self.ids, version=Bounds(maxs=tops), sort=BY_AGGREGATE)

    def merge(self, *others: EntityQuery) -> EntityQuery:
        """The query that accepts the union of every field's values."""
        out = self
        for q in others:
            out = EntityQuery(unique((*out.names, *q.names)), unique((*out.ids, *q.ids)), out.version.merged(q.version), unique((*out.tags, *q.tags)))
        return out

    def expand(self, *, names: tuple[str, ...] = (), ids: tuple[str, ...] = (), tags: tuple[str, ...] = (), **bounds: tuple) -> EntityQuery:
        """This query with more values in its fields; ``bounds`` are those of the version."""
        return self.merge(EntityQuery(names, ids, Bounds(**bounds), tags))

    def accepts(self, states: DataFrame) -> DataFrame:
        """Folded states (aggregate_name, aggregate_id, version, and tags if asked for) that meet the query exactly."""
        parts = [F.col(c).isin(*v) for c, v in (("aggregate_name", self.names), ("aggregate_id", self.ids)) if v] + self.version.compile(F.col("version"))
        if self.tags:
            parts.append(F.arrays_overlap("tags", F.array(*map(F.lit, self.tags))))
        return states.where(all_of(parts))


@dataclass(frozen=True)
class SnapshotQuery:
    """Snapshots (aggregate_name, aggregate_id, aggregate_version, time_ns, state) of entities, by version and time."""

    entities: EntityQuery = field(default_factory=EntityQuery)
    time: Bounds = field(default_factory=Bounds)

    def apply(self, snapshots: DataFrame) -> DataFrame:
        q = self.entities
        parts = [F.col(c).isin(*v) for c, v in (("aggregate_name", q.names), ("aggregate_id", q.ids)) if v]
        return snapshots.where(all_of(parts + q.version.compile(F.col("aggregate_version")) + self.time.compile(F.col("time_ns"))))


def commands(rows: DataFrame, *filters: Column) -> DataFrame:
    """Commands that every filter accepts; a filter that says nothing (null) rejects."""
    return rows.where(all_of([F.coalesce(f, F.lit(False)) for f in filters]))


def cursor_text(time_ns: int, id: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([time_ns, id]).encode()).decode().rstrip("=")


def parse_cursor(text: str) -> tuple[int, str]:
    time_ns, id = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    return int(time_ns), str(id)
