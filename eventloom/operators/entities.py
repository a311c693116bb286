"""Ordered folds of entities, consistency, soft deletion, snapshots."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query import EntityQuery

ENTITY = ["aggregate_name", "aggregate_id"]


def fold(events: DataFrame, **states: Column) -> DataFrame:
    """Fold by aggregates that Spark combines before the shuffle, such as sum, max_by(x, aggregate_version): one row an entity."""
    return events.where("aggregate_id is not null").groupBy(*ENTITY).agg(F.max("aggregate_version").alias("version"), F.count(F.lit(1)).alias("n_events"), *[c.alias(n) for n, c in states.items()])


def fold_expression(events: DataFrame, zero: Column, step: Callable[[Column, Column], Column], columns: tuple[str, ...] = ("name", "data")) -> DataFrame:
    """Fold by an expression over the state and the next event, in version order.

    ``columns`` are what the expression reads besides version, time and id. One task holds those of one entity: for
    entities too long for that, fold by aggregates, or from snapshots.
    """
    item = F.struct("aggregate_version", "time_ns", "id", *columns)
    held = events.where("aggregate_id is not null").groupBy(*ENTITY).agg(F.sort_array(F.collect_list(item)).alias("e"))
    return held.select(*ENTITY, F.element_at("e", -1)["aggregate_version"].alias("version"), F.aggregate("e", zero, step).alias("state"))


def fold_python(events: DataFrame, schema: str, reducers: dict[str, Callable], zero: Callable[[], dict]) -> DataFrame:
    """Fold by Python reducers per event name (``reducer(state, row)``); events without one are passed over."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = zero()
        pdf = pdf.sort_values(["aggregate_version", "time_ns", "id"], kind="stable")
        for row in pdf.to_dict("records"):
            if row["name"] in reducers:
                reducers[row["name"]](state, row)
        return pd.DataFrame([{"aggregate_name": key[0], "aggregate_id": key[1], "version": pdf["aggregate_version"].iat[-1], **state}])

    return events.where("aggregate_id is not null").groupBy(*ENTITY).applyInPandas(run, f"aggregate_name string, aggregate_id string, version int, {schema}")


def at_version(events: DataFrame, version: int) -> DataFrame:
    """The prefix of each entity's events up to a version; below 0 counts as 0."""
    return events.where(F.col("aggregate_version") <= max(0, version))


def reached(states: DataFrame, version: int) -> DataFrame:
    """States whose entity has exactly the version."""
    return states.where(F.col("version") == max(0, version))


def without(events: DataFrame, gone: DataFrame) -> DataFrame:
    """Events of entities that are not in ``gone``; null names and ids are equal to each other."""
    other = gone.select(*[F.col(c).alias(f"_{c}") for c in ENTITY])
    same = [events[c].eqNullSafe(other[f"_{c}"]) for c in ENTITY]
    return events.join(other, same[0] & same[1], "left_anti")


def split_consistent(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of consistent entities, all others with the kind and place of their entity's first violation)."""
    bad = violations(events)
    other = bad.select(*[F.col(c).alias(f"_{c}") for c in ENTITY], "kind", "index")
    same = events["aggregate_name"].eqNullSafe(other["_aggregate_name"]) & events["aggregate_id"].eqNullSafe(other["_aggregate_id"])
    return without(events, bad), events.join(other, same).drop("_aggregate_name", "_aggregate_id")


def entities(events: DataFrame, query: EntityQuery, strict: bool = False, with_deleted: bool = False, consistent: bool = True) -> DataFrame:
    """Events of the entities of a query, of consistent ones, without those softly deleted.

    An exact version v means entities up to v; with ``strict`` only such whose prefix meets the query.
    """
    read = events.where(query.events().predicate())
    if consistent:
        read = without(read, violations(read))
    if not with_deleted:
        read = read.join(deleted(read), ENTITY, "left_anti")
    if strict:
        read = read.join(query.accepts(read.groupBy(*ENTITY).agg(F.max("aggregate_version").alias("version"))), ENTITY, "left_semi")
    return read


def numbered(events: DataFrame) -> DataFrame:
    """Events with aggregate_version counted from 1 by time and id."""
    order = Window.partitionBy(*ENTITY).orderBy("time_ns", "id")
    return events.withColumn("aggregate_version", F.row_number().over(order))


def previous_version(events: DataFrame) -> DataFrame:
    """Events with aggregate_version one above that of the event before them in time, where that one has an entity."""
    before = Window.partitionBy(*ENTITY).orderBy("time_ns", "id")
    return events.withColumn("aggregate_version", F.when(F.col("aggregate_id").isNotNull(), F.coalesce(F.lag("aggregate_version").over(before), F.lit(0)) + 1).otherwise(F.col("aggregate_version")))


def generated(spark, entities: int, events: int, skip: int = 0, name: str = "entity", names: tuple[str, ...] = ("foo", "bar", "baz")) -> DataFrame:
    """``events`` events of each of ``entities`` entities; every ``skip``-th version is left free."""
    i, n = F.col("id") % events, F.floor(F.col("id") / events)
    version = i + 1 + (F.floor(i / (skip - 1)) if skip > 1 else 0)
    time = F.lit(1_700_000_000_000_000_000) + F.col("id") * 1000
    return spark.range(entities * events).select(
        F.format_string("%012d", "id").alias("id"), F.array(*map(F.lit, names))[(F.col("id") % len(names)).cast("int")].alias("name"), time.alias("time_ns"), F.timestamp_micros(F.floor(time / 1000).cast("long")).cast("timestamp_ntz").alias("ts"),
        F.lit(name).alias("aggregate_name"), n.cast("string").alias("aggregate_id"), version.cast("int").alias("aggregate_version"), F.to_json(F.struct(i.alias("A"))).alias("data"),
    )


def shuffled(events: DataFrame, seed: int) -> DataFrame:
    """Events in an order that the seed alone decides, however they are dealt."""
    return events.orderBy(F.xxhash64("id", F.lit(seed)), "id")


def next_versions(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes numbered after their entity's current version."""
    top = current.groupBy(*ENTITY).agg(F.max("aggregate_version").alias("_top"))
    return numbered(changes).join(top, ENTITY, "left").withColumn("aggregate_version", F.col("aggregate_version") + F.coalesce("_top", F.lit(0))).drop("_top")


def monotone_times(events: DataFrame) -> DataFrame:
    """Times raised so that each event of an entity is at least 1 ns after the one before."""
    ordered = Window.partitionBy(*ENTITY).orderBy("aggregate_version", "time_ns", "id")
    n = F.row_number().over(ordered)
    w = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_n", n).withColumn("time_ns", F.max(F.col("time_ns") - F.col("_n")).over(w) + F.col("_n")).drop("_n")


def violations(events: DataFrame, current: int = 0, ignore_time: bool = False, order: list[str] | None = None) -> DataFrame:
    """The first inconsistent event of each entity: kind and its position.

    Kinds in order of checking: id, name, version (not positive, not above the current one or the previous
    one; gaps are allowed) and time (not after the previous one). Each event is compared with the one before
    it, by ``order`` (default version, time, id).
    """
    w = Window.partitionBy(*ENTITY).orderBy(*(order or ["aggregate_version", "time_ns", "id"]))
    rows = events.withColumn("_i", F.row_number().over(w) - 1).withColumn("_v", F.lag("aggregate_version").over(w)).withColumn("_t", F.lag("time_ns").over(w))
    kind = F.when(F.col("aggregate_id").isNull(), "id").when(F.coalesce("aggregate_name", F.lit("")) == "", "name")
    kind = kind.when((F.coalesce("aggregate_version", F.lit(0)) <= 0) | (F.col("aggregate_version") <= current) | (F.col("aggregate_version") <= F.col("_v")), "version")
    if not ignore_time:
        kind = kind.when(F.col("time_ns") <= F.col("_t"), "time")
    bad = rows.withColumn("kind", kind).where("kind is not null")
    return bad.groupBy(*ENTITY).agg(F.min_by("kind", "_i").alias("kind"), F.min("_i").alias("index"), F.min_by("id", "_i").alias("id"))


def deleted(events: DataFrame, delete: str = "deleted", restore: str = "restored") -> DataFrame:
    """Entities whose last deletion or restoration is a deletion."""
    last = F.max_by("name", F.struct("aggregate_version", "time_ns", "id"))
    return events.where(F.col("name").isin(delete, restore)).groupBy(*ENTITY).agg(last.alias("_m")).where(F.col("_m") == delete).select(*ENTITY)


def live(events: DataFrame, delete: str = "deleted", restore: str = "restored") -> DataFrame:
    return events.join(deleted(events, delete, restore), ENTITY, "left_anti")


# -- snapshots: (aggregate_name, aggregate_id, aggregate_version, time_ns, state)


def snapshot_due(old: Column, new: Column, every: int) -> Column:
    """Whether (old, new] holds a multiple of ``every``."""
    return F.floor(new / every) > F.floor(old / every)


def latest_snapshots(snapshots: DataFrame, version: int | None = None) -> DataFrame:
    """The newest snapshot of each entity, not above ``version`` if given."""
    rows = snapshots if version is None else snapshots.where(F.col("aggregate_version") <= version)
    others = [c for c in snapshots.columns if c not in ENTITY]
    return rows.groupBy(*ENTITY).agg(F.max_by(F.struct(*others), "aggregate_version").alias("s")).select(*ENTITY, "s.*")


def exact_snapshot(snapshots: DataFrame, version: int) -> DataFrame:
    return snapshots.where(F.col("aggregate_version") == version)


def save_snapshots(held: DataFrame, saved: DataFrame) -> DataFrame:
    key = [*ENTITY, "aggregate_version"]
    return held.join(saved.select(*key), key, "left_anti").unionByName(saved)


def fresh_snapshots(held: DataFrame, oldest_ns: int) -> DataFrame:
    return held.where(F.col("time_ns") >= oldest_ns)


def after_snapshots(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events above their entity's latest snapshot, and all of those without one."""
    top = latest_snapshots(snapshots).select(*ENTITY, F.col("aggregate_version").alias("_top"))
    return events.join(top, ENTITY, "left").where("_top is null or aggregate_version > _top").drop("_top")


def first_ids(events: DataFrame, *names: str) -> DataFrame:
    """Distinct entities in the order in which they were first seen: (aggregate_name, aggregate_id, first)."""
    rows = events.where(F.col("aggregate_name").isin(*names)) if names else events
    return rows.where("aggregate_id is not null").groupBy(*ENTITY).agg(F.min(F.struct("time_ns", "id")).alias("first")).orderBy("first")


def same_events(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def union(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out
