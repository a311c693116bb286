"""Read-only analytics over a log: summary, facets, catalogue and pages with keyset cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PAGE, MOST = 50, 200


def page_size(n: int | None) -> int:
    return min(MOST, n) if n and n > 0 else DEFAULT_PAGE


def summary(events: DataFrame) -> DataFrame:
    """Counts of events, names and entity names (empty ones do not count), and the newest time."""
    some = F.when(F.col("aggregate_name") != "", F.col("aggregate_name"))
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct(F.when(F.col("name") != "", F.col("name"))).alias("names"), F.count_distinct(some).alias("aggregate_names"), F.max("time_ns").alias("newest_ns"))


def facets(events: DataFrame, column: str, most: int = MOST) -> DataFrame:
    """Values of a column with their counts, most frequent first, then by value."""
    return events.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def catalog(events: DataFrame) -> DataFrame:
    """Entities with the time of their first version."""
    return events.where("aggregate_version = 1 and aggregate_id is not null").groupBy("aggregate_name", "aggregate_id").agg(F.min("time_ns").alias("created_ns"))


def catalog_page(events: DataFrame, size: int | None = None, before: tuple | None = None, name: str | None = None) -> DataFrame:
    """Newest entities first, below a cursor of time, id and (where several names are shown) name; one row beyond the page tells that more follow."""
    rows = catalog(events)
    if name:
        rows = rows.where(F.col("aggregate_name") == name)
    if before:
        created, id, of = (*before, "")[:3]
        rows = rows.where(F.struct("created_ns", "aggregate_id", "aggregate_name") < F.struct(F.lit(created).cast("bigint"), F.lit(id), F.lit(of)))
    return rows.orderBy(F.desc("created_ns"), F.desc("aggregate_id"), F.desc("aggregate_name")).limit(page_size(size) + 1)


def event_page(events: DataFrame, size: int | None = None, before: tuple[int, str] | None = None) -> DataFrame:
    """Newest events first, without payload, below a cursor of time and id, plus one row."""
    if before and "ts" in events.columns:  # the bound in microseconds reaches the scan
        events = events.where(F.col("ts").isNull() | (F.col("ts") <= F.timestamp_micros(F.lit(-(-before[0] // 1000))).cast("timestamp_ntz")))
    rows = events.select("id", "name", "time_ns", "aggregate_name", "aggregate_id", "aggregate_version")
    if before:
        rows = rows.where((F.col("time_ns") < before[0]) | ((F.col("time_ns") == before[0]) & (F.col("id") < before[1])))
    return rows.orderBy(F.desc("time_ns"), F.desc("id")).limit(page_size(size) + 1)


def entity_page(events: DataFrame, name: str, id: str, after: int = 0, size: int | None = None) -> DataFrame:
    """An entity's events by version, above ``after``, plus one row."""
    rows = events.where((F.col("aggregate_name") == name) & (F.col("aggregate_id") == id) & (F.col("aggregate_version") > after))
    return rows.orderBy("aggregate_version", "id").limit(page_size(size) + 1)
