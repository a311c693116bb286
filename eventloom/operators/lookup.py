"""Key-value lookups that events provide, forward and in reverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def operations(events: DataFrame, providers: dict[str, Column]) -> DataFrame:
    """Operations that events provide: by event name an array of struct(op, key, value), op being provide or remove."""
    given = F.lit(None).cast("array<struct<op:string,key:string,value:string>>")
    for name, array in providers.items():
        given = F.when(F.col("name") == name, array.cast("array<struct<op:string,key:string,value:string>>")).otherwise(given)
    rows = events.where(F.col("name").isin(*providers)).select("aggregate_name", "aggregate_id", "time_ns", "id", F.explode(given).alias("o"))
    return rows.select("aggregate_name", "aggregate_id", "o.key", "o.value", "o.op", "time_ns", "id")


def index(operations: DataFrame) -> DataFrame:
    """Live entries of (aggregate_name, aggregate_id, key, value, op, time_ns, id): the last operation of each key, unless it removes it."""
    order = F.struct("time_ns", "id")
    last = operations.groupBy("aggregate_name", "aggregate_id", "key").agg(F.max_by("op", order).alias("op"), F.max_by("value", order).alias("value"), F.max(order).alias("at"))
    return last.where("op = 'provide'").drop("op")


def forward(probes: DataFrame, live: DataFrame) -> DataFrame:
    """Probes (aggregate_name, aggregate_id, key) with the value, null where there is none."""
    return probes.join(live.select("aggregate_name", "aggregate_id", "key", "value"), ["aggregate_name", "aggregate_id", "key"], "left")


def reverse(probes: DataFrame, live: DataFrame) -> DataFrame:
    """Probes (aggregate_name, key, value) with the entity that provided it last."""
    owner = live.groupBy("aggregate_name", "key", "value").agg(F.max_by("aggregate_id", "at").alias("aggregate_id"))
    return probes.join(owner, ["aggregate_name", "key", "value"], "left")


def contains(probes: DataFrame, live: DataFrame) -> DataFrame:
    return forward(probes, live).withColumn("contained", F.col("value").isNotNull())


def expected(probes: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(probes with their values, probes that should have one and have none)."""
    found = forward(probes, live)
    return found.where("value is not null"), found.where("value is null").drop("value")


def mapped(rows: DataFrame, key: str, live: DataFrame, of: str) -> DataFrame:
    """Rows with column ``of``: the id of the entity that provided the row's value under a key last; null where none did."""
    owner = live.where(F.col("key") == key).groupBy("aggregate_name", "value").agg(F.max_by("aggregate_id", "at").alias(of))
    return rows.join(owner, ["aggregate_name", "value"], "left")
