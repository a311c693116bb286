"""Scalar expressions over event columns."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, text: Column) -> Column:
    """Name-based UUID (SHA-1) of a text, as an expression."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), text.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def new_uuid7() -> str:
    """A time-ordered UUID for new events, made on the driver."""
    n = (time.time_ns() // 1_000_000) << 80 | uuid.uuid4().int & ((1 << 80) - 1)
    return str(uuid.UUID(int=n & ~(0xF << 76) & ~(3 << 62) | 7 << 76 | 2 << 62))


def nanoseconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def timestamp(time_ns: Column) -> Column:
    return F.timestamp_micros(F.floor(time_ns / 1000)).cast("timestamp_ntz")


def reference(name: Column, id: Column) -> Column:
    return F.concat(name, F.lit("("), F.coalesce(id, F.lit("")), F.lit(")"))


def parse_reference(text: Column) -> Column:
    """struct(name, id) of ``name(id)``, null where the text is not of that form."""
    form = r"^([^()]+)\(([^()]+)\)$"
    return F.when(text.rlike(form), F.struct(F.regexp_extract(text, form, 1).alias("name"), F.regexp_extract(text, form, 2).alias("id")))


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def missing(wanted: Column, granted: Column) -> Column:
    return F.array_except(wanted, granted)


def granted(wanted: Column, have: Column) -> Column:
    return F.array_intersect(wanted, have)
