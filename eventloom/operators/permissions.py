"""Permission read models: clamped counts of grants, roles, wildcard checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["subject", "ref_name", "ref_id", "action"]
ANY = "*"


def counted(changes: DataFrame) -> DataFrame:
    """Grants of (subject, ref_name, ref_id, action, delta, position) that are left, where a count never falls below 0.

    With running sums S, a count that is clamped at 0 after every step ends at S_n - min(0, min S).
    """
    rows = changes.withColumn("ref_id", F.coalesce("ref_id", F.lit("")))
    steps = Window.partitionBy(*KEY).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("s", F.sum("delta").over(steps))
    out = sums.groupBy(*KEY).agg((F.sum("delta") - F.least(F.lit(0), F.min("s"))).alias("n"))
    return out.where("n > 0")


_GRANT = "aggregate struct<name:string,id:string>, actions array<string>"


def grant_changes(events: DataFrame, granted: str = "permission.granted", revoked: str = "permission.revoked") -> DataFrame:
    """Changes that permission events of actors and roles (their entity is the subject) bring, one an action."""
    rows = events.where(F.col("name").isin(granted, revoked)).withColumn("_p", F.from_json("data", _GRANT))
    return rows.select(F.col("aggregate_id").alias("subject"), F.col("_p.aggregate.name").alias("ref_name"), F.col("_p.aggregate.id").alias("ref_id"), F.explode("_p.actions").alias("action"), F.when(F.col("name") == granted, 1).otherwise(-1).alias("delta"), F.col("aggregate_version").alias("position"))


def member_changes(events: DataFrame, given: str = "role.given", removed: str = "role.removed") -> DataFrame:
    """(role, member, op, position) of events whose data lists actors."""
    rows = events.where(F.col("name").isin(given, removed))
    return rows.select(F.col("aggregate_id").alias("role"), F.explode(F.from_json("data", "array<string>")).alias("member"), F.when(F.col("name") == given, "give").otherwise("remove").alias("op"), F.col("aggregate_version").alias("position"))


def granted_by(events: DataFrame, rules: dict[str, list[tuple[Column, Column, str]]], granted: str = "permission.granted") -> DataFrame:
    """Changes that a granter makes of events by their name: for each rule (subject, id of the entity, action) one on the event's own kind of entity."""
    out = None
    for name, given in rules.items():
        for subject, id, action in given:
            rows = events.where(F.col("name") == name).select(subject.alias("subject"), F.col("aggregate_name").alias("ref_name"), id.alias("ref_id"), F.lit(action).alias("action"), F.lit(1).alias("delta"), F.col("time_ns").alias("position"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("a granter needs rules")
    return out.where("subject is not null")


def members(changes: DataFrame) -> DataFrame:
    """(role, member) of (role, member, op, position): the last of give and remove counts."""
    return changes.groupBy("role", "member").agg(F.max_by("op", "position").alias("op")).where("op = 'give'").select("role", "member")


def with_roles(direct: DataFrame, role_grants: DataFrame, member: DataFrame) -> DataFrame:
    """Grants of actors: their own and one for each role that holds the action."""
    by_role = member.join(role_grants.withColumnRenamed("subject", "role"), "role").groupBy(F.col("member").alias("subject"), *KEY[1:]).agg(F.count(F.lit(1)).alias("n"))
    return direct.unionByName(by_role).groupBy(*KEY).agg(F.sum("n").alias("n"))


def allowed(probes: DataFrame, grants: DataFrame) -> DataFrame:
    """Probes (subject, ref_name, ref_id, action) that a grant covers: exactly, or with a wildcard name, id or action.

    Each probe turns into the eight grants that would allow it, so the check is an equi join.
    """
    name, id, action = F.col("ref_name"), F.coalesce("ref_id", F.lit("")), F.col("action")
    pairs = [(name, id), (F.lit(ANY), F.lit("")), (F.lit(ANY), id), (name, F.lit(""))]
    options = F.array(*[F.struct(n.alias("ref_name"), i.alias("ref_id"), a.alias("action")) for n, i in pairs for a in (action, F.lit(ANY))])
    keyed = probes.withColumn("_k", F.explode(F.array_distinct(options)))
    grant = grants.select(F.col("subject").alias("_s"), *[F.col(c).alias(f"_{c}") for c in KEY[1:]])
    hit = keyed.join(grant, (F.col("subject") == F.col("_s")) & (F.col("_k.ref_name") == F.col("_ref_name")) & (F.col("_k.ref_id") == F.col("_ref_id")) & (F.col("_k.action") == F.col("_action")), "left_semi")
    return hit.select(*probes.columns).distinct()
