"""Process state: effects and timeouts that are due, workflow states, command lifecycles, sagas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uuid5

#: Which phase follows which.
TRANSITIONS = {"running": ("completed", "failed", "compensating"), "compensating": ("compensated", "compensation_failed")}


def pending_commands(requested: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Requests whose effect has not been dispatched."""
    return requested.join(dispatched.select("effect_id").distinct(), "effect_id", "left_anti")


def due_timeouts(requested: DataFrame, ended: DataFrame, now) -> DataFrame:
    """The latest timeout of each (workflow_id, key) that is neither canceled nor fired, and whose time has come."""
    w = Window.partitionBy("workflow_id", "key").orderBy(F.desc("position"))
    last = requested.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return last.join(ended.select("workflow_id", "key", "effect_id").distinct(), ["workflow_id", "key", "effect_id"], "left_anti").where(F.col("at") <= F.lit(now))


def correlated(events: DataFrame, by: str | Column = "aggregate_id", namespace=None) -> DataFrame:
    """Events with a workflow_id: a column as it is, or the name-based UUID of a key; events without key match none."""
    key = F.col(by) if isinstance(by, str) else by
    return events.withColumn("workflow_id", uuid5(namespace, key) if namespace else key).where("workflow_id is not null and workflow_id <> ''")


def workflow_states(events: DataFrame) -> DataFrame:
    """One row a workflow of (workflow_id, kind, ref, position): phase, distinct triggers, open commands.

    kind is started, trigger, command, dispatched, or a phase of TRANSITIONS; the first end of a phase counts. Rows
    combine by (workflow, ref) first, so no workflow's references are gathered anywhere.
    """
    kinds = ("started", *TRANSITIONS["running"], *TRANSITIONS["compensating"])
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("position")))
    has = lambda kind: F.max(F.when((F.col("kind") == kind) & F.col("ref").isNotNull(), 1).otherwise(0))
    each = events.groupBy("workflow_id", "ref").agg(*[at(k).alias(k) for k in kinds], has("trigger").alias("_t"), has("command").alias("_c"), has("dispatched").alias("_d"))
    got = each.groupBy("workflow_id").agg(*[F.min(k).alias(k) for k in kinds], F.sum("_t").cast("int").alias("_t"), F.sum(F.when(F.col("_d") == 0, F.col("_c")).otherwise(0)).cast("int").alias("_c"))
    first = F.least(*[F.col(k) for k in TRANSITIONS["running"]])
    end = F.least(*[F.col(k) for k in TRANSITIONS["compensating"]])
    phase = F.when(F.col("started").isNull(), "unknown").when(first.isNull(), "running")
    phase = phase.when(first == F.col("completed"), "completed").when(first == F.col("failed"), "failed")
    phase = phase.when(end.isNull(), "compensating").when(end == F.col("compensated"), "compensated").otherwise("compensation_failed")
    return got.select("workflow_id", phase.alias("phase"), F.col("_t").alias("triggers"), F.col("_c").alias("pending"))


def command_lifecycle(events: DataFrame) -> DataFrame:
    """One row a command of (command_id, kind, time_ns, error): when it first reached each stage, runtime and outcome."""
    stages = ("dispatched", "requested", "assigned", "accepted", "executed")
    first = [F.min(F.when(F.col("kind") == k, F.col("time_ns"))).alias(f"{k}_ns") for k in stages]
    out = events.groupBy("command_id").agg(*first, F.max(F.when(F.col("kind") == "executed", F.col("error"))).alias("error"))
    status = F.when(F.col("executed_ns").isNotNull(), F.when(F.col("error").isNull(), "succeeded").otherwise("failed")).otherwise("open")
    return out.withColumn("runtime_ns", F.col("executed_ns") - F.col("accepted_ns")).withColumn("status", status)


@dataclass
class Saga:
    """Actions in sequence; after a failure the compensators of what succeeded run in reverse. Reports are rows."""

    actions: dict[str, Callable[[], None]]
    compensators: dict[str, str] = field(default_factory=dict)
    sequence: tuple[str, ...] | None = None

    def run(self) -> list[dict]:
        rows: list[dict] = []

        def attempt(name: str, kind: str) -> bool:
            try:
                self.actions[name]()
                rows.append({"action": name, "kind": kind, "status": "succeeded", "error": None})
            except Exception as e:  # an action's failure is the saga's input
                rows.append({"action": name, "kind": kind, "status": "failed", "error": str(e)})
            return rows[-1]["error"] is None

        done: list[str] = []
        for name in self.sequence or tuple(self.actions)[:1]:
            if not attempt(name, "action"):
                for back in reversed(done):
                    if back in self.compensators and not attempt(self.compensators[back], "compensation"):
                        break
                break
            done.append(name)
        return rows


def saga_rows(actions: DataFrame, compensators: DataFrame) -> DataFrame:
    """What happens in sagas of (saga_id, position, action, ok): actions run in order until one fails; then what succeeded is compensated.

    ``compensators`` (action, compensator, ok) tells which actions have one and whether it succeeds; compensation runs backwards
    and ends with the first that fails. Gives (saga_id, step, action, kind, status).
    """
    order = Window.partitionBy("saga_id").orderBy("position")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    ran = actions.withColumn("_bad", F.coalesce(F.max((~F.col("ok")).cast("int")).over(so_far), F.lit(0))).where("_bad = 0")
    end = ran.groupBy("saga_id").agg(F.max("position").alias("_end"), F.min("ok").alias("_all"))
    forward = ran.select("saga_id", F.col("position").alias("step"), "action", F.lit("action").alias("kind"), "ok")
    back = ran.where("ok").join(end.where("not _all"), "saga_id").join(compensators.withColumnRenamed("ok", "_ok"), "action")
    back = back.withColumn("step", 2 * F.col("_end") - F.col("position") + 1)
    stopped = F.coalesce(F.max((~F.col("_ok")).cast("int")).over(Window.partitionBy("saga_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    back = back.withColumn("_bad", stopped).where("_bad = 0").select("saga_id", "step", F.col("compensator").alias("action"), F.lit("compensation").alias("kind"), F.col("_ok").alias("ok"))
    return forward.unionByName(back).withColumn("status", F.when(F.col("ok"), "succeeded").otherwise("failed")).drop("ok")


def saga_report(rows: DataFrame) -> DataFrame:
    """Numbers of (saga_id, kind, status) actions that succeeded, failed, and were compensated."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    act, ok = F.col("kind") == "action", F.col("status") == "succeeded"
    return rows.groupBy("saga_id").agg(n(act & ok)("succeeded"), n(~ok)("failed"), n(~act & ok)("compensated"))


def guarded(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Events that the rule of their name accepts; names without a rule are rejected."""
    ok = F.lit(False)
    for name, rule in rules.items():
        ok = F.when(F.col("name") == name, F.coalesce(rule, F.lit(False))).otherwise(ok)
    return events.where(ok)
