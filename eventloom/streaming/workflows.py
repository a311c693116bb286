"""Workflows as keyed state: events start, advance, complete or compensate them, each trigger once; effects come out as rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.processes import TRANSITIONS

OUT = "workflow_id string, position long, kind string, effect_id string, key string, trigger_id string, name string, data string, at_ms long"
SPACE_ID = uuid.uuid5(uuid.NAMESPACE_URL, "urn:eventloom:effects")


class Refused(Exception):
    """A handler asked for a phase that does not follow, or for another command under a key that is taken."""


@dataclass
class Context:
    """What a handler may do. Its effects count only when it ends without an error."""

    workflow_id: str
    trigger_id: str
    state: dict
    rows: list[tuple] = field(default_factory=list)

    def _add(self, kind: str, key: str | None = None, name: str | None = None, data: str | None = None, at_ms: int | None = None) -> str:
        effect = str(uuid.uuid5(SPACE_ID, "|".join((self.workflow_id, kind, key or "", self.trigger_id))))
        self.rows.append((kind, effect, key, name, data, at_ms))
        return effect

    def dispatch(self, key: str, name: str, data: str | None = None) -> None:
        """Ask for a command once: the same one again changes nothing, another one under the key is refused."""
        key = key.strip()
        if not key:
            raise Refused("a command needs a key")
        held = self.state["commands"].get(key)
        if held is None:
            self.state["commands"][key] = [name, data]
            self._add("command", key, name, data)
        elif held != [name, data]:
            raise Refused(f"{key} stands for another command")

    def schedule(self, key: str, at_ms: int) -> None:
        self.state["timers"][key] = at_ms
        self._add("timeout.requested", key, at_ms=at_ms)

    def unschedule(self, key: str) -> None:
        if self.state["timers"].pop(key, None) is not None:
            self._add("timeout.canceled", key)

    def _enter(self, phase: str, reason: str | None = None) -> None:
        if phase not in TRANSITIONS.get(self.state["phase"], ()):
            raise Refused(f"{phase} does not follow {self.state['phase']}")
        self.state["phase"] = phase
        self._add(phase, data=reason)

    def complete(self) -> None:
        self._enter("completed")

    def fail(self, reason: str) -> None:
        self._enter("failed", reason)

    def compensate(self, reason: str) -> None:
        self._enter("compensating", reason)

    def compensated(self) -> None:
        self._enter("compensated")

    def compensation_failed(self, reason: str) -> None:
        self._enter("compensation_failed", reason)


Handler = Callable[[Context, dict], None]


@dataclass
class Service:
    """Handlers by event name: ``start`` of a workflow that is unknown, ``react`` while it runs, ``back`` while it compensates.

    A fired timeout is an event named ``timeout:<key>``. A handler that raises is tried ``attempts`` times on the same state;
    then its trigger is left unrecorded and a row of kind error says why.
    """

    start: dict[str, Handler] = field(default_factory=dict)
    react: dict[str, Handler] = field(default_factory=dict)
    back: dict[str, Handler] = field(default_factory=dict)
    attempts: int = 3

    def handle(self, state: dict, workflow_id: str, event: dict) -> list[tuple]:
        """Change the state by one event; the rows that come of it."""
        phase, trigger = state["phase"], str(event["id"])
        table = {"unknown": self.start, "running": self.react, "compensating": self.back}.get(phase, {})
        handler = table.get(event["name"])
        if handler is None or trigger in state["triggers"]:
            return []
        error = None
        for _ in range(self.attempts):
            context = Context(workflow_id, trigger, json.loads(json.dumps(state)))
            if phase == "unknown":
                context.state["phase"] = "running"
                context._add("started")
            try:
                handler(context, event)
            except Exception as e:  # a handler's failure is told in a row
                error = e
                continue
            context.state["triggers"].append(trigger)
            context._add("trigger", name=event["name"])
            if context.state["phase"] not in ("running", "compensating"):
                context.state["timers"] = {}
            state.clear()
            state.update(context.state)
            return [(trigger, *row) for row in context.rows]
        return [(trigger, "error", None, None, event["name"], f"{type(error).__name__}: {error}", None)]

    def fire(self, state: dict, workflow_id: str, now_ms: int) -> list[tuple]:
        """Timeouts whose time has come, earliest first; handlers of one may schedule others."""
        rows: list[tuple] = []
        while due := sorted((at, key) for key, at in state["timers"].items() if at <= now_ms):
            at, key = due[0]
            del state["timers"][key]
            trigger = f"timeout:{key}:{at}"
            rows.append((trigger, "timeout.fired", str(uuid.uuid5(SPACE_ID, f"{workflow_id}|{trigger}")), key, None, None, at))
            rows += self.handle(state, workflow_id, {"id": trigger, "name": f"timeout:{key}", "time_ns": at * 1_000_000, "data": None})
        return rows


def fresh_state() -> dict:
    return {"phase": "unknown", "triggers": [], "commands": {}, "timers": {}, "position": 0}


def advance(service: Service, state: dict, workflow_id: str, events: list[dict], clock_ms: int | None = None) -> pd.DataFrame:
    """Handle events in their order; timeouts due before an event's time fire first, those due by ``clock_ms`` last."""
    rows: list[tuple] = []
    for event in sorted(events, key=lambda e: (e["time_ns"], str(e["id"]))):
        rows += service.fire(state, workflow_id, event["time_ns"] // 1_000_000 - 1)
        rows += service.handle(state, workflow_id, event)
    if clock_ms is not None:
        rows += service.fire(state, workflow_id, clock_ms)
    first = state["position"]
    state["position"] = first + len(rows)
    names = [f.split()[0] for f in OUT.split(", ")]
    out = pd.DataFrame([(workflow_id, first + i, kind, effect, key, trigger, name, data, at) for i, (trigger, kind, effect, key, name, data, at) in enumerate(rows)], columns=names)
    return out.astype({"position": "int64", "at_ms": "Int64"})


def serve(events: DataFrame, service: Service, clock: bool = True) -> DataFrame:
    """The service over a stream of (workflow_id, id, name, time_ns, data): a row for all that happens to a workflow.

    A workflow's state lies in the state store: its phase, its triggers (so each counts once, also after a restart),
    commands by key and timers. A micro-batch handles a workflow's events by time in one task; what a micro-batch
    holds of one workflow must fit it, which maxFilesPerTrigger bounds. With ``clock``, timers also fire by processing time.
    Rows without a workflow_id belong to none.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else fresh_state()
        now = held.getCurrentProcessingTimeMs() if clock else None
        rows = [] if held.hasTimedOut else [row for pdf in frames for row in pdf.to_dict("records")]
        yield advance(service, state, key[0], rows, now)
        held.update((json.dumps(state),))
        if clock and state["timers"]:
            held.setTimeoutDuration(max(1, min(state["timers"].values()) - now))

    rows = events.where("workflow_id is not null").select("workflow_id", "id", "name", "time_ns", "data")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if clock else GroupStateTimeout.NoTimeout
    return rows.groupBy("workflow_id").applyInPandasWithState(step, OUT, "state string", "append", timeout)


def serve_into(events: DataFrame, service: Service, out: str, checkpoint: str) -> None:
    """Serve what is there and append the rows to ``out`` (one folder a micro-batch, written again when it is repeated)."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    serve(events, service, clock=False).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def resync(requested: DataFrame, done: DataFrame, now_ns: int, grace_ns: int = 500_000_000, window_ns: int = 30 * 86_400 * 1_000_000_000) -> DataFrame:
    """Effects asked for that are not done, old enough that their own worker had its time, and not older than the recovery window."""
    old = requested.where((F.col("time_ns") <= now_ns - grace_ns) & (F.col("time_ns") >= now_ns - window_ns))
    return old.join(done.select("effect_id").distinct(), "effect_id", "left_anti")
