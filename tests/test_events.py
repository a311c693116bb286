import glob
import os
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.functions.query import Bounds, EventQuery, Ref, cursor_text, merge, parse_cursor
from eventloom.functions.scalar import new_uuid7, uuid5
from eventloom.operators import entities, permissions, processes, repository
from eventloom.plans import queries as plans
from eventloom.sources import log
from eventloom.functions.query import EntityQuery
from eventloom.streaming import projections, workflows
from eventloom.streaming.projections import Job, Progress, ProgressFile, Projection, continuously, triggered

SF = "/root/testdata/sf0.001"


def rows_of(spark, *rows):
    """(id, name, time_ns, aggregate_name, aggregate_id, version)"""
    df = log.events_from(spark, [(i, n, t, None, a, k, v, None) for i, n, t, a, k, v in rows])
    return df.withColumn("ts", F.timestamp_micros(F.floor(F.col("time_ns") / 1000)).cast("timestamp_ntz"))


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    return c


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert text(got) == text(want)


def test_version_bounds(spark):
    df = rows_of(spark, *[(str(v), "foo", v, "a", "x", v) for v in (2, 4, 8, 16, 32)])
    assert sorted(ids(EventQuery(version=Bounds(mins=(5,), maxs=(16,))).apply(df))) == ["16", "8"]
    assert Bounds(mins=(9, 5)).includes(5) and not Bounds(exact=(1,), maxs=(5,)).includes(2, 7)


def test_refs_and_merge(spark):
    df = rows_of(spark, *[(f"{n}{k}", "e", 1, n, k, 1) for n in ("foo", "bar", "baz") for k in ("1", "2")])
    assert sorted(ids(EventQuery(refs=(Ref("foo", "1"), Ref("bar", "1"))).apply(df))) == ["bar1", "foo1"]
    assert sorted(ids(EventQuery(refs=(Ref("foo", "1"), Ref("baz"))).apply(df))) == ["baz1", "baz2", "foo1"]
    q = merge(EventQuery(names=("a",)).since(5), EventQuery(names=("b",)).since(3))
    assert q.names == ("a", "b") and q.time.mins == (3,)
    with pytest.raises(ValueError):
        Ref.parse("foo")
    assert parse_cursor(cursor_text(7, "x")) == (7, "x")


def test_nulls_count_as_zero(spark):
    df = rows_of(spark, ("a", "e", 1, None, None, None), ("b", "e", 1, "n", "x", 6))
    assert ids(EventQuery(version=Bounds(maxs=(5,))).apply(df)) == ["a"]


def test_sort_is_total(spark):
    df = rows_of(spark, ("b", "e", 1, "n", "x", 1), ("a", "e", 1, "n", "x", 2), ("c", "e", 0, "n", "x", 3))
    assert ids(EventQuery(sort=(("time", True),)).apply(df)) == ["c", "a", "b"]


def test_append_is_all_or_nothing(spark, tmp_path):
    store = log.EventLog(spark, str(tmp_path / "log"))
    store.insert(rows_of(spark, ("1", "e", 1, "n", "x", 1)))
    for bad in (("1", "e", 2, "n", "x", 2), ("2", "e", 2, "n", "x", 1)):
        with pytest.raises(log.Conflict):
            store.insert(rows_of(spark, ("9", "e", 3, "n", "y", 1), bad))
    with pytest.raises(log.Conflict):
        store.insert(rows_of(spark, ("5", "e", 1, "n", "z", 2), ("6", "e", 1, "n", "z", 2)))
    store.insert(rows_of(spark, ("7", "e", 1, "n", "z", 0), ("8", "e", 1, "n", "z", 0)))  # version 0 is exempt
    assert sorted(ids(store.read())) == ["1", "7", "8"]
    store.delete_entity("n", "x")
    store.delete(rows_of(spark, ("nothing", "e", 1, None, None, None)))
    assert sorted(ids(store.read())) == ["7", "8"]
    assert store.find("7").name == "e"
    with pytest.raises(log.NotFound):
        store.find("1")
    assert log.schema_problems(store.read()) == []
    assert log.schema_problems(spark.range(1))[0] == "id is bigint, not string"


def test_consistency_and_soft_delete(spark):
    df = rows_of(spark, ("1", "e", 1, "n", "gap", 1), ("2", "e", 2, "n", "gap", 5), ("3", "e", 5, "n", "t", 1), ("4", "e", 5, "n", "t", 2), ("5", "e", 1, "n", "v", 0), ("6", "deleted", 3, "n", "gap", 6))
    found = {r.aggregate_id: (r.kind, r["index"]) for r in entities.violations(df).collect()}
    assert found == {"t": ("time", 1), "v": ("version", 0)}
    assert {r.aggregate_id for r in entities.violations(df, ignore_time=True).collect()} == {"v"}
    assert {r.aggregate_id for r in entities.live(df).collect()} == {"t", "v"}
    back = df.unionByName(rows_of(spark, ("7", "restored", 4, "n", "gap", 7)))
    assert "gap" in {r.aggregate_id for r in entities.live(back).collect()}


def test_clamped_counts(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for s in range(50):
        n = 0
        for p in range(rng.randint(1, 20)):
            x = rng.choice((1, -1))
            n = max(0, n + x)
            rows.append((str(s), "doc", "1", "read", x, p))
        want[str(s)] = n
    df = spark.createDataFrame(rows, "subject string, ref_name string, ref_id string, action string, delta int, position int")
    assert {r.subject: r.n for r in permissions.counted(df).collect()} == {k: v for k, v in want.items() if v}


def test_wildcards(spark):
    grants = spark.createDataFrame([("a", "*", "", "read", 1), ("b", "doc", "", "*", 1), ("c", "doc", "1", "read", 1), ("d", "*", "1", "*", 1)], "subject string, ref_name string, ref_id string, action string, n long")
    probes = spark.createDataFrame([(s, "doc", i, x) for s in "abcd" for i in ("1", "2") for x in ("read", "write")], "subject string, ref_name string, ref_id string, action string")
    got = {(r.subject, r.ref_id, r.action) for r in permissions.allowed(probes, grants).collect()}
    assert got == {("a", "1", "read"), ("a", "2", "read"), *(("b", i, x) for i in "12" for x in ("read", "write")), ("c", "1", "read"), ("d", "1", "read"), ("d", "1", "write")}


def test_uuids(spark):
    space = uuid.uuid4()
    texts = ["", "a", "ü", "key:7"] + [str(i) for i in range(50)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", uuid5(space, F.col("t")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(space, r.t)) for r in got)
    assert uuid.UUID(new_uuid7()).version == 7


def test_projection_applies_each_event_once(spark, tmp_path):
    store = log.EventLog(spark, str(tmp_path / "log"))
    seen: list[str] = []
    p = Projection(lambda rows, reset: (seen.clear() if reset else None, seen.extend(ids(rows)))[0])
    store.insert(rows_of(spark, ("a", "e", 5, "n", "x", 1), ("b", "e", 5, "n", "y", 1)))
    continuously(store.stream(), p, str(tmp_path / "cp")).awaitTermination()
    store.insert(rows_of(spark, ("c", "e", 5, "n", "z", 1)))
    continuously(store.stream(), p, str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "b", "c"] and p.progress == Progress(5, ("a", "b", "c"), 1)
    assert triggered(store.read(), p) == 0
    assert triggered(store.read(), p, reset=True) == 3 and sorted(seen) == ["a", "b", "c"]
    assert Job(store.read(), Progress()).named("e").count() == 3


def test_saga_compensates_in_reverse():
    ran: list[str] = []

    def fail():
        raise RuntimeError("no")

    s = processes.Saga({"a": lambda: ran.append("a"), "b": lambda: ran.append("b"), "c": fail, "ua": lambda: ran.append("ua"), "ub": lambda: ran.append("ub")}, {"a": "ua", "b": "ub"}, ("a", "b", "c"))
    report = s.run()
    assert ran == ["a", "b", "ub", "ua"] and [r["status"] for r in report] == ["succeeded", "succeeded", "failed", "succeeded", "succeeded"]


def test_codec_keeps_bad_rows(spark):
    codec = log.Codec()
    codec.register("e", "A int")
    df = rows_of(spark, ("1", "e", 1, None, None, None), ("2", "e", 1, None, None, None)).withColumn("data", F.when(F.col("id") == "1", '{"A": 3}').otherwise("{oops"))
    got = {r.id: (r.payload.A, r.decode_error) for r in codec.decode(df, "e").collect()}
    assert got == {"1": (3, None), "2": (None, "{oops")}
    with pytest.raises(KeyError):
        codec.decode(df, "other")


def test_refused_events_reach_no_reader(spark, tmp_path):
    store = log.EventLog(spark, str(tmp_path / "log"))
    store.insert(rows_of(spark, ("1", "e", 1, "n", "x", 2)))
    for bad in (("1", "e", 2, "n", "y", 1), ("2", "e", 2, "n", "x", 1), ("3", "e", 2, "n", "x", 2)):  # repeated id; free but stale version; taken version
        with pytest.raises(log.Conflict):
            store.insert(rows_of(spark, bad))
    store.insert(rows_of(spark, ("4", "e", 2, "n", "x", 3)))
    seen: list[str] = []
    p = Projection(lambda rows, reset: seen.extend(ids(rows)))
    continuously(store.stream(), p, str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["1", "4"] == sorted(ids(store.read()))
    store.delete(rows_of(spark, ("1", "e", 1, None, None, None)))
    assert ids(store.read()) == ["4"]
    store.insert(rows_of(spark, ("1", "e", 9, "n", "z", 1)))  # a deleted id may come again
    assert sorted(ids(store.read())) == ["1", "4"]
    other = log.EventLog(spark, str(tmp_path / "log"))
    number = other._next()
    other._claim(number)
    with pytest.raises(log.Conflict):
        store._claim(number)


def test_late_events_and_restart(spark, tmp_path):
    """Late events are applied; a restarted process goes on from stored progress; a repeated micro-batch is passed over."""
    store, seen = log.EventLog(spark, str(tmp_path / "log"), optimistic=False), []

    def fresh():
        return Projection(lambda rows, reset: seen.extend(ids(rows)), store=ProgressFile(spark, str(tmp_path / "progress")))

    for one in (("b", "e", 9, "n", "y", 5), ("late", "e", 3, "n", "x", 1), ("c", "e", 9, "n", "z", 6)):
        store.insert(rows_of(spark, one))
        continuously(store.stream(), fresh(), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["b", "late", "c"] and fresh().progress == Progress(9, ("b", "c"), 2)
    assert fresh().run(Job(store.read(), Progress(), live=True), 2) == 0
    assert triggered(store.read(), fresh()) == 0
    assert triggered(store.read(), fresh(), entities=EntityQuery(names=("other",)), reset=True) == 0


def test_debounce_waits_for_silence_and_not_for_ever(spark, tmp_path):
    store = log.EventLog(spark, str(tmp_path / "log"))
    store.insert(rows_of(spark, ("a", "e", 5, "n", "x", 1), ("b", "e", 6, "n", "x", 2)))
    seen: list[str] = []
    p = Projection(lambda rows, reset: seen.extend(ids(rows)))
    q = projections.debounced(store.stream(), store.read, p, str(tmp_path / "cp"), 300)
    for _ in range(100):
        if seen or q.awaitTermination(0.2):
            break
    q.stop()
    assert sorted(seen) == ["a", "b"]


def test_await_first_and_broken_handlers(spark, tmp_path):
    store = log.EventLog(spark, str(tmp_path / "log"))
    store.insert(rows_of(spark, ("a", "e", 5, "n", "x", 1), ("b", "f", 4, "n", "x", 2)))
    assert projections.await_first(store.stream(), ("f",), str(tmp_path / "cp0")).id == "b"
    got, broken = [], []

    def fails(rows):
        raise RuntimeError("no")

    table = {"e": [lambda rows: got.extend(ids(rows)), fails], "f": [lambda rows: got.extend(ids(rows))]}
    projections.handled(store.stream(), table, str(tmp_path / "cp1"), replay=store.read, broken=lambda rows, why: broken.append(why)).awaitTermination()
    assert sorted(got) == ["a", "a", "b", "b"] and set(broken) == {"RuntimeError: no"}
    with pytest.raises(RuntimeError):
        projections.handlers(table)(store.read(), 0)


def event(id, name, ms, data=None):
    return {"id": id, "name": name, "time_ns": ms * 1_000_000, "data": data}


def test_workflow_handlers():
    tries = []

    def shaky(c, e):
        c.dispatch("late", "cmd")
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("again")

    def clash(c, e):
        c.dispatch("k", "other")

    service = workflows.Service(
        start={"begin": lambda c, e: c.schedule("t", 50)},
        react={"do": lambda c, e: c.dispatch("k", "cmd", "x"), "shaky": shaky, "clash": clash, "timeout:t": lambda c, e: c.compensate("late"), "end": lambda c, e: c.complete(), "undo": lambda c, e: c.compensated()},
        back={"undo": lambda c, e: c.compensated(), "end": lambda c, e: c.complete()},
    )
    state = workflows.fresh_state()
    first = workflows.advance(service, state, "w", [event("2", "do", 20), event("1", "begin", 10), event("0", "do", 5), event("2", "do", 21), event("3", "do", 22)])
    assert first.kind.tolist() == ["started", "timeout.requested", "trigger", "command", "trigger", "trigger"] and state["phase"] == "running"
    more = workflows.advance(service, state, "w", [event("4", "shaky", 30), event("5", "clash", 31), event("6", "undo", 32)])
    assert more.kind.tolist() == ["command", "trigger", "error", "error"] and more.position.tolist() == [6, 7, 8, 9] and len(tries) == 3
    due = workflows.advance(service, state, "w", [event("7", "end", 60)])
    assert due.kind.tolist() == ["timeout.fired", "compensating", "trigger", "error"] and state["phase"] == "compensating"
    assert workflows.advance(service, state, "w", [event("8", "undo", 70), event("9", "do", 80)]).kind.tolist() == ["compensated", "trigger"]
    assert workflows.advance(service, state, "v", []).empty


def test_workflows_go_on_after_a_restart(spark, tmp_path):
    service = workflows.Service(start={"begin": lambda c, e: None}, react={"do": lambda c, e: c.dispatch(e["data"], "cmd")})
    schema = "workflow_id string, id string, name string, time_ns bigint, data string"
    for rows in ([("w", "1", "begin", 1, None), ("w", "2", "do", 2, "a"), ("v", "1", "do", 1, "x")], [("w", "2", "do", 3, "a"), ("w", "3", "do", 4, "b"), (None, "9", "begin", 1, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        workflows.serve_into(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), service, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("workflow_id", "position").collect()
    assert [(r.workflow_id, r.position, r.kind, r.key) for r in got] == [("w", 0, "started", None), ("w", 1, "trigger", None), ("w", 2, "command", "a"), ("w", 3, "trigger", None), ("w", 4, "command", "b"), ("w", 5, "trigger", None)]


@pytest.mark.parametrize("name", ["workflow_service", "overview_stream"])
def test_streamed_tables_are_written_by_many_tasks(spark, tmp_path, monkeypatch, name):
    """No task writes most of what a stream reads, and the stream gives the same over many files."""
    for n in range(4):
        rows = spark.read.parquet(f"{SF}/events.parquet").withColumns({"event_id": F.col("event_id") + n * 10_000, "user_id": F.col("user_id") + n * 10_000})
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    paths = {}
    monkeypatch.setattr(plans, "new_folder", lambda spark, kind: paths.setdefault(kind, str(tmp_path / kind)))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        got = {tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(merging)
    c = duckdb.connect()
    c.sql(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(c.execute(plans.ORACLES[name]).fetchall())
    files = [r[0] for r in c.execute(f"select count(*) from read_parquet('{paths['events']}/*.parquet', filename = true) group by filename").fetchall()]
    assert len(files) >= 4 and max(files) < sum(files) / 2


def test_repository(spark, tmp_path):
    calls: list[str] = []
    hooks = repository.Hooks(before=[lambda d: calls.append("before")], after=[lambda d: calls.append("after")], failed=[lambda d, e: calls.append(type(e).__name__)], deleted=[lambda n, i: calls.append(f"{n}({i})")])
    model = repository.Model("n long", lambda: {"n": 0}, {"e": lambda s, r: s.update(n=s["n"] + 1)})
    repo = repository.Repository(log.EventLog(spark, str(tmp_path / "log")), model, str(tmp_path / "snap"), 3, hooks)
    repo.save(rows_of(spark, *[(f"a{v}", "e", v, "n", "x", v) for v in (1, 2, 3, 4)]))
    repo.save(rows_of(spark, ("b1", "e", 1, "n", "y", 1), ("a5", "e", 5, "n", "x", 5)))
    assert [(r.aggregate_id, r.aggregate_version, r.state) for r in repo.held_snapshots().collect()] == [("x", 4, '{"n": 4}')]
    assert repo.fetch("n", "x")["n"] == 5 and repo.fetch("n", "x", 2)["n"] == 2 and repo.typed("n").fetch("y")["n"] == 1
    for bad, error in ((("a9", "e", 9, "n", "x", 5), log.Conflict), (("a0", "e", 9, "n", "x", 0), repository.Inconsistent)):
        with pytest.raises(error):
            repo.save(rows_of(spark, bad))
    with pytest.raises(log.NotFound):
        repo.fetch("n", "x", 9)
    repo.use(lambda held: rows_of(spark, ("d", "deleted", 9, "n", "y", 2)))
    with pytest.raises(repository.Deleted):
        repo.fetch("n", "y")
    assert {r.aggregate_id: r.n for r in repo.typed("n").query().collect()} == {"x": 5}
    cached = repository.Cached(repo.typed("n"), 1)
    assert cached.fetch("x") is cached.fetch("x")
    cached.clear("x")
    repo.delete("n", "x")
    with pytest.raises(log.NotFound):
        repo.log.find("a1")
    assert calls == ["before", "after", "before", "after", "before", "Conflict", "Inconsistent", "before", "after", "n(x)"]


def test_null_entities_and_models(spark):
    df = rows_of(spark, ("1", "e", 1, "n", None, 1), ("2", "e", 1, "n", "x", 1), ("3", "e", 1, None, "x", 1))
    assert ids(entities.entities(df, EntityQuery())) == ["2"]
    good, bad = entities.split_consistent(df)
    assert ids(good) == ["2"] and {r.id: r.kind for r in bad.collect()} == {"1": "id", "3": "name"}
    models = log.Models(["k"], decode=lambda r: r["v"])
    held = spark.createDataFrame([("o'k", 1), (None, 2)], "k string, v int")
    assert models.fetch(held, k="o'k") == 1 and models.fetch(held, k=None) == 2 and models.fetch(held, {"v": 7}, k="x") == 7
    with pytest.raises(log.NotFound):
        models.fetch(held, k="x")
    again = models.upsert(held, models.rows(spark, [{"k": "o'k", "v": 3}, {"k": "o'k", "v": 5}], "k string, v int"))
    assert models.fetch(again, k="o'k") == 5


def test_saga_rows_equal_the_run_on_the_driver(spark):
    rng = random.Random(4)
    acts, want = [], {}
    back = {"a": ("ua", True), "b": ("ub", True), "c": ("uc", False)}
    for s in range(40):
        ran = [(s, i, rng.choice("abcd"), rng.random() < 0.8) for i in range(rng.randint(1, 5))]
        acts += ran
        rows, done = [], []
        for _, _, a, ok in ran:
            rows.append((a, "action", "succeeded" if ok else "failed"))
            if not ok:
                for b in reversed(done):
                    if b in back:
                        rows.append((back[b][0], "compensation", "succeeded" if back[b][1] else "failed"))
                        if not back[b][1]:
                            break
                break
            done.append(a)
        want[s] = rows
    df = spark.createDataFrame(acts, "saga_id long, position int, action string, ok boolean")
    undo = spark.createDataFrame([(a, c, ok) for a, (c, ok) in back.items()], "action string, compensator string, ok boolean")
    got: dict = {}
    for r in processes.saga_rows(df, undo).orderBy("saga_id", "step").collect():
        got.setdefault(r.saga_id, []).append((r.action, r.kind, r.status))
    assert got == want
