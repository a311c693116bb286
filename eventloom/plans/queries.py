"""Queries over the test tables, each with the same result in SQL.

The ``events`` table is one log (entity: the user, version: order by time), ``conversations`` and ``orders``
are others; ``lineitem`` has repeated versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.query import BY_TIME, Bounds, EntityQuery, EventQuery, Ref, SnapshotQuery, accept_all, commands, cursor_text, merge, parse_cursor
from ..functions.scalar import blank, granted, missing, nanoseconds, parse_reference, reference
from ..operators import console, entities, lookup, permissions, processes, repository
from ..sources import log
from ..sources.folders import new_folder
from ..streaming import workflows
from ..streaming.projections import Progress, ProgressFile, Projection, before_each, continuously, quarantined, run_overview

SEC = 1_000_000_000
#: Fixed values of the queries: instants (ns since the epoch) inside the test data are found by share of its span.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the log's form, without versions, so that filters reach the scan."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), nanoseconds(F.col("ts")).alias("time_ns"), "ts", F.lit("user").alias("aggregate_name"),
        F.col("user_id").cast("string").alias("aggregate_id"), F.lit(None).cast("int").alias("aggregate_version"), F.to_json(F.struct("value", "props")).alias("data"), "value", "props",
    )


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("aggregate_id").orderBy("ts", F.col("id").cast("bigint"))
    return raw_log(spark, sf_dir).withColumn("aggregate_version", F.row_number().over(order))


def talk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("name"), (F.col("turn") * SEC).alias("time_ns"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit("conversation").alias("aggregate_name"), F.col("conv_id").cast("string").alias("aggregate_id"), (F.col("turn") + 1).cast("int").alias("aggregate_version"), F.col("text").alias("data"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), F.col("o_orderstatus").alias("name"), nanoseconds(F.col("o_orderdate")).alias("time_ns"), F.col("o_orderdate").alias("ts"),
        F.lit("customer").alias("aggregate_name"), F.col("o_custkey").cast("string").alias("aggregate_id"), F.lit(None).cast("int").alias("aggregate_version"), F.col("o_totalprice").cast("string").alias("data"),
    )
    return entities.numbered(rows)


LINE_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


V = "(SELECT *, epoch_us(ts) * 1000 AS ns, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ver FROM events)"
ENV = "CAST(event_id AS VARCHAR) AS id, event_type AS name, ns AS time_ns, CAST(user_id AS VARCHAR) AS aggregate_id"
T0 = "2024-01-08 00:00:00"
T0_NS = 1_704_672_000 * SEC
T1_NS = T0_NS + 7 * 86_400 * SEC
_LIVE = f"(SELECT user_id, arg_max(json_extract_string(props, '$.k'), ver) AS value, max(ns) AS seen, arg_max(event_type, ver) AS t FROM {V} GROUP BY user_id)"
_E = ["id", "name", "time_ns", "aggregate_id"]


@query(f"SELECT {ENV} FROM {V} WHERE event_type IN ('click', 'error') AND ns >= {T0_NS}")
def event_filter_name_time(spark, d):
    return EventQuery(names=("click", "error"), sort=BY_TIME).since(T0_NS).apply(raw_log(spark, d)).select(*_E)


def _times(spark: SparkSession, d: str, *ids: int) -> list[int]:
    """Times of a few events, in order: bounds that events lie on."""
    return sorted(r.time_ns for r in raw_log(spark, d).where(F.col("id").isin(*map(str, ids))).select("time_ns").collect())


_LOW, _HIGH = (f"(SELECT {f}(epoch_us(ts) * 1000) FROM events WHERE event_id IN (100, 700))" for f in ("min", "max"))


@query(f"SELECT {ENV} FROM {V} WHERE ns > {_LOW} AND ns < {_HIGH}")
def event_filter_before_after(spark, d):
    low, high = _times(spark, d, 100, 700)
    return EventQuery().after(low).before(high).apply(raw_log(spark, d)).select(*_E)


@query(f"SELECT {ENV} FROM {V} WHERE ns BETWEEN {_LOW} AND {_HIGH}")
def event_filter_time_range(spark, d):
    low, high = _times(spark, d, 100, 700)
    return EventQuery(time=Bounds(ranges=((low, high),))).apply(raw_log(spark, d)).select(*_E)


@query(f"SELECT {ENV} FROM {V} WHERE ns IN ({_LOW}, {_HIGH})")
def event_filter_time_exact(spark, d):
    return EventQuery(time=Bounds(exact=tuple(_times(spark, d, 100, 700)))).apply(raw_log(spark, d)).select(*_E)


@query(f"SELECT {ENV} FROM {V} WHERE event_type IN ('click', 'view') AND user_id IN (1, 2, 3) AND ns >= {T0_NS}")
def event_accept_all(spark, d):
    return accept_all(raw_log(spark, d), EventQuery(names=("click", "view")), EventQuery(aggregate_ids=("1", "2", "3")), EventQuery().since(T0_NS)).select(*_E)


@query(f"SELECT {ENV}, CAST(ver AS INTEGER) AS aggregate_version FROM {V} WHERE (ver BETWEEN 1 AND 3 OR ver BETWEEN 10 AND 12) AND ver <= 11 AND ver >= 2")
def event_filter_version_ranges(spark, d):
    return EventQuery(version=Bounds(ranges=((1, 3), (10, 12)), mins=(2, 5), maxs=(4, 11))).apply(user_log(spark, d)).select(*_E, "aggregate_version")


@query(f"SELECT {ENV} FROM {V} WHERE event_id IN (3, 17, 99)")
def event_find_ids(spark, d):
    return EventQuery(ids=("3", "17", "99")).apply(raw_log(spark, d)).select(*_E)


@query(f"SELECT {ENV} FROM {V} WHERE user_id IN (1, 2, 7)")
def event_filter_refs(spark, d):
    return EventQuery(refs=(Ref("user", "1"), Ref("user", "2"), Ref.parse("user(7)"), Ref("order"))).apply(raw_log(spark, d)).select(*_E)


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, role AS name FROM conversations WHERE turn + 1 IN (1, 3)")
def event_filter_other_log(spark, d):
    q = EventQuery(aggregate_names=("conversation",), version=Bounds(exact=(1, 3)))
    return q.apply(entities.union(talk_log(spark, d), user_log(spark, d).drop("value", "props"))).select("id", "name")


@query(f"SELECT {ENV} FROM {V} WHERE event_type IN ('click', 'error', 'view') AND user_id IN (1, 2, 3) AND ns >= {T0_NS}")
def query_merge_widen(spark, d):
    a = EventQuery(names=("click", "error"), aggregate_ids=("1", "2")).since(0)
    return merge(a, EventQuery(names=("view",), aggregate_ids=("3",)).since(T0_NS)).apply(raw_log(spark, d)).select(*_E)


@query(f"SELECT {ENV} FROM {V} WHERE ns < {T1_NS} ORDER BY ns DESC, id DESC LIMIT 51")
def event_page_keyset(spark, d):
    return console.event_page(raw_log(spark, d), 50, parse_cursor(cursor_text(T1_NS, ""))).select(*_E)


@query(f"SELECT {ENV}, CAST(ver AS INTEGER) AS aggregate_version FROM {V} WHERE user_id = 5 AND ver > 10 ORDER BY ver LIMIT 21")
def entity_events_page(spark, d):
    return console.entity_page(user_log(spark, d), "user", "5", 10, 20).select(*_E, "aggregate_version")


@query(f"SELECT count(*) AS events, count(DISTINCT event_type) AS names, CAST(1 AS BIGINT) AS aggregate_names, max(ns) AS newest_ns FROM {V}")
def console_summary(spark, d):
    return console.summary(raw_log(spark, d))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 200")
def console_facets(spark, d):
    return console.facets(raw_log(spark, d), "name")


@query(f"SELECT 'user' AS aggregate_name, CAST(user_id AS VARCHAR) AS aggregate_id, ns AS created_ns FROM {V} WHERE ver = 1")
def entity_catalog(spark, d):
    return console.catalog(user_log(spark, d))


@query(f"SELECT 'user' AS aggregate_name, CAST(user_id AS VARCHAR) AS aggregate_id, ns AS created_ns FROM {V} WHERE ver = 1 AND ns < {T0_NS} ORDER BY ns DESC, aggregate_id DESC LIMIT 31")
def entity_catalog_page(spark, d):
    return console.catalog_page(user_log(spark, d), 30, (T0_NS, ""), "user")


_FOLD = "CAST(user_id AS VARCHAR) AS aggregate_id, CAST(max(ver) AS INTEGER) AS version, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total, arg_max(event_type, ver) AS last_name"


def _folded(events: DataFrame) -> DataFrame:
    return entities.fold(events, total=F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), last_name=F.max_by("name", "aggregate_version")).drop("aggregate_name")


@query(f"SELECT {_FOLD} FROM {V} GROUP BY user_id")
def entity_fold(spark, d):
    return _folded(user_log(spark, d))


@query(f"SELECT {_FOLD} FROM {V} WHERE ver <= 20 GROUP BY user_id")
def entity_fold_at_version(spark, d):
    q = EntityQuery(names=("user",), version=Bounds(exact=(10, 20)))
    return _folded(user_log(spark, d).where(q.events().predicate()))


@query(f"SELECT {_FOLD} FROM {V} WHERE ver <= 20 GROUP BY user_id HAVING max(ver) = 20")
def entity_fold_strict(spark, d):
    return entities.reached(_folded(entities.at_version(user_log(spark, d), 20)), 20)


@query(f"SELECT CAST(user_id AS VARCHAR) AS aggregate_id, CAST(max(ver) AS INTEGER) AS version, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS INTEGER) AS state FROM {V} GROUP BY user_id")
def entity_fold_expression(spark, d):
    return entities.fold_expression(user_log(spark, d), F.lit(0), lambda s, e: s + F.when(e["name"] == "click", 1).otherwise(0)).drop("aggregate_name")


@query(f"SELECT CAST(user_id AS VARCHAR) AS aggregate_id, CAST(max(ver) AS INTEGER) AS version, count(*) FILTER (WHERE event_type = 'view') AS views, CAST(coalesce(max(ver) FILTER (WHERE event_type = 'error'), 0) AS BIGINT) AS last_error FROM {V} GROUP BY user_id")
def entity_fold_python(spark, d):
    def view(state, row):
        state["views"] += 1

    def error(state, row):
        state["last_error"] = row["aggregate_version"]

    return entities.fold_python(user_log(spark, d), "views long, last_error long", {"view": view, "error": error}, lambda: {"views": 0, "last_error": 0}).drop("aggregate_name")


_L = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)"


def _lines(spark, d) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    rows = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(order))
    return rows.select(F.lit("order").alias("aggregate_name"), F.col("l_orderkey").cast("string").alias("aggregate_id"), F.col("l_linenumber").alias("aggregate_version"), nanoseconds(F.col("l_shipdate")).alias("time_ns"), F.concat_ws("-", "l_orderkey", "rn").alias("id"), "rn")


@query(f"""
    WITH p AS (SELECT *, lag(l_linenumber) OVER w AS pv, lag(l_shipdate) OVER w AS pt FROM {_L} WINDOW w AS (PARTITION BY l_orderkey ORDER BY rn)),
    b AS (SELECT l_orderkey, rn - 1 AS i, CASE WHEN l_linenumber <= 0 OR l_linenumber <= pv THEN 'version' WHEN l_shipdate <= pt THEN 'time' END AS kind FROM p)
    SELECT CAST(l_orderkey AS VARCHAR) AS aggregate_id, arg_min(kind, i) AS kind, CAST(min(i) AS INTEGER) AS index FROM b WHERE kind IS NOT NULL GROUP BY l_orderkey""")
def consistency_violations(spark, d):
    return entities.violations(_lines(spark, d), order=["rn"]).select("aggregate_id", "kind", "index")


@query(f"""
    WITH b AS (SELECT * FROM {_L} WHERE rn % 2 = 0), l AS (SELECT * FROM {_L} WHERE rn % 2 = 1)
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(rn AS VARCHAR) AS id, 'version' AS kind FROM b WHERE l_linenumber > 0
    AND ((SELECT count(*) FROM b c WHERE c.l_orderkey = b.l_orderkey AND c.l_linenumber = b.l_linenumber) > 1 OR EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = b.l_orderkey AND l.l_linenumber = b.l_linenumber))""")
def append_conflicts(spark, d):
    lines = _lines(spark, d)
    return log.conflicts(lines.where("rn % 2 = 0"), lines.where("rn % 2 = 1")).select("id", "kind")


@query(f"SELECT CAST(event_id AS VARCHAR) AS id FROM {V} v WHERE ver = 2 AND EXISTS (SELECT 1 FROM {V} w WHERE w.user_id = v.user_id AND w.ver % 2 = 1 AND w.ver >= 2)")
def append_stale(spark, d):
    """Even versions of users do not follow a log that holds the odd ones."""
    rows = user_log(spark, d)
    return log.conflicts(rows.where("aggregate_version % 2 = 0"), rows.where("aggregate_version % 2 = 1"), optimistic=True).where("kind = 'stale'").select("id")


def _stored(spark: SparkSession, d: str) -> log.EventLog:
    """A log with all events, appended in two batches; a batch that repeats some of them is refused."""
    store, rows = log.EventLog(spark, new_folder(spark, "log")), user_log(spark, d).select(*log.FIELDS)
    store.insert(rows.where("aggregate_version <= 20"))
    store.insert(rows.where("aggregate_version > 20"))
    try:
        store.insert(rows.where("aggregate_version = 5"))
        raise AssertionError("a repeated batch was taken")
    except log.Conflict:
        return store


@query(f"SELECT {ENV} FROM {V} WHERE event_id % 10 <> 0")
def log_delete(spark, d):
    store = _stored(spark, d)
    store.delete(store.read().where(F.col("id").cast("bigint") % 10 == 0))
    return store.read().select(*_E)


@query(f"SELECT {ENV} FROM {V} WHERE user_id <> 3")
def log_delete_entity(spark, d):
    store = _stored(spark, d)
    store.delete_entity("user", "3")
    return store.query(EventQuery(aggregate_names=("user",))).select(*_E)


@query(f"SELECT {ENV} FROM {V} WHERE event_id = 17")
def log_find(spark, d):
    return spark.createDataFrame([_stored(spark, d).find("17")], log.SCHEMA).select(*_E)


@query(f"SELECT {ENV} FROM {V} WHERE user_id NOT IN (1, 2) UNION ALL SELECT 'c' || CAST(u AS VARCHAR), 'user.deleted', {T0_NS} + u, NULL FROM (VALUES (1), (2)) t(u)")
def delete_command(spark, d):
    store = _stored(spark, d)
    commands = spark.createDataFrame([(f"c{u}", "user", str(u), T0_NS + u) for u in (1, 2)], "command_id string, aggregate_name string, aggregate_id string, time_ns bigint")
    repository.delete_commands(store, commands, "user.deleted")
    return store.read().select(*_E)


@query("SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1")
def projection_with_late_events(spark, d):
    """A continuous projection over three appends, the last one older than what was applied, with a restart before each: each event once."""
    store, rows, out = log.EventLog(spark, new_folder(spark, "log"), optimistic=False), user_log(spark, d).select(*log.FIELDS), new_folder(spark, "target")
    for part in ("time_ns > {0}", "time_ns = {0}", "time_ns < {0}"):
        store.insert(rows.where(part.format(_times(spark, d, 100, 700)[0])))
        target = Projection(lambda batch, reset: batch.select("id", "name").write.mode("append").parquet(out), store=ProgressFile(spark, out + "-progress"))
        continuously(store.stream(), target, out + "-checkpoint").awaitTermination()
    return spark.read.schema("id string, name string").parquet(out).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1")
def overview_stream(spark, d):
    """Running counts of a stream in which a third of all events comes again."""
    path, out, rows = new_folder(spark, "events"), new_folder(spark, "overview"), raw_log(spark, d).select("id", "name", "ts")
    for part in (rows, rows.where(F.col("id").cast("bigint") % 3 == 0)):
        part.write.mode("append").parquet(path)
        run_overview(spark.readStream.schema(rows.schema).parquet(path), out, out + "-checkpoint")
    return spark.read.parquet(out).groupBy("name").agg(F.max("n").alias("n"))


@query(f"""
    WITH s AS (SELECT user_id, min(ver) AS s FROM {V} WHERE event_type = 'signup' GROUP BY user_id),
    e AS (SELECT v.user_id, min(ver) AS e, arg_min(event_type, ver) AS t FROM {V} v JOIN s ON s.user_id = v.user_id AND ver > s WHERE event_type IN ('purchase', 'error') GROUP BY v.user_id),
    c AS (SELECT v.user_id, count(DISTINCT json_extract_string(props, '$.k')) AS c, count(*) AS n FROM {V} v JOIN s USING (user_id) LEFT JOIN e USING (user_id) WHERE event_type = 'click' AND ver > s AND (e IS NULL OR ver < e) GROUP BY v.user_id)
    SELECT CAST(s.user_id AS VARCHAR) AS workflow_id, CASE t WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS phase, CAST(coalesce(c, 0) AS BIGINT) AS commands,
        CAST(1 + coalesce(n, 0) + CASE WHEN t IS NULL THEN 0 ELSE 1 END AS BIGINT) AS triggers FROM s LEFT JOIN e USING (user_id) LEFT JOIN c USING (user_id)""")
def workflow_service(spark, d):
    """Workflows on a stream: signup starts one, clicks dispatch a command a key, a purchase completes and an error fails it."""
    path, out = new_folder(spark, "events"), new_folder(spark, "workflows")
    rows = user_log(spark, d).select(F.col("aggregate_id").alias("workflow_id"), F.lpad("aggregate_version", 9, "0").alias("id"), "name", "time_ns", F.get_json_object("props", "$.k").alias("data"))
    rows.write.parquet(path)
    service = workflows.Service(
        start={"signup": lambda c, e: None},
        react={"click": lambda c, e: c.dispatch(str(e["data"]), "do", str(e["data"])), "purchase": lambda c, e: c.complete(), "error": lambda c, e: c.fail("error")},
    )
    workflows.serve_into(spark.readStream.schema(rows.schema).parquet(path), service, out, out + "-checkpoint")
    rows = spark.read.schema(workflows.OUT).parquet(out)
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).cast("bigint")
    phase = F.when(n("completed") > 0, "completed").when(n("failed") > 0, "failed").otherwise("running")
    return rows.groupBy("workflow_id").agg(phase.alias("phase"), n("command").alias("commands"), n("trigger").alias("triggers"))


@query(f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ver DESC) AS r FROM {V} WHERE event_type = 'click')
    SELECT CAST(user_id AS VARCHAR) AS workflow_id, json_extract_string(props, '$.k') AS key, CAST(event_id AS VARCHAR) AS effect_id FROM r WHERE r = 1 AND event_id % 3 <> 0 AND ns + 86400000000000 <= {T0_NS}""")
def due_timeouts(spark, d):
    asked = user_log(spark, d).where("name = 'click'").select(F.col("aggregate_id").alias("workflow_id"), F.get_json_object("props", "$.k").alias("key"), F.col("id").alias("effect_id"), (F.col("time_ns") + 86_400 * SEC).alias("at"), F.col("aggregate_version").alias("position"))
    return processes.due_timeouts(asked, asked.where(F.col("effect_id").cast("bigint") % 3 == 0), T0_NS).select("workflow_id", "key", "effect_id")


@query(f"""SELECT CAST(event_id AS VARCHAR) AS effect_id FROM {V} v WHERE event_type = 'click' AND ns BETWEEN {T0_NS} - 259200000000000 AND {T0_NS} - 500000000
    AND NOT EXISTS (SELECT 1 FROM {V} w WHERE w.event_id = v.event_id AND w.event_id % 4 = 0)""")
def effect_resync(spark, d):
    asked = raw_log(spark, d).where("name = 'click'").withColumnRenamed("id", "effect_id")
    return workflows.resync(asked, asked.where(F.col("effect_id").cast("bigint") % 4 == 0), T0_NS, window_ns=3 * 86_400 * SEC).select("effect_id")


@query(f"""
    WITH b AS (SELECT *, coalesce(max(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM {_L}),
    r AS (SELECT l_orderkey, l_linestatus = 'O' AS ok, l_returnflag AS f FROM b WHERE bad = 0)
    SELECT l_orderkey AS saga_id, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed,
        CAST(CASE WHEN bool_and(ok) THEN 0 ELSE count(*) FILTER (WHERE ok AND f <> 'A') END AS BIGINT) AS compensated FROM r GROUP BY l_orderkey""")
def saga_report(spark, d):
    lines = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    acts = lines.select(F.col("l_orderkey").alias("saga_id"), F.col("rn").alias("position"), F.col("l_returnflag").alias("action"), (F.col("l_linestatus") == "O").alias("ok"))
    back = spark.createDataFrame([("N", "undo N", True), ("R", "undo R", True)], "action string, compensator string, ok boolean")
    return processes.saga_report(processes.saga_rows(acts, back))


@query(f"SELECT max(ns) AS time_ns, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) AS ids FROM {V} WHERE ns = (SELECT max(ns) FROM {V})")
def progress_after(spark, d):
    found = Progress().after(raw_log(spark, d))
    return spark.createDataFrame([(found.time_ns, ",".join(found.ids))], "time_ns bigint, ids string")


@query("SELECT o_orderkey AS orderkey, CAST(CASE WHEN row_number() OVER w = 1 THEN 1 ELSE lag(o_orderkey % 100) OVER w + 1 END AS INTEGER) AS aggregate_version FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def previous_version(spark, d):
    rows = order_log(spark, d).withColumn("aggregate_version", (F.col("id").cast("bigint") % 100).cast("int"))
    return entities.previous_version(rows).select(F.col("id").cast("bigint").alias("orderkey"), "aggregate_version")


@query(f"""
    WITH p AS (SELECT *, lag(l_linenumber) OVER w AS pv, lag(l_shipdate) OVER w AS pt, row_number() OVER w - 1 AS i FROM {_L} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, CAST(l_orderkey AS VARCHAR) || '-' || CAST(rn AS VARCHAR))),
    b AS (SELECT l_orderkey, arg_min(CASE WHEN l_linenumber <= 0 OR l_linenumber <= pv THEN 'version' ELSE 'time' END, i) AS kind FROM p WHERE l_linenumber <= 0 OR l_linenumber <= pv OR l_shipdate <= pt GROUP BY l_orderkey)
    SELECT coalesce(kind, 'consistent') AS kind, count(*) AS n FROM lineitem LEFT JOIN b USING (l_orderkey) GROUP BY 1""")
def entity_histories(spark, d):
    good, bad = entities.split_consistent(_lines(spark, d))
    return good.select(F.lit("consistent").alias("kind")).unionByName(bad.select("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _model() -> repository.Model:
    def seen(state, row):
        state["views"] += 1

    return repository.Model("views long", lambda: {"views": 0}, {"view": seen})


@query(f"SELECT CAST(user_id AS VARCHAR) AS aggregate_id, CAST(max(ver) AS INTEGER) AS version, count(*) FILTER (WHERE event_type = 'view') AS views FROM {V} WHERE user_id < 40 GROUP BY user_id")
def repository_save_and_query(spark, d):
    """Two saves with snapshots; then states fold from snapshots and equal those folded from all events."""
    repo = repository.Repository(log.EventLog(spark, new_folder(spark, "log")), _model(), new_folder(spark, "snapshots"), 25)
    rows = entities.monotone_times(user_log(spark, d).where(F.col("aggregate_id").cast("int") < 40)).select(*log.FIELDS)
    repo.save(rows.where("aggregate_version <= 30"))
    repo.save(rows.where("aggregate_version > 30"))
    snaps = repo.held_snapshots()
    out = repository.fold_from(entities.after_snapshots(repo.log.read(), snaps), entities.latest_snapshots(snaps), _model())
    whole = repo.query(EntityQuery(names=("user",)))
    return out.select("aggregate_id", "version", "views").intersect(whole.select("aggregate_id", "version", "views"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS aggregate_id, CAST(ver AS INTEGER) AS aggregate_version, ns AS time_ns FROM {V} WHERE ver % 10 = 0 AND user_id IN (1, 2, 3, 4) AND ver >= 20 AND ver <= 60 AND ns < {T1_NS}")
def snapshot_query(spark, d):
    q = SnapshotQuery(EntityQuery(("user",), ("1", "2", "3", "4"), Bounds(mins=(20,), maxs=(60,))), Bounds(maxs=(T1_NS - 1,)))
    return q.apply(_snapshots(user_log(spark, d), 10)).select("aggregate_id", "aggregate_version", "time_ns")


@query(f"SELECT CAST(user_id AS VARCHAR) AS aggregate_id, CAST(ver AS INTEGER) AS aggregate_version FROM {V} WHERE ver % 10 = 0 AND ns >= {T0_NS}")
def snapshot_cleanup(spark, d):
    return entities.fresh_snapshots(_snapshots(user_log(spark, d), 10), T0_NS).select("aggregate_id", "aggregate_version")


@query(f"SELECT CAST(user_id AS VARCHAR) AS aggregate_id, CAST(max(ver) AS INTEGER) AS version FROM {V} WHERE user_id BETWEEN 1 AND 9 GROUP BY user_id HAVING arg_max(event_type, ver) IN ('click', 'view')")
def entity_query_tags(spark, d):
    q = EntityQuery(("user",), ("1", "2", "3")).expand(ids=("4", "5"), tags=("click",), mins=(1,)).merge(EntityQuery(ids=("6", "7", "8", "9", "1"), tags=("view",)))
    return q.accepts(_folded_all(user_log(spark, d))).select("aggregate_id", "version")


def _folded_all(events: DataFrame) -> DataFrame:
    return entities.fold(events, tags=F.array(F.max_by("name", "aggregate_version")))


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type = 'click' AND value > 50 AND user_id <> 3")
def command_filter(spark, d):
    return commands(raw_log(spark, d), F.col("name") == "click", F.col("value") > 50, F.col("aggregate_id") != "3").select("id")


@query("""WITH o AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS custkey, coalesce(price, c_acctbal) AS amount FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0""")
def models_upsert(spark, d):
    models = log.Models(["custkey"], order="at")
    none = F.lit(None).cast("struct<a:timestamp_ntz,b:bigint>").alias("at")
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("amount"), none)
    saved = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("amount"), F.struct(F.col("o_orderdate").alias("a"), F.col("o_orderkey").alias("b")).alias("at"))
    now = models.upsert(held, saved)
    return models.delete(now, now.where("custkey % 7 = 0")).select("custkey", "amount")


@query(f"SELECT CAST(v.user_id AS VARCHAR) AS aggregate_id, json_extract_string(v.props, '$.k') AS value, CAST(o.user_id AS VARCHAR) AS owner FROM {V} v LEFT JOIN (SELECT value, arg_max(user_id, seen) AS user_id FROM {_LIVE} WHERE t <> 'error' GROUP BY value) o ON o.value = json_extract_string(v.props, '$.k') WHERE v.ver = 1")
def lookup_mapped(spark, d):
    k = F.get_json_object("props", "$.k")
    one = lambda op: F.array(F.struct(F.lit(op).alias("op"), F.lit("k").alias("key"), k.alias("value")))
    events = user_log(spark, d)
    names = ["click", "view", "purchase", "signup"]
    live = lookup.index(lookup.operations(events, {**{n: one("provide") for n in names}, "error": one("remove")}))
    return lookup.mapped(events.where("aggregate_version = 1").withColumn("value", k), "k", live, "owner").select("aggregate_id", "value", "owner")


@query("SELECT CAST(o_custkey AS VARCHAR) AS subject, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS ref_id, a AS action, CAST(1 AS BIGINT) AS n FROM orders, (VALUES ('read'), ('pay')) t(a) WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND a = 'read')")
def granter_grants(spark, d):
    rows = order_log(spark, d).withColumn("subject", F.col("aggregate_id"))
    rules = {"O": [(F.col("subject"), F.col("id"), "read"), (F.col("subject"), F.col("id"), "pay")], "F": [(F.col("subject"), F.col("id"), "read")]}
    return permissions.counted(permissions.granted_by(rows, rules)).select("subject", "ref_id", "action", "n")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type = 'error' THEN CAST(event_id % 5 AS INTEGER) ELSE 0 END AS code, CASE WHEN event_type = 'error' THEN 'no' ELSE event_type END AS message FROM events WHERE event_type IN ('error', 'view')")
def command_failures(spark, d):
    rows = raw_log(spark, d).where("name in ('error', 'view')")
    text = F.when(F.col("name") == "error", F.to_json(F.struct((F.col("id").cast("bigint") % 5).alias("code"), F.lit("no").alias("message")))).otherwise(F.col("name"))
    return repository.failures(rows.withColumn("error", text)).select("id", "failure.code", "failure.message")


@query("SELECT CAST(i // 40 AS VARCHAR) AS aggregate_id, CAST(i % 40 + 1 + (i % 40) // 4 AS INTEGER) AS aggregate_version, 1700000000000000000 + i * 1000 AS time_ns FROM range(2000) t(i)")
def generated_events(spark, d):
    return entities.shuffled(entities.generated(spark, 50, 40, skip=5), 3).select("aggregate_id", "aggregate_version", "time_ns")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'")
def quarantine_good_rows(spark, d):
    def step(row: dict) -> dict:
        if row["name"] == "error":
            raise ValueError("bad")
        return {"id": row["id"], "k": int(row["k"])}

    return quarantined(raw_log(spark, d).select("id", "name", F.get_json_object("props", "$.k").alias("k")), step, "id string, k long")[0]


@query("SELECT CAST(event_id AS VARCHAR) AS id, 'ValueError: bad' AS error FROM events WHERE event_type = 'error'")
def quarantine_bad_rows(spark, d):
    def step(row: dict) -> dict:
        if row["name"] == "error":
            raise ValueError("bad")
        return {"id": row["id"]}

    return quarantined(raw_log(spark, d).select("id", "name"), step, "id string")[1].select(F.get_json_object("row", "$.id").alias("id"), "error")


@query("SELECT CAST(event_id AS VARCHAR) AS of, CASE WHEN s = 1 THEN event_type ELSE 'before' END AS name, CAST(s AS INTEGER) AS last FROM events, (VALUES (0), (1)) t(s) WHERE s = 1 OR event_type = 'click'")
def before_events(spark, d):
    rows = raw_log(spark, d).select("id", "name", "time_ns")
    put = rows.where("name = 'click'").select(F.concat(F.lit("b"), "id").alias("id"), F.lit("before").alias("name"), "time_ns", F.col("id").alias("_of"), F.lit(0).alias("_nth"))
    return before_each(rows, put).select(F.col("_of").alias("of"), "name", (F.col("_sub") > 0).cast("int").alias("last"))


_SPACE_ID = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for object identifiers


@query(f"""WITH h AS (SELECT user_id, sha1(from_hex('{_SPACE_ID.hex}') || encode(CAST(user_id AS VARCHAR))) AS h FROM events GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS aggregate_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS workflow_id FROM h""")
def uuid_by_name(spark, d):
    rows = raw_log(spark, d).select("aggregate_id").distinct()
    return processes.correlated(rows, F.col("aggregate_id"), _SPACE_ID).select("aggregate_id", "workflow_id")


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type NOT IN ('click', 'view') AS lacks, event_type IN ('click', 'view') AS has, event_type = 'error' AS empty FROM events")
def action_lists(spark, d):
    have, wanted = F.array(F.lit("click"), F.lit("view"), F.lit("other")), F.array("name")
    text = F.when(F.col("name") == "error", "  ").otherwise(F.col("name"))
    return raw_log(spark, d).select("id", (F.size(missing(wanted, have)) > 0).alias("lacks"), (F.size(granted(wanted, have)) > 0).alias("has"), blank(text).alias("empty"))


@query("SELECT true AS same, false AS other")
def event_lists_equal(spark, d):
    rows = raw_log(spark, d).select(*_E)
    return spark.createDataFrame([(entities.same_events(rows, entities.shuffled(rows, 1)), entities.same_events(rows, rows.where("id <> '5'")))], "same boolean, other boolean")


def _snapshots(events: DataFrame, every: int) -> DataFrame:
    w = Window.partitionBy("aggregate_name", "aggregate_id").orderBy("aggregate_version")
    running = events.withColumn("state", F.sum(F.col("value").cast("decimal(18,4)")).over(w))
    return running.where(F.col("aggregate_version") % every == 0).select("aggregate_name", "aggregate_id", "aggregate_version", "time_ns", "state")


@query(f"SELECT CAST(user_id AS VARCHAR) AS aggregate_id, CAST(max(ver) AS INTEGER) AS aggregate_version, max(ns) AS time_ns FROM {V} WHERE ver % 10 = 0 AND ver <= 35 GROUP BY user_id")
def snapshot_latest_le_v(spark, d):
    return entities.latest_snapshots(_snapshots(user_log(spark, d), 10), 35).select("aggregate_id", "aggregate_version", "time_ns")


@query(f"SELECT CAST(user_id AS VARCHAR) AS aggregate_id, CAST(max(ver) AS INTEGER) AS version, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM {V} GROUP BY user_id")
def snapshot_resume_equals_full(spark, d):
    events = user_log(spark, d)
    snaps = entities.latest_snapshots(_snapshots(events, 25))
    rest = entities.fold(entities.after_snapshots(events, snaps), more=F.sum(F.col("value").cast("decimal(18,4)")))
    both = snaps.join(rest, entities.ENTITY, "full")
    return both.select("aggregate_id", F.coalesce("version", "aggregate_version").alias("version"), (F.coalesce("state", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("double").alias("total"))


@query(f"SELECT {ENV}, CAST(ver AS INTEGER) AS aggregate_version FROM {V} WHERE ver // 7 > (ver - 1) // 7")
def snapshot_schedule(spark, d):
    return user_log(spark, d).where(entities.snapshot_due(F.col("aggregate_version") - 1, F.col("aggregate_version"), 7)).select(*_E, "aggregate_version")


@query(f"SELECT CAST(user_id AS VARCHAR) AS aggregate_id, count(*) AS n FROM {V} WHERE user_id NOT IN (SELECT user_id FROM {V} WHERE event_type IN ('error', 'signup') GROUP BY user_id HAVING arg_max(event_type, ver) = 'error') GROUP BY user_id")
def soft_delete_live_entities(spark, d):
    return entities.live(user_log(spark, d), "error", "signup").groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("n"))


def _operations(spark, d) -> DataFrame:
    e = user_log(spark, d)
    return e.select("aggregate_name", "aggregate_id", F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value"), F.when(F.col("name") == "error", "remove").otherwise("provide").alias("op"), "time_ns", "id")


@query(f"SELECT CAST(user_id AS VARCHAR) AS aggregate_id, CASE WHEN t <> 'error' THEN value END AS value FROM {_LIVE}")
def lookup_forward(spark, d):
    ops = _operations(spark, d)
    return lookup.forward(ops.select("aggregate_name", "aggregate_id", "key").distinct(), lookup.index(ops)).select("aggregate_id", "value")


@query(f"SELECT value, CAST(arg_max(user_id, seen) AS VARCHAR) AS aggregate_id FROM {_LIVE} WHERE t <> 'error' GROUP BY value")
def lookup_reverse(spark, d):
    live = lookup.index(_operations(spark, d))
    return lookup.reverse(live.select("aggregate_name", "key", "value").distinct(), live).select("value", "aggregate_id")


@query("SELECT CAST(user_id AS VARCHAR) AS aggregate_id, min(epoch_us(ts) * 1000) AS first_ns FROM events WHERE event_type = 'click' GROUP BY user_id")
def job_aggregates(spark, d):
    return entities.first_ids(raw_log(spark, d).where("name = 'click'"), "user").select("aggregate_id", F.col("first.time_ns").alias("first_ns"))


@query("SELECT CAST(user_id AS VARCHAR) AS aggregate_id, epoch_us(ts) * 1000 AS first_ns FROM events ORDER BY ts, event_id LIMIT 1")
def job_first_aggregate(spark, d):
    return entities.first_ids(raw_log(spark, d), "user").limit(1).select("aggregate_id", F.col("first.time_ns").alias("first_ns"))


def _grants(spark, d) -> DataFrame:
    e = user_log(spark, d)
    return e.where("name in ('click', 'error', 'view')").select(F.col("aggregate_id").alias("subject"), F.lit("doc").alias("ref_name"), F.get_json_object("props", "$.k").alias("ref_id"), F.lit("read").alias("action"), F.when(F.col("name") == "click", 1).otherwise(-1).alias("delta"), F.col("aggregate_version").alias("position"))


_G = f"""(WITH c AS (SELECT user_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_type = 'click' THEN 1 ELSE -1 END AS x, ver FROM {V} WHERE event_type IN ('click', 'error', 'view')),
    s AS (SELECT *, sum(x) OVER (PARTITION BY user_id, k ORDER BY ver) AS s FROM c)
    SELECT CAST(user_id AS VARCHAR) AS subject, coalesce(k, '') AS ref_id, CAST(sum(x) - least(0, min(s)) AS BIGINT) AS n FROM s GROUP BY user_id, k HAVING sum(x) - least(0, min(s)) > 0)"""


@query(f"SELECT subject, ref_id, n FROM {_G}")
def acl_refcount(spark, d):
    return permissions.counted(_grants(spark, d)).select("subject", "ref_id", "n")


@query(f"SELECT DISTINCT CAST(e.user_id AS VARCHAR) AS subject, json_extract_string(e.props, '$.k') AS ref_id FROM events e JOIN {_G} g ON g.subject = CAST(e.user_id AS VARCHAR) AND g.ref_id = json_extract_string(e.props, '$.k') WHERE event_type = 'purchase'")
def acl_allows(spark, d):
    probes = raw_log(spark, d).where("name = 'purchase'").select(F.col("aggregate_id").alias("subject"), F.lit("doc").alias("ref_name"), F.get_json_object("props", "$.k").alias("ref_id"), F.lit("read").alias("action"))
    return permissions.allowed(probes, permissions.counted(_grants(spark, d))).select("subject", "ref_id")


@query(f"SELECT m.member AS subject, g.ref_id, count(*) AS n FROM (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS role, 'm' || CAST(s_suppkey AS VARCHAR) AS member FROM supplier WHERE s_suppkey % 5 <> 0) m JOIN {_G} g ON g.subject = m.role GROUP BY ALL UNION ALL SELECT subject, ref_id, n FROM {_G}")
def acl_role_members(spark, d):
    give = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("role"), F.concat(F.lit("m"), "s_suppkey").alias("member"), F.lit("give").alias("op"), F.lit(1).alias("position"))
    taken = give.where(F.substring("member", 2, 20).cast("bigint") % 5 == 0)
    changes = give.unionByName(taken.withColumn("op", F.lit("remove")).withColumn("position", F.lit(2)))
    grants = permissions.counted(_grants(spark, d))
    return permissions.with_roles(grants, grants, permissions.members(changes)).select("subject", "ref_id", F.col("n"))


_CMD = "user_id * 1000 + CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"SELECT DISTINCT {_CMD} AS effect_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = 'purchase' AND f.user_id = e.user_id AND json_extract_string(f.props, '$.k') = json_extract_string(e.props, '$.k'))")
def pending_effects(spark, d):
    rows = raw_log(spark, d).withColumn("effect_id", F.col("aggregate_id").cast("bigint") * 1000 + F.get_json_object("props", "$.k").cast("bigint"))
    return processes.pending_commands(rows.where("name = 'click'"), rows.where("name = 'purchase'")).select("effect_id").distinct()


@query(f"""SELECT {_CMD} AS command_id, coalesce(min(CASE WHEN event_type = 'signup' THEN epoch_us(ts) * 1000 END), -1) AS dispatched_ns, coalesce(min(CASE WHEN event_type = 'view' THEN epoch_us(ts) * 1000 END), -1) AS accepted_ns,
    coalesce(min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) * 1000 END), -1) AS executed_ns, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'succeeded' ELSE 'open' END AS status FROM events GROUP BY 1""")
def command_lifecycle(spark, d):
    stage = F.when(F.col("name") == "signup", "dispatched").when(F.col("name") == "view", "accepted").when(F.col("name") == "purchase", "executed")
    rows = raw_log(spark, d).select((F.col("aggregate_id").cast("bigint") * 1000 + F.get_json_object("props", "$.k").cast("bigint")).alias("command_id"), stage.alias("kind"), "time_ns", F.lit(None).cast("string").alias("error"))
    return processes.command_lifecycle(rows).select("command_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("dispatched_ns", "accepted_ns", "executed_ns")], "status")


@query(f"""SELECT CAST(user_id AS VARCHAR) AS workflow_id, CAST(count(DISTINCT CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') END) AS INTEGER) AS triggers,
    CASE WHEN count(*) FILTER (WHERE event_type = 'signup') = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE event_type IN ('purchase', 'error')) = 0 THEN 'running'
    WHEN arg_min(event_type, ver) FILTER (WHERE event_type IN ('purchase', 'error')) = 'purchase' THEN 'completed' ELSE 'failed' END AS phase FROM {V} GROUP BY user_id""")
def workflow_state(spark, d):
    kind = F.when(F.col("name") == "signup", "started").when(F.col("name") == "click", "trigger").when(F.col("name") == "purchase", "completed").when(F.col("name") == "error", "failed")
    rows = processes.correlated(user_log(spark, d)).select("workflow_id", kind.alias("kind"), F.get_json_object("props", "$.k").alias("ref"), F.col("aggregate_version").alias("position"))
    return processes.workflow_states(rows).select("workflow_id", "triggers", "phase")


@query(f"SELECT {ENV} FROM {V} WHERE ns >= {_LOW} AND event_id NOT IN (100, 700)")
def progress_resume(spark, d):
    """What is left after the events at an instant, of which one was applied (both bounds are events)."""
    rows = raw_log(spark, d)
    return Progress(_times(spark, d, 100, 700)[0], ("100", "700")).remaining(rows).where("id not in ('100', '700')").select(*_E)


@query("SELECT CAST(o_custkey AS VARCHAR) AS aggregate_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS aggregate_version, o_orderkey AS orderkey FROM orders")
def version_numbering(spark, d):
    return order_log(spark, d).select("aggregate_id", "aggregate_version", F.col("id").cast("bigint").alias("orderkey"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) * 1000 AS ns, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
    SELECT o_orderkey AS orderkey, CAST(max(ns - n) OVER (PARTITION BY o_custkey ORDER BY n) + n AS BIGINT) AS time_ns FROM o""")
def monotone_times(spark, d):
    return entities.monotone_times(order_log(spark, d)).select(F.col("id").cast("bigint").alias("orderkey"), "time_ns")


@query("SELECT 'user(' || CAST(user_id AS VARCHAR) || ')' AS ref, 'user' AS name, CAST(user_id AS VARCHAR) AS id FROM events GROUP BY user_id")
def ref_round_trip(spark, d):
    refs = raw_log(spark, d).select(reference(F.col("aggregate_name"), F.col("aggregate_id")).alias("ref")).distinct()
    return refs.select("ref", parse_reference(F.col("ref")).alias("r")).select("ref", "r.name", "r.id")


@query(f"SELECT {ENV} FROM {V} WHERE (event_type = 'click' AND value > 50) OR event_type = 'view'")
def guarded_events(spark, d):
    return processes.guarded(raw_log(spark, d), {"click": F.col("value") > 50, "view": F.lit(True)}).select(*_E)


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'")
def payload_decode(spark, d):
    codec = log.Codec()
    codec.register("click", "k long")
    return codec.decode(raw_log(spark, d).withColumn("data", F.col("props")), "click").select("id", "payload.k")
