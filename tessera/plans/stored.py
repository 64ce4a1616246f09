"""Queries that go through documents, versions and observed sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import observe, usage
from tessera.plans.common import SQL_RUNS, runs, table
from tessera.plans.workspace import _GRAPH, edges, nodes
from tessera.sources import document, store

_CHUNK = document.CHUNK


def _folder(spark, name: str) -> str:
    return f"{store.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def graph_document(spark, d):
    """The hash tree of the graph's document."""
    lines = document.placed(document.elements(document.graph_lists(nodes(spark, d), edges(spark, d))))
    return document.hash_tree(lines)


def document_read(spark, d):
    """The graph written as a document and read back by splits: every edge with the types of its ends."""
    path = _folder(spark, "document")
    document.write_document(nodes(spark, d), edges(spark, d), path)
    lists, _ = document.read_document(spark, path, {"nodes": "id string, type string, file string, name string", "edges": "`from` string, `to` string, type string"})
    kinds = lists["nodes"].select("id", "type")
    met = lists["edges"].join(kinds.select(F.col("id").alias("to"), F.col("type").alias("to_type")), "to", "left")
    return met.groupBy("type", F.coalesce("to_type", F.lit("")).alias("to_type")).agg(F.count("*").alias("n"), F.max("from").alias("last"))


def _marks(spark, d):
    """Signups begin a session of their user, purchases end it."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "stop")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session"), F.col("event_id").alias("order"))


def runs_observed(spark, d):
    """The totals of every observed session; a user's runs are its events."""
    found = store.settled(observe.sessions(_marks(spark, d)))
    watched = observe.observed(runs(spark, d).withColumnRenamed("session", "key"), found)
    return observe.reports(watched, found).select("key", "session", "started", F.coalesce("stopped", F.lit(-1)).alias("stopped"), "invocations", "token_before", "token_saved", F.round("reduction_pct_avg", 6).alias("reduction_pct_avg"))


def runs_versioned(spark, d):
    """The log after appends in batches, one of them replayed, and a prune; summed by command."""
    path, log = _folder(spark, "runs"), runs(spark, d)
    days = F.floor(F.col("recorded_at") / 86_400).cast("int")
    span = log.agg(F.min(days).alias("a"), F.max(days).alias("b"), F.max("recorded_at").alias("last")).first()
    middle = (span.a + span.b) // 2
    store.append_runs(log.filter(days <= middle), path, ("days", 0))
    store.append_runs(log.filter(days > middle), path, ("days", 1))
    store.append_runs(log.filter(days > middle), path, ("days", 1))
    store.prune_runs(spark, path, 10, span.last)
    return usage.by_command(store.open_runs(spark, path)).select("command", "invocations", "token_saved")


QUERIES = {"graph_document": graph_document, "document_read": document_read, "runs_observed": runs_observed, "runs_versioned": runs_versioned}

_LINES = f"""{_GRAPH}, l0 AS (
  SELECT 'nodes' AS list, row_number() OVER (ORDER BY id, line) - 1 AS place, line FROM (SELECT id, '{{"file":"' || file || '","id":"' || id || '","name":"' || name || '","type":"' || type || '"}}' AS line FROM nodes)
  UNION ALL SELECT 'edges', row_number() OVER (ORDER BY "from", "to", type, line) - 1, line FROM (SELECT *, '{{"from":"' || "from" || '","to":"' || "to" || '","type":"' || type || '"}}' AS line FROM edges))"""


def _level(n: int) -> str:
    """Leaves of a level of the tree, while the level below has more than one."""
    return f"l{n + 1} AS (SELECT list, place // {_CHUNK} AS place, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY place)) AS line FROM l{n} {'' if not n else f'WHERE (SELECT max(place) FROM l{n}) > 0'} GROUP BY ALL)"


ORACLE_SQL = {
    "graph_document": f"WITH {_LINES}, {', '.join(_level(n) for n in range(4))} " + " UNION ALL ".join(f"SELECT {n} AS level, list, place AS chunk, n, line AS digest FROM l{n + 1}" for n in range(4)),
    "document_read": f"""WITH {_GRAPH} SELECT e.type, coalesce(n.type, '') AS to_type, count(*) AS n, max("from") AS last FROM edges e LEFT JOIN nodes n ON n.id = e."to" GROUP BY ALL""",
    "runs_observed": f"""WITH {SQL_RUNS}, m AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type, event_id FROM events WHERE event_type IN ('signup', 'purchase')),
w AS (SELECT *, lag(event_type) OVER o AS before, min(CASE WHEN event_type = 'purchase' THEN t END) OVER (PARTITION BY key ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stopped FROM m WINDOW o AS (PARTITION BY key ORDER BY t, event_id)),
s AS (SELECT key, 's' || event_id AS session, t AS started, stopped FROM w WHERE event_type = 'signup' AND coalesce(before, 'purchase') = 'purchase')
SELECT key, s.session, started, coalesce(stopped, -1) AS stopped, count(id) AS invocations, CAST(coalesce(sum(token_before), 0) AS BIGINT) AS token_before, CAST(coalesce(sum(token_saved), 0) AS BIGINT) AS token_saved, round(coalesce(avg(reduction_pct), 0), 6) AS reduction_pct_avg
FROM s LEFT JOIN runs ON runs.session = key AND recorded_at >= started AND (stopped IS NULL OR recorded_at < stopped) GROUP BY ALL""",
    "runs_versioned": f"WITH {SQL_RUNS} SELECT command, count(*) AS invocations, CAST(sum(token_saved) AS BIGINT) AS token_saved FROM runs WHERE recorded_at >= (SELECT max(recorded_at) FROM runs) - 864000 GROUP BY 1",
}
