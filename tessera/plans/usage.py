"""Usage-log queries over the log that the events stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import usage
from tessera.plans.common import SQL_RUNS, runs

_AGG = "count(*) AS invocations, CAST(sum(token_saved) AS BIGINT) AS token_saved, avg(reduction_pct) AS reduction_pct_avg"
_ALL = "id, command, session, recorded_at, duration_ms, token_before, token_after, token_saved, reduction_pct, matched_filter, exit_code"


def _sql(body: str) -> str:
    return f"WITH {SQL_RUNS}\n{body}"


def _recent(spark, d):
    r = runs(spark, d)
    # the newest run is the clock, so that every scale has rows on both sides of the cut
    now = r.agg(F.max("recorded_at").alias("m")).first()["m"]
    return r, now


def retained(spark, d):
    r, now = _recent(spark, d)
    return usage.since_days(r, 7, now).select(*_ALL.split(", "))


def pruned(spark, d):
    r, now = _recent(spark, d)
    return usage.removed(r, 7, now).groupBy("command").agg(F.count("*").alias("removed"))


QUERIES = {
    "usage_summary": lambda s, d: usage.summary(runs(s, d)),
    "usage_trend_day": lambda s, d: usage.trend(runs(s, d), "daily"),
    "usage_trend_week": lambda s, d: usage.trend(runs(s, d), "weekly"),
    "usage_trend_month": lambda s, d: usage.trend(runs(s, d), "monthly"),
    "usage_by_command": lambda s, d: usage.by_command(runs(s, d)),
    "usage_by_filter": lambda s, d: usage.by_filter(runs(s, d)),
    "usage_by_exit": lambda s, d: usage.by_exit(runs(s, d)),
    "top_savers": lambda s, d: usage.top_savers(runs(s, d)),
    "top_reducers": lambda s, d: usage.top_reducers(runs(s, d)),
    "runs_scan": lambda s, d: usage.scan(runs(s, d), command="CLI", limit=50).select("id", "command", "recorded_at", "token_saved"),
    "runs_session": lambda s, d: usage.scan(runs(s, d), session="7").select("id", "command", "session", "recorded_at"),
    "runs_retention": retained,
    "runs_prune": pruned,
    "runs_migrate": lambda s, d: usage.with_dotted_filters(usage.with_session(runs(s, d).drop("session"))).select("id", "session", "matched_filter"),
    "token_reduction": lambda s, d: runs(s, d).select("id", *[c.alias(n) for n, c in usage.envelope(F.col("token_before"), F.col("token_after")).items()]),
}
ORACLE_SQL = {
    "usage_summary": _sql("SELECT count(*) AS invocations, CAST(coalesce(sum(token_before), 0) AS BIGINT) AS token_before, CAST(coalesce(sum(token_after), 0) AS BIGINT) AS token_after, CAST(coalesce(sum(token_saved), 0) AS BIGINT) AS token_saved, coalesce(avg(reduction_pct), 0) AS reduction_pct_avg, coalesce(avg(duration_ms), 0) AS duration_ms_avg FROM runs"),
    "usage_trend_day": _sql(f"SELECT strftime(make_timestamp(recorded_at * 1000000), '%Y-%m-%d') AS label, {_AGG} FROM runs GROUP BY 1"),
    "usage_trend_week": _sql(f"SELECT strftime(make_timestamp(recorded_at * 1000000), '%G-W%V') AS label, {_AGG} FROM runs GROUP BY 1"),
    "usage_trend_month": _sql(f"SELECT strftime(make_timestamp(recorded_at * 1000000), '%Y-%m') AS label, {_AGG} FROM runs GROUP BY 1"),
    "usage_by_command": _sql(f"SELECT command, {_AGG} FROM runs GROUP BY 1"),
    "usage_by_filter": _sql(f"SELECT CASE WHEN matched_filter = '' THEN 'unknown' ELSE matched_filter END AS matched_filter, {_AGG} FROM runs GROUP BY 1"),
    "usage_by_exit": _sql("SELECT exit_code, count(*) AS invocations FROM runs GROUP BY 1"),
    "top_savers": _sql(f"SELECT command, {_AGG} FROM runs GROUP BY 1 ORDER BY token_saved DESC, command LIMIT 5"),
    "top_reducers": _sql(f"SELECT command, {_AGG} FROM runs GROUP BY 1 ORDER BY reduction_pct_avg DESC, invocations DESC, command LIMIT 5"),
    "runs_scan": _sql("SELECT id, command, recorded_at, token_saved FROM runs WHERE command ILIKE '%CLI%' ORDER BY recorded_at DESC, id DESC LIMIT 50"),
    "runs_session": _sql("SELECT id, command, session, recorded_at FROM runs WHERE session = '7'"),
    "runs_retention": _sql(f"SELECT {_ALL} FROM runs WHERE recorded_at >= (SELECT max(recorded_at) FROM runs) - 7 * 86400"),
    "runs_prune": _sql("SELECT command, count(*) AS removed FROM runs WHERE recorded_at < (SELECT max(recorded_at) FROM runs) - 7 * 86400 GROUP BY 1"),
    "runs_migrate": _sql("SELECT id, '' AS session, regexp_replace(matched_filter, '^read:', 'read.') AS matched_filter FROM runs"),
    "token_reduction": _sql("SELECT id, token_saved, reduction_pct FROM runs"),
}
