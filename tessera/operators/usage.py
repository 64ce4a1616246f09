"""Usage log: scans, migrations, and reports by period, command, filter and exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "id long, command string, session string, recorded_at long, duration_ms long, token_before long, token_after long, token_saved long, reduction_pct double, matched_filter string, exit_code int"


def scan(runs: DataFrame, since: int | None = None, command: str | None = None, session: str | None = None, limit: int | None = None) -> DataFrame:
    """Runs from an epoch on, with a command part (case of ASCII letters is ignored, % and _ match as in LIKE), of a
    session; newest first, then highest id."""
    out = runs
    if since:
        out = out.filter(F.col("recorded_at") >= since)
    if command:
        out = out.filter(F.col("command").ilike(f"%{command}%"))
    if session:
        out = out.filter(F.col("session") == session)
    out = out.orderBy(F.desc("recorded_at"), F.desc("id"))
    return out.limit(limit) if limit and limit > 0 else out


def since_days(runs: DataFrame, days: int, now: int) -> DataFrame:
    """Runs of the last days before the epoch now; 0 keeps all."""
    return runs if days <= 0 else runs.filter(F.col("recorded_at") >= now - 86_400 * days)


def pruned(runs: DataFrame, days: int, now: int) -> DataFrame:
    """What is left after the retention delete."""
    return since_days(runs, days, now)


def removed(runs: DataFrame, days: int, now: int) -> DataFrame:
    """What the retention delete takes away."""
    return runs.filter(F.lit(days > 0) & ~F.coalesce(F.col("recorded_at") >= now - 86_400 * days, F.lit(False)))


def with_session(runs: DataFrame) -> DataFrame:
    """Adds the session column of later versions; '' where there is none."""
    has = "session" in runs.columns
    return runs.withColumn("session", F.coalesce("session", F.lit("")) if has else F.lit(""))


def with_dotted_filters(runs: DataFrame) -> DataFrame:
    """read:x becomes read.x."""
    return runs.withColumn("matched_filter", F.regexp_replace("matched_filter", "^read:", "read."))


def summary(runs: DataFrame) -> DataFrame:
    """One row of totals; zeros for no run."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return runs.agg(
        F.count("*").alias("invocations"), zero(F.sum("token_before")).alias("token_before"), zero(F.sum("token_after")).alias("token_after"), zero(F.sum("token_saved")).alias("token_saved"),
        F.coalesce(F.avg("reduction_pct"), F.lit(0.0)).alias("reduction_pct_avg"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("duration_ms_avg"),
    )


def period_label(epoch: Column, period: str = "daily") -> Column:
    """UTC day, ISO week or month of an epoch."""
    ts = F.timestamp_seconds(epoch)
    if period == "weekly":
        return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM" if period == "monthly" else "yyyy-MM-dd")


def breakdown(runs: DataFrame, key: Column, name: str) -> DataFrame:
    """Runs, tokens saved and mean reduction for each value of key."""
    return runs.groupBy(key.alias(name)).agg(F.count("*").alias("invocations"), F.sum("token_saved").alias("token_saved"), F.avg("reduction_pct").alias("reduction_pct_avg"))


def trend(runs: DataFrame, period: str = "daily") -> DataFrame:
    return breakdown(runs, period_label(F.col("recorded_at"), period), "label")


def by_command(runs: DataFrame) -> DataFrame:
    return breakdown(runs, F.col("command"), "command")


def by_filter(runs: DataFrame) -> DataFrame:
    return breakdown(runs, F.when(F.coalesce("matched_filter", F.lit("")) == "", "unknown").otherwise(F.col("matched_filter")), "matched_filter")


def by_exit(runs: DataFrame) -> DataFrame:
    return runs.groupBy("exit_code").agg(F.count("*").alias("invocations"))


def top_savers(runs: DataFrame, n: int = 5) -> DataFrame:
    return by_command(runs).orderBy(F.desc("token_saved"), "command").limit(n)


def top_reducers(runs: DataFrame, n: int = 5) -> DataFrame:
    return by_command(runs).orderBy(F.desc("reduction_pct_avg"), F.desc("invocations"), "command").limit(n)


def envelope(before: Column, after: Column) -> dict[str, Column]:
    """Tokens saved and the reduction in per cent; 0 where there was nothing."""
    saved = before - after
    return {"token_saved": saved, "reduction_pct": F.when(before == 0, 0.0).otherwise(100.0 * saved / before)}
