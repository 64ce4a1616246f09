"""Shared pieces of the registered queries and of the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import usage

STOP_LIST = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_runs(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '\\P{{L}}+'), lambda w: w <> '')"


def sql_words(c: str) -> str:
    return f"list_filter({sql_runs(c)}, lambda w: strlen(w) >= 2 AND NOT list_contains({STOP_LIST}, w))"


def sql_path(c: str) -> str:
    return sql_words(f"translate({c}, '/-_.*', '     ')")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage log that the events stand for."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    before = F.floor(F.col("value") * 100).cast("long")
    saved = F.floor(before * k / 100.0).cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("command"), F.col("user_id").cast("string").alias("session"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("recorded_at"), k.alias("duration_ms"),
        before.alias("token_before"), (before - saved).alias("token_after"), saved.alias("token_saved"),
        F.when(before == 0, F.lit(0.0)).otherwise(100.0 * saved / before).alias("reduction_pct"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("read:"), "event_type")).otherwise("").alias("matched_filter"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"),
    )


assert usage.SCHEMA.startswith("id long")

SQL_RUNS = """runs AS (
  SELECT *, token_before - token_saved AS token_after, CASE WHEN token_before = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * token_saved / token_before END AS reduction_pct
  FROM (SELECT *, CAST(floor(token_before * duration_ms / 100.0::DOUBLE) AS BIGINT) AS token_saved
    FROM (SELECT event_id AS id, event_type AS command, CAST(user_id AS VARCHAR) AS session, CAST(floor(epoch(ts)) AS BIGINT) AS recorded_at,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS duration_ms, CAST(floor(value * 100) AS BIGINT) AS token_before,
      CASE WHEN event_id % 2 = 0 THEN 'read:' || event_type ELSE '' END AS matched_filter, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code FROM events)))"""
