"""Tables on disk: graph and overlay JSON, the usage log, keyed caches, logs, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.operators import usage
from tessera.sources.versions import Versions

#: Used only where a local session names no checkpoint folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tessera"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which only local sessions may leave unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL_CHECKPOINTS


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that all executors share, and read from there: no plan behind it, nothing to
    recompute."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and (schema_version, content_hash) of one JSON document."""
    whole = spark.read.json(path, multiLine=True)
    meta = whole.select(*[c for c in ("schema_version", "content_hash") if c in whole.columns])
    return whole.select(F.inline("nodes")), whole.select(F.inline("edges")), meta


def write_table(rows: DataFrame, path: str, by: list[str] | None = None, order: list[str] | None = None) -> None:
    """Parquet; Spark's commit puts it in place as a whole.  order: sorts within files, by: partitions."""
    out = rows.sortWithinPartitions(*order) if order else rows
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(rows: DataFrame, path: str, order: list[str]) -> None:
    """Sorted JSON lines, for a reader of files."""
    rows.orderBy(*order).write.mode("overwrite").json(path)


def read_overlay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Concepts, edges and meta of an overlay; None where there is none."""
    if not exists(spark, path):
        return None
    whole = spark.read.json(path, multiLine=True)
    return whole.select(F.inline("concepts")), whole.select(F.inline("edges")), whole.select("schema_version", "graph_hash", "model", "generated_at")


def _log(spark: SparkSession, path: str) -> Versions:
    """The usage log; files of a log without versions become its first one."""
    log = Versions(spark, path)
    if not log.numbers() and exists(spark, path) and log.plain():
        log.replace(spark.read.option("mergeSchema", "true").parquet(path), 0, "taken over")
    return log


def open_runs(spark: SparkSession, path: str) -> DataFrame:
    """The usage log: an empty one where there is none, files without a session column read with ''."""
    return usage.with_dotted_filters(usage.with_session(_log(spark, path).read(usage.SCHEMA)))


def append_runs(rows: DataFrame, path: str, batch: tuple[str, int] | None = None) -> bool:
    """Adds runs in one step; a batch (stream, number) that the log has already is left out, and false comes back."""
    return _log(rows.sparkSession, path).append(rows, batch)


def prune_runs(spark: SparkSession, path: str, days: int, now: int) -> int:
    """Puts a version of the log without runs older than days in place of the newest; returns how many went.

    The count comes with the write; a version that another writer put meanwhile raises a Conflict and loses nothing.
    """
    log = _log(spark, path)
    number = log.manifest()["number"]
    before = usage.with_dotted_filters(usage.with_session(log.read(usage.SCHEMA, number)))
    gone = usage.removed(before, days, now).count()
    if gone:
        log.replace(usage.pruned(before, days, now), number, f"pruned {gone}")
    return gone


def cache_key(path, content, model):
    """The key of a cached classification."""
    return F.sha2(F.concat_ws("\u0000", path, content, model).cast("binary"), 256)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A keyed table; an unreadable or missing one is empty."""
    try:
        return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def put_cache(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """old with new entries, which win."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def append_log(rows: DataFrame, path: str) -> None:
    """Tab-separated lines."""
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.mode("append").text(path)


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Requested files (path) that are not there; - is the standard input, once."""
    return wanted.filter("path <> '-'").distinct().join(found.select("path"), "path", "left_anti")


def piped(rows: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """Rows (id, text) whose text is within the limit of a pipe."""
    return rows.filter(F.octet_length("text") <= most_bytes)


def refused(rows: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """id, error of the rows (id, text) that a pipe refuses."""
    return rows.filter(F.octet_length("text") > most_bytes).select("id", F.lit(f"input exceeds {most_bytes} byte limit").alias("error"))


def kept_raw(rows: DataFrame, mode: str = "failure") -> DataFrame:
    """Captured outputs that are kept as they are: after failure, always or never."""
    if mode == "always":
        return rows
    return rows.filter(F.col("exit_code") != 0) if mode == "failure" else rows.limit(0)
