"""Shared pieces of the training-data operators: lineage cuts, Arrow streaming, skew-safe lookups."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only by local sessions that name no checkpoint folder (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tessera"
#: Most rows of a table that is broadcast after it was counted; the tables hold a few numbers and names a row.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local session may be without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or LOCAL_CHECKPOINTS


def cut(df: DataFrame, clean: bool = True) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that lost executors cost no recomputation; clean:
    let files of earlier cuts go that nothing refers to any more."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    if clean:
        free(spark)
    return out


def written(df: DataFrame, path: str) -> DataFrame:
    """df as read back from Parquet files in path, which go when the application ends."""
    spark = df.sparkSession
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of written()."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keyed(df: DataFrame) -> DataFrame:
    """doc (a struct of all columns of df, so that no name clashes) and row, a number of its own for each row, written to
    the shared folder, so that every later read finds the same."""
    rows = df.select(packed(df).alias("doc")).withColumn("row", F.monotonically_increasing_id())
    return written(rows, f"{shared_folder(df.sparkSession)}/keyed-{uuid.uuid4().hex}")


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct, whatever their names."""
    return F.struct(*[quoted_column(c).alias(c) for c in df.columns])


def quoted_column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def unpacked(df: DataFrame, doc: str = "doc") -> DataFrame:
    """The columns of the struct doc."""
    return df.select(f"{doc}.*")


def free(spark: SparkSession) -> None:
    """Lets the driver drop what nothing refers to: plans, and shuffle and checkpoint files of earlier rounds.

    Spark deletes such files when the driver's garbage is collected, which by itself may take half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table, marked for broadcast if it has no more rows than that; the result of a join is the same."""
    return F.broadcast(df) if df.count() <= most else df


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Map every Arrow batch of df with fn; Spark bounds a batch by rows and by bytes (64 MB), but for a single row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def fold(id_col: str | Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; false for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_sample(rows: DataFrame, id_col: str, group_col: str, most: int) -> DataFrame:
    """id, group, k of at most that many different ids of each group: those with the smallest hashes, k from 1.

    A cut at four times the expected hash comes before the ranking, so that the ranking gets some thousands of rows of a
    group, however many there are.  Only ids and groups are read.
    """
    own = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("group")).withColumn("h", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)))
    sizes = cut(own.groupBy("group").agg(F.approx_count_distinct("id").alias("n")))
    near = own.join(few(sizes), "group").filter(F.col("h") / float(1 << 40) * F.col("n") <= 4.0 * most).select("id", "group", "h").distinct()
    w = Window.partitionBy("group").orderBy("h", "id")
    return cut(near.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("id", "group", "k"))


def sampled(rows: DataFrame, chosen: DataFrame, most: int, by: list[str]) -> DataFrame:
    """group, k, text of the different rows (id, text, and group if it is in by) of a sample, written once; at most that
    many rows of a group, also where ids repeat."""
    own = rows.join(few(chosen), by).groupBy("group", "k", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    w = Window.partitionBy("group").orderBy("k", "h")
    return cut(own.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= most).select("group", "k", "text"))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, hot_share: int = 500, total: int | None = None, most: int | None = None) -> DataFrame:
    """Left join of right, unique on key, where a few keys may hold most rows of left.

    weight: a column of right with the number of rows that left has of the key; total: the number of left's rows, if
    known; most: the number of rows of its most frequent key, if known and left has no row without a key.  Keys with more
    than a hot_share-th of all rows are fewer than hot_share (a proven bound): they are broadcast and their rows of left,
    and those without a key, are not shuffled.  left is read three times then, so it should be a written table.
    """
    if total is None:
        total = right.agg(F.sum(weight).alias("n")).first()["n"] or 0
    limit = max(64, total // hot_share)
    rest = [c for c in right.columns if c not in (key, weight)]
    named = right.select(F.col(key).alias("_key"), weight, *[F.col(c).alias(f"_r_{c}") for c in rest])
    if most is not None and most <= limit:
        return left.join(named.drop(weight), F.col(key) == F.col("_key"), "left").select(*left.columns, *[F.col(f"_r_{c}").alias(c) for c in rest])
    hot, cold = named.filter(F.col(weight) > limit).drop(weight), named.filter(F.col(weight) <= limit).drop(weight)
    out = [*left.columns, *[F.col(f"_r_{c}").alias(c) for c in rest]]
    frequent = left.join(F.broadcast(hot), F.col(key) == F.col("_key")).select(*out)
    others = left.filter(F.col(key).isNotNull()).join(F.broadcast(hot.select("_key")), F.col(key) == F.col("_key"), "left_anti")
    many = others.join(cold, F.col(key) == F.col("_key"), "left").select(*out)
    kinds = dict(right.dtypes)
    without = left.filter(F.col(key).isNull()).select(*left.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in rest])
    return frequent.unionAll(many).unionAll(without)
