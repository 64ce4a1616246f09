"""Observed sessions: start and stop marks, and the runs that fall between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.bm25 import broadcast_if_small

#: Cells are 1, 16, 256, ... seconds wide; an open session ends at FOREVER.
BASE, LEVELS = 16, 9
FOREVER = BASE**LEVELS


def sessions(marks: DataFrame) -> DataFrame:
    """key, session, started, stopped (null while it is open) of marks (key, at, kind, session, order).

    Marks of a key follow each other by at, then order.  A start while a session is open and a stop while none is count for
    nothing: a session begins at a start that is the first mark or comes after a stop, and ends at the next stop.
    """
    w = Window.partitionBy("key").orderBy("at", "order")
    later = w.rowsBetween(1, Window.unboundedFollowing)
    known = marks.filter(F.col("kind").isin("start", "stop") & F.col("key").isNotNull() & F.col("at").isNotNull())
    seen = known.withColumns({"before": F.lag("kind").over(w), "stopped": F.first(F.when(F.col("kind") == "stop", F.col("at")), ignorenulls=True).over(later)})
    return seen.filter((F.col("kind") == "start") & (F.coalesce("before", F.lit("stop")) == "stop")).select("key", "session", F.col("at").alias("started"), "stopped")


def _cells(start: Column, stop: Column) -> Column:
    """The fewest cells (level, n) that make up [start, stop), from 0 on: at each level those that no wider cell holds."""

    def up(x: Column, level: Column) -> Column:
        return F.ceil(x / F.pow(F.lit(BASE), level)).cast("long")

    def down(x: Column, level: Column) -> Column:
        return F.floor(x / F.pow(F.lit(BASE), level)).cast("long")

    def numbers(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<long>"))

    def of(level: Column) -> Column:
        a, b = up(start, level), down(stop, level)
        wide_a, wide_b = up(start, level + 1) * BASE, down(stop, level + 1) * BASE
        own = F.when(wide_a < wide_b, F.concat(numbers(a, wide_a), numbers(wide_b, b))).otherwise(numbers(a, b))
        return F.transform(own, lambda n: F.struct(level.alias("level"), n.alias("n")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of))


def observed(runs: DataFrame, found: DataFrame, key: str = "key", at: str = "recorded_at") -> DataFrame:
    """runs with the session of found (sessions()) that was open at their time: started <= at < stopped; others are left out.

    Every session is cut into the cells of a fixed tree of times, a run looks up the cells around it, one a level: a join on
    equality, with no product of a busy key's runs and sessions.  The driver gets the levels in use, ten numbers at most.
    """
    cut = found.select(F.col("key").alias("_key"), "session", "started", "stopped", F.explode(_cells(F.col("started"), F.coalesce("stopped", F.lit(FOREVER)))).alias("c"))
    cut = cut.select("_key", "session", "started", "stopped", F.col("c.level").alias("_level"), F.col("c.n").alias("_n"))
    levels = sorted(r._level for r in cut.select("_level").distinct().collect())
    place = F.array(*[F.struct(F.lit(x).alias("level"), F.floor(F.col(at) / F.lit(BASE**x)).cast("long").alias("n")) for x in levels])
    looked = runs.withColumn("_cell", F.explode(place) if levels else F.lit(None).cast("struct<level:int,n:long>")).withColumns({"_level": F.col("_cell.level"), "_n": F.col("_cell.n")}).drop("_cell")
    own = [c for c in runs.columns if c not in ("session", "started", "stopped")]
    return looked.drop("session", "started", "stopped").join(broadcast_if_small(cut), (F.col(key) == F.col("_key")) & (looked._level == cut._level) & (looked._n == cut._n)).select(*own, "session", "started", "stopped")


def reports(watched: DataFrame, found: DataFrame) -> DataFrame:
    """key, session, started, and the totals of each session, zeros for one without runs."""
    totals = watched.groupBy("key", "started").agg(F.count("*").alias("n"), F.sum("token_before").alias("before"), F.sum("token_after").alias("after"), F.sum("token_saved").alias("saved"), F.avg("reduction_pct").alias("pct"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.join(totals, ["key", "started"], "left").select("key", "session", "started", "stopped", zero("n").alias("invocations"), zero("before").alias("token_before"), zero("after").alias("token_after"), zero("saved").alias("token_saved"), F.coalesce("pct", F.lit(0.0)).alias("reduction_pct_avg"))
