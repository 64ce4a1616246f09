"""Routing a query to an owner: penalised scores, softmax, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import bm25
from tessera.operators.bm25 import Field

CONFIDENT, LEAST_CANDIDATE, LEAST_SCORE, TEMPERATURE, PENALTY = 0.7, 0.2, 0.01, 0.2, 2.5


def penalties(docs: DataFrame, queries: DataFrame, doc: str, fields: list[Field], outside: str, penalty: float = PENALTY) -> DataFrame:
    """query_id, doc, penalty: for each query term that the out-of-scope field holds and none of the fields does."""
    positive = F.concat(*[F.coalesce(f.name, F.array().cast("array<string>")) for f in fields])
    against = docs.select(F.col(doc).alias("doc"), F.explode(F.array_except(outside, positive)).alias("term"))
    sizes = queries.groupBy("query_id").agg(F.count("*").alias("n"))
    asked = queries.join(sizes, "query_id")
    return against.join(bm25.broadcast_if_small(asked), "term").groupBy("query_id", "doc").agg((F.lit(penalty) * F.sum(1 / F.col("n"))).alias("penalty"))


def found_scores(docs: DataFrame, queries: DataFrame, doc: str, fields: list[Field], outside: str | None = None, k1: float = 1.2, penalty: float = PENALTY, grouped: bool = False) -> DataFrame:
    """query_id, doc, score of the documents that a query finds, 0 at least.  grouped: rows that share doc are one owner."""
    found = bm25.scores(docs, queries, doc, fields, k1, grouped)
    if outside:
        found = found.join(penalties(docs, queries, doc, fields, outside, penalty), ["query_id", "doc"], "left")
    else:
        found = found.withColumn("penalty", F.lit(0.0))
    return found.select("query_id", "doc", F.greatest(F.col("score") - F.coalesce("penalty", F.lit(0.0)), F.lit(0.0)).alias("score"))


def owner_scores(docs: DataFrame, queries: DataFrame, doc: str, fields: list[Field], outside: str | None = None, k1: float = 1.2, penalty: float = PENALTY, grouped: bool = False) -> DataFrame:
    """query_id, doc, score for every query and every document, 0 where nothing is found: queries times owners rows.

    To route, route() takes found_scores() and the number of owners instead.
    """
    found = found_scores(docs, queries, doc, fields, outside, k1, penalty, grouped)
    owners = docs.select(F.col(doc).alias("doc"))
    every = queries.select("query_id").distinct().join(bm25.broadcast_if_small(owners.distinct() if grouped else owners), how="cross")
    return every.join(found, ["query_id", "doc"], "left").select("query_id", "doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def with_absent(found: DataFrame, queries: DataFrame, owners: DataFrame, least_candidate: float = LEAST_CANDIDATE) -> tuple[DataFrame, int | None]:
    """What route() needs to count owners (doc) that a query does not find: their number.

    Such an owner can only be named where all owners together are so few that each has a share of least_candidate: then
    (fewer than 1 / least_candidate owners) they get rows of score 0, and no number is needed.
    """
    n = owners.count()
    asked = queries.select("query_id").distinct()
    if n * (least_candidate if least_candidate > 0 else 0.2) > 1:
        # a query that finds nothing has a row without an owner
        return asked.join(found, "query_id", "left"), n
    names = F.array(*[F.lit(r.doc) for r in owners.collect()]).cast("array<string>")
    every = asked.select("query_id", F.explode(names).alias("doc"))
    return every.join(found, ["query_id", "doc"], "left").select("query_id", "doc", F.coalesce("score", F.lit(0.0)).alias("score")), None


def softmax(scores: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Adds confidence: shares of exp(score / temperature) within a query."""
    w = Window.partitionBy("query_id")
    e = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    return scores.withColumn("confidence", e / F.sum(e).over(w))


def route(scores: DataFrame, temperature: float = TEMPERATURE, confident: float = CONFIDENT, least_candidate: float = LEAST_CANDIDATE, least_score: float = LEAST_SCORE, owners: int | None = None) -> DataFrame:
    """query_id, owner, confidence, candidates: the first of the best owners by name; candidates where it is unsure.

    The owner is null and there are no candidates where no score reaches least_score.  owners: their number, if scores lacks
    those of score 0 (with_absent): they count in the shares without rows.
    """
    w = Window.partitionBy("query_id")
    least = least_candidate if least_candidate > 0 else 0.2
    if owners is None:
        shares = softmax(scores, temperature).withColumn("top", F.max("score").over(w))
    else:
        top = F.coalesce(F.max("score").over(w), F.lit(0.0))
        e = F.exp((F.col("score") - F.col("top")) / temperature)
        rest = (F.lit(owners) - F.count("score").over(w)) * F.exp(-F.col("top") / temperature)
        shares = scores.withColumn("top", top).withColumn("confidence", e / (F.sum(e).over(w) + rest))
    grouped = shares.groupBy("query_id").agg(
        F.first("top").alias("top"),
        F.min(F.struct((-F.col("confidence")).alias("minus"), "doc")).alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("confidence") >= least, F.struct((-F.col("confidence")).alias("minus"), "doc")))).alias("near"),
    )
    clear = F.col("top") >= least_score
    unsure = clear & (-F.col("best.minus") < confident)
    return grouped.select(
        "query_id",
        F.when(clear, F.col("best.doc")).alias("owner"),
        F.when(clear, -F.col("best.minus")).otherwise(0.0).alias("confidence"),
        F.when(unsure, F.transform("near", lambda x: F.struct(x["doc"].alias("name"), (-x["minus"]).alias("confidence")))).otherwise(F.array().cast("array<struct<name:string,confidence:double>>")).alias("candidates"),
    )


def overview(docs: DataFrame, doc: str) -> DataFrame:
    """All owners with confidence 0."""
    return docs.select(F.col(doc).alias("owner"), F.lit(0.0).alias("confidence"))
