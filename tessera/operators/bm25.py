"""BM25F over token arrays, for one or many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.store import settled

#: Rows of query terms up to which they are broadcast; beyond, the join shuffles.
BROADCAST_TERMS = 200_000
#: Distinct terms up to which the plan itself holds them.
LITERAL_TERMS = 20_000
#: Documents that a task scores, about.
DOCS_A_TASK = 4096


@dataclass(frozen=True)
class Field:
    """A token-array column with its weight and length normalisation."""

    name: str
    weight: float
    b: float


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_TERMS) -> DataFrame:
    """df with a broadcast hint if it has no more rows than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def postings(docs: DataFrame, doc: str, fields: list[Field], terms: DataFrame | None = None) -> DataFrame:
    """doc, field, term, tf, len; only of terms (term) if given.

    Documents are cut down to the terms asked for before anything is shuffled.
    """
    parts = [docs.select(F.col(doc).alias("doc"), F.lit(f.name).alias("field"), F.size(f.name).alias("len"), F.explode(f.name).alias("term")) for f in fields]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    if terms is not None:
        every = every.join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")
    return every.groupBy("doc", "field", "term", "len").agg(F.count("*").alias("tf"))


def document_frequency(found: DataFrame) -> DataFrame:
    """term, df: documents that hold the term in any field, also one of weight 0."""
    return found.select("doc", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def row_frequency(docs: DataFrame, fields: list[Field]) -> DataFrame:
    """term, df as document_frequency, where every document is one row: one shuffle, of sums."""
    return docs.select(F.explode(F.array_distinct(F.concat(*[F.col(f.name) for f in fields]))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def matches(docs: DataFrame, queries: DataFrame, doc: str, fields: list[Field]) -> DataFrame:
    """doc, for each field its length, and for each field its tokens that are query terms: one row for every document.

    Texts are read and cut once; what is left of them is written to the checkpoint folder, for the statistics of all
    documents and the scores of those that match are made from it.  Up to LITERAL_TERMS terms go into the plan, more are
    joined.
    """
    distinct = queries.select("term").distinct()
    terms = [r.term for r in distinct.limit(LITERAL_TERMS + 1).collect()]
    lengths = [F.greatest(F.size(f.name), F.lit(0)).alias(f"{f.name}_n") for f in fields]
    if len(terms) <= LITERAL_TERMS:
        held = [F.filter(f.name, lambda w: w.isin(terms)).alias(f.name) if terms else F.array().cast("array<string>").alias(f.name) for f in fields]
        return settled(docs.select(F.col(doc).alias("doc"), *lengths, *held))
    # a document may be several rows: each has a number of its own, written with it
    rows = settled(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc"), *[F.col(f.name) for f in fields]))
    found = postings(rows, "row", fields, queries)
    listed = found.groupBy(F.col("doc").alias("row")).agg(*[F.flatten(F.collect_list(F.when(F.col("field") == f.name, F.array_repeat("term", F.col("tf").cast("int"))))).alias(f.name) for f in fields])
    return settled(rows.select("row", "doc", *lengths).join(listed, "row", "left").drop("row"))


def _weighed(slim: DataFrame, fields: list[Field], grouped: bool = False) -> tuple[DataFrame, int]:
    """doc, field, term, part: the weighted, length-normalised frequency; and the number of documents.

    grouped: rows that share doc are parts of one document; lengths and frequencies are added up, so that no part's tokens
    have to meet in one place.
    """
    sizes = [f"{f.name}_n" for f in fields]
    if grouped:
        whole = settled(slim.groupBy("doc").agg(*[F.sum(n).alias(n) for n in sizes]))
        small = broadcast_if_small(whole)
    else:
        whole = slim
    row = whole.agg(F.count("*").alias("n"), *[F.avg(f"{f.name}_n").alias(f.name) for f in fields]).first()
    parts = []
    for f in fields:
        norm = 1 - f.b + f.b * F.col("len") / F.lit(max(1.0, row[f.name] or 0.0))
        own = slim.filter(F.size(f.name) > 0)
        if grouped:
            counted = own.select("doc", F.explode(f.name).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf")).join(small.select("doc", F.col(f"{f.name}_n").alias("len")), "doc")
        else:
            counted = own.select("doc", F.col(f"{f.name}_n").alias("len"), F.explode(f.name).alias("term")).groupBy("doc", "term", "len").agg(F.count("*").alias("tf"))
        parts.append(counted.select("doc", F.lit(f.name).alias("field"), "term", (F.lit(f.weight) * F.col("tf") / F.when(norm == 0, 1.0).otherwise(norm)).alias("part")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every, row.n


def _totals(slim: DataFrame, fields: list[Field]) -> tuple[DataFrame, int]:
    """doc, term, total: the sum of the parts of _weighed(); and the number of documents.

    Rows are dealt out by document, to more tasks where there are more documents, and stay there: what a task holds does
    not grow with the table.
    """
    sizes = [f"{f.name}_n" for f in fields]
    row = slim.agg(F.count("*").alias("n"), *[F.avg(n).alias(f.name) for n, f in zip(sizes, fields, strict=True)]).first()
    tasks = max(row.n // DOCS_A_TASK + 1, slim.sparkSession.sparkContext.defaultParallelism)

    def said(i: int, f: Field):
        return F.transform(F.coalesce(f.name, F.array().cast("array<string>")), lambda t: F.struct(F.lit(i).alias("field"), t.alias("term")))

    each = slim.repartition(tasks, "doc").select("doc", *sizes, F.explode(F.concat(*[said(i, f) for i, f in enumerate(fields)])).alias("t")).select("doc", *sizes, "t.field", "t.term")
    counted = each.groupBy("doc", "term", *sizes).agg(*[F.sum(F.when(F.col("field") == i, 1).otherwise(0)).alias(f"_{f.name}") for i, f in enumerate(fields)])
    parts = []
    for f in fields:
        norm = 1 - f.b + f.b * F.col(f"{f.name}_n") / F.lit(max(1.0, row[f.name] or 0.0))
        parts.append(F.when(F.col(f"_{f.name}") > 0, F.lit(f.weight) * F.col(f"_{f.name}") / F.when(norm == 0, 1.0).otherwise(norm)).otherwise(0.0))
    return counted.select("doc", "term", sum(parts, F.lit(0.0)).alias("part")).groupBy("doc", "term").agg(F.sum("part").alias("total")), row.n


def _idf(n: int):
    return F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), F.lit(1.0))


def contributions(docs: DataFrame, queries: DataFrame, doc: str, fields: list[Field], k1: float = 1.2) -> DataFrame:
    """query_id, doc, term, field, part, total, contrib: one row for each matching field."""
    found, n = _weighed(matches(docs, queries, doc, fields), fields)
    df = document_frequency(found).select("term", _idf(n).alias("idf"))
    whole = found.join(broadcast_if_small(df), "term").withColumn("total", F.sum("part").over(Window.partitionBy("doc", "term"))).withColumn("contrib", F.col("idf") * F.col("total") / (F.lit(k1) + F.col("total")))
    return whole.join(broadcast_if_small(queries.select("query_id", "term")), "term").select("query_id", "doc", "term", "field", "part", "total", "contrib")


def scores(docs: DataFrame, queries: DataFrame, doc: str, fields: list[Field], k1: float = 1.2, grouped: bool = False) -> DataFrame:
    """query_id, doc, score of the documents that match; queries: (query_id, term), repeats count again.

    grouped: rows that share doc are one document.
    """
    slim = matches(docs, queries, doc, fields)
    if grouped:
        found, n = _weighed(slim, fields, grouped)
        per_term = found.groupBy("doc", "term").agg(F.sum("part").alias("total"))
    else:
        per_term, n = _totals(slim, fields)
    # one row for each document and term by now, so the document frequency needs no DISTINCT
    df = per_term.groupBy("term").agg(F.count("*").alias("df")).select("term", _idf(n).alias("idf"))
    weighed = per_term.join(broadcast_if_small(df), "term").select("doc", "term", (F.col("idf") * F.col("total") / (F.lit(k1) + F.col("total"))).alias("contrib"))
    return weighed.join(broadcast_if_small(queries.select("query_id", "term")), "term").groupBy("doc", "query_id").agg(F.sum("contrib").alias("score")).select("query_id", "doc", "score")


def field_shares(docs: DataFrame, queries: DataFrame, doc: str, fields: list[Field], k1: float = 1.2) -> DataFrame:
    """query_id, doc, field, share: what each field adds to the score."""
    got = contributions(docs, queries, doc, fields, k1).filter("total > 0")
    return got.groupBy("query_id", "doc", "field").agg(F.sum(F.col("contrib") * F.col("part") / F.col("total")).alias("share"))


def top_k(scored: DataFrame, k: int, by: list, key: str = "query_id") -> DataFrame:
    """The first k rows of each query, with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))
