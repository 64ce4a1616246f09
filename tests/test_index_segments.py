"""The stored index by segments: texts are read once, and every segment is scored in one place with all its ties."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import bm25, stemindex
from tessera.operators.bm25 import Field
from tessera.sources.store import settled

FIELDS = [Field("body", 1.0, 0.75), Field("path", 1.7, 0.5)]
WORDS = "running runs runner stored storing graph graphs index indexing queries as ies naïve café".split()
QUERIES = [("a", "runs"), ("a", "stored"), ("b", "graph"), ("b", "graphs"), ("c", "unknown"), ("d", "index"), ("d", "cafés"), ("d", "running"), (None, "graph")]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 60)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def docs(spark, kind="long"):
    r = random.Random(3)
    rows = [(i, [r.choice(WORDS) for _ in range(r.randint(0, 40))], r.sample(WORDS, r.randint(0, 2))) for i in range(600)]
    rows += [(i, ["graph", "runs", "graph"], ["index"]) for i in range(600, 900)]  # equal documents
    rows += [(None, ["graph"] * 50, ["graph"]), (900, None, None), (901, ["only", "alonely"], None)]
    return spark.createDataFrame(rows, "id long, body array<string>, path array<string>").withColumn("id", F.col("id").cast(kind))


def built(spark, df, tmp_path):
    return stemindex.build(df, "id", FIELDS, f"{tmp_path}/{uuid.uuid4().hex}")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_segments_together_equal_scores_of_all_documents(spark, small_batches, tmp_path, kind):
    df = docs(spark, kind)
    index = built(spark, df, tmp_path)
    assert index.table("lengths").select("segment").distinct().count() >= 16
    emptied = df.withColumns({f.name: F.when(F.col("id").isNotNull(), text.stemmed(F.coalesce(f.name, F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>")) for f in FIELDS})
    terms = spark.createDataFrame(sorted({(q, text.stem(w)) for q, w in QUERIES if q}), "query_id string, term string")
    want = bm25.top_k(bm25.scores(emptied, terms, "id", FIELDS), 9, [F.desc(F.round("score", 9)), "doc"])
    want = [(r.query_id, r["rank"], r.doc, round(r.score, 8)) for r in want.orderBy("query_id", "rank").collect()]
    assert len(want) >= 27
    for first in (1, 8):
        got = stemindex.search(index, spark.createDataFrame(QUERIES, "query_id string, word string"), 9, settled, first=first)
        assert [(r.query_id, r["rank"], r.doc, round(r.score, 8)) for r in got.filter("query_id IS NOT NULL").orderBy("query_id", "rank").collect()] == want


def test_shares_and_terms_of_several_segments(spark, small_batches, tmp_path):
    df = docs(spark)
    index = built(spark, df, tmp_path)
    queries = spark.createDataFrame(QUERIES[:-1], "query_id string, word string")
    found = settled(stemindex.search(index, queries, 2, settled))
    parts = {(r.query_id, r.doc): r.share for r in stemindex.shares(index, queries, found).groupBy("query_id", "doc").agg(F.sum("share").alias("share")).collect()}
    assert {(r.query_id, r.doc): round(r.score, 9) for r in found.collect()} == {k: round(v, 9) for k, v in parts.items()}
    stems = df.filter("id IS NOT NULL").select("id", F.explode(text.stemmed(F.concat(F.coalesce("body", F.array().cast("array<string>")), F.coalesce("path", F.array().cast("array<string>"))))).alias("term"))
    want = {(r.term, r.df, r.cf) for r in stems.groupBy("term").agg(F.countDistinct("id").alias("df"), F.count("*").alias("cf")).collect()}
    assert {(r.term, r.df, r.cf) for r in index.table("terms").collect()} == want
    assert {(r.term, r.top) for r in index.table("terms").collect()} == {(r.term, r.top) for r in index.table("blocks").groupBy("term").agg(F.max("top").alias("top")).collect()}
    assert {(r.word, r.term) for r in index.table("vocabulary").collect()} == {(w, text.stem(w)) for w in {*WORDS, "only", "alonely"} if len(text.stem(w).encode()) >= 2}


def test_a_build_reads_its_documents_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(words):
        read.add(1)
        return words

    rows = [(i, ["graph", "runs"], ["index"]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, body array<string>, path array<string>").withColumn("body", F.udf(seen, "array<string>").asNondeterministic()("body"))
    built(spark, df, tmp_path)
    assert read.value == 200


def test_a_segment_returns_no_more_than_the_first_places(spark, small_batches, tmp_path):
    index = built(spark, docs(spark), tmp_path)
    wanted = settled(stemindex.asked(index, spark.createDataFrame([("b", "graph")], "query_id string, word string")))
    bound = settled(stemindex.bounds(index.table("tops"), wanted))
    scored = stemindex._scored(index, wanted, bound, 3, 1.2)
    # postings are never rows: they stay arrays until the first places of their segment are known
    assert "Generate" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert 3 <= scored.count() <= 3 * bound.select("segment").distinct().count()


def test_the_rows_of_the_segments_are_dealt_out(spark, small_batches, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = built(spark, docs(spark), tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = index.table("postings").filter(F.col("bucket") == stemindex.SEGMENTS)
    assert own.count() >= 16 and own.select(F.input_file_name()).distinct().count() == 4
