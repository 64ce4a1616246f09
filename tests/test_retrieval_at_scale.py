"""The stored index, prefix joins and near-tie order: results, plans and awkward rows."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import bm25, retrieval, stemindex
from tessera.operators.bm25 import Field
from tessera.plans import indexed, ranking, scoped
from tessera.sources.store import settled

FIELDS = [Field("body", 1.0, 0.75), Field("path", 1.7, 0.5)]
WORDS = "running runs runner stored storing stores graph graphs index indexing query queries é naïve café".split()


def docs(spark, n=700, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.choice(WORDS) for _ in range(r.randint(0, 30))], r.sample(WORDS, r.randint(0, 2))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, body array<string>, path array<string>")


def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return stemindex.build(docs(spark), "id", FIELDS, folder(tmp_path_factory.mktemp("index")))


QUERIES = [("a", "runs"), ("a", "stored"), ("b", "graph"), ("b", "graphs"), ("c", "unknown"), ("d", "index"), ("d", "cafés"), ("d", "running")]


def test_search_equals_scores_of_all_documents(spark, index):
    queries = spark.createDataFrame(QUERIES, "query_id string, word string")
    stems = docs(spark).withColumns({f.name: text.stemmed(F.col(f.name)) for f in FIELDS})
    terms = spark.createDataFrame(sorted({(q, text.stem(w)) for q, w in QUERIES}), "query_id string, term string")
    want = bm25.top_k(bm25.scores(stems, terms, "id", FIELDS), 7, [F.desc(F.round("score", 9)), "doc"])
    for first in (1, 8):
        got = stemindex.search(index, queries, 7, settled, first=first)
        assert [(r.query_id, r["rank"], r.doc, round(r.score, 8)) for r in got.orderBy("query_id", "rank").collect()] == [(r.query_id, r["rank"], r.doc, round(r.score, 8)) for r in want.orderBy("query_id", "rank").collect()]


def test_blocks_hold_every_posting_once_under_its_top(index):
    rows = index.table("blocks").collect()
    assert all(r.n == len(r.postings) and r.top == max(p.total for p in r.postings) and r.n <= 4 * stemindex.BLOCK_DOCS for r in rows)
    assert any(r.bits > 0 for r in index.table("terms").collect())
    df = {r.term: r.df for r in index.table("terms").collect()}
    assert {t: sum(r.n for r in rows if r.term == t) for t in df} == df
    assert index.table("vocabulary").filter("word = 'running'").first().term == "run"


def test_only_the_buckets_of_the_terms_are_read(spark, index):
    wanted = settled(stemindex.asked(index, spark.createDataFrame([("q", "graph")], "query_id string, word string")))
    plan = stemindex.blocks_of(index, wanted)._jdf.queryExecution().executedPlan().toString()
    (bucket,) = {r.bucket for r in wanted.collect()}
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})" in plan or f"bucket#" in plan and f"IN ({bucket})" in plan


def test_bounds_leave_slices_out(spark, tmp_path):
    rows = [(i, ["graph"] * (30 if i == 7 else 1) + ["other"] * (i % 50), []) for i in range(3000)]
    index = stemindex.build(spark.createDataFrame(rows, "id long, body array<string>, path array<string>"), "id", FIELDS, folder(tmp_path))
    wanted = settled(stemindex.asked(index, spark.createDataFrame([("q", "graph")], "query_id string, word string")))
    bound = settled(stemindex.bounds(stemindex.blocks_of(index, wanted), wanted))
    seen = stemindex.search(index, spark.createDataFrame([("q", "graph")], "query_id string, word string"), 1, settled)
    assert seen.first().doc == 7 and bound.count() >= 16 and stemindex.open_slices(bound, seen, 1).count() < bound.count() / 2


def test_index_of_nothing(spark, tmp_path):
    index = stemindex.build(docs(spark, 0), "id", FIELDS, folder(tmp_path))
    assert stemindex.search(index, spark.createDataFrame([("q", "graph")], "query_id string, word string"), 3, settled).collect() == []


PATHS = ["code/cmd/main.go", "code/cmdx/a.go", "code/x", "README.md", "docs/a/b/c.md", "docs/a", "", None, "a*b/c", "aXb/c", "specs/[x].md"]
SCOPES = ["code/cmd/**", "code/cmd", "code/*", "**", "*", "", "README.md", "docs/*/b/*", "docs/?", "a*b/c", "code/*/main.go", "*.md", "specs/[x].md", "code/cmd/"]


def test_scopes_by_prefix_equal_the_pattern_test(spark):
    paths, scopes = spark.createDataFrame([(p,) for p in PATHS], "path string"), spark.createDataFrame([(s,) for s in SCOPES], "scope string")
    got = {(r.path, r.scope) for r in retrieval.in_scopes(paths, scopes).collect()}
    want = {(r.path, r.scope) for r in paths.crossJoin(scopes).filter(text.in_scope(F.col("path"), F.col("scope"))).collect()}
    assert got == want and len(got) > 20
    assert retrieval.in_scopes(paths, scopes.limit(0)).count() == 0


def test_connected_agents_needs_no_nested_loop(spark):
    plan = scoped.connected_agents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def insertion(rows, tie=0.12):
    out = []
    for x in sorted(rows, key=lambda r: r["orig"]):
        at = 0
        for i, y in enumerate(out):
            if abs(x["relevance"] - y["relevance"]) > tie:
                first = x["relevance"] > y["relevance"]
            else:
                first = next((a > b if k in ("reach", "package") else a < b for k in ("reach", "package", "file", "symbol", "line", "orig") if (a := x[k]) != (b := y[k])), False)
            if not first:
                at = i + 1
        out.insert(at, x)
    return out


@pytest.mark.parametrize("spread", [0.3, 2.0, 20.0])
def test_near_ties_are_ordered_by_insertion_in_their_runs(spark, spread):
    r = random.Random(int(spread * 10))
    rows = [{"query_id": q, "relevance": round(r.uniform(0, spread), 3), "reach": r.choice([0.0, 0.5]), "package": r.choice("ab"), "file": r.choice("fg"), "symbol": r.choice("xyz"), "line": r.randrange(3), "orig": i} for q in "pq" for i in range(40)]
    kinds = "query_id string, relevance double, reach double, package string, file string, symbol string, line int, orig int"
    df = spark.createDataFrame([tuple(x.values()) for x in rows], kinds)
    got = retrieval.near_tie_order(df, 6).orderBy("query_id", "rank").collect()
    for q in "pq":
        own, want, run = sorted((x for x in rows if x["query_id"] == q), key=lambda x: -x["relevance"]), [], []
        for x in own:
            if run and run[-1]["relevance"] - x["relevance"] > 0.12:
                want, run = want + insertion(run), []
            run.append(x)
        want += insertion(run)
        assert [(x["rank"], x.orig) for x in got if x.query_id == q] == [(i, x["orig"]) for i, x in enumerate(want[:6], 1)]


def test_near_ties_do_not_gather_what_lies_beyond_a_gap(spark):
    rows = [("q", 10.0 + i / 100, 0.0, "a", "f", "s", 0, i) for i in range(9)] + [("q", i / 10_000, 0.0, "a", "f", "s", 0, 100 + i) for i in range(5000)]
    df = spark.createDataFrame(rows, "query_id string, relevance double, reach double, package string, file string, symbol string, line int, orig int")
    assert [r.orig for r in retrieval.near_tie_order(df, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("spread", [0.5, 4.0])
def test_near_ties_are_those_of_insertion_in_blocks_of_a_few(spark, monkeypatch, spread):
    monkeypatch.setattr(retrieval, "BLOCK_SYMBOLS", 32)
    r = random.Random(7)
    rows = [{"query_id": "q", "relevance": round(r.uniform(0, spread), 3), "reach": r.choice([0.0, 0.5]), "package": r.choice("abcd"), "file": r.choice("fghi"), "symbol": r.choice("xyz"), "line": r.randrange(9), "orig": i} for i in range(600)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "query_id string, relevance double, reach double, package string, file string, symbol string, line int, orig int")
    got = retrieval.near_tie_order(df, 5).orderBy("rank").collect()
    assert [(x["rank"], x.orig) for x in got] == [(i, x["orig"]) for i, x in enumerate(insertion(rows)[:5], 1)]


def test_near_ties_of_many_symbols_do_not_grow_with_their_square(spark):
    # one run, wider than the tie: 60,000 symbols took minutes when every one was put into a list of all
    rows = spark.range(60_000).select(F.lit("q").alias("query_id"), (F.col("id") * 7919 % 50_021 / 10_000).alias("relevance"), F.lit(0.0).alias("reach"), F.lit("a").alias("package"), F.lit("f").alias("file"), (F.col("id") * 31 % 977).cast("string").alias("symbol"), F.lit(0).alias("line"), F.col("id").alias("orig"))
    start = time.monotonic()
    assert len(retrieval.near_tie_order(rows, 5).collect()) == 5
    assert time.monotonic() - start < 60


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_stems_are_counted_without_reading_texts_twice(spark):
    got = ranking.stemmed(spark, "/root/testdata/sf0.001")
    assert scans(got) == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_stems(") == 1


def test_vocabulary_needs_no_index(spark, monkeypatch):
    monkeypatch.setattr(stemindex, "build", lambda *a: pytest.fail("an index was built"))
    assert indexed.vocabulary(spark, "/root/testdata/sf0.001").count() > 100


def test_stem_counts_are_those_of_the_words(spark):
    words = ["running", "runs", "run", "é", "a", "graphs", "runner"]
    df = spark.createDataFrame([(words, ["runs"]), ([], None), (None, ["graph"])], "body array<string>, path array<string>")
    got = [{t["term"]: list(t["tf"]) for t in r.x} for r in df.select(text.stem_counts(F.col("body"), F.col("path")).alias("x")).collect()]
    assert got == [{"run": [3, 1], "é": [1, 0], "graph": [1, 0], "runner": [1, 0]}, {}, {"graph": [0, 1]}]


def test_equal_scopes_are_tested_once_for_all_their_agents(spark):
    paths = spark.createDataFrame([("a/b1", 1), ("a/c", 2)], "path string, id int")
    scopes = spark.createDataFrame([(f"g{i}", s) for i in range(50) for s in ("*/b?", "a/**")] + [("g1", "a/**")], "agent string, scope string")
    got = retrieval.in_scopes(paths, scopes)
    assert sorted((r.path, r.id, r.agent, r.scope) for r in got.collect()) == sorted([("a/b1", 1, f"g{i}", s) for i in range(50) for s in ("*/b?", "a/**")] + [("a/c", 2, f"g{i}", "a/**") for i in range(50)] + [("a/b1", 1, "g1", "a/**"), ("a/c", 2, "g1", "a/**")])
    # patterns are columns of the scopes, not made again for each path
    assert "_pattern" in got._jdf.queryExecution().optimizedPlan().toString()


def test_scores_stay_where_their_documents_lie(spark):
    df = docs(spark)
    got = bm25.scores(df, spark.createDataFrame([("q", "graph"), ("q", "stored")], "query_id string, term string"), "id", FIELDS)
    assert got.count() > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan
