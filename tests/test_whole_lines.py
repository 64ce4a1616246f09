"""Whole lines, headings and documents of several rows, on planted cases."""

from pyspark.sql import functions as F

from tessera.operators import bm25, compact, graph, usage


def test_repeats_compare_whole_lines(spark):
    text = "alpha one\nalpha two\nalpha two\nalpha two\n\n\n" + "x" * 3000 + "\n" + "x" * 2999 + "y"
    df = spark.createDataFrame([(1, text), (2, "a"), (3, None)], "doc_id long, text string")
    got = compact.repeats(graph.lines(df, "doc_id"), "doc_id").filter("doc_id = 1").orderBy("first").collect()
    assert [(r["first"], r.n) for r in got] == [(1, 1), (2, 3), (5, 2), (7, 1), (8, 1)] and got[3].x == "x" * 3000
    rows = {r.doc_id: r.t for r in df.select("doc_id", F.array_join(compact.collapsed(F.split("text", "\n")), "\n").alias("t")).collect()}
    assert rows[1] == "alpha one\n[repeated 3 times] alpha two\n[repeated 2 times] \n" + "x" * 3000 + "\n" + "x" * 2999 + "y" and rows[2] == "a"
    words = [f"word{i}" * 50 for i in range(30)]
    short = spark.createDataFrame([(words,)], "w array<string>").select(compact.elided(F.col("w"), 11).alias("w")).first().w
    assert short == [*words[:5], "...(20 lines omitted)...", *words[-5:]]


def test_headings_of_any_length(spark):
    name = "h" * 5000
    df = spark.createDataFrame([(1, f"intro\n## {name}\nbody\n## next\nrest")], "doc_id long, text string")
    got = graph.carried_heading(graph.lines(df, "doc_id"), "doc_id").orderBy("line").collect()
    assert [r.heading for r in got] == [None, name, name, "next", "next"]
    body = df.select(graph.section_body(F.col("text"), F.lit(name)).alias("a"), graph.section_body(F.col("text"), F.lit("next")).alias("b"), graph.section_body(F.col("text"), F.lit("nex")).alias("c"), F.col("text")).first()
    assert (body.a, body.b, body.c) == ("body", "rest", body.text)


def test_many_terms_with_documents_of_several_rows(spark, monkeypatch):
    docs = spark.createDataFrame([("d", ["a", "b", "a"]), ("d", ["b"]), ("e", ["c"])], "doc string, body array<string>")
    queries = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, term string")
    fields = [bm25.Field("body", 1.0, 0.75)]

    def rows():
        return sorted((r["doc"], r.body_n, sorted(r.body or [])) for r in bm25.matches(docs, queries, "doc", fields).collect())

    want = rows()
    monkeypatch.setattr(bm25, "LITERAL_TERMS", 1)
    assert rows() == want == [("d", 1, ["b"]), ("d", 3, ["a", "a", "b"]), ("e", 1, [])]


def test_removed_runs(spark):
    runs = spark.createDataFrame([(1, 100), (1, 10_000_000), (None, None)], "id long, recorded_at long")
    assert usage.removed(runs, 1, 10_000_000).count() == 2 and usage.removed(runs, 0, 10_000_000).count() == 0
