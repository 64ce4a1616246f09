"""Styled reports, refused pipes, manifests and layers, limits before ranks."""

import random

from pyspark.sql import functions as F

from tessera.operators import audit, retrieval
from tessera.sources import store, workspace

KINDS = "`check` string, code string, severity string, message string, file string, line long, refs array<string>"


def test_styled_report(spark):
    rows = [("orphans", "ORPH001", "error", f"m{i:02d}", f"f{i:02d}", i if i % 2 else None, []) for i in range(30)] + [("coverage", "COV004", "info", "i", None, None, [])]
    df = spark.createDataFrame(rows, KINDS)
    got = [r.value for r in audit.as_styled(df, colours=False).collect()]
    assert got[:4] == ["30 error, 0 warn, 1 info", "Errors  (showing 25 of 30)", "   ORPH001 f00 m00", "   ORPH001 f01:1 m01"] and got[-2:] == ["Info", "   COV004 i"] and len(got) == 29
    assert [r.value for r in audit.as_styled(df, "error").collect()][1].startswith("\x1b[1;31mErrors\x1b[0m")
    assert [r.value for r in audit.as_styled(df.limit(0)).collect()] == ["0 error, 0 warn, 0 info"]


def test_refused_pipes(spark):
    rows = spark.createDataFrame([(1, "é" * 3), (2, "abcd"), (3, None)], "id int, text string")
    assert [r.id for r in store.refused(rows, 5).collect()] == [1] and [r.id for r in store.piped(rows, 5).collect()] == [2]


def test_manifest_and_layers(spark):
    files = spark.createDataFrame([("M.md", "# x\nproject: first\nproject:  Demo \n description: no\nother: y"), ("specs/a.md", ""), ("specs/b/c.md", ""), ("notes/n.md", "")], "path string, text string")
    (row,) = workspace.manifest(files, "M.md").collect()
    assert (row.project, row.description) == ("Demo", None)
    assert [(r.layer, r.files) for r in workspace.layers(files).collect()] == [("specs", 2), ("docs", 0), ("context", 0), ("notes", 1)]


def test_scope_survivor_equals_the_ranking_of_all(spark):
    r = random.Random(7)
    for share in (0.0, 0.05, 0.6):
        rows = [("q", f"{'in' if r.random() < share else 'out'}/{i:03d}", "", r.choice(["high", "low"]), round(r.uniform(0, 1), 2)) for i in range(60)]
        df = spark.createDataFrame(rows, "query_id string, file string, section string, trust string, relevance double")
        got = [(x["rank"], x.file) for x in retrieval.with_scope_survivor(df, F.col("file").startswith("in/"), 0.05, 5).orderBy("rank").collect()]
        order = [x[1] for x in sorted((x for x in rows if x[4] >= 0.05), key=lambda x: (-x[4], x[3] != "high", x[1]))]
        want, inside = order[:5], [f for f in order if f.startswith("in/")]
        if inside and not any(f.startswith("in/") for f in want):
            want[-1] = inside[0]
        assert got == list(enumerate(want, 1))


def test_thresholds_are_of_the_query(spark):
    rows = [("a", "x", 4.0), ("a", "y", 1.9), ("a", "z", 2.0), ("b", "x", 0.15), ("b", "y", 0.09), ("c", "x", 0.05)]
    df = spark.createDataFrame(rows, "query_id string, doc string, score double")
    assert sorted((r.query_id, r.doc, r.threshold) for r in retrieval.concept_threshold(df).collect()) == [("a", "x", 2.0), ("a", "z", 2.0), ("b", "x", 0.1)]
    assert "Window" not in retrieval.concept_threshold(df)._jdf.queryExecution().executedPlan().toString()
