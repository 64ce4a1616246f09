"""Documents, versions, sinks and observed sessions: round trips, steps that stop half-way, brute force."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import observe, usage
from tessera.sources import document, sinks, store
from tessera.sources.versions import Conflict, Versions
from tessera.streaming.usage import into_log

SCHEMAS = {"nodes": "id string, type string, text string", "edges": "`from` string, `to` string, type string"}


def graph(spark, n=1500, seed=1):
    r = random.Random(seed)
    parts = ["{", "}", '"', "\\", "},{", '"nodes":[{', '"edges":[', "x", "é", " ", "\n", '\\"', "[", "]"]
    nodes = [(f"n{i}", "doc", "".join(r.choice(parts) for _ in range(r.randint(0, 12))) if i % 3 else None) for i in range(n)]
    edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.choice("abc")) for _ in range(2 * n)]
    return nodes, edges, spark.createDataFrame(nodes, SCHEMAS["nodes"]), spark.createDataFrame(edges, SCHEMAS["edges"])


def text_of(path):
    return "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{path}/file=*/part-*")))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_document_is_the_same_from_shuffled_rows_and_reads_back(spark, tmp_path):
    nodes, edges, n, e = graph(spark)
    one = document.write_document(n, e, f"{tmp_path}/a", file_lines=400)
    two = document.write_document(n.orderBy("text").repartition(3), e.orderBy(F.desc("to")).repartition(5), f"{tmp_path}/b", file_lines=400)
    assert one == two and text_of(f"{tmp_path}/a") == text_of(f"{tmp_path}/b") and len(glob.glob(f"{tmp_path}/a/file=*")) == 12
    whole = json.loads(text_of(f"{tmp_path}/a"))
    assert list(whole) == ["schema_version", "content_hash", "nodes", "edges"] and whole["content_hash"] == one
    assert [x["id"] for x in whole["nodes"]] == sorted(x[0] for x in nodes) and [(x["from"], x["to"], x["type"]) for x in whole["edges"]] == sorted(edges)
    got, meta = document.read_document(spark, f"{tmp_path}/a", SCHEMAS)
    assert rows(got["nodes"]) == sorted(nodes, key=str) and rows(got["edges"]) == sorted(edges, key=str)
    assert {r.name: r.value for r in meta.collect()} == {"schema_version": "1", "content_hash": one}


def test_a_changed_byte_or_order_changes_the_hash(spark):
    nodes, _, n, e = graph(spark, 1100)
    tree = store.settled(document.hash_tree(document.placed(document.elements(document.graph_lists(n, e)))))
    assert {r.level for r in tree.collect()} == {0, 1} and all(r.n <= document.CHUNK for r in tree.collect())
    other = n.withColumn("text", F.when(F.col("id") == "n700", "y").otherwise(F.col("text")))
    names = ["nodes", "edges"]
    assert document.root(tree, names) != document.root(document.hash_tree(document.placed(document.elements(document.graph_lists(other, e)))), names)
    lines = store.settled(document.placed(document.elements(document.graph_lists(n, e))))
    swapped = lines.withColumn("place", F.when((F.col("list") == "nodes") & F.col("place").isin(5, 6), 11 - F.col("place")).otherwise(F.col("place")))
    assert document.root(tree, names) != document.root(document.hash_tree(swapped), names)


def test_one_line_of_json_is_read_by_several_tasks(spark, tmp_path):
    nodes, edges, *_ = graph(spark, 800)
    whole = {"schema_version": "2", "nodes": [{"id": i, "type": t, "text": x, "deep": {"a": [{"b": {}}, {"c": "}"}]}} for i, t, x in nodes], "other": "z", "edges": [{"from": a, "to": b, "type": t} for a, b, t in edges]}
    path = tmp_path / "graph.json"
    for indent in (None, 2):
        path.write_text(json.dumps(whole, ensure_ascii=False, indent=indent) + "\n")
        before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 3
            got, meta = document.read_document(spark, str(path), SCHEMAS)
            assert rows(got["nodes"]) == sorted(nodes, key=str) and rows(got["edges"]) == sorted(edges, key=str)
            assert {r.name: r.value for r in meta.collect()} == {"schema_version": "2", "other": "z"}
        finally:
            for key, value in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before, strict=True):
                spark.conf.set(key, value)


def test_empty_document(spark, tmp_path):
    _, _, n, e = graph(spark, 3)
    document.write_document(n.limit(0), e.limit(0), f"{tmp_path}/d")
    assert json.loads(text_of(f"{tmp_path}/d"))["nodes"] == []
    got, _ = document.read_document(spark, f"{tmp_path}/d", SCHEMAS)
    assert rows(got["nodes"]) == rows(got["edges"]) == []


def numbers(spark, a, b):
    return spark.range(a, b).select(F.col("id"))


def test_versions_are_seen_whole_or_not_at_all(spark, tmp_path):
    log = Versions(spark, f"{tmp_path}/t")
    assert rows(log.read("id long")) == []
    assert log.append(numbers(spark, 0, 3)) and log.append(numbers(spark, 3, 5))
    staged = log.stage(numbers(spark, 100, 200))  # a crash here leaves a folder that nobody reads
    assert rows(log.read("id long")) == [(i,) for i in range(5)] and rows(log.read("id long", 1)) == [(i,) for i in range(3)]
    log.replace(numbers(spark, 1, 4), 2, "cut")
    assert rows(log.read("id long")) == [(1,), (2,), (3,)] and log.manifest()["note"] == "cut"
    assert log.sweep() == 3 and not (tmp_path / "t" / staged).exists() and rows(log.read("id long")) == [(1,), (2,), (3,)]


def test_a_slower_writer_loses_nothing(spark, tmp_path):
    log = Versions(spark, f"{tmp_path}/t")
    log.append(numbers(spark, 0, 2))
    seen = log.manifest()["number"]
    log.append(numbers(spark, 2, 4))  # comes in between
    with pytest.raises(Conflict):
        log.replace(numbers(spark, 0, 1), seen)
    assert not log.put({**log.manifest(), "number": seen}) and len(rows(log.read("id long"))) == 4


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path = f"{tmp_path}/runs"
    add = into_log(path, "stream")
    day = spark.createDataFrame([(1, "a", "", 10, 1, 2, 1, 1, 50.0, "", 0)], usage.SCHEMA)
    for number in (0, 1, 1, 0):
        add(day.withColumn("id", F.lit(number).cast("long")), number)
    assert sorted(r.id for r in store.open_runs(spark, path).collect()) == [0, 1]
    into_log(path, "other")(day, 0)
    assert store.open_runs(spark, path).count() == 3


def test_a_stream_into_the_log(spark, tmp_path):
    day = spark.createDataFrame([(i, "a", "", 10 + i, 1, 2, 1, 1, 50.0, "", 0) for i in range(6)], usage.SCHEMA)
    day.repartition(3).write.parquet(f"{tmp_path}/in")
    query = spark.readStream.schema(usage.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(into_log(f"{tmp_path}/runs", "s")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert store.open_runs(spark, f"{tmp_path}/runs").count() == 6 and Versions(spark, f"{tmp_path}/runs").manifest()["batches"]["s"] == 2


def test_a_log_without_versions_is_taken_over(spark, tmp_path):
    path = f"{tmp_path}/runs"
    spark.createDataFrame([(1, "a", 10, 1, 2, 1, 1, 50.0, "read:x", 0)], usage.SCHEMA.replace("session string, ", "")).write.parquet(path)
    store.append_runs(spark.createDataFrame([(2, "a", "s", 90_000, 1, 2, 1, 1, 50.0, "", 0)], usage.SCHEMA), path)
    assert [(r.id, r.session, r.matched_filter) for r in store.open_runs(spark, path).orderBy("id").collect()] == [(1, "", "read.x"), (2, "s", "")]
    assert store.prune_runs(spark, path, 1, 100_000) == 1 and [r.id for r in store.open_runs(spark, path).collect()] == [2]


def test_promotions_are_all_or_none(spark, tmp_path):
    path = f"{tmp_path}/docs"
    files = spark.createDataFrame([("a.md", "one"), ("b.md", "two")], "target string, content string")
    assert sinks.promote(files, path) == 2
    with pytest.raises(FileExistsError, match="b.md"):
        sinks.promote(spark.createDataFrame([("b.md", "x"), ("c.md", "y")], "target string, content string"), path)
    with pytest.raises(FileExistsError, match="d.md"):
        sinks.promote(spark.createDataFrame([("d.md", "x"), ("d.md", "y")], "target string, content string"), path)
    assert rows(Versions(spark, path).read("target string, content string")) == [("a.md", "one"), ("b.md", "two")]


def test_overlay_and_code_concepts(spark, tmp_path):
    concepts, edges = spark.createDataFrame([("concept:a", "A }", True)], "id string, name string, reviewed boolean"), spark.createDataFrame([("concept:a", "package:p", "implements", 0.9)], "`from` string, `to` string, type string, confidence double")
    kinds = ("id string, name string, reviewed boolean", "`from` string, `to` string, type string, confidence double")
    assert sinks.load_overlay(spark, f"{tmp_path}/o", *kinds) is None
    sinks.write_overlay(concepts, edges, f"{tmp_path}/o", "h", "m", "2024-01-01T00:00:00Z")
    sinks.write_overlay(concepts.withColumn("name", F.lit("B")), edges, f"{tmp_path}/o", "h2", "m", "2024-01-02T00:00:00Z")
    c, e, meta = sinks.load_overlay(spark, f"{tmp_path}/o", *kinds)
    assert rows(c) == [("concept:a", "B", True)] and rows(e) == [("concept:a", "package:p", "implements", 0.9)] and {r.name: r.value for r in meta.collect()}["graph_hash"] == "h2"
    assert sinks.load_code_concepts(spark, f"{tmp_path}/none").count() == 0
    found = spark.createDataFrame([("GET /x", "http.route", "a.go", 3, ["code_symbol:p.X"], {"verb": "GET"}), ("run", "command", "b.go", 9, [], None)], sinks.CODE_CONCEPT)
    sinks.write_code_concepts(found, f"{tmp_path}/cc", "h")
    got = sinks.load_code_concepts(spark, f"{tmp_path}/cc").orderBy("line").collect()
    assert [(r.name, r.kind, r.file, r.line, r.refs, r.meta) for r in got] == [("GET /x", "http.route", "a.go", 3, ["code_symbol:p.X"], {"verb": "GET"}), ("run", "command", "b.go", 9, [], None)]


def test_sessions_and_their_runs_equal_a_state_machine(spark):
    r = random.Random(3)
    marks = [(r.choice("kl"), r.randrange(100_000) if i % 20 else r.randrange(100_000) // 16 * 16, r.choice(["start", "start", "stop", "x", None]), f"s{i}", i) for i in range(300)] + [(None, 5, "start", "n", 999), ("k", None, "start", "n", 998)]
    runs = [(i, r.choice("klm"), r.randrange(110_000)) for i in range(2000)]
    open_, want = {}, []
    for key, at, kind, session, _ in sorted((m for m in marks if m[0] and m[1] is not None and m[2] in ("start", "stop")), key=lambda m: (m[0], m[1], m[4])):
        if kind == "start" and key not in open_:
            open_[key] = (session, at)
        elif kind == "stop" and key in open_:
            want.append((key, *open_.pop(key), at))
    want += [(k, s, at, None) for k, (s, at) in open_.items()]
    found = store.settled(observe.sessions(spark.createDataFrame(marks, "key string, at long, kind string, session string, order long")))
    assert rows(found) == sorted(want, key=str)
    log = spark.createDataFrame(runs, "id long, key string, recorded_at long")
    met = observe.observed(log, found)
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.id, x.session) for x in met.collect()) == sorted((i, s) for i, k, t in runs for key, s, a, b in want if key == k and a <= t and (b is None or t < b))
    assert observe.observed(log, found.limit(0)).count() == 0


def test_documents_are_placed_without_a_window_and_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(document, "settled", lambda rows: pytest.fail("rows were written as a checkpoint"))
    rows = spark.range(3000).select(F.lpad((F.col("id") * 7919 % 3000).cast("string"), 5, "0").alias("id"))
    got = document.placed(document.elements({"nodes": (rows, ["id"]), "more": (rows.limit(7), ["id"])}))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    lines = [r.line for r in got.filter("list = 'nodes'").orderBy("place").collect()]
    assert lines == [f'{{"id":"{i:05d}"}}' for i in range(3000)]
    assert [r.place for r in got.filter("list = 'more'").orderBy("place").collect()] == list(range(7))
