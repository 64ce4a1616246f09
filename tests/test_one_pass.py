"""The audit in one pass, routing without a product, near-duplicate names: against the single checks and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import audit, overlay, routing
from tessera.operators.bm25 import Field


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def graph(spark, tmp_path):
    r = random.Random(2)
    kinds = ["spec_section", "decision", "doc", "context_snapshot", "note"]
    nodes = [(f"{k}:{i}", k, f"{'context' if k == 'context_snapshot' else k}/{i % 9}/x.md" if i % 11 else None, f"name {i}") for i in range(120) for k in [r.choice(kinds)]]
    nodes += [nodes[3], nodes[7]]  # ids are not unique
    edges = [(r.choice(["agent:a", "doc:1"]), r.choice(nodes)[0] if i % 9 else "path:x", r.choice(["reads", "owns", "supports", "references"])) for i in range(60)]
    concepts = [(f"concept:{i}", f"c{i}", r.random() < 0.5 if i % 7 else None) for i in range(30)]
    links = [(f"concept:{r.randrange(40)}", f"code_package:{i}", r.choice(["implements", "other"]), r.random() < 0.5) for i in range(25)]
    tables = {"nodes": (nodes, "id string, type string, file string, name string"), "edges": (edges, "`from` string, `to` string, type string"), "concepts": (concepts, "id string, name string, reviewed boolean"), "links": (links, "`from` string, `to` string, type string, reviewed boolean"), "topics": ([("3",), ("4",)], "topic string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    return {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}


def findings(df):
    return sorted((r.check, r.code, r.severity, r.message or "", r.file or "", r.line or 0, tuple(r.refs)) for r in df.collect())


def test_one_pass_finds_what_the_single_checks_find(graph):
    n, e, c, k, t = (graph[x] for x in ("nodes", "edges", "concepts", "links", "topics"))
    single = [audit.orphan_specs(n, e), audit.orphan_decisions(n, e), audit.orphan_docs(n, e), audit.orphan_snapshots(n, e, t), audit.unimplemented(c, k), audit.unreviewed(c, k)]
    got, want = findings(audit.one_pass(n, e, c, k, t)), findings(audit.report(single))
    assert got == want and {x[1] for x in got} == {"ORPH001", "ORPH002", "ORPH003", "COV005", "STALE003"}


def test_each_table_is_read_once(graph):
    p = plan(audit.report([audit.one_pass(graph["nodes"], graph["edges"], graph["concepts"], graph["links"], graph["topics"])]))
    final = p.split("+- == Initial Plan ==")[0]
    # paths may be cut short in a plan, so scans are counted: one for each of the five tables
    assert len(re.findall("FileScan parquet", final)) == 5


def test_one_action_writes_the_report_and_counts_it(spark, graph, tmp_path):
    every = audit.one_pass(graph["nodes"], graph["edges"], graph["concepts"], graph["links"], graph["topics"])
    seen = audit.run(every, lambda df: audit.as_json(df).write.text(f"{tmp_path}/report"))
    counts = {r.severity: r.n for r in audit.severity_counts(every).collect()}
    assert seen == {**counts, "failed": True} and spark.read.text(f"{tmp_path}/report").count() == sum(counts.values())
    only = audit.run(every, lambda df: df.write.format("noop").mode("overwrite").save(), checks=("coverage",))
    assert only["error"] == 0 and only["warn"] > 0 and not only["failed"] and audit.run(every, lambda df: df.write.format("noop").mode("overwrite").save(), at="warn", checks=("coverage",))["failed"]
    with pytest.raises(ValueError):
        audit.run(every, lambda df: None, checks=("none",))


@pytest.mark.parametrize("n", [3, 40])
@pytest.mark.parametrize("least", [0.0, 0.02, 0.2])
def test_routing_without_rows_for_absent_owners(spark, n, least):
    r = random.Random(n)
    words = "graph index query load build test".split()
    docs = spark.createDataFrame([(f"o{i:02d}", [r.choice(words) for _ in range(r.randint(0, 6))]) for i in range(n)], "name string, body array<string>")
    queries = spark.createDataFrame([("a", "graph"), ("a", "index"), ("b", "load"), ("c", "nothing"), ("d", "test")], "query_id string, term string")
    fields = [Field("body", 1.0, 0.75)]
    want = routing.route(routing.owner_scores(docs, queries, "name", fields), 2.0, least_candidate=least)
    found, owners = routing.with_absent(routing.found_scores(docs, queries, "name", fields), queries, docs.select(F.col("name").alias("doc")), least)
    got = routing.route(found, 2.0, least_candidate=least, owners=owners)

    def told(df):
        return [(x.query_id, x.owner, round(x.confidence, 9), [(c["name"], round(c["confidence"], 9)) for c in x.candidates]) for x in df.orderBy("query_id").collect()]

    assert told(got) == told(want) and len(told(got)) == 4
    assert "NestedLoop" not in plan(got)


def test_near_names_of_two_tables(spark):
    r = random.Random(5)
    names = ["".join(r.choice("abC ") for _ in range(r.randint(1, 14))) for _ in range(120)]
    a, b = names[:60] + names[:3], names[60:] + names[10:15]
    one, two = (spark.createDataFrame([(x,) for x in rows], "name string") for rows in (a, b))
    got = sorted(map(tuple, overlay.near_duplicates(one, two).collect()))
    every = one.distinct().crossJoin(two.distinct().select(F.col("name").alias("other"))).withColumns({"x": text.bare_name(F.col("name")), "y": text.bare_name(F.col("other"))}).withColumn("d", F.levenshtein("x", "y"))
    want = sorted((x.name, x.other, x.d) for x in every.filter(F.col("d") <= F.when(F.length("x") > 10, 3).otherwise(2)).collect())
    assert got == want and len(got) > 20
