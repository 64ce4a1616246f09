import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import packet
from tessera.sources import config, store, workspace

AGENT = """# {name}

## Role
{role}

## Responsibilities
{duties}

Scope:
- `{scope}`

## Read-chain
1. `specs/graph.md` — first
2. `docs/guide.md`

## Rules
- `rules/style.md`

## Out of scope
{outside}
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("ws")

    def put(path, text):
        (d / path).parent.mkdir(parents=True, exist_ok=True)
        (d / path).write_text(text)

    put("agents/builder/AGENT.md", AGENT.format(name="builder", role="Builds the graph from files", duties="Graph construction and indexing of packages", scope="code/graph/**", outside="billing invoices"))
    put("agents/payer/AGENT.md", AGENT.format(name="payer", role="Handles billing and invoices", duties="Payment flows, invoices and refunds", scope="code/billing/**", outside="graph"))
    put("specs/graph.md", "# Graph\n\n## Nodes\nEvery node of the graph has an id. See `docs/guide.md`.\n\n## Edges\nEdges join nodes.\n---\n")
    put("specs/decisions/0001-hash.md", "We decided on sha256 for invoices. [spec](specs/graph.md)")
    put("docs/guide.md", "no headings, but a [spec](specs/graph.md) and `code/graph/build.go`\n")
    put("context/payments/snap.md", "refund flow of invoices")
    put("notes/idea.md", "an idea about graph layouts")
    put("notes/skip/me.md", "ignored")
    put("code/graph/go.mod", "module example.org/graph\n")
    put("code/graph/build.go", "// Graph building.\npackage graph\n\nfunc Build() {}\nfunc (b *Box) Run() {}\nfunc hidden() {}\ntype (\n\tNode struct{}\n\tedge struct{}\n)\nconst Max = 1\n")
    put("code/graph/build_test.go", "package graph\nfunc TestX() {}\n")
    put("code/graph/vendor/v.go", "package v\nfunc V() {}\n")
    return str(d)


@pytest.fixture(scope="module")
def built(spark, root):
    n, e = workspace.build(spark, root, spark.createDataFrame([("notes/skip/",), ("# no",)], "prefix string"))
    return store.settled(n), store.settled(e)


def test_scan(spark, root):
    assert {r.path: r.kind for r in workspace.markdown(spark, root).collect()}["specs/decisions/0001-hash.md"] == "decision"
    assert [r.path for r in workspace.code(spark, root).collect()] == ["code/graph/build.go"]
    assert [(r.dir, r.module) for r in workspace.manifests(spark, root).collect()] == [("code/graph", "example.org/graph")]
    assert {r.path for r in workspace.required(workspace.markdown(spark, root)).collect()} == {"AGENTS.md", "README.md"}


def test_nodes(built):
    nodes = {r.id: r for r in built[0].collect()}
    assert {i for i in nodes if i.startswith("spec_section")} == {"spec_section:specs/graph.md:Nodes", "spec_section:specs/graph.md:Edges"}
    assert {"doc:docs/guide.md:", "decision:0001-hash", "context_snapshot:context/payments/snap.md", "note:notes/idea.md", "code_file:code/graph/build.go", "code_package:example.org/graph"} <= set(nodes)
    assert "note:notes/skip/me.md" not in nodes
    assert {(r["name"], r.symbol_kind, r.line) for r in nodes.values() if r.type == "code_symbol"} == {("Build", "func", 4), ("Run", "func", 5), ("Node", "type", 8), ("Max", "value", 11)}
    b = nodes["agent:builder"]
    assert b.scope == ["code/graph/**"] and b.read_chain == ["specs/graph.md", "docs/guide.md"] and b.rules == ["rules/style.md"] and b.responsibilities == "Graph construction and indexing of packages"
    assert nodes["code_package:example.org/graph"].doc_comment == "Graph building."


def test_edges(built):
    edges = {(r["from"], r["to"], r["type"]) for r in built[1].collect()}
    assert ("agent:builder", "spec_section:specs/graph.md:Edges", "reads") in edges
    assert ("agent:payer", "path:code/billing/**", "owns") in edges
    assert ("doc:docs/guide.md:", "spec_section:specs/graph.md:Edges", "supports") in edges
    assert ("code_file:code/graph/build.go", "code_symbol:example.org/graph.Node", "contains") in edges


QUERIES = [("1", "build the graph of packages"), ("2", "refund an invoice"), ("3", "the of and"), ("4", "zebra")]


def test_packets(spark, built):
    concepts = spark.createDataFrame([("concept:g", "Graph build", "building graphs", ["code/graph"], True), ("concept:x", "Graph things", "", [], False)], "id string, name string, description string, source_files array<string>, reviewed boolean")
    leads = spark.createDataFrame([("concept:g", "code_package:example.org/graph", "implements", True)], "from string, to string, type string, reviewed boolean")
    got = {p["query_id"]: p for p in packet.packet(spark, *built, QUERIES, concepts=concepts, concept_edges=leads)}
    one = got["1"]
    assert one["agent"] == "builder" and one["confidence"] > 0.7 and one["scope"] == ["code/graph/**"]
    assert one["relevant_concepts"] == ["Graph build"] and one["implementing_packages"] == ["example.org/graph"]
    assert one["code_entry_points"][0]["symbol"] == "Build" and all(a["relevance"] >= b["relevance"] for a, b in zip(one["context_blocks"], one["context_blocks"][1:]))
    assert got["2"]["agent"] == "payer" and {b["file"] for b in got["2"]["context_blocks"]} >= {"context/payments/snap.md"}
    assert got["3"] == {"query_id": "3", "agent": "", "confidence": 0.0, "reason": "no_clear_owner"}
    assert got["4"]["reason"] == "no_clear_owner"
    again = packet.packet(spark, *built, QUERIES, concepts=concepts, concept_edges=leads)
    assert json.dumps(again, sort_keys=True) == json.dumps(list(got.values()), sort_keys=True)


def test_proposal_and_debug(spark, built):
    got = packet.proposal(spark, *built, [("1", "graph nodes"), ("2", "the")], blocks=2)
    assert len(got[0]["context_blocks"]) == 2 and got[0]["context_blocks"][0]["file"] == "specs/graph.md" and got[1]["context_blocks"] == []
    parts = packet.debug(spark, *built, "build graph")
    assert [r.doc for r in parts["agents"].collect()] == ["builder", "payer"]
    kept = {r.id for r in parts["nodes"].collect()}
    assert {"agent:builder", "agent:payer", "spec_section:specs/graph.md:Nodes"} <= kept
    assert all(r["from"] in kept and r["to"] in kept for r in parts["edges"].collect())


def test_service(spark, built):
    def ask(method, **params):
        return json.loads(packet.serve(spark, *built, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))

    assert len(ask("tools/list")["result"]["tools"]) == 4
    node = ask("tools/call", name="get_node", arguments={"id": "agent:payer"})
    assert json.loads(node["result"]["content"][0]["text"])["name"] == "payer"
    near = json.loads(ask("tools/call", name="get_neighbors", arguments={"id": "decision:0001-hash"})["result"]["content"][0]["text"])
    assert [n["direction"] for n in near] == ["outbound"]
    route = json.loads(ask("tools/call", name="agent_for_task", arguments={"task": "invoices"})["result"]["content"][0]["text"])
    assert route["agent"] == "payer"
    assert ask("tools/call", name="get_node", arguments={"id": "x"})["error"]["code"] == -32603
    assert ask("nothing")["error"]["code"] == -32601
    assert json.loads(packet.serve(spark, *built, "{"))["error"]["code"] == -32700
    assert packet.serve(spark, *built, '{"method": "notifications/initialized"}') is None


def test_settings(tmp_path):
    f = tmp_path / "scoring.toml"
    f.write_text("[bm25]\nk1 = 2\n[routing]\ntemperature = -1\n[odd]\nx = 1\n[retrieval.trust_boost]\nnotes = 0.4\n")
    s = config.load(f)
    assert s["bm25.k1"] == 2.0 and s["routing.temperature"] == 0.2 and s["retrieval.trust_boost.notes"] == 0.4
    assert len(config.problems(f)) == 2 and config.load(tmp_path / "none")["bm25.k1"] == 1.2
    config.save(f, s.with_value("retrieval.include_notes", "false"))
    again = config.load(f)
    assert again["bm25.k1"] == 2.0 and again["retrieval.include_notes"] is False and config.problems(f) == []
    with pytest.raises(ValueError):
        s.with_value("bm25.k1", "0")
    with pytest.raises(KeyError):
        s.with_value("no.key", "1")
    assert "saturation" in config.describe("bm25.k1")


def test_stores(spark, tmp_path):
    assert store.open_runs(spark, f"{tmp_path}/runs").count() == 0
    row = spark.createDataFrame([(1, "ls", "s", 100, 1, 1, 1, 0, 0.0, "read:go", 0), (2, "ls", "", 900_000, 1, 1, 1, 0, 0.0, "", 0)], store.usage.SCHEMA)
    store.append_runs(row.drop("session").limit(1), f"{tmp_path}/runs")
    store.append_runs(row.filter("id = 2"), f"{tmp_path}/runs")
    assert {(r.id, r.session, r.matched_filter) for r in store.open_runs(spark, f"{tmp_path}/runs").collect()} == {(1, "", "read.go"), (2, "", "")}
    assert store.prune_runs(spark, f"{tmp_path}/runs", 1, 950_000) == 1 and store.open_runs(spark, f"{tmp_path}/runs").count() == 1
    assert store.read_overlay(spark, f"{tmp_path}/overlay.json") is None
    (tmp_path / "graph.json").write_text(json.dumps({"schema_version": "1", "content_hash": "h", "nodes": [{"id": "a", "type": "doc"}], "edges": [{"from": "a", "to": "b", "type": "reads"}]}))
    nodes, edges, meta = store.read_graph(spark, f"{tmp_path}/graph.json")
    assert nodes.first().id == "a" and edges.first()["to"] == "b" and meta.first().content_hash == "h"
    old = spark.createDataFrame([("k", 1), ("l", 2)], "key string, v int")
    assert {tuple(r) for r in store.put_cache(old, old.filter("key = 'k'").withColumn("v", F.lit(9))).collect()} == {("k", 9), ("l", 2)}
    assert store.read_cache(spark, f"{tmp_path}/none", "key string").count() == 0
    texts = spark.createDataFrame([(1, "ok", 0), (2, "x" * 100, 1)], "id int, text string, exit_code int")
    assert store.piped(texts, 50).count() == 1 and store.kept_raw(texts).first().id == 2 and store.kept_raw(texts, "never").count() == 0


def test_stream_trend(spark, tmp_path):
    from tessera.streaming import usage as stream

    rows = spark.createDataFrame([(1, 0, 5, 1.0), (2, 90_000, 7, 3.0), (3, 90_001, 7, 5.0)], "id long, recorded_at long, token_saved long, reduction_pct double")
    rows.write.parquet(f"{tmp_path}/in")
    q = stream.trend(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("trend").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.invocations for r in spark.table("trend").collect()) == [1, 2]
