import math

from pyspark.sql import functions as F

from tessera.operators import audit, bm25, classify, compact, graph, overlay, retrieval, routing, usage
from tessera.operators.bm25 import Field


def docs(spark):
    rows = [(1, ["graph", "build", "graph"], ["code"]), (2, ["audit"], ["code", "graph"]), (3, [], [])]
    return spark.createDataFrame(rows, "id long, body array<string>, path array<string>")


FIELDS = [Field("body", 2.0, 0.75), Field("path", 0.0, 0.5)]


def terms(spark, *ts):
    return spark.createDataFrame([("q", t) for t in ts], "query_id string, term string")


def test_bm25_by_hand(spark):
    got = {r.doc: r.score for r in bm25.scores(docs(spark), terms(spark, "graph"), "id", FIELDS, k1=1.2).collect()}
    # df counts the field of weight 0 too: 2 of 3 documents; idf falls below its floor of 1
    avg = max(1.0, 4 / 3)
    t = 2.0 * 2 / (1 - 0.75 + 0.75 * 3 / avg)
    assert math.isclose(got[1], t / (1.2 + t)) and got[2] == 0.0 and 3 not in got
    twice = {r.doc: r.score for r in bm25.scores(docs(spark), terms(spark, "graph", "graph"), "id", FIELDS).collect()}
    assert math.isclose(twice[1], 2 * got[1])


def test_shares_sum_to_score(spark):
    fields = [Field("body", 2.0, 0.75), Field("path", 1.0, 0.5)]
    q = terms(spark, "graph", "code")
    score = {r.doc: r.score for r in bm25.scores(docs(spark), q, "id", fields).collect()}
    share = {r.doc: r.s for r in bm25.field_shares(docs(spark), q, "id", fields).groupBy("doc").agg(F.sum("share").alias("s")).collect()}
    assert score.keys() == share.keys() and all(math.isclose(score[d], share[d]) for d in score)


def test_empty_corpus(spark):
    assert bm25.scores(docs(spark).limit(0), terms(spark, "x"), "id", FIELDS).count() == 0


def test_routing(spark):
    scores = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 0.0), ("n", "a", 0.0), ("n", "b", 0.0)], "query_id string, doc string, score double")
    got = {r.query_id: r for r in routing.route(scores).collect()}
    assert got["q"].owner == "a" and [c.name for c in got["q"].candidates] == ["a", "b"]
    assert got["n"].owner is None and got["n"].candidates == [] and got["n"].confidence == 0
    sums = routing.softmax(scores).groupBy("query_id").agg(F.sum("confidence").alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in sums)


def test_out_of_scope(spark):
    d = spark.createDataFrame([("x", ["a"], ["a", "b"])], "name string, body array<string>, outside array<string>")
    got = routing.owner_scores(d, terms(spark, "a", "b"), "name", [Field("body", 1.0, 0.75)], "outside").first().score
    plain = bm25.scores(d, terms(spark, "a", "b"), "name", [Field("body", 1.0, 0.75)]).first().score
    assert math.isclose(got, max(0.0, plain - 2.5 / 2))


def relevant(spark, n=14):
    rows = [("q", f"docs/{i:02d}", "", "docs", 20.0 - i) for i in range(n)]
    return retrieval.with_relevance(spark.createDataFrame(rows, "query_id string, file string, section string, tier string, score double"))


def test_blocks_and_survivors(spark):
    r = relevant(spark)
    assert [x.rank for x in retrieval.blocks(r).orderBy("rank").collect()] == list(range(1, 13))
    kept = retrieval.with_scope_survivor(r, F.col("file") == "docs/13").orderBy("rank").collect()
    assert len(kept) == 12 and kept[-1].file == "docs/13" and kept[0].file == "docs/00"
    same = retrieval.with_scope_survivor(r, F.col("file") == "docs/03").orderBy("rank").collect()
    assert [x.file for x in same] == [f"docs/{i:02d}" for i in range(12)]
    code = retrieval.with_relevance(spark.createDataFrame([("q", "code/a", "", "docs", 1.0)], "query_id string, file string, section string, tier string, score double"))
    out = retrieval.with_code_survivor(retrieval.blocks(r.limit(5)), code, F.lit(True)).orderBy("rank").collect()
    assert out[-1].file == "code/a" and len(out) == 6


def test_trust_comes_with_tier(spark):
    r = retrieval.with_relevance(spark.createDataFrame([("q", t, "", t, 1.0) for t in ("specs", "docs", "notes")], "query_id string, file string, section string, tier string, score double"))
    assert {x.file: (x.trust, x.relevance) for x in r.collect()} == {"specs": ("high", 1.3), "docs": ("medium", 1.0), "notes": ("low", 0.6)}


def test_near_ties(spark):
    rows = [(1.0, 0.0, "b", "f", "x", 1), (0.95, 0.0, "c", "f", "y", 1), (0.5, 9.0, "z", "f", "z", 1)]
    got = retrieval.entry_points(spark.createDataFrame(rows, "relevance double, reach double, package string, file string, symbol string, line int"))
    assert [g["symbol"] for g in got] == ["y", "x", "z"]


def runs(spark, rows=((1, "a", 0, 10, 100, 10, 90, 90.0, "", 0), (2, "a", 86400, 20, 100, 50, 50, 50.0, "read:go", 0), (3, "b", 86400, 60, 100, 60, 40, 40.0, "rg", 1))):
    return spark.createDataFrame(list(rows), "id long, command string, recorded_at long, duration_ms long, token_before long, token_after long, token_saved long, reduction_pct double, matched_filter string, exit_code int")


def test_usage(spark):
    s = usage.summary(runs(spark)).first()
    assert (s.invocations, s.token_saved, s.reduction_pct_avg, s.duration_ms_avg) == (3, 180, 60.0, 30.0)
    e = usage.summary(runs(spark).limit(0)).first()
    assert (e.invocations, e.token_saved, e.reduction_pct_avg) == (0, 0, 0.0)
    assert {r.label: r.invocations for r in usage.trend(runs(spark)).collect()} == {"1970-01-01": 1, "1970-01-02": 2}
    assert usage.trend(runs(spark), "weekly").first().label == "1970-W01"
    assert usage.top_savers(runs(spark)).first().command == "a"
    assert {r.matched_filter for r in usage.by_filter(runs(spark)).collect()} == {"unknown", "read:go", "rg"}
    assert [r.matched_filter for r in usage.with_dotted_filters(runs(spark)).orderBy("id").collect()] == ["", "read.go", "rg"]
    assert usage.with_session(runs(spark)).first().session == ""
    assert [r.id for r in usage.scan(usage.with_session(runs(spark)), since=1, limit=1).collect()] == [3]
    assert usage.since_days(runs(spark), 1, 86400 * 2).count() == 2


def test_sections_and_references(spark):
    t = spark.createDataFrame([("a", "intro\n## One\nx\n---\ny\n## Two\n"), ("b", None)], "id string, text string")
    assert [(r.heading, r.content) for r in graph.sections(t, "id").orderBy("nth").collect()] == [("One", "x\ny"), ("Two", "")]
    r = spark.range(1).select(graph.references(F.lit("[a](docs/x.md) `src/y.py` [b](https://z) [a](docs/x.md)")).alias("x")).first().x
    assert r == ["docs/x.md", "src/y.py"]


def test_edges(spark):
    nodes = spark.createDataFrame([("doc:b", "d.md"), ("doc:a", "d.md"), ("spec_section:s", "s.md")], "id string, file string")
    agents = spark.createDataFrame([("agent:x", ["d.md — why", "gone"], ["code/x", "s.md"])], "id string, read_chain array<string>, scope array<string>")
    assert [tuple(r) for r in graph.read_edges(agents, nodes).collect()] == [("agent:x", "doc:a", "reads")]
    assert {r.to for r in graph.owner_edges(agents, nodes).collect()} == {"path:code/x", "spec_section:s"}
    texts = spark.createDataFrame([("doc:a", "see `s.md` and [me](d.md)")], "id string, text string")
    assert [tuple(r) for r in graph.reference_edges(texts, nodes).collect()] == [("doc:a", "spec_section:s", "supports")]


def test_hash_ignores_order_only(spark):
    a = spark.createDataFrame([("x", 1), ("y", None)], "id string, n int")
    h = lambda df: graph.content_hash(df).first().hash
    assert h(a) == h(a.orderBy(F.desc("id"))) and h(a) != h(a.limit(1)) and h(a) != h(a.unionAll(a))


def test_manifest(spark):
    files = spark.createDataFrame([("a/b/c.go",), ("x.go",)], "file string")
    manifests = spark.createDataFrame([("a", "m/a"), ("", "root")], "dir string, module string")
    assert {r.file: r.package for r in graph.nearest_manifest(files, manifests).collect()} == {"a/b/c.go": "m/a/b", "x.go": "root"}


def test_drift(spark):
    lines = spark.createDataFrame([("s.md", 1, "`audit.Run` `Gone` `code/x` [l](code/y)"), ("s.md", 2, "`Gone`")], "file string, line int, x string")
    found = audit.candidates(lines)
    symbols = spark.createDataFrame([("lib/audit", "Run", "f", 1), ("lib/audit", "Quiet", "f", 2)], "pkg string, name string, file string, line int")
    disk = spark.createDataFrame([("code/x",)], "path string")
    assert [(r.refs, r.line) for r in audit.missing_paths(found, disk).collect()] == [(["code/y"], 1)]
    assert [r.refs for r in audit.missing_identifiers(found, symbols).collect()] == [["Gone"]]
    assert [r.refs for r in audit.unmentioned(found, symbols).collect()] == [["lib/audit.Quiet"]]


def test_overlaps_and_owners(spark):
    scopes = spark.createDataFrame([("a", "code/x"), ("b", "code/x/y"), ("b", "code/z"), ("a", "code/q/**")], "agent string, scope string")
    assert [r.refs for r in audit.overlapping_scopes(scopes).collect()] == [["a", "b", "code/x", "code/x/y"]]
    dirs = spark.createDataFrame([("x",), ("w",)], "dir string")
    assert [r.file for r in audit.unowned_dirs(dirs, scopes.select("scope")).collect()] == ["code/w"]
    star = spark.createDataFrame([("code/**",)], "scope string")
    assert audit.unowned_dirs(dirs, star).count() == 0


def test_report_order(spark):
    f = [audit.no_overlay(spark, False), audit.stale_graph(spark.createDataFrame([("a",)], "hash string"), spark.createDataFrame([("b",)], "hash string"))]
    assert [r.severity for r in audit.report(f).collect()] == ["error", "info"]
    assert {r.severity: r.n for r in audit.severity_counts(audit.report(f)).collect()} == {"error": 1, "warn": 0, "info": 1}
    assert audit.failed(audit.report(f)) and not audit.failed(f[0])


def test_classify(spark):
    notes = spark.createDataFrame([(1, "We decided X. ## Decision, status: accepted"), (2, None), (3, "1. run this must how to step 1 step 2")], "id int, text string")
    got = {r.id: (r.type, r.confidence) for r in classify.decided(notes).collect()}
    assert got[1] == ("adr", "high") and got[2] == ("unknown", "low") and got[3][0] == "guide"
    files = spark.createDataFrame([("0007-x.md",), ("readme",)], "name string")
    assert classify.next_number(files) == 8 and classify.next_number(files.limit(0)) == 1
    path = spark.range(1).select(classify.target_path(F.lit("adr"), F.lit("My Note"), F.lit(8)).alias("x")).first().x
    assert path == "specs/decisions/0008-my-note.md"
    key = spark.range(1).select(classify.front_matter(F.lit("---\ntype: adr\n---\nx"), "type").alias("x")).first().x
    assert key == "adr"


def test_overlay(spark):
    good = '```json\n{"concepts":[{"id":"concept:a","name":"A"},{"id":"x","name":"B"}],"edges":[{"from":"concept:a","to":"n:1","type":"implements","confidence":0.9},{"from":"concept:a","to":"gone","type":"implements"}]}\n```'
    parsed = overlay.parse(spark.createDataFrame([(1, good), (2, "no json"), (3, None)], "k int, text string"), "k")
    nodes = spark.createDataFrame([("n:1",)], "id string")
    c = overlay.concepts(parsed, "k").collect()
    assert [(r.id, r.tag, r.confidence, r.reviewed) for r in c] == [("concept:a", "EXTRACTED", 1.0, False)]
    assert [(r.to, r.reviewed) for r in overlay.edges(parsed, "k", nodes).collect()] == [("n:1", True)]
    assert {r.k: (r.concepts, r.edges) for r in overlay.skipped(parsed, "k", nodes).collect()} == {1: (1, 1), 2: (0, 0), 3: (0, 0)}


def test_near_duplicates_by_brute_force(spark):
    names = ["graph build", "graph-build", "graf build", "audit", "audlt", "au", "ax", "a", "", "completely different", "completly diferent", "xgraph build", "raph builds"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.name, r.other) for r in overlay.near_duplicates(df, df).collect()}
    bare = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in names for b in names if distance(bare(a), bare(b)) <= (3 if len(bare(a)) > 10 else 2)}
    assert got == want


def test_review(spark):
    items = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "id string, reviewed boolean")
    said = spark.createDataFrame([("a", True), ("b", False)], "id string, accept boolean")
    assert {(r.id, r.reviewed) for r in overlay.reviewed(items, said, ["id"]).collect()} == {("a", True), ("c", True)}


def test_compact(spark):
    x = lambda c: spark.range(1).select(c.alias("x")).first().x
    a = F.array(*[F.lit(v) for v in "aabccc"])
    assert x(compact.collapsed(a)) == ["[repeated 2 times] a", "b", "[repeated 3 times] c"]
    assert x(compact.collapsed(F.array().cast("array<string>"))) == []
    assert x(compact.elided(a, 3)) == ["a", "...(4 lines omitted)...", "c"]
    assert x(compact.generic(F.lit("x \n\n x\n\x1b[31my\x1b[0m"))) == "[repeated 2 times] x\ny"
    assert x(compact.generic(F.lit("é" * 400))) == "é" * 250 + "...(truncated)"
    assert x(compact.single_blanks(F.array(F.lit("a"), F.lit(""), F.lit(" "), F.lit("b")))) == ["a", "", "b"]
    assert x(compact.window(a, last=2)) == ["c", "c"] and x(compact.window(a, first=0)) == []
    assert x(compact.json_kind(F.lit("[1]"))) == "array" and x(compact.json_kind(F.lit("{x"))) is None


def test_fences_and_runs(spark):
    md = "a\n```\n" + "\n".join("x" for _ in range(13)) + "\n```\n```go\n" + "\n".join("y" for _ in range(13)) + "\n```\nb\n```\nopen"
    lines = graph.lines(spark.createDataFrame([("f", md)], "k string, text string"), "k")
    got = compact.fences(lines, "k").orderBy("line").collect()
    assert [r.omitted for r in got if r.omitted] == [13] and sum(r.x == "y" for r in got) == 13 and got[-1].x == "open" and not any(r.x == "x" for r in got)
    runs_ = compact.repeats(spark.createDataFrame([("f", 1, "a"), ("f", 2, "a"), ("f", 3, "b")], "k string, line int, x string"), "k").orderBy("first").collect()
    assert [(r.first, r.n, r.x) for r in runs_] == [(1, 2, "a"), (3, 1, "b")]


def test_promotion(spark):
    x = lambda c: spark.range(1).select(c.alias("x")).first().x
    day = F.to_date(F.lit("2026-01-02"))
    assert x(classify.proposed_content(F.lit("adr"), F.lit("T"), F.lit("body"), F.lit(3), day)) == "---\nstatus: accepted\ndate: 2026-01-02\n---\n\n# ADR-0003: T\n\nbody"
    item = x(classify.proposed_content(F.lit("open-item"), F.lit("T"), F.lit("body"), F.lit(0), day))
    assert item == "## T\n\nbody\n"
    assert x(classify.with_open_items(F.lit("").cast("string"), F.array(F.lit(item)))) == "# Open Items\n\n## T\n\nbody\n"
    assert x(classify.with_open_items(F.lit("# Open Items\n\n## A\n\na\n"), F.array(F.lit(item)))).endswith("a\n\n## T\n\nbody\n")
    assert x(classify.rewritten(F.lit("a\nb"), F.lit("c"))) == "-a\n-b\n+c"


def test_sections_and_prompt(spark):
    agents = spark.createDataFrame([("a", "## Role ## Read-chain ## Rules ## Skills ## Responsibilities ## Out of scope"), ("b", None)], "agent string, text string")
    got = audit.missing_sections(agents).collect()
    assert [r.section for r in got if r.agent == "a"] == ["## Context topics"] and sum(r.agent == "b" for r in got) == 7
    nodes = spark.createDataFrame([("agent:x", "agent", "x", "f", None), ("code_package:p", "code_package", "p", "g", "p"), ("note:n", "note", "n", "h", None)], "id string, type string, name string, file string, package string")
    packs = spark.createDataFrame([("p", ["A", "B"])], "package string, symbols array<string>")
    one, two = overlay.prompt(nodes, packs).first().text, overlay.prompt(nodes.orderBy(F.desc("id")), packs).first().text
    assert one == two and one.endswith("agent:x\ncode_package:p") and '"symbols":["A","B"]' in one and "note:n" not in one


def test_report_forms(spark):
    rows = spark.createDataFrame([("drift", "DRIFT001", "error", "gone", "a.md", 3, ["x"]), ("coverage", "COV003", "warn", "m", None, None, [])], "check string, code string, severity string, message string, file string, line long, refs array<string>")
    assert [r.value for r in audit.as_text(rows).collect()] == ["error DRIFT001 a.md:3 gone", "warn  COV003 m"]
    assert audit.as_json(rows).first().value == '{"check":"drift","code":"DRIFT001","severity":"error","message":"gone","file":"a.md","line":3,"refs":["x"]}'
    assert audit.selected(rows, ["drift"]).count() == 1 and audit.selected(rows, []).count() == 2
    try:
        audit.selected(rows, ["nothing"])
        raise AssertionError
    except ValueError as e:
        assert "nothing" in str(e)


def test_concept_lookups(spark):
    concepts = spark.createDataFrame([("concept:a", True), ("concept:b", True), ("concept:c", False)], "id string, reviewed boolean")
    edges = spark.createDataFrame([("concept:a", "agent:x", "agent_owns_concept", True), ("concept:c", "agent:x", "agent_owns_concept", True), ("concept:b", "agent:x", "agent_owns_concept", False), ("concept:a", "code_package:p/q", "implements", True), ("concept:a", "code_package:r", "implements", False)], "from string, to string, type string, reviewed boolean")
    assert [r.id for r in overlay.concepts_of(concepts, edges, "x").collect()] == ["concept:a"]
    assert [r.package for r in overlay.packages_of(edges, "concept:a").collect()] == ["p/q"]


def test_signals_are_looked_for_once_under_a_condition(spark):
    notes = spark.createDataFrame([("we decided; how to; step 1",)], "text string")
    plan = classify.decided(notes).filter(classify.auto_accepted())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
