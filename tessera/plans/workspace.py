"""Graph, audit, overlay, classification and compaction queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import audit, classify, compact, graph, overlay
from tessera.plans.common import table

# ---- the graph that the star schema stands for ----


def nodes(spark, d):
    """Typed nodes of the star schema; file is the parent that a node belongs to."""
    parts = [
        ("region", "region", "r_regionkey", "r_name", None),
        ("nation", "nation", "n_nationkey", "n_name", "n_regionkey"),
        ("customer", "doc", "c_custkey", "c_name", "floor(c_custkey / 2)"),
        ("supplier", "decision", "s_suppkey", "s_name", "s_nationkey"),
        ("part", "spec_section", "p_partkey", "p_name", "floor(p_partkey / 2)"),
    ]
    out = None
    for name, kind, key, label, parent in parts:
        own = table(spark, d, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.concat(F.lit(f"{name}/"), F.expr(parent).cast("string") if parent else F.lit("all")).alias("file"), F.col(label).alias("name"))
        out = own if out is None else out.unionAll(own)
    return out


def edges(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    a = nation.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("from"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("to"), F.lit("reads").alias("type"))
    b = customer.select(F.concat(F.lit("doc:"), F.col("c_custkey").cast("string")).alias("from"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("to"), F.lit("owns").alias("type"))
    c = table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("from"), F.concat(F.lit("doc:"), F.col("o_custkey").cast("string")).alias("to"), F.lit("owns").alias("type"))
    # every line is an edge, of a type by its columns
    part, supplier = F.concat(F.lit("spec_section:"), F.col("l_partkey").cast("string")), F.concat(F.lit("decision:"), F.col("l_suppkey").cast("string"))
    back = (F.col("l_quantity") > 49) & (F.col("l_discount") > 0.09)
    kind = F.when(back, "supports").when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45), "references").otherwise("owns")
    f = table(spark, d, "lineitem").select(F.when(back, part).otherwise(supplier).alias("from"), F.when(back, supplier).otherwise(part).alias("to"), kind.alias("type")).distinct()
    return a.unionAll(b).unionAll(c).unionAll(f)


_GRAPH = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS type, 'region/all' AS file, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 'nation/' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'doc:' || c_custkey, 'doc', 'customer/' || c_custkey // 2, c_name FROM customer
  UNION ALL SELECT 'decision:' || s_suppkey, 'decision', 'supplier/' || s_nationkey, s_name FROM supplier
  UNION ALL SELECT 'spec_section:' || p_partkey, 'spec_section', 'part/' || p_partkey // 2, p_name FROM part
), edges AS (
  SELECT 'nation:' || n_nationkey AS "from", 'region:' || n_regionkey AS "to", 'reads' AS type FROM nation
  UNION ALL SELECT 'doc:' || c_custkey, 'nation:' || c_nationkey, 'owns' FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'doc:' || o_custkey, 'owns' FROM orders
  UNION ALL SELECT DISTINCT 'decision:' || l_suppkey, 'spec_section:' || l_partkey, CASE WHEN l_returnflag = 'A' AND l_quantity > 45 THEN 'references' ELSE 'owns' END FROM lineitem WHERE NOT (l_quantity > 49 AND l_discount > 0.09)
  UNION ALL SELECT DISTINCT 'spec_section:' || l_partkey, 'decision:' || l_suppkey, 'supports' FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09
)"""
_F = ["code", "severity", "message", "file", "line"]


def _findings(df):
    return df.select("code", "severity", "message", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.array_join("refs", ",").alias("refs"))


def _graph_audit(check):
    return lambda s, d: _findings(check(nodes(s, d), edges(s, d)))


def induced(spark, d):
    want = nodes(spark, d).filter((F.col("type") == "nation") | F.col("file").isin("customer/3", "customer/7")).select("id")
    return graph.induced(nodes(spark, d), edges(spark, d), want)[1]


def snapshots(spark, d):
    """Pages as snapshots of the topic of their first path part; sources are the topics that agents declare."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("context_snapshot:"), F.col("page_id").cast("string")).alias("id"), F.lit("context_snapshot").alias("type"), F.concat(F.lit("context/"), F.concat(F.lit("SRC"), (F.col("page_id") % 40).cast("string")), F.lit("/snap.md")).alias("file"), F.col("url").alias("name"))
    links = pages.filter("name LIKE '%page=%'").select(F.lit("agent:a").alias("from"), F.col("id").alias("to"), F.lit("reads").alias("type"))
    return _findings(audit.orphan_snapshots(pages, links, table(spark, d, "documents").select(F.col("source").alias("topic")).distinct()))


def _urls(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


def dangling(spark, d):
    pages = _urls(spark, d)
    owned = pages.select(F.concat(F.lit("agent:"), (F.col("page_id") % 7).cast("string")).alias("from"), F.concat(F.lit("path:"), "path").alias("to"), F.lit("owns").alias("type"))
    return _findings(audit.dangling_paths(owned, pages.filter("url LIKE 'https:%'").select("path")))


def unowned(spark, d):
    dirs = table(spark, d, "documents").select(F.col("source").alias("dir")).distinct()
    scopes = table(spark, d, "documents").filter("source < 'src15'").select(F.concat(F.lit("code/"), "source", F.lit("/**")).alias("scope")).distinct()
    return _findings(audit.unowned_dirs(dirs, scopes))


def overlapping(spark, d):
    pages = _urls(spark, d)
    scopes = pages.select(F.concat(F.lit("agent:"), F.lpad((F.col("page_id") % 5).cast("string"), 2, "0")).alias("agent"), F.when(F.col("page_id") % 10 == 0, F.regexp_extract("path", "^([^/]*)", 1)).otherwise(F.col("path")).alias("scope"))
    return _findings(audit.overlapping_scopes(scopes))


def blank(spark, d):
    agents = table(spark, d, "customer").select(F.concat(F.lit("agent:"), F.col("c_custkey").cast("string")).alias("id"), F.array("c_mktsegment").alias("scope"), F.when(F.col("c_acctbal") < 0, F.lit("  ")).otherwise(F.col("c_name")).alias("responsibilities"), F.col("c_name").alias("file"))
    return _findings(audit.blank_responsibilities(agents))


def _concepts(spark, d):
    """Labelled documents are concepts, reviewed where the quality is 1."""
    return table(spark, d, "labels").select(F.concat(F.lit("concept:"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("name"), (F.col("quality") == 1).alias("reviewed"))


def _concept_edges(spark, d):
    return table(spark, d, "labels").filter("quality = 1").select(F.concat(F.lit("concept:"), F.col("doc_id").cast("string")).alias("from"), F.concat(F.lit("package:"), (F.col("doc_id") % 9).cast("string")).alias("to"), F.lit("implements").alias("type"), (F.col("toxic") == 1).alias("reviewed"))


def _lead(c):
    """The first two words of a line as a path."""
    return F.concat_ws("/", *[F.regexp_extract(F.lower(c), "^[^a-z]*([a-z]+)[^a-z]+([a-z]+)", i) for i in (1, 2)])


def _candidates(spark, d):
    """Words of benchmark items as ticked identifiers, one line each."""
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("specs/"), F.col("item_id").cast("string"), F.lit(".md")).alias("file"), F.explode(F.split("text", "\n")).alias("x0")).withColumn("line", F.lit(1)).withColumn("x", F.concat(F.lit("`"), F.array_join(F.filter(F.split(F.regexp_replace("x0", "[^A-Za-z ]", ""), " +"), lambda w: w != ""), "` `"), F.lit("` [x](code/"), _lead("x0"), F.lit(")")))
    return audit.candidates(rows)


def _symbols(spark, d):
    words = table(spark, d, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[ \n])([A-Z][a-z]+)[ ,.]"))).alias("name")).distinct()
    return words.select(F.concat(F.lit("lib/"), "source").alias("pkg"), "name", F.lit("f").alias("file"), F.lit(1).alias("line"))


def drift_paths(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("x"))
    disk = lines.select(F.concat(F.lit("code/"), _lead("x")).alias("path")).distinct()
    return _findings(audit.missing_paths(_candidates(spark, d), disk)).select("code", "message", "file")


def drift_identifiers(spark, d):
    return _findings(audit.missing_identifiers(_candidates(spark, d), _symbols(spark, d))).select("code", "message", "file")


def drift_unmentioned(spark, d):
    got = audit.unmentioned(_candidates(spark, d), _symbols(spark, d))
    return got.select("code", F.array_join("refs", ",").alias("refs"))


def _report(spark, d):
    """The findings of all checks, from one reading of the graph and of the overlay."""
    return [audit.one_pass(nodes(spark, d), edges(spark, d), _concepts(spark, d), _concept_edges(spark, d))]


def staleness(spark, d):
    a, b = graph.content_hash(nodes(spark, d)), graph.content_hash(nodes(spark, d).orderBy("name"))
    c = graph.content_hash(nodes(spark, d).filter("id <> 'region:0'"))
    return _findings(audit.stale_graph(a, b).unionAll(audit.stale_graph(a, c)).unionAll(audit.stale_overlay(c.select(F.col("hash").alias("graph_hash")), a)).unionAll(audit.no_overlay(spark, False)))


def merge(spark, d):
    """The concepts of toxic documents come in anew, unreviewed."""
    new = table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("concept:"), F.col("doc_id").cast("string")).alias("id"))
    c = _concepts(spark, d)
    return overlay.merge_concepts(c, c.join(new, "id", "left_semi").withColumn("reviewed", F.lit(False)))


def merge_edges(spark, d):
    """The edges to the first packages come in anew, unreviewed."""
    e = _concept_edges(spark, d)
    return overlay.merge_edges(e, e.filter(F.col("to") < "package:4").withColumn("reviewed", F.lit(False)), merge(spark, d))


def validate(spark, d):
    """One response for each labelled document: a concept and an edge, right or wrong by its labels."""
    rows = table(spark, d, "labels").select(
        "doc_id",
        F.concat(
            F.lit('```json\n{"concepts":[{"id":"'), F.when(F.col("quality") == 1, "concept:").otherwise("c:"), F.col("doc_id").cast("string"), F.lit('","name":"n","confidence":2.0}],"edges":[{"from":"concept:'), F.col("doc_id").cast("string"),
            F.lit('","to":"nation:'), (F.col("doc_id") % 40).cast("string"), F.lit('","type":"'), F.when(F.col("toxic") == 1, "implements").otherwise("drifted_from"), F.lit('","tag":"x","confidence":'), F.when(F.col("doc_id") % 2 == 0, "0.9").otherwise("0.5"), F.lit("}]}\n```"),
        ).alias("text"),
    )
    parsed = overlay.parse(rows, "doc_id")
    return overlay.edges(parsed, "doc_id", nodes(spark, d)).select("doc_id", "from", "to", "type", "tag", "confidence", "reviewed")


def near_duplicates(spark, d):
    """Words of benchmark items as proposals, the symbols of documents as what there is."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " +")).alias("name")).filter(F.length("name") >= 6).distinct()
    return overlay.near_duplicates(words, _symbols(spark, d).select("name").filter(F.length("name") >= 6).distinct())


# ---- texts ----


def _lines(spark, d):
    return graph.lines(table(spark, d, "documents"), "doc_id")


def _repeated(spark, d):
    return compact.repeats(_lines(spark, d), "doc_id").withColumn("x", F.md5(F.col("x").cast("binary")))


def sections(spark, d):
    """Documents with every third line as a heading."""
    marked = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("## "), x)).otherwise(x)), "\n").alias("text"))
    return graph.sections(marked, "doc_id").select("doc_id", "nth", "heading", F.length("content").alias("n"))


def references(spark, d):
    page = table(spark, d, "pages").select("page_id", F.concat(F.lit("[a](docs/"), F.regexp_extract("url", "([^/]*)$", 1), F.lit(") and `src/"), (F.col("page_id") % 9).cast("string"), F.lit("/x.py` [b]("), "url", F.lit(") [a](docs/x.md)")).alias("text"))
    return page.select("page_id", F.array_join(graph.references(F.col("text")), " ").alias("refs"))


def list_items(spark, d):
    listed = table(spark, d, "part").select("p_partkey", F.concat(F.lit("intro\n- `"), "p_name", F.lit("` — why\n2. "), "p_type", F.lit("\n* "), "p_brand", F.lit("\nend")).alias("text"))
    return listed.select("p_partkey", F.array_join(graph.list_items(F.col("text")), "|").alias("items"))


def classified(spark, d):
    return classify.decided(_notes(spark, d)).select("doc_id", "type", "confidence", "best", "second")


def _notes(spark, d):
    """Documents with phrases of notes put in by id, so that every type occurs."""
    phrase = F.element_at(F.array(*[F.lit(x) for x in ("We decided X. rationale: because", "It must be, and shall hold. Normative text", "How to: step 1, step 2. ```sh", "architecture and component layer pipeline", "TODO: open question? unclear, tbd", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    second = F.when(F.col("doc_id") % 5 == 0, F.lit(" getting started walkthrough")).when(F.col("doc_id") % 7 == 0, F.lit(" fixme todo pending")).otherwise("")
    return table(spark, d, "documents").select("doc_id", "source", F.concat(phrase, second, F.lit(" "), "text").alias("text"))


def class_scores(spark, d):
    return _notes(spark, d).select("doc_id", *[classify.score(F.col("text"), t).alias(t.replace("-", "_")) for t in classify.TYPES])


def targets(spark, d):
    notes = classify.decided(_notes(spark, d))
    title = F.concat("source", F.lit(" Note, No. "), F.col("doc_id").cast("string"))
    return notes.select("doc_id", F.coalesce(classify.target_path(F.col("type"), title, F.col("doc_id") % 10000), F.lit("")).alias("path"))


QUERIES = {
    "graph_nodes": nodes,
    "graph_edges": edges,
    "graph_summary": lambda s, d: graph.summary(nodes(s, d), edges(s, d)),
    "graph_first_node": lambda s, d: graph.first_node(nodes(s, d)),
    "neighbors": lambda s, d: graph.neighbours(nodes(s, d), edges(s, d), "decision:7"),
    "node_lookup": lambda s, d: graph.node(nodes(s, d), "nation:7"),
    "induced_subgraph": induced,
    "orphans_file": _graph_audit(audit.orphan_specs),
    "orphans_node": _graph_audit(audit.orphan_decisions),
    "orphans_doc": _graph_audit(audit.orphan_docs),
    "orphans_topic": snapshots,
    "inbound_counts": lambda s, d: audit.inbound(edges(s, d)),
    "dangling_paths": dangling,
    "unowned_dirs": unowned,
    "overlapping_scopes": overlapping,
    "blank_resp": blank,
    "unimplemented": lambda s, d: _findings(audit.unimplemented(_concepts(s, d), _concept_edges(s, d))),
    "unreviewed": lambda s, d: _findings(audit.unreviewed(_concepts(s, d), _concept_edges(s, d))),
    "drift_missing": drift_paths,
    "drift_ident": drift_identifiers,
    "drift_unmentioned": drift_unmentioned,
    "findings_report": lambda s, d: _findings(audit.report(_report(s, d), "warn")),
    "severity_counts": lambda s, d: audit.severity_counts(audit.report(_report(s, d))),
    "findings_shown": lambda s, d: _findings(audit.shown(audit.report(_report(s, d)))).select("code", "message"),
    "staleness": staleness,
    "overlay_merge": merge,
    "overlay_merge_edges": merge_edges,
    "overlay_validate": validate,
    "allowlist": lambda s, d: overlay.allowed_ids(nodes(s, d), _concepts(s, d)),
    "near_duplicates": near_duplicates,
    "md_sections": sections,
    "md_refs": references,
    "list_items": list_items,
    "classify_scores": class_scores,
    "classify_label": classified,
    "promote_targets": targets,
    "repeat_collapse": _repeated,
    "collapse_text": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(compact.collapsed(F.split("text", "\n")), "\n").alias("text")).withColumn("text", F.md5(F.col("text").cast("binary"))),
    "head_tail": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(compact.elided(F.split("text", "[ \n]"), 11), " ").alias("text")),
    "line_window": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(compact.window(F.split("text", "\n"), first=2), "|").alias("first"), F.array_join(compact.window(F.split("text", "\n"), last=2), "|").alias("last")),
    "line_numbers": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.array_join(text.numbered(F.split("text", "\n")), "\n").cast("binary")).alias("digest")),
    "json_summary": lambda s, d: table(s, d, "events").select("event_id", compact.json_summary(F.col("props")).alias("j")).select("event_id", "j.kind", F.col("j.n").cast("long").alias("n"), "j.keys"),
    "redact": lambda s, d: table(s, d, "documents").select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: text.is_secret_name(F.split_part(w, F.lit("="), F.lit(1))) & w.contains("="))).cast("long").alias("secrets")),
}


def _find(code: str, severity: str, message: str, file: str = "''", refs: str = "''", line: str = "0::BIGINT") -> str:
    return f"SELECT '{code}' AS code, '{severity}' AS severity, {message} AS message, {file} AS file, {line} AS line, {refs} AS refs"


_IN = """inb AS (SELECT "to" AS id, count(*) FILTER (WHERE type IN ('reads', 'references', 'supports')) AS referring, count(*) AS "any" FROM edges GROUP BY 1)"""
_SPECS = _find("ORPH001", "error", "'spec file ' || file || ' is not referenced by any agent or document'", "file", "string_agg(DISTINCT id, ',' ORDER BY id)") + " FROM nodes LEFT JOIN inb USING (id) WHERE type = 'spec_section' GROUP BY file HAVING max(coalesce(referring, 0)) = 0"
_DECISIONS = _find("ORPH001", "error", "'decision ' || name || ' is not referenced by any agent or document'", "file", "id") + " FROM nodes LEFT JOIN inb USING (id) WHERE type = 'decision' AND coalesce(referring, 0) = 0"
_DOCS = _find("ORPH002", "warn", "'doc file ' || file || ' has no inbound references'", "file") + " FROM nodes LEFT JOIN inb USING (id) WHERE type = 'doc' GROUP BY file HAVING max(coalesce(\"any\", 0)) = 0"
_CON = """con AS (SELECT 'concept:' || doc_id AS id, 'c' || doc_id AS name, quality = 1 AS reviewed, toxic = 1 AS flagged FROM labels),
ce AS (SELECT 'concept:' || doc_id AS "from", 'package:' || doc_id % 9 AS "to", 'implements' AS type, toxic = 1 AS reviewed FROM labels WHERE quality = 1)"""
_UNIMPL = _find("COV005", "warn", "'concept \"' || name || '\" (' || id || ') has no implementing code package'", "''", "id") + " FROM con WHERE id NOT IN (SELECT \"from\" FROM ce)"
_UNREV = _find("STALE003", "warn", "n || ' overlay items are not reviewed'") + " FROM (SELECT count(*) FILTER (WHERE NOT reviewed) AS n FROM (SELECT reviewed FROM con UNION ALL SELECT reviewed FROM ce)) WHERE n > 0"
_ALL = f"allf AS ({_SPECS} UNION ALL {_DECISIONS} UNION ALL {_DOCS} UNION ALL {_UNIMPL} UNION ALL {_UNREV})"
_LEAD = "concat_ws('/', regexp_extract(lower(x), '^[^a-z]*([a-z]+)[^a-z]+([a-z]+)', 1), regexp_extract(lower(x), '^[^a-z]*([a-z]+)[^a-z]+([a-z]+)', 2))"
_CAND = f"""lines AS (SELECT 'specs/' || item_id || '.md' AS file, unnest(string_split(text, chr(10))) AS x FROM benchmark),
toks AS (SELECT file, unnest(regexp_split_to_array(regexp_replace(x, '[^A-Za-z ]', '', 'g'), ' +')) AS t FROM lines),
idents AS (SELECT DISTINCT file, t FROM toks WHERE regexp_matches(t, '^[A-Z][A-Za-z0-9]*$')),
paths AS (SELECT 'code/' || {_LEAD} AS t, min(file) AS file FROM lines GROUP BY 1),
syms AS (SELECT DISTINCT 'lib/' || source AS pkg, unnest(regexp_extract_all(text, '(?:^|[ \\n])([A-Z][a-z]+)[ ,.]', 1)) AS name FROM documents)"""


def _score_sql(kind: str) -> str:
    parts = []
    for strength, patterns in classify.SIGNALS[kind].items():
        for p in patterns:
            q = p.replace("'", "''")
            hit = f"regexp_matches(low, '{q[1:-1]}')" if len(p) > 1 and p[0] == p[-1] == "/" else f"contains(low, '{q}')"
            parts.append(f"CASE WHEN {hit} THEN {classify.WEIGHTS[strength]} ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


_PHRASES = "['We decided X. rationale: because', 'It must be, and shall hold. Normative text', 'How to: step 1, step 2. ```sh', 'architecture and component layer pipeline', 'TODO: open question? unclear, tbd', '']"
_NOTES = f"""notes AS (SELECT doc_id, source, lower({_PHRASES}[CAST(doc_id % 6 + 1 AS INTEGER)] || CASE WHEN doc_id % 5 = 0 THEN ' getting started walkthrough' WHEN doc_id % 7 = 0 THEN ' fixme todo pending' ELSE '' END || ' ' || text) AS low FROM documents),
sc AS (SELECT doc_id, source, {', '.join(f'{_score_sql(t)} AS s{i}' for i, t in enumerate(classify.TYPES))} FROM notes),
un AS (SELECT doc_id, source, unnest([{', '.join(f's{i}' for i in range(5))}]) AS s, unnest([0, 1, 2, 3, 4]) AS i FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS r FROM un),
top AS (SELECT a.doc_id, a.source, a.s AS best, b.s AS second, CASE WHEN a.s < 4 THEN 'unknown' ELSE {list(classify.TYPES)}[a.i + 1] END AS type FROM rk a JOIN rk b ON a.doc_id = b.doc_id AND a.r = 1 AND b.r = 2)"""
_RUNS = "SELECT doc_id, line, x, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY doc_id ORDER BY line) THEN 0 ELSE 1 END AS new FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"
ORACLE_SQL = {
    "graph_nodes": f"WITH {_GRAPH} SELECT * FROM nodes",
    "graph_edges": f"WITH {_GRAPH} SELECT * FROM edges",
    "graph_summary": f"WITH {_GRAPH} SELECT 'node' AS what, type, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY 2",
    "graph_first_node": f"WITH {_GRAPH} SELECT file, min(id) AS id FROM nodes GROUP BY file",
    "neighbors": f"""WITH {_GRAPH}, a AS (SELECT 'outbound' AS direction, type AS edge, "to" AS id FROM edges WHERE "from" = 'decision:7' UNION ALL SELECT 'inbound', type, "from" FROM edges WHERE "to" = 'decision:7' AND "from" <> 'decision:7') SELECT id, direction, edge, type, file, name FROM a JOIN nodes USING (id)""",
    "node_lookup": f"WITH {_GRAPH} SELECT * FROM nodes WHERE id = 'nation:7'",
    "induced_subgraph": f"""WITH {_GRAPH}, w AS (SELECT id FROM nodes WHERE type = 'nation' OR file IN ('customer/3', 'customer/7')) SELECT "from", "to", type FROM edges WHERE "from" IN (SELECT id FROM w) AND "to" IN (SELECT id FROM w)""",
    "orphans_file": f"WITH {_GRAPH}, {_IN} {_SPECS}",
    "orphans_node": f"WITH {_GRAPH}, {_IN} {_DECISIONS}",
    "orphans_doc": f"WITH {_GRAPH}, {_IN} {_DOCS}",
    "orphans_topic": _find("ORPH003", "info", "'context snapshot ' || file || ' is not referenced by any agent'", "file", "'context_snapshot:' || page_id") + " FROM (SELECT page_id, url, 'context/SRC' || page_id % 40 || '/snap.md' AS file FROM pages) WHERE NOT contains(url, 'page=') AND 'src' || page_id % 40 NOT IN (SELECT lower(source) FROM documents WHERE source IS NOT NULL)",
    "inbound_counts": f"WITH {_GRAPH}, {_IN} SELECT * FROM inb",
    "dangling_paths": "WITH p AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), o AS (SELECT DISTINCT 'agent:' || page_id % 7 AS a, path FROM p WHERE NOT regexp_matches(path, '[*?]')) " + _find("COV001", "error", "a || ' owns \"' || path || '\" which does not exist on disk'", "''", "a || ',' || path") + " FROM o WHERE path NOT IN (SELECT path FROM p WHERE starts_with(url, 'https:'))",
    "unowned_dirs": _find("COV002", "warn", "'code/' || dir || '/ is not owned by any agent'", "'code/' || dir") + " FROM (SELECT DISTINCT source AS dir FROM documents) WHERE dir NOT IN (SELECT source FROM documents WHERE source < 'src15')",
    "overlapping_scopes": """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
s AS (SELECT DISTINCT 'agent:' || lpad(CAST(page_id % 5 AS VARCHAR), 2, '0') AS agent, CASE WHEN page_id % 10 = 0 THEN regexp_extract(path, '^([^/]*)', 1) ELSE path END AS scope FROM p),
t AS (SELECT agent, scope, regexp_replace(scope, '/+$', '') AS path FROM s WHERE NOT regexp_matches(scope, '[*?]')) """ + _find("COV003", "warn", "a.agent || ' and ' || b.agent || ' have overlapping scope paths \"' || a.scope || '\" and \"' || b.scope || '\"'", "''", "concat_ws(',', a.agent, b.agent, a.scope, b.scope)") + " FROM t a JOIN t b ON a.agent < b.agent AND (a.path = b.path OR starts_with(a.path, b.path || '/') OR starts_with(b.path, a.path || '/'))",
    "blank_resp": _find("COV004", "info", "'agent:' || c_custkey || ' declares scope paths but has no responsibilities description'", "c_name", "'agent:' || c_custkey") + " FROM customer WHERE c_acctbal < 0 OR trim(c_name) = ''",
    "unimplemented": f"WITH {_CON} {_UNIMPL}",
    "unreviewed": f"WITH {_CON} {_UNREV}",
    "drift_missing": f"WITH {_CAND} SELECT 'DRIFT001' AS code, 'spec references code path \"' || t || '\" which does not exist' AS message, file FROM paths WHERE t NOT IN (SELECT 'code/' || {_LEAD} FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents))",
    "drift_ident": f"WITH {_CAND} SELECT 'DRIFT002' AS code, 'spec references identifier \"' || t || '\" which is not present in the codebase' AS message, file FROM idents WHERE t NOT IN (SELECT name FROM syms)",
    "drift_unmentioned": f"WITH {_CAND} SELECT 'DRIFT003' AS code, pkg || '.' || name AS refs FROM syms WHERE name NOT IN (SELECT t FROM idents)",
    "findings_report": f"WITH {_GRAPH}, {_IN}, {_CON}, {_ALL} SELECT * FROM allf WHERE severity <> 'info'",
    "severity_counts": f"WITH {_GRAPH}, {_IN}, {_CON}, {_ALL} SELECT s.severity, count(code) AS n FROM (VALUES ('error'), ('warn'), ('info')) s(severity) LEFT JOIN allf USING (severity) GROUP BY 1",
    "findings_shown": f"WITH {_GRAPH}, {_IN}, {_CON}, {_ALL} SELECT code, message FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY CASE substr(code, 1, 4) WHEN 'ORPH' THEN 'orphans' WHEN 'COV0' THEN 'coverage' ELSE 'staleness' END, code, file, line, message) AS k FROM allf) WHERE k <= 25",
    "staleness": "SELECT * FROM (" + " UNION ALL ".join([_find("STALE001", "error", "'graph differs from the workspace'"), _find("STALE002", "warn", "'overlay was made for another graph'"), _find("STALE004", "info", "'no semantic overlay'")]) + ")",
    "overlay_merge": f"WITH {_CON} SELECT id, name, false AS reviewed FROM con WHERE flagged UNION ALL SELECT id, name, reviewed FROM con WHERE reviewed AND NOT flagged",
    "overlay_merge_edges": f"""WITH {_CON}, m AS (SELECT id FROM con WHERE flagged OR reviewed), e AS (SELECT "from", "to", type, false AS reviewed FROM ce WHERE "to" < 'package:4' UNION ALL SELECT "from", "to", type, reviewed FROM ce WHERE reviewed AND "to" >= 'package:4') SELECT * FROM e WHERE "from" IN (SELECT id FROM m)""",
    "overlay_validate": """SELECT doc_id, 'concept:' || doc_id AS "from", 'nation:' || doc_id % 40 AS "to", CASE WHEN toxic = 1 THEN 'implements' ELSE 'drifted_from' END AS type, 'EXTRACTED' AS tag, CASE WHEN doc_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence, doc_id % 2 = 0 AS reviewed FROM labels WHERE quality = 1 AND doc_id % 40 IN (SELECT n_nationkey FROM nation)""",
    "allowlist": f"WITH {_GRAPH}, {_CON} SELECT id FROM nodes UNION SELECT id FROM con WHERE reviewed",
    "near_duplicates": f"""WITH {_CAND}, a AS (SELECT DISTINCT t AS name, lower(t) AS norm FROM (SELECT unnest(regexp_split_to_array(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +')) AS t FROM benchmark) WHERE length(t) >= 6),
b AS (SELECT DISTINCT name AS other, lower(name) AS other_norm FROM syms WHERE length(name) >= 6)
SELECT name, other, CAST(levenshtein(norm, other_norm) AS INTEGER) AS distance FROM a, b WHERE abs(length(norm) - length(other_norm)) <= 3 AND levenshtein(norm, other_norm) <= CASE WHEN length(norm) > 10 THEN 3 ELSE 2 END""",
    "md_sections": """WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
m AS (SELECT doc_id, i, CASE WHEN i % 3 = 1 THEN '## ' || t ELSE t END AS t FROM l),
g AS (SELECT *, count(*) FILTER (WHERE starts_with(t, '## ')) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM m)
SELECT doc_id, CAST(nth AS INTEGER) AS nth, trim(substr(min(t) FILTER (WHERE starts_with(t, '## ')), 4)) AS heading, CAST(length(trim(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE NOT starts_with(t, '## ') AND trim(t) <> '---'), ''), ' ' || chr(10))) AS INTEGER) AS n FROM g WHERE nth > 0 GROUP BY doc_id, nth""",
    "md_refs": "SELECT page_id, CASE WHEN f = 'x.md' THEN 'docs/x.md src/' || page_id % 9 || '/x.py' ELSE 'docs/' || f || ' docs/x.md src/' || page_id % 9 || '/x.py' END AS refs FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS f FROM pages)",
    "list_items": "SELECT p_partkey, p_name || '|' || p_type || '|' || p_brand AS items FROM part",
    "classify_scores": f"WITH {_NOTES} SELECT doc_id, {', '.join(f's{i} AS {t.replace('-', '_')}' for i, t in enumerate(classify.TYPES))} FROM sc",
    "classify_label": f"WITH {_NOTES} SELECT doc_id, type, CASE WHEN best < 4 THEN 'low' WHEN best - second < 2 THEN 'medium' WHEN best >= 6 THEN 'high' ELSE 'medium' END AS confidence, best, second FROM top",
    "promote_targets": f"""WITH {_NOTES}, sl AS (SELECT doc_id, type, source || '-note-no-' || doc_id || '.md' AS f FROM top) SELECT doc_id, CASE type WHEN 'adr' THEN 'specs/decisions/' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '-' || f WHEN 'spec' THEN 'specs/' || f WHEN 'guide' THEN 'docs/guides/' || f WHEN 'arch' THEN 'docs/' || f WHEN 'open-item' THEN 'docs/open-items.md' ELSE '' END AS path FROM sl""",
    "repeat_collapse": f"SELECT doc_id, CAST(min(line) AS INTEGER) AS first, count(*) AS n, md5(any_value(x)) AS x FROM ({_RUNS}) GROUP BY doc_id, run",
    "collapse_text": f"SELECT doc_id, md5(string_agg(CASE WHEN n > 1 THEN '[repeated ' || n || ' times] ' || x ELSE x END, chr(10) ORDER BY run)) AS text FROM (SELECT doc_id, run, count(*) AS n, any_value(x) AS x FROM ({_RUNS}) GROUP BY doc_id, run) GROUP BY doc_id",
    "head_tail": "SELECT doc_id, CASE WHEN len(w) <= 11 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:5], ' ') || ' ...(' || (len(w) - 10) || ' lines omitted)... ' || array_to_string(w[len(w) - 4:len(w)], ' ') END AS text FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n]') AS w FROM documents)",
    "line_window": "SELECT doc_id, array_to_string(l[1:2], '|') AS first, array_to_string(l[greatest(len(l) - 1, 1):len(l)], '|') AS last FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "line_numbers": "SELECT doc_id, md5(array_to_string(list_transform(list_zip(l, range(1, len(l) + 1)), lambda p: lpad(CAST(p[2] AS VARCHAR), CAST(length(CAST(len(l) AS VARCHAR)) AS INTEGER), ' ') || '|' || p[1]), chr(10))) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "json_summary": "SELECT event_id, lower(json_type(props)) AS kind, CAST(len(json_keys(props)) AS BIGINT) AS n, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "redact": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: contains(w, '=') AND regexp_matches(split_part(w, '=', 1), '(?i)(token|secret|password|passwd|pwd|bearer|credential|api[_-]?key|auth|private[_-]?key)'))) AS secrets FROM documents",
}
