"""Queries of single operators over whole tables: edges from texts, manifests, line windows, notes and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import classify, compact, graph, overlay
from tessera.plans.common import table
from tessera.plans.workspace import _CON, _GRAPH, _NOTES, _concepts, _notes, nodes


def _digest(c):
    return F.md5(c.cast("binary"))


# ---- the graph from texts ----


def _agents(spark, d):
    """Each nation reads and owns files named after its key, written in the ways that references are."""
    key = F.col("n_nationkey").cast("string")
    refs = F.array(F.concat(F.lit("customer/"), key, F.lit(" — its customers")), F.concat(F.lit("`part\\"), key, F.lit("`")), F.concat(F.lit("gone/"), key))
    return table(spark, d, "nation").select(F.concat(F.lit("agent:"), key).alias("id"), refs.alias("read_chain"), refs.alias("scope"))


def references(spark, d):
    key = F.col("page_id").cast("string")
    named = table(spark, d, "pages").select(F.concat(F.lit("doc:"), key).alias("id"), F.concat(F.lit("[a](part/"), key, F.lit(") `supplier/"), (F.col("page_id") % 25).cast("string"), F.lit("` [b](region/all) [c]("), "url", F.lit(") `customer/"), key, F.lit("`")).alias("text"))
    return graph.reference_edges(named, nodes(spark, d))


def packages(spark, d):
    doc = F.when(F.col("p_brand") == "Brand#2", "").otherwise(F.col("p_name"))
    return graph.packages(table(spark, d, "part").select(F.col("p_type").alias("package"), F.concat(F.lit("f"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("file"), doc.alias("doc")))


def manifests(spark, d):
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    files = docs.select(F.concat(F.lit("src/"), "source", F.lit("/"), F.coalesce("lang", F.lit("x")), F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".go")).alias("file"))
    own = docs.filter("source < 'src15'").select(F.concat(F.lit("src/"), "source").alias("dir"), F.concat(F.lit("m.org/"), "source").alias("module")).distinct()
    return graph.nearest_manifest(files, own.unionAll(spark.createDataFrame([("", "m.org/root")], own.schema)))


def prompt(spark, d):
    got = graph.prompt_packages(table(spark, d, "part").select(F.col("p_type").alias("package"), F.col("p_name").alias("name")))
    return got.select("package", F.array_join("symbols", ",").alias("symbols"))


def _headed(spark, d):
    """Documents with every third line as a heading, and the name of the second heading."""
    rows = F.split("text", "\n")
    marked = F.array_join(F.transform(rows, lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("## "), x)).otherwise(x)), "\n")
    return table(spark, d, "documents").select("doc_id", marked.alias("text"), F.trim(F.get(rows, F.lit(4))).alias("heading"))


def headings(spark, d):
    got = graph.carried_heading(graph.lines(_headed(spark, d), "doc_id"), "doc_id")
    return got.groupBy("doc_id", F.coalesce("heading", F.lit("")).alias("heading")).agg(F.count("*").alias("n"))


# ---- lines ----


def blame(spark, d):
    return compact.blame_ranges(table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("hash")), "key")


def _coloured(c):
    return F.concat(F.lit("\x1b[1;31m  "), c, F.lit("\x1b[0m\r\n\n"))


def failures(spark, d):
    got = text.failure_lines(F.concat("text", F.lit("\nbuild Failed\nok")), F.concat(F.lit("a panic of "), "role"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(got, "|").alias("lines"))


def first_lines(spark, d):
    shown, omitted = text.head(F.split("text", "\n"), 2)
    return table(spark, d, "documents").select("doc_id", _digest(F.array_join(shown, "\n")).alias("digest"), omitted.cast("long").alias("omitted"))


# ---- notes ----


def proposed(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "adr").when(F.col("o_orderstatus") == "O", "open-item").otherwise("guide")
    title = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", classify.proposed_content(kind, title, F.col("o_orderpriority"), F.col("o_orderkey") % 10000, F.lit("2024-05-06").cast("date")).alias("text"))


def numbers(spark, d):
    files = table(spark, d, "part").select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.lit("-"), "p_name").alias("name"))
    return spark.createDataFrame([(classify.next_number(files),)], "number long")


def judged(spark, d):
    decisions = table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("concept:"), F.col("doc_id").cast("string")).alias("id"), (F.col("quality") == 1).alias("accept"))
    return overlay.reviewed(_concepts(spark, d).withColumn("reviewed", F.lit(False)), decisions, ["id"])


def existing_targets(spark, d):
    path = F.concat(F.lit("docs/"), text.slugify(F.col("p_name")), F.lit(".md"))
    part = table(spark, d, "part")
    targets = part.select("p_partkey", F.when(F.col("p_size") > 40, "docs/open-items.md").otherwise(path).alias("path"))
    return classify.collisions(targets, part.filter("p_size < 5").select(path.alias("path")).unionAll(spark.createDataFrame([("docs/open-items.md",)], "path string")))


QUERIES = {
    "read_edges": lambda s, d: graph.read_edges(_agents(s, d), nodes(s, d)),
    "owner_edges": lambda s, d: graph.owner_edges(_agents(s, d), nodes(s, d)),
    "reference_edges": references,
    "package_comments": packages,
    "nearest_manifest": manifests,
    "prompt_packages": prompt,
    "content_hash": lambda s, d: graph.content_hash(nodes(s, d)),
    "clean_references": lambda s, d: table(s, d, "pages").select("page_id", graph.clean_reference(F.concat(F.lit("`a\\"), "url", F.lit(" — why"))).alias("ref")),
    "section_body": lambda s, d: _headed(s, d).select("doc_id", _digest(graph.section_body(F.col("text"), F.col("heading"))).alias("digest")),
    "carried_headings": headings,
    "blame_ranges": blame,
    "single_blanks": lambda s, d: table(s, d, "documents").select("doc_id", _digest(F.array_join(compact.single_blanks(F.split(F.replace("text", F.lit("."), F.lit("\n \n\n")), "\n")), "\n")).alias("digest")),
    "plain_lines": lambda s, d: table(s, d, "documents").select("doc_id", _digest(F.array_join(text.plain_lines(_coloured(F.col("text"))), "\n")).alias("digest")),
    "failure_lines": failures,
    "first_lines": first_lines,
    "cut_titles": lambda s, d: table(s, d, "documents").select("doc_id", text.cut_to(F.col("text"), 40).alias("title")),
    "front_matter": lambda s, d: table(s, d, "documents").select("doc_id", classify.front_matter(F.concat(F.lit("---\nkind:  "), F.coalesce("source", F.lit("")), F.lit(" \nlang: x\n---\n"), "text"), "kind").alias("kind")),
    "normal_labels": lambda s, d: table(s, d, "orders").select("o_orderkey", classify.normal_type(F.concat(F.lit(" "), F.when(F.col("o_orderstatus") == "F", "ADR").otherwise(F.col("o_orderstatus")))).alias("type"), classify.normal_confidence(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("confidence")),
    "auto_accepted": lambda s, d: classify.decided(_notes(s, d)).filter(classify.auto_accepted()).select("doc_id", "type"),
    "review_counts": lambda s, d: classify.type_counts(classify.decided(_notes(s, d))),
    "notes_about": lambda s, d: classify.about(table(s, d, "documents"), "Ththe").select("doc_id"),
    "first_known": lambda s, d: table(s, d, "labels").select("doc_id", classify.first_known(F.when(F.col("quality") == 0, "adr"), F.when(F.col("toxic") == 1, "spec"), F.lit("guide")).alias("type")),
    "rewritten_files": lambda s, d: table(s, d, "part").select("p_partkey", classify.rewritten(F.concat("p_name", F.lit("\n"), "p_type"), F.col("p_brand")).alias("diff")),
    "proposed_content": proposed,
    "open_items": lambda s, d: table(s, d, "part").select("p_partkey", classify.with_open_items(F.when(F.col("p_size") > 25, "").when(F.col("p_size") > 10, F.concat("p_type", F.lit("\n"))).otherwise(F.col("p_type")), F.array("p_name", "p_brand")).alias("text")),
    "next_number": numbers,
    "single_concepts": lambda s, d: overlay.single(table(s, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey"),
    "reviewed_concepts": judged,
    "existing_targets": existing_targets,
}

_FIRST = "fn AS (SELECT file, min(id) AS id FROM nodes GROUP BY file)"
_ASKED = """ag AS (SELECT 'agent:' || n_nationkey AS a, unnest(['customer/' || n_nationkey, 'part/' || n_nationkey, 'gone/' || n_nationkey]) AS file, unnest(['customer/' || n_nationkey || ' — its customers', '`part\\' || n_nationkey || '`', 'gone/' || n_nationkey]) AS ref FROM nation)"""
_HEADED = "hd AS (SELECT doc_id, list_transform(l, lambda x, i: CASE WHEN (i - 1) % 3 = 1 THEN '## ' || x ELSE x END) AS l, trim(l[5], ' ') AS h FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
ORACLE_SQL = {
    "read_edges": f"""WITH {_GRAPH}, {_FIRST}, {_ASKED} SELECT DISTINCT a AS "from", id AS "to", 'reads' AS type FROM ag JOIN fn USING (file)""",
    "owner_edges": f"""WITH {_GRAPH}, {_FIRST}, {_ASKED} SELECT DISTINCT a AS "from", coalesce(id, 'path:' || ref) AS "to", 'owns' AS type FROM ag LEFT JOIN fn USING (file)""",
    "reference_edges": f"""WITH {_GRAPH}, {_FIRST}, r AS (SELECT 'doc:' || page_id AS a, unnest(['part/' || page_id, 'supplier/' || page_id % 25, 'region/all', 'customer/' || page_id]) AS file FROM pages)
SELECT DISTINCT a AS "from", id AS "to", CASE WHEN regexp_matches(id, '^(spec_section|decision):') THEN 'supports' ELSE 'references' END AS type FROM r JOIN fn USING (file) WHERE a <> id""",
    "package_comments": "SELECT p_type AS package, min('f' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')) AS file, arg_min(p_name, p_partkey) FILTER (WHERE p_brand <> 'Brand#2' AND p_name <> '') AS doc FROM part GROUP BY 1",
    "nearest_manifest": """SELECT 'src/' || source || '/' || l || '/f' || doc_id || '.go' AS file, CASE WHEN source < 'src15' THEN 'm.org/' || source ELSE 'm.org/root' END AS module,
  CASE WHEN source < 'src15' THEN 'm.org/' || source || '/' || l ELSE 'm.org/root/src/' || source || '/' || l END AS package FROM (SELECT *, coalesce(lang, 'x') AS l FROM documents WHERE source IS NOT NULL)""",
    "prompt_packages": "SELECT p_type AS package, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS symbols FROM part GROUP BY 1",
    "content_hash": f"WITH {_GRAPH}, j AS (SELECT md5('{{\"file\":\"' || file || '\",\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"type\":\"' || type || '\"}}') AS h FROM nodes) SELECT sha256(count(*) || ':' || " + " || ':' || ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT))" for i in range(4)) + ") AS hash FROM j",
    "clean_references": "SELECT page_id, 'a/' || url AS ref FROM pages",
    "section_body": f"""WITH {_HEADED}, p AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: CASE WHEN starts_with(x, '## ') THEN trim(substr(x, 4), ' ') END), h), 0) AS pos FROM hd),
r AS (SELECT *, l[pos + 1:] AS rest FROM p), e AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: starts_with(x, '## ')), true), 0) AS stop FROM r)
SELECT doc_id, md5(array_to_string(CASE WHEN h IS NULL OR pos = 0 THEN l WHEN stop > 0 THEN rest[1:stop - 1] ELSE rest END, chr(10))) AS digest FROM e""",
    "carried_headings": f"""WITH {_HEADED}, x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM hd),
c AS (SELECT doc_id, last_value(CASE WHEN starts_with(t, '## ') THEN substr(t, 4) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM x) SELECT doc_id, coalesce(h, '') AS heading, count(*) AS n FROM c GROUP BY 1, 2""",
    "blame_ranges": "WITH a AS (SELECT o_custkey AS key, o_orderkey AS line, o_orderstatus AS hash, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS new FROM orders), b AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY line) AS run FROM a) SELECT key, hash, min(line) AS first, max(line) AS last FROM b GROUP BY key, run, hash",
    "single_blanks": "SELECT doc_id, md5(array_to_string(list_filter(l, lambda x, i: NOT (trim(x, ' ') = '' AND i > 1 AND trim(l[i - 1], ' ') = '')), chr(10))) AS digest FROM (SELECT doc_id, string_split(replace(text, '.', chr(10) || ' ' || chr(10) || chr(10)), chr(10)) AS l FROM documents)",
    "plain_lines": "SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(regexp_replace(x, '[\\s\\x0B]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))) AS digest FROM documents",
    "failure_lines": """SELECT conv_id, turn, array_to_string(list_concat(['a panic of ' || role], list_filter(list_transform(regexp_split_to_array(text || chr(10) || 'build Failed' || chr(10) || 'ok', '\\r?\\n'), lambda x: trim(regexp_replace(x, '[\\s\\x0B]+', ' ', 'g'), ' ')), lambda x: regexp_matches(lower(x), 'fail|error|fatal|panic'))), '|') AS lines FROM conversations""",
    "first_lines": "SELECT doc_id, md5(array_to_string(l[1:2], chr(10))) AS digest, CAST(greatest(len(l) - 2, 0) AS BIGINT) AS omitted FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "cut_titles": "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS title FROM documents",
    "front_matter": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN nullif(source, '') END AS kind FROM documents",
    "normal_labels": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'adr' ELSE 'unknown' END AS type, CASE WHEN lower(trim(split_part(o_orderpriority, '-', 2))) IN ('high', 'medium', 'low') THEN lower(trim(split_part(o_orderpriority, '-', 2))) ELSE 'low' END AS confidence FROM orders",
    "auto_accepted": f"WITH {_NOTES} SELECT doc_id, type FROM top WHERE best >= 6 AND best - second >= 2",
    "review_counts": f"WITH {_NOTES} SELECT type, count(*) AS n FROM top GROUP BY 1",
    "notes_about": "SELECT doc_id FROM documents WHERE contains(lower(text), 'ththe')",
    "first_known": "SELECT doc_id, CASE WHEN quality = 0 THEN 'adr' WHEN toxic = 1 THEN 'spec' ELSE 'guide' END AS type FROM labels",
    "rewritten_files": "SELECT p_partkey, '-' || p_name || chr(10) || '-' || p_type || chr(10) || '+' || p_brand AS diff FROM part",
    "proposed_content": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '---' || chr(10) || 'status: accepted' || chr(10) || 'date: 2024-05-06' || chr(10) || '---' || chr(10) || chr(10) || '# ADR-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || ': Order ' || o_orderkey || chr(10) || chr(10) || o_orderpriority
  WHEN 'O' THEN '## Order ' || o_orderkey || chr(10) || chr(10) || o_orderpriority || chr(10) ELSE o_orderpriority END AS text FROM orders""",
    "open_items": "SELECT p_partkey, CASE WHEN p_size > 25 THEN '# Open Items' ELSE p_type END || chr(10) || chr(10) || p_name || chr(10) || p_brand AS text FROM part",
    "next_number": "SELECT coalesce(max(CAST(substr(n, 1, 4) AS BIGINT)), 0) + 1 AS number FROM (SELECT CASE WHEN p_partkey < 10000 THEN lpad(CAST(p_partkey AS VARCHAR), 4, '0') ELSE substr(CAST(p_partkey AS VARCHAR), 1, 4) END AS n FROM part)",
    "single_concepts": "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)",
    "reviewed_concepts": f"WITH {_CON}, l AS (SELECT 'concept:' || doc_id AS id, quality = 1 AS accept FROM labels WHERE toxic = 1) SELECT con.id, con.name, coalesce(accept, false) AS reviewed FROM con LEFT JOIN l ON con.id = l.id WHERE coalesce(accept, true)",
    "existing_targets": "WITH p AS (SELECT p_partkey, p_size, 'docs/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS path FROM part) SELECT p_partkey, path FROM p WHERE p_size <= 40 AND path IN (SELECT path FROM p WHERE p_size < 5)",
}
