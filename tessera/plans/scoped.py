"""Scopes of agents over paths, entry points in near-tie order, and symbols of Go sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import bm25, retrieval
from tessera.operators.bm25 import Field
from tessera.plans.common import sql_path, sql_words, table
from tessera.plans.ranking import sql_scores
from tessera.sources import workspace

_SYMBOL_FIELDS = [Field("title", 2.5, 0.75), Field("path", 1.7, 0.5)]


def _scopes(pages):
    """Scopes of all forms, cut from the paths of pages: folders, files, beginnings, patterns, everything, nothing."""
    host, n = F.regexp_extract("path", "^([^/]*)", 1), F.col("page_id") % 7
    tail = F.regexp_replace("path", "^[^.]*", "*")
    scope = (
        F.when(n == 0, F.concat(host, F.lit("/**"))).when(n == 1, F.regexp_replace("path", "/[^/]*$", "/*")).when(n == 2, F.col("path")).when(n == 3, F.concat(F.substring("path", 1, 5), F.lit("*")))
        .when(n == 4, F.regexp_replace(tail, "[0-9]+.*$", "??*")).when(n == 5, F.concat(host, F.lit("/*/*[0-4]"))).otherwise("")
    )
    return pages.select(F.concat(F.lit("a"), (F.col("page_id") % 50).cast("string")).alias("agent"), scope.alias("scope")).distinct()


def connected_agents(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    nodes = pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"), F.col("path").alias("file"))
    reads = pages.filter("path LIKE '%page=%'").select(F.concat(F.lit("agent:a"), (F.col("page_id") % 11).cast("string")).alias("from"), F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("to"), F.lit("reads").alias("type"))
    return retrieval.connected(nodes, reads, _scopes(pages))


def entry_points(spark, d):
    """Parts as symbols of their brand, asked for by each of the eight most frequent words of names."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", text.words(F.col("p_name")).alias("title"), text.path_words(F.col("p_brand")).alias("path"))
    first = parts.select(F.explode("title").alias("term")).groupBy("term").count().orderBy(F.desc("count"), "term").limit(8)
    got = bm25.scores(parts, first.select(F.col("term").alias("query_id"), "term"), "p_partkey", _SYMBOL_FIELDS, k1=1.05)
    # as in a graph, where concepts reach some packages
    reach = F.when(F.col("p_brand").endswith("1"), 0.5).otherwise(0.0)
    relevance = F.round(F.col("score") * (0.5 + F.col("p_size") / 50.0), 9)
    rows = got.join(parts.withColumnRenamed("p_partkey", "doc"), "doc").select("query_id", relevance.alias("relevance"), reach.alias("reach"), F.col("p_brand").alias("package"), F.col("p_brand").alias("file"), F.col("p_name").alias("symbol"), F.col("doc").alias("line"), F.col("doc").alias("orig"))
    return retrieval.near_tie_order(rows.filter(F.col("relevance") >= retrieval.LEAST)).select("query_id", "rank", "package", "symbol", "line", F.round("relevance", 6).alias("relevance"))


def document_nodes(spark, d):
    """Documents as files of five kinds, their every fourth line a heading: the nodes of their sections, or of the files."""
    kinds = F.array(*[F.lit(x) for x in ("spec_section", "doc", "decision", "context_snapshot", "note")])
    number = F.col("doc_id").cast("string")
    headed = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 4 == 1, F.concat(F.lit("## h"), (i / 4).cast("int").cast("string"))).otherwise(x)), "\n")
    kind = F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int"))
    found = table(spark, d, "documents").select(kind.alias("kind"), F.concat(F.lit("x/"), number, F.lit(".md")).alias("path"), F.lit("docs").alias("tier"), headed.alias("text"))
    return workspace.document_nodes(found).select("id", "type", "file", "name", F.coalesce("section", F.lit("")).alias("section"), F.length(F.regexp_replace("text", r"\s", "")).alias("signs"))


def go_symbols(spark, d):
    """The symbols of a Go source made of each document: its text in a comment and in a raw string, beside declarations, and
    beside what looks like some in literals."""
    own = F.coalesce("text", F.lit(""))
    number = F.col("doc_id").cast("string")
    source = F.concat(
        F.lit("package p\n/*\n"), F.replace(own, F.lit("*/"), F.lit("")), F.lit("\nfunc InComment() {}\n*/\nvar raw = `"), F.replace(own, F.lit("`"), F.lit("")), F.lit("\nfunc InRaw() {}\n`\nfunc F"), number,
        F.lit('() { s := "func InString() {"; type Local int }\ntype (\n\tT'), number, F.lit(" struct {\n\t\tField int\n\t}\n)\nconst V"), number, F.lit(", w = '{', 2\n"),
    )
    sources = table(spark, d, "documents").select(F.concat(F.lit("code/"), number, F.lit(".go")).alias("path"), source.alias("text"))
    packages = sources.select(F.col("path").alias("file"), F.lit("p").alias("package"))
    return workspace.symbols(sources, packages)


QUERIES = {"document_nodes": document_nodes, "go_symbols": go_symbols, "connected_agents": connected_agents, "entry_points": entry_points}

_BEFORE = """CASE WHEN abs(x[1].relevance - y.relevance) > 0.12::DOUBLE THEN x[1].relevance > y.relevance WHEN x[1].reach <> y.reach THEN x[1].reach > y.reach WHEN x[1].package <> y.package THEN x[1].package > y.package
  WHEN x[1].symbol <> y.symbol THEN x[1].symbol < y.symbol ELSE x[1].line < y.line END"""
ORACLE_SQL = {
    "document_nodes": r"""WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
m AS (SELECT doc_id, i, i % 4 = 1 AS head, CASE WHEN i % 4 = 1 THEN '## h' || i // 4 ELSE t END AS t FROM l),
g AS (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM m),
k AS (SELECT doc_id, ['spec_section', 'doc', 'decision', 'context_snapshot', 'note'][CAST(doc_id % 5 + 1 AS INTEGER)] AS kind, 'x/' || doc_id || '.md' AS path FROM documents),
s AS (SELECT doc_id, nth, CAST(coalesce(sum(length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))) FILTER (WHERE NOT head AND trim(t) <> '---'), 0) AS INTEGER) AS signs FROM g WHERE nth > 0 GROUP BY ALL),
w AS (SELECT doc_id, CAST(coalesce(sum(length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))), 0) AS INTEGER) AS signs FROM m GROUP BY doc_id)
SELECT kind || ':' || path || ':h' || (nth - 1) AS id, kind AS type, path AS file, 'h' || (nth - 1) AS name, 'h' || (nth - 1) AS section, signs FROM s JOIN k USING (doc_id) WHERE kind IN ('spec_section', 'doc')
UNION ALL SELECT kind || ':' || path || ':', kind, path, doc_id || '.md', '', signs FROM w JOIN k USING (doc_id) WHERE kind IN ('spec_section', 'doc') AND doc_id NOT IN (SELECT doc_id FROM s)
UNION ALL SELECT CASE WHEN kind = 'decision' THEN 'decision:' || doc_id ELSE kind || ':' || path END, kind, path, CASE WHEN kind = 'decision' THEN '' || doc_id ELSE doc_id || '.md' END, '', signs FROM w JOIN k USING (doc_id) WHERE kind IN ('decision', 'context_snapshot', 'note')""",
    "go_symbols": """WITH n AS (SELECT doc_id, 2 * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) AS n FROM documents),
r AS (SELECT doc_id, n, unnest(['F', 'T', 'V']) AS name, unnest(['func', 'type', 'value']) AS kind, unnest([9, 11, 15]) AS line FROM n)
SELECT 'p' AS package, name || doc_id AS name, kind, 'code/' || doc_id || '.go' AS file, CAST(line + n AS INTEGER) AS line FROM r""",
    "connected_agents": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
s AS (SELECT DISTINCT 'a' || page_id % 50 AS agent, CASE page_id % 7 WHEN 0 THEN split_part(path, '/', 1) || '/**' WHEN 1 THEN regexp_replace(path, '/[^/]*$', '/*') WHEN 2 THEN path WHEN 3 THEN path[1:5] || '*'
  WHEN 4 THEN regexp_replace(regexp_replace(path, '^[^.]*', '*'), '[0-9]+.*$', '??*') WHEN 5 THEN split_part(path, '/', 1) || '/*/*[0-4]' ELSE '' END AS scope FROM p),
t AS (SELECT *, regexp_replace(regexp_replace(scope, '\*\*$', ''), '\*$', '') AS prefix,
  replace(replace(regexp_replace(scope, '([.+^$(){}|\\])', '\\\1', 'g'), '*', '[^/]*'), '?', '[^/]') AS pattern FROM s WHERE scope <> '')
SELECT 'page:' || page_id AS id, agent FROM p JOIN t ON starts_with(path, prefix) OR NOT suffix(prefix, '/') AND regexp_full_match(path, pattern)
UNION SELECT 'page:' || page_id, 'a' || page_id % 11 FROM p WHERE path LIKE '%page=%'""",
    "entry_points": f"""WITH pt AS (SELECT p_partkey, p_name, p_brand, p_size, {sql_words('p_name')} AS title, {sql_path('p_brand')} AS path FROM part),
wd AS (SELECT term FROM (SELECT unnest(title) AS term FROM pt) GROUP BY term ORDER BY count(*) DESC, term LIMIT 8),
{sql_scores('pt', 'p_partkey', _SYMBOL_FIELDS, 1.05, '(SELECT term AS query_id, term FROM wd)')},
sy AS (SELECT query_id, round(score * (0.5::DOUBLE + p_size / 50.0::DOUBLE), 9) AS relevance, CASE WHEN suffix(p_brand, '1') THEN 0.5::DOUBLE ELSE 0 END AS reach, p_brand AS package, p_name AS symbol, p_partkey AS line FROM scores JOIN pt ON doc = p_partkey),
li AS (SELECT query_id, list([sy] ORDER BY line) AS l FROM sy WHERE relevance >= 0.05 GROUP BY query_id),
fo AS (SELECT query_id, list_reduce(l, lambda acc, x: list_concat(acc[:coalesce(list_max(list_transform(list_zip(acc, range(1, len(acc) + 1)), lambda z: CASE WHEN {_BEFORE.replace('y.', 'z[1].')} THEN NULL ELSE z[2] END)), 0)],
  x, acc[coalesce(list_max(list_transform(list_zip(acc, range(1, len(acc) + 1)), lambda z: CASE WHEN {_BEFORE.replace('y.', 'z[1].')} THEN NULL ELSE z[2] END)), 0) + 1:])) AS o FROM li)
SELECT query_id, CAST(i AS INTEGER) AS rank, o[i].package AS package, o[i].symbol AS symbol, o[i].line AS line, round(o[i].relevance, 6) AS relevance FROM (SELECT query_id, o, unnest(range(1, least(len(o), 5) + 1)) AS i FROM fo)""",
}
