"""Command output, command rewriting and file reading over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import filters, readers
from tessera.operators import compact, graph, outputs, rewriting
from tessera.plans.common import table

_TOOLS = ["ls", "find", "rg", "cargo build", "npm install", "make", "go build", "go test", "git status", "env", "wc", "pytest", "jq", "other"]


def captured(spark, d):
    """Documents as the output of commands, one tool after another by id."""
    tool = F.element_at(F.array(*[F.lit(t) for t in _TOOLS]), (F.col("doc_id") % len(_TOOLS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.split(tool, " ").alias("args"), F.col("text").alias("stdout"), F.when(F.col("doc_id") % 9 == 0, "fatal: stop").otherwise("").alias("stderr"), (F.col("doc_id") % 9 == 0).cast("int").alias("exit_code"), (F.col("doc_id") % 2 == 0).alias("ultra"))


def line_filters(spark, d):
    return filters.with_compact(captured(spark, d)).select("doc_id", "compact.filter", "compact.out", "compact.err")


def commands(spark, d):
    verb = F.element_at(F.array(*[F.lit(t) for t in ("cat", "head -n 3", "tail -5", "grep -r x", "ls", "cat -n")]), (F.col("page_id") % 6 + 1).cast("int"))
    tail = F.when(F.col("page_id") % 5 == 0, " | sort").when(F.col("page_id") % 7 == 0, " > out").when(F.col("page_id") % 11 == 0, " && make").otherwise("")
    path = F.regexp_extract("url", "([^/]*)$", 1)
    return table(spark, d, "pages").select("page_id", F.concat(verb, F.lit(" "), path, tail).alias("command"))


def rewritten(spark, d):
    return commands(spark, d).select("page_id", rewriting.decide(F.col("command"), exclude=("grep",)).alias("d")).select("page_id", "d.allowed", "d.reason", "d.rewritten")


def fenced(spark, d):
    """Documents with two fences put around their lines."""
    lines = graph.lines(table(spark, d, "documents").select("doc_id", F.concat(F.lit("a\n```x\n"), F.array_join(F.split("text", r"[.]"), "\n"), F.lit("\n```\n```go\n"), F.substring("text", 1, 40), F.lit("\n```\nend")).alias("text")), "doc_id")
    return compact.fences(lines, "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("omitted").alias("omitted"))


def read_files(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".json", ".go", ".txt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), ext).alias("path"), "text")
    return readers.read(files, last=5, numbers=True).select("doc_id", "language", "tokens_before", "tokens_after", F.md5(F.col("content").cast("binary")).alias("digest"))


def go_outline(spark, d):
    """Documents as the bodies of Go functions."""
    body = F.array_join(F.transform(F.split("text", " "), lambda w: F.concat(F.lit('\tprint("'), F.translate(w, '"\\\n', "   "), F.lit('")'))), "\n")
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("package p\n\n// note\nfunc F() {\n"), body, F.lit("\n}\n")).alias("text"))
    return files.select("doc_id", readers.filtered(F.lit("go"), F.col("text")).alias("outline"))


def native_filters(spark, d):
    """Listings, matches and settings made of pages, documents and customers, in their native compact forms."""

    def output(rows, tool, by, order, line):
        listed = rows.filter(line.isNotNull()).groupBy(by.alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("x")))), lambda r: r["x"]), "\n").alias("stdout"))
        return listed.select(F.concat(F.lit(f"{tool}:"), F.col("g").cast("string")).alias("id"), F.array(F.lit(tool)).alias("args"), "stdout", F.lit("").alias("stderr"), F.lit(0).alias("exit_code"), F.lit(False).alias("ultra"))

    pages, docs, customers = table(spark, d, "pages"), table(spark, d, "documents"), table(spark, d, "customer")
    key = F.concat(F.when(F.col("c_nationkey") % 3 == F.col("c_custkey") % 3, "API_KEY_").otherwise("NAME_"), F.col("c_custkey").cast("string"))
    every = output(pages, "find", F.col("page_id") % 5, F.col("page_id"), F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""))
    every = every.unionAll(output(docs, "rg", F.col("doc_id") % 7, F.col("doc_id"), F.concat(F.col("source"), F.lit(":"), F.col("doc_id").cast("string"), F.lit(":n="), F.col("n_chars").cast("string"))))
    every = every.unionAll(output(customers, "env", F.col("c_nationkey"), F.col("c_custkey"), F.concat(key, F.lit("="), "c_mktsegment")))
    return every.withColumn("c", outputs.compact(F.col("args"))).select("id", "c.filter", "c.out", "c.err")


QUERIES = {
    "native_filters": native_filters,
    "line_filters": line_filters,
    "filter_dispatch": lambda s, d: captured(s, d).select("doc_id", filters.filter_column(F.col("args")).alias("filter")),
    "rewrite_cmd": rewritten,
    "md_fences": fenced,
    "read_files": read_files,
    "go_outline": go_outline,
    "compact_generic": lambda s, d: table(s, d, "documents").select("doc_id", compact.generic(F.col("text")).alias("text")),
}
ORACLE_SQL = {
    "compact_generic": r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\x1b\[[0-9;]*m', '', 'g'), chr(10)) AS l FROM documents),
r AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM l),
t AS (SELECT doc_id, i, regexp_replace(x, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') AS x FROM r),
k AS (SELECT doc_id, i, CASE WHEN strlen(x) > 500 THEN left(x, list_max(list_filter(range(124, 501), lambda n: strlen(left(x, n)) <= 500))) || '...(truncated)' ELSE x END AS x FROM t WHERE x <> ''),
n AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
c AS (SELECT doc_id, run, CASE WHEN count(*) > 1 THEN '[repeated ' || count(*) || ' times] ' || any_value(x) ELSE any_value(x) END AS x, max(run) OVER (PARTITION BY doc_id) AS total FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, run, CASE WHEN total > 120 AND run = 61 THEN '...(' || (total - 119) || ' lines omitted)...' ELSE x END AS x FROM c WHERE total <= 120 OR run <= 61 OR run > total - 59)
SELECT d.doc_id, coalesce(string_agg(x, chr(10) ORDER BY run), '') AS text FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id GROUP BY d.doc_id""",
    "rewrite_cmd": """WITH c AS (SELECT page_id, ['cat', 'head -n 3', 'tail -5', 'grep -r x', 'ls', 'cat -n'][CAST(page_id % 6 + 1 AS INTEGER)] AS verb, regexp_extract(url, '([^/]*)$', 1) AS path, CASE WHEN page_id % 5 = 0 THEN ' | sort' WHEN page_id % 7 = 0 THEN ' > out' WHEN page_id % 11 = 0 THEN ' && make' ELSE '' END AS tail FROM pages),
n AS (SELECT *, verb <> 'grep -r x' AND tail <> ' > out' AS allowed, CASE WHEN path <> '' AND verb = 'cat' THEN 'read --line-numbers ' || path WHEN path <> '' AND verb = 'head -n 3' THEN 'read --max-lines 3 ' || path WHEN path <> '' AND verb = 'tail -5' THEN 'read --tail-lines 5 ' || path ELSE 'run -- ' || verb || CASE WHEN path = '' THEN '' ELSE ' ' || path END END AS new FROM c)
SELECT page_id, allowed, CASE WHEN allowed THEN 'suggest mode default' ELSE 'command excluded' END AS reason, CASE WHEN allowed THEN 'tessera shell ' || new || CASE WHEN path = '' AND tail <> '' THEN ' ' ELSE '' END || CASE WHEN tail = ' && make' THEN ' && tessera shell run -- make' ELSE tail END END AS rewritten FROM n""",
    "native_filters": r"""WITH p AS (SELECT DISTINCT page_id % 5 AS g, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS x FROM pages WHERE url IS NOT NULL),
pk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY encode(x)) AS k, regexp_extract(x, '([^/]*)$', 1) AS name FROM p),
pe AS (SELECT g, CASE WHEN contains(name, '.') AND regexp_extract(name, '([^.]*)$', 1) <> '' THEN lower(regexp_extract(name, '([^.]*)$', 1)) ELSE '(noext)' END AS e, count(*) AS n FROM pk GROUP BY ALL),
pb AS (SELECT g, string_agg(e || '=' || n, ', ' ORDER BY encode(e)) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY encode(e)) AS k FROM pe) WHERE k <= 16 GROUP BY g),
ps AS (SELECT g, count(*) AS n, string_agg('  ' || x, chr(10) ORDER BY k) FILTER (WHERE k <= 50) AS sample FROM pk GROUP BY g),
m AS (SELECT doc_id % 7 AS g, source, count(*) AS n, min_by('  L' || doc_id || ': n=' || n_chars, doc_id) AS first FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY ALL),
mk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY source) AS k FROM m),
c AS (SELECT c_nationkey AS g, CASE WHEN c_nationkey % 3 = c_custkey % 3 THEN 'API_KEY_' ELSE 'NAME_' END || c_custkey AS key FROM customer WHERE c_mktsegment IS NOT NULL),
ck AS (SELECT g, key, row_number() OVER (PARTITION BY g ORDER BY key) AS k FROM c WHERE NOT starts_with(key, 'API')),
cn AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE starts_with(key, 'API')) AS r FROM c GROUP BY g),
cs AS (SELECT g, string_agg('  ' || key, chr(10) ORDER BY k) FILTER (WHERE k <= 60) AS keys, count(*) AS shown FROM ck GROUP BY g)
SELECT 'find:' || g AS id, 'find' AS filter, 'find summary: unique_paths=' || n || chr(10) || 'by_ext: ' || parts || chr(10) || 'sample:' || CASE WHEN n > 50 THEN ' (' || (n - 50) || ' omitted)' ELSE '' END || chr(10) || sample AS out, '' AS err FROM ps JOIN pb USING (g)
UNION ALL SELECT 'rg:' || g, 'rg', string_agg(source || ' (' || n || ' matches)' || chr(10) || first, chr(10) ORDER BY k) FILTER (WHERE k <= 20), '' FROM mk GROUP BY g
UNION ALL SELECT 'env:' || g, 'env', 'env summary: vars=' || n || ' redacted=' || r || chr(10) || 'keys:' || CASE WHEN shown > 60 THEN ' (' || (shown - 60) || ' omitted)' ELSE '' END || coalesce(chr(10) || keys, ''), '' FROM cn LEFT JOIN cs USING (g)""",
    "filter_dispatch": "SELECT doc_id, ['ls', 'find', 'rg', 'cargo', 'npm', 'make', 'go.build', 'go.test', 'git.status', 'env', 'wc', 'pytest', 'json', 'generic'][CAST(doc_id % 14 + 1 AS INTEGER)] AS filter FROM documents",
    "md_fences": """WITH n AS (SELECT doc_id, (SELECT sum(len(string_split(p, chr(10)))) FROM (SELECT unnest(string_split(text, '.')) AS p)) AS body, len(string_split(substr(text, 1, 40), chr(10))) AS tail FROM documents)
SELECT doc_id, CAST(3 + CASE WHEN body > 12 THEN 0 ELSE body END + 2 + tail + 1 AS BIGINT) AS lines, CAST(CASE WHEN body > 12 THEN body ELSE 0 END AS BIGINT) AS omitted FROM n""",
}
