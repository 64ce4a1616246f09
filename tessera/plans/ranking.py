"""Tokens, BM25F, routing and retrieval over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import bm25, retrieval, routing
from tessera.operators.bm25 import Field
from tessera.plans.common import sql_path, sql_words, table

TERMS = ("erer", "onan", "thon", "inin", "queeau", "enst")
FIELDS = [Field("body", 1.0, 0.75), Field("path", 1.7, 0.5)]
_TERM_ROWS = ", ".join(f"('q', '{t}')" for t in TERMS)
_TIER = "CASE CAST(regexp_extract(source, '[0-9]+', 0) AS INTEGER) % 4 WHEN 0 THEN 'specs' WHEN 1 THEN 'docs' WHEN 2 THEN 'context' ELSE 'notes' END"


def _terms(spark, terms=TERMS):
    return spark.createDataFrame([("q", t) for t in terms], "query_id string, term string")


def _docs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", text.words(F.coalesce("text", F.lit(""))).alias("body"), text.path_words(F.coalesce("source", F.lit(""))).alias("path"))


def _tier():
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 4
    return F.when(n == 0, "specs").when(n == 1, "docs").when(n == 2, "context").otherwise("notes")


def topk(spark, d):
    got = bm25.scores(_docs(spark, d), _terms(spark), "doc_id", FIELDS)
    return bm25.top_k(got, 20, [F.desc(F.round("score", 9)), "doc"]).select("query_id", F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def shares(spark, d):
    return bm25.field_shares(_docs(spark, d), _terms(spark), "doc_id", FIELDS).select("query_id", F.col("doc").alias("doc_id"), "field", F.round("share", 6).alias("share"))


def batch(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(text.query_terms(text.words(F.coalesce("text", F.lit(""))))).alias("term"))
    got = bm25.scores(_docs(spark, d), items, "doc_id", FIELDS)
    return bm25.top_k(got, 5, [F.desc(F.round("score", 9)), "doc"]).select("query_id", F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def df_terms(spark, d):
    return bm25.row_frequency(_docs(spark, d), FIELDS)


def avg_len(spark, d):
    docs = _docs(spark, d)
    return docs.agg(*[F.round(F.greatest(F.avg(F.size(f.name)), F.lit(1.0)), 6).alias(f.name) for f in FIELDS])


def _relevant(spark, d):
    docs = _docs(spark, d)
    got = bm25.scores(docs, _terms(spark), "doc_id", FIELDS).withColumn("score", F.round("score", 9))
    meta = docs.select(F.col("doc_id").alias("doc"), _tier().alias("tier"), F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("file"), F.lit("").alias("section"))
    return retrieval.with_relevance(got.join(meta, "doc"), F.col("file").startswith("src1/")).withColumn("relevance", F.round("relevance", 9))


_OUT = ["query_id", "file", "trust", "rank"]


def boosted(spark, d):
    return retrieval.blocks(_relevant(spark, d)).select(*_OUT, F.round("relevance", 6).alias("relevance"))


def scope_survivor(spark, d):
    kept = retrieval.with_scope_survivor(_relevant(spark, d), text.in_scope(F.col("file"), F.lit("src3/**")))
    return kept.select(*_OUT, F.round("relevance", 6).alias("relevance"))


def code_survivor(spark, d):
    relevant = _relevant(spark, d).withColumn("file", F.regexp_replace("file", "^src7/", "code/"))
    kept = retrieval.blocks(relevant, cap=30)
    return retrieval.with_code_survivor(kept, relevant.filter(F.col("relevance") >= retrieval.LEAST), F.lit(True), cap=40).select(*_OUT, F.round("relevance", 6).alias("relevance"))


def _owner_scores(spark, d):
    """One owner for each source; its text is that of all its documents."""
    return routing.owner_scores(_docs(spark, d), _terms(spark), "source", FIELDS, grouped=True).withColumn("score", F.round("score", 9))


def route(spark, d):
    got = _owner_scores(spark, d)
    return routing.softmax(got).select("query_id", "doc", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def route_owner(spark, d):
    docs, asked = _docs(spark, d), _terms(spark)
    found = routing.found_scores(docs, asked, "source", FIELDS, grouped=True).withColumn("score", F.round("score", 9))
    got, owners = routing.with_absent(found, asked, docs.select(F.col("source").alias("doc")).distinct(), 0.02)
    return routing.route(got, temperature=2.0, least_candidate=0.02, owners=owners).select("query_id", "owner", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("candidates", lambda x: x["name"]), ",").alias("candidates"))


def penalty(spark, d):
    """Words of good documents of a source are in its scope, words of bad ones out of it."""
    docs = _docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")

    def held(quality):
        """The query terms of each source's documents, each once."""
        own = docs.filter(F.col("quality") == quality).select(F.col("source").alias("name"), F.explode(F.filter("body", lambda w: w.isin(*TERMS))).alias("w")).distinct()
        return own.groupBy("name").agg(F.collect_list("w").alias("body"))

    both = held(0).withColumnRenamed("body", "outside").join(held(1), "name", "left").withColumn("body", F.coalesce("body", F.array().cast("array<string>")))
    return routing.penalties(both, _terms(spark), "name", FIELDS[:1], "outside").select("query_id", "doc", F.round("penalty", 6).alias("penalty"))


def _concepts(spark, d):
    """Labelled documents as concepts; those of quality 1 are reviewed."""
    return _docs(spark, d).join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


def concept_threshold(spark, d):
    got = bm25.scores(_concepts(spark, d), _terms(spark), "doc_id", FIELDS).withColumn("score", F.round("score", 9))
    return retrieval.concept_threshold(got).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"))


def concept_coverage(spark, d):
    terms = F.array(*[F.lit(t) for t in TERMS])
    return _concepts(spark, d).select("doc_id", F.round(retrieval.coverage(F.col("body"), terms), 6).alias("coverage"))


def reach(spark, d):
    """Parts as concepts, suppliers as the packages that implement them."""
    parts = table(spark, d, "part").select("p_partkey", text.words(F.concat_ws(" ", "p_name", "p_type")).alias("name"))
    word = parts.select(F.explode("name").alias("term")).groupBy("term").count().orderBy(F.desc("count"), "term").limit(3)
    queries = word.select(F.lit("q").alias("query_id"), "term")
    got = bm25.scores(parts, queries, "p_partkey", [Field("name", 2.0, 0.75)]).withColumn("score", F.round("score", 9))
    implements = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc"), F.col("l_suppkey").alias("package")).distinct()
    return retrieval.package_reach(got, implements)


def package_reach(spark, d):
    return reach(spark, d).select("package", F.round("score", 6).alias("score"))


def implementing(spark, d):
    return retrieval.implementing_packages(reach(spark, d)).select("package", "rank", F.round("score", 6).alias("score"))


def _counts(c, spark, d, name="documents", key="doc_id", col="text"):
    return table(spark, d, name).select(F.explode(c(F.coalesce(col, F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def stemmed(spark, d):
    long = table(spark, d, "documents").select(F.explode(text.words(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return text.stems_of(long).groupBy("stem").agg(F.sum("n").alias("n"))


def rewrite(spark, d):
    """The words of each item, of which some lengths stand for the words that a rewrite looks for."""

    def said(w):
        n = F.length(w) % 5
        return F.when(n == 0, "code").when(n == 1, "index").when((n == 2) & w.startswith("t"), "codeindex").otherwise(w)

    own = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.transform(F.slice(text.words(F.coalesce("text", F.lit(""))), F.lit(1), F.col("item_id").cast("int") % 4 + 1), said)).alias("terms"))
    return own.select("item_id", F.array_join(text.drop_noise(F.col("terms")), " ").alias("kept"), F.array_join(text.expand_terms(F.col("terms")), " ").alias("expanded"))


QUERIES = {
    "bm25_topk": topk,
    "bm25_field_shares": shares,
    "bm25_batch_topk": batch,
    "df_terms": df_terms,
    "avg_field_len": avg_len,
    "retrieval_boosted": boosted,
    "scope_survivor": scope_survivor,
    "code_survivor": code_survivor,
    "route_softmax": route,
    "route_owner": route_owner,
    "out_of_scope_penalty": penalty,
    "concept_threshold": concept_threshold,
    "concept_coverage": concept_coverage,
    "package_reach": package_reach,
    "implementing_packages": implementing,
    "tokens_unigram": lambda s, d: _counts(text.words, s, d),
    "tokens_bigram": lambda s, d: _counts(lambda c: text.bigrams(text.words(c)), s, d),
    "tokens_path": lambda s, d: _counts(text.path_words, s, d, "pages", "page_id", "url"),
    "tokens_stemmed": stemmed,
    "query_rewrite": rewrite,
    "token_estimate": lambda s, d: table(s, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens")),
    "slugify": lambda s, d: table(s, d, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("slug"), text.bare_name(F.col("p_name")).alias("bare")),
    "camel_split": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(text.camel_words(F.concat(F.lit("load"), F.initcap("p_name"), F.lit(".runAll"))), " ").alias("words")),
    "title_from_path": lambda s, d: table(s, d, "pages").select("page_id", text.title_from_path(F.col("url")).alias("title")),
}

_DOCS = f"docs AS (SELECT doc_id, source, {sql_words("coalesce(text, '')")} AS body, {sql_path("coalesce(source, '')")} AS path FROM documents)"


def _long(fields) -> str:
    return "long AS (" + " UNION ALL ".join(f"SELECT {{key}} AS doc, '{f.name}' AS field, len({f.name}) AS len, unnest({f.name}) AS term FROM {{src}}" for f in fields) + ")"


def sql_scores(src: str, key: str, fields=FIELDS, k1: float = 1.2, queries: str = f"(VALUES {_TERM_ROWS}) v(query_id, term)") -> str:
    """CTEs up to scores(query_id, doc, score) and parts, over a relation that has token lists."""
    norm = "CASE field " + " ".join(f"WHEN '{f.name}' THEN {f.weight}::DOUBLE * tf / (1 - {f.b}::DOUBLE + {f.b}::DOUBLE * len / (SELECT greatest(1, avg(len({f.name}))) FROM {src}))" for f in fields) + " END"
    return f"""{_long(fields).format(key=key, src=src)},
qs AS (SELECT query_id, term FROM {queries}),
post AS (SELECT doc, field, len, term, count(*) AS tf FROM long WHERE term IN (SELECT term FROM qs) GROUP BY ALL),
parts AS (SELECT doc, field, term, {norm} AS part FROM post),
dfs AS (SELECT term, greatest(1.0::DOUBLE, ln(((SELECT count(*) FROM {src}) - count(DISTINCT doc) + 0.5::DOUBLE) / (count(DISTINCT doc) + 0.5::DOUBLE) + 1)) AS idf FROM post GROUP BY term),
tot AS (SELECT doc, term, sum(part) AS total FROM parts GROUP BY doc, term),
contrib AS (SELECT query_id, doc, term, total, idf * total / ({k1}::DOUBLE + total) AS contrib FROM tot JOIN dfs USING (term) JOIN qs USING (term)),
scores AS (SELECT query_id, doc, sum(contrib) AS score FROM contrib GROUP BY query_id, doc)"""


_SC = f"WITH {_DOCS}, {sql_scores('docs', 'doc_id')}"
_REL = f"""{_SC}, meta AS (SELECT doc_id AS doc, {_TIER} AS tier, source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS file FROM docs),
rel AS (SELECT query_id, file, tier, CASE tier WHEN 'specs' THEN 'high' WHEN 'notes' THEN 'low' ELSE 'medium' END AS trust,
  round(round(score, 9) * CASE tier WHEN 'specs' THEN 1.3::DOUBLE WHEN 'notes' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN starts_with(file, 'src1/') THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 9) AS relevance
  FROM scores JOIN meta USING (doc)),
ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, CASE trust WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, file) AS rank FROM rel WHERE relevance >= 0.05)"""
_OWN = f"WITH {_DOCS}, own AS (SELECT source AS name, flatten(list(body)) AS body, flatten(list(path)) AS path FROM docs GROUP BY source), {sql_scores('own', 'name')}, every AS (SELECT 'q' AS query_id, name AS doc, round(greatest(coalesce(score, 0), 0), 9) AS score FROM own LEFT JOIN scores ON doc = name)"
_REVIEWED = f"WITH {_DOCS}, con AS (SELECT * FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"
_PART_FIELDS = [Field("name", 2.0, 0.75)]
_REACH = f"""WITH pt AS (SELECT p_partkey, {sql_words("concat_ws(' ', p_name, p_type)")} AS name FROM part),
wd AS (SELECT term FROM (SELECT unnest(name) AS term FROM pt) GROUP BY term ORDER BY count(*) DESC, term LIMIT 3),
{sql_scores('pt', 'p_partkey', _PART_FIELDS, 1.2, "(SELECT 'q' AS query_id, term FROM wd)")},
sc AS (SELECT doc, round(score, 9) AS score FROM scores),
ok AS (SELECT * FROM sc WHERE score >= greatest(0.1, (SELECT max(score) FROM sc) * 0.5::DOUBLE)),
rch AS (SELECT l_suppkey AS package, max(score) AS score FROM ok JOIN lineitem ON l_partkey = doc GROUP BY 1)"""


def _count_sql(tokens: str, rel: str) -> str:
    return f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens}) AS term FROM {rel}) GROUP BY term"


_W = sql_words("coalesce(text, '')")
_OUTSIDE = f"""WITH {_DOCS}, tl AS (SELECT unnest(['{"', '".join(TERMS)}']) AS term),
g AS (SELECT DISTINCT source, unnest(body) AS term FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
b AS (SELECT DISTINCT source, unnest(body) AS term FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT 'q' AS query_id, b.source AS doc, round(2.5::DOUBLE * count(*) / {len(TERMS)}, 6) AS penalty FROM b JOIN tl USING (term) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source = b.source AND g.term = b.term) GROUP BY 2"""
ORACLE_SQL = {
    "bm25_topk": f"{_SC} SELECT query_id, doc AS doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM scores) WHERE rank <= 20",
    "bm25_field_shares": f"{_SC} SELECT query_id, doc AS doc_id, field, round(sum(contrib * part / total), 6) AS share FROM contrib JOIN parts USING (doc, term) WHERE total > 0 GROUP BY 1, 2, 3",
    "bm25_batch_topk": f"""WITH {_DOCS}, items AS (SELECT DISTINCT item_id AS query_id, unnest({_W}) AS term FROM benchmark), {sql_scores('docs', 'doc_id', queries='items')}
SELECT query_id, doc AS doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM scores) WHERE rank <= 5""",
    "df_terms": f"WITH {_DOCS}, {_long(FIELDS).format(key='doc_id', src='docs')} SELECT term, count(DISTINCT doc) AS df FROM long GROUP BY term",
    "avg_field_len": f"WITH {_DOCS} SELECT round(greatest(1, avg(len(body))), 6) AS body, round(greatest(1, avg(len(path))), 6) AS path FROM docs",
    "retrieval_boosted": f"{_REL} SELECT query_id, file, trust, rank, round(relevance, 6) AS relevance FROM ord WHERE rank <= 12",
    "scope_survivor": f"""{_REL}, f AS (SELECT query_id, min(rank) FILTER (WHERE starts_with(file, 'src3/')) AS first, least(max(rank), 12) AS last FROM ord GROUP BY 1)
SELECT query_id, file, trust, least(rank, last) AS rank, round(relevance, 6) AS relevance FROM ord JOIN f USING (query_id)
WHERE CASE WHEN coalesce(first, 0) > 12 THEN rank < last OR rank = first ELSE rank <= 12 END""",
    "code_survivor": f"""{_REL.replace("source || '/' || lpad", "CASE source WHEN 'src7' THEN 'code' ELSE source END || '/' || lpad")}, kept AS (SELECT * FROM ord WHERE rank <= 30),
st AS (SELECT query_id, bool_or(starts_with(file, 'code/')) AS has, bool_and(rank > 3 OR trust = 'high') AS lead, max(rank) AS n FROM kept GROUP BY 1),
best AS (SELECT * FROM ord WHERE starts_with(file, 'code/') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1)
SELECT query_id, file, trust, rank, round(relevance, 6) AS relevance FROM kept
UNION ALL SELECT query_id, file, trust, n + 1, round(relevance, 6) FROM best JOIN st USING (query_id) WHERE NOT has AND NOT lead""",
    "route_softmax": f"{_OWN} SELECT query_id, doc, round(score, 6) AS score, round(exp((score - max(score) OVER ()) / 0.2::DOUBLE) / sum(exp((score - (SELECT max(score) FROM every)) / 0.2::DOUBLE)) OVER (), 6) AS confidence FROM every",
    "route_owner": f"""{_OWN}, c AS (SELECT doc, exp((score - (SELECT max(score) FROM every)) / 2.0::DOUBLE) / sum(exp((score - (SELECT max(score) FROM every)) / 2.0::DOUBLE)) OVER () AS conf FROM every),
t AS (SELECT doc, conf FROM c ORDER BY conf DESC, doc LIMIT 1)
SELECT 'q' AS query_id, t.doc AS owner, round(t.conf, 6) AS confidence, CASE WHEN t.conf < 0.7 THEN coalesce((SELECT string_agg(doc, ',' ORDER BY conf DESC, doc) FROM c WHERE conf >= 0.02), '') ELSE '' END AS candidates FROM t""",
    "out_of_scope_penalty": _OUTSIDE,
    "concept_threshold": f"{_REVIEWED}, {sql_scores('con', 'doc_id')}, sc AS (SELECT doc, round(score, 9) AS score FROM scores), t AS (SELECT greatest(0.1::DOUBLE, max(score) * 0.5::DOUBLE) AS threshold FROM sc) SELECT doc AS doc_id, round(score, 6) AS score, round(threshold, 6) AS threshold FROM sc, t WHERE score >= threshold",
    "concept_coverage": f"{_REVIEWED} SELECT doc_id, round(len(list_intersect(body, ['{"', '".join(TERMS)}'])) / {len(TERMS)}::DOUBLE, 6) AS coverage FROM con",
    "package_reach": f"{_REACH} SELECT package, round(score, 6) AS score FROM rch",
    "implementing_packages": f"{_REACH} SELECT package, row_number() OVER (ORDER BY score DESC, package) AS rank, round(score, 6) AS score FROM rch ORDER BY rank LIMIT 5",
    "tokens_unigram": _count_sql(_W, "documents"),
    "tokens_bigram": f"WITH w AS (SELECT {_W} AS w FROM documents) SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || '_' || w[i + 1])) AS term FROM w) GROUP BY term",
    "tokens_path": _count_sql(sql_path("coalesce(url, '')"), "pages"),
    "query_rewrite": f"""WITH w AS (SELECT item_id, list_transform(({_W})[1:item_id % 4 + 1], lambda w: CASE WHEN length(w) % 5 = 0 THEN 'code' WHEN length(w) % 5 = 1 THEN 'index' WHEN length(w) % 5 = 2 AND starts_with(w, 't') THEN 'codeindex' ELSE w END) AS l FROM benchmark),
t AS (SELECT item_id, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: list_position(l, x[1]) = x[2]), lambda x: x[1]) AS terms FROM w),
k AS (SELECT item_id, terms, CASE WHEN len(terms) > 1 AND len(list_filter(terms, lambda x: x <> 'code')) > 0 THEN list_filter(terms, lambda x: x <> 'code') ELSE terms END AS kept FROM t)
SELECT item_id, array_to_string(kept, ' ') AS kept, array_to_string(CASE WHEN list_contains(terms, 'code') AND list_contains(kept, 'index') AND NOT list_contains(kept, 'codeindex') THEN list_append(kept, 'codeindex') ELSE kept END, ' ') AS expanded FROM k""",
    "token_estimate": "SELECT doc_id, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents",
    "slugify": "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS bare FROM part",
    "camel_split": f"""WITH n AS (SELECT p_partkey, {sql_words("regexp_replace(translate('load' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || '.runAll', './_', '   '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')")} AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS words FROM n""",
    "title_from_path": "SELECT page_id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', ''), '[-_]+'), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), ' ') AS title FROM pages",
}
