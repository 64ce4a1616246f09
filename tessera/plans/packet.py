"""A query's packet: its owner, ranked blocks, concepts, packages and entry points; and the service that hands them out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import bm25, graph, retrieval, routing
from tessera.operators.bm25 import Field
from tessera.sources.config import Settings
from tessera.sources.store import settled

SEARCHED = ("spec_section", "decision", "doc", "context_snapshot", "code_package")


def tokens(c: Column, pairs: bool = False) -> Column:
    own = text.stemmed(text.words(F.coalesce(c, F.lit(""))))
    return F.concat(own, text.bigrams(own)) if pairs else own


def path_tokens(c: Column, pairs: bool = False) -> Column:
    """Of a path or an array of paths."""
    own = text.stemmed(text.path_words(F.coalesce(c, F.lit(""))))
    return F.concat(own, text.bigrams(own)) if pairs else own


def _joined(c: str) -> Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")


def query_terms(spark: SparkSession, queries: list[tuple[str, str]], pairs: bool = False) -> DataFrame:
    """query_id, term of texts (query_id, text); a term once for each query."""
    rows = spark.createDataFrame(queries, "query_id string, text string").select("query_id", tokens(F.col("text")).alias("t"))
    return rows.select("query_id", F.explode(text.query_terms(F.col("t"), pairs)).alias("term"))


def agent_documents(nodes: DataFrame, pairs: bool = False) -> DataFrame:
    """Token arrays of agents; a section's body goes before its list."""
    own = nodes.filter("type = 'agent'")
    skills = F.when(F.coalesce("skills_body", F.lit("")) != "", tokens(F.col("skills_body"), pairs)).otherwise(path_tokens(_joined("skills"), pairs))
    topics = F.when(F.coalesce("context_topics_body", F.lit("")) != "", F.col("context_topics_body")).otherwise(_joined("context_topics"))
    return own.select("name", F.col("scope").alias("scope_paths"), path_tokens(_joined("scope"), pairs).alias("scope"), tokens(F.col("role"), pairs).alias("role"), tokens(F.col("responsibilities"), pairs).alias("responsibilities"), path_tokens(_joined("read_chain"), pairs).alias("readchain"), skills.alias("skills"), tokens(topics, pairs).alias("context_topics"), path_tokens(_joined("rules"), pairs).alias("rules"), tokens(F.col("out_of_scope"), pairs).alias("outside"))


def agent_fields(s: Settings) -> list[Field]:
    b_text, b_path = s["fields.b_text"], s["fields.b_path"]
    return [Field(n, s[f"weights.{n}"], b_path if n in ("scope", "readchain", "skills", "rules") else b_text) for n in ("scope", "role", "responsibilities", "readchain", "skills", "context_topics", "rules")]


def owner_scores(nodes: DataFrame, terms: DataFrame, s: Settings) -> DataFrame:
    """query_id, doc, score for every agent.

    A field of weight 0 counts in document frequencies; out-of-scope words do not, they only feed the penalty, which spares
    terms that any other field holds.
    """
    docs = settled(agent_documents(nodes, s["tokenize.use_bigrams"]))
    return routing.owner_scores(docs, terms, "name", agent_fields(s), "outside", s["bm25.k1"], s["weights.out_of_scope_penalty"])


def block_documents(nodes: DataFrame, s: Settings) -> DataFrame:
    """Token arrays of what is searched: title, path, body."""
    kinds = [*SEARCHED, *(["note"] if s["retrieval.include_notes"] else [])]
    pack, pairs = F.col("type") == "code_package", s["tokenize.use_bigrams"]
    title = F.when(pack, F.coalesce(F.nullif("package", F.lit("")), F.trim("name"))).otherwise(F.coalesce(F.nullif(F.trim(F.coalesce("section", F.lit(""))), F.lit("")), F.trim("name")))
    path = F.when(pack, F.concat_ws(" ", "file", "package")).otherwise(F.col("file"))
    section = F.coalesce(F.when(pack, F.col("package")), F.col("section"), F.lit(""))
    return nodes.filter(F.col("type").isin(kinds)).select("id", F.coalesce("file", F.lit("")).alias("file"), section.alias("section"), F.coalesce("tier", F.lit("")).alias("tier"), tokens(title, pairs).alias("title"), path_tokens(path, pairs).alias("path"), tokens(F.col("text"), pairs).alias("body"))


def block_fields(s: Settings) -> list[Field]:
    return [Field("title", s["retrieval.fields.weight_title"], s["fields.b_text"]), Field("path", s["retrieval.fields.weight_path"], s["fields.b_path"]), Field("body", s["retrieval.fields.weight_body"], s["fields.b_text"])]


def relevant_blocks(nodes: DataFrame, edges: DataFrame, terms: DataFrame, owners: DataFrame, s: Settings) -> DataFrame:
    """query_id, file, section, tier, trust, relevance; owners: (query_id, owner), null for none."""
    docs = settled(block_documents(nodes, s).withColumn("row", F.monotonically_increasing_id()))
    scored = bm25.scores(docs, terms, "row", block_fields(s), s["retrieval.bm25.k1"])
    scopes = nodes.filter("type = 'agent'").select(F.col("name").alias("agent"), F.explode("scope").alias("scope"))
    near = retrieval.connected(nodes.filter(F.col("type").isin(*SEARCHED, "note")), edges, scopes).select("id", F.col("agent").alias("owner"), F.lit(True).alias("near")).distinct()
    rows = scored.join(docs.select(F.col("row").alias("doc"), "id", "file", "section", "tier"), "doc").join(owners, "query_id").join(near, ["id", "owner"], "left")
    return retrieval.with_relevance(rows, F.col("near"))


def concept_documents(concepts: DataFrame, pairs: bool = False) -> DataFrame:
    return concepts.select("id", "name", "reviewed", tokens(F.col("name"), pairs).alias("title"), tokens(F.col("description"), pairs).alias("description"), path_tokens(_joined("source_files"), pairs).alias("source_paths"))


def concept_fields(s: Settings) -> list[Field]:
    return [Field("title", s["retrieval.concepts.weight_name"], s["fields.b_text"]), Field("description", s["retrieval.concepts.weight_description"], s["fields.b_text"]), Field("source_paths", s["retrieval.concepts.weight_source_files"], s["fields.b_path"])]


def expanded(terms: DataFrame) -> DataFrame:
    """terms without noise and with the compound, in one row each."""
    own = terms.groupBy("query_id").agg(F.collect_list("term").alias("t"))
    return own.select("query_id", F.explode(text.expand_terms(F.col("t"), text.stem(text.COMPOUND[2]))).alias("term"))


def packet(spark: SparkSession, nodes: DataFrame, edges: DataFrame, queries: list[tuple[str, str]], settings: Settings | None = None, concepts: DataFrame | None = None, concept_edges: DataFrame | None = None) -> list[dict]:
    """The packets of queries (query_id, text), as they are asked: few rows that a caller waits for.

    All scores of all queries are made together; the driver gets only what the packets show.  nodes and edges should be
    stored tables (store.settled, parquet).
    """
    s = settings or Settings()
    terms = settled(query_terms(spark, queries, s["tokenize.use_bigrams"]))
    routed = routing.route(owner_scores(nodes, terms, s), s["routing.temperature"], s["routing.confidence_threshold"], s["routing.min_candidate_confidence"], s["routing.min_score"])
    routed = settled(routed)
    owners = {r.query_id: r for r in routed.collect()}
    scopes = {r["name"]: r.scope or [] for r in nodes.filter("type = 'agent'").select("name", "scope").collect()}
    clear = routed.filter("owner IS NOT NULL").select("query_id", "owner")
    blocks = _shown_blocks(spark, relevant_blocks(nodes, edges, terms, clear, s), terms, {q: scopes.get(r.owner, []) for q, r in owners.items()}, s)
    names, packs, reach = _concept_parts(terms, s, concepts, concept_edges)
    left_out = [r.prefix for r in retrieval.excluded(nodes, s["retrieval.include_notes"]).collect()]
    out = []
    for q, _ in queries:
        r = owners.get(q)
        if r is None or r.owner is None:
            out.append({"query_id": q, "agent": "", "confidence": 0.0, "reason": "no_clear_owner"})
            continue
        points = _entry_points(nodes, terms.filter(F.col("query_id") == q), scopes.get(r.owner, []), reach.get(q, {}), s)
        found = {"query_id": q, "agent": r.owner, "confidence": r.confidence, "scope": scopes.get(r.owner, []), "context_blocks": blocks.get(q, []), "relevant_concepts": names.get(q, []), "implementing_packages": packs.get(q, []), "code_entry_points": points, "excluded": left_out, "candidate_agents": [c.asDict() for c in r.candidates]}
        out.append({k: v for k, v in found.items() if v or k in ("agent", "confidence")} | ({} if blocks.get(q) else {"reason": "no_relevant_context"}))
    return out


def _shown_blocks(spark: SparkSession, relevant: DataFrame, terms: DataFrame, scopes: dict[str, list[str]], s: Settings) -> dict[str, list[dict]]:
    """The blocks of each query: the best above the threshold, with the survivors of scope and code."""
    least, cap = s["retrieval.min_relevance"], max(1, round(s["retrieval.max_blocks"]))
    inside = spark.createDataFrame([(q, x) for q, own in scopes.items() for x in own] or [("", "")], "query_id string, own string").groupBy("query_id").agg(F.collect_list("own").alias("own"))
    marked = relevant.join(inside, "query_id", "left").withColumn("inside", F.exists(F.coalesce("own", F.array().cast("array<string>")), lambda x: text.in_scope(F.col("file"), x)))
    marked = settled(marked.select("query_id", "file", "section", "trust", "relevance", "inside"))
    kept = settled(retrieval.with_scope_survivor(marked, F.col("inside"), least, cap))
    asks = terms.groupBy("query_id").agg(F.max(F.col("term").isin(*retrieval.CODE_STEMS)).alias("asks"))
    shown = retrieval.with_code_survivor(kept.join(asks, "query_id"), marked.filter(F.col("relevance") >= least), F.col("asks"), cap)
    blocks: dict[str, list[dict]] = {}
    for r in shown.orderBy("query_id", "rank").collect():
        blocks.setdefault(r.query_id, []).append({"file": r.file, "section": r.section, "trust": r.trust, "relevance": r.relevance})
    return blocks


def proposal(spark: SparkSession, nodes: DataFrame, edges: DataFrame, queries: list[tuple[str, str]], settings: Settings | None = None, concepts: DataFrame | None = None, concept_edges: DataFrame | None = None, blocks: int | None = None) -> list[dict]:
    """What is relevant to queries without an owner: blocks (the first so many), concepts, packages, and symbols of packages
    that concepts lead to."""
    s = settings or Settings()
    terms = settled(query_terms(spark, queries, s["tokenize.use_bigrams"]))
    nobody = terms.select("query_id", F.lit(None).cast("string").alias("owner")).distinct()
    shown = _shown_blocks(spark, relevant_blocks(nodes, edges, terms, nobody, s), terms, {}, s)
    names, packs, reach = _concept_parts(terms, s, concepts, concept_edges)
    out = []
    for q, _ in queries:
        points = _entry_points(nodes, terms.filter(F.col("query_id") == q), [], reach[q], s) if reach.get(q) else []
        out.append({"query_id": q, "context_blocks": shown.get(q, [])[:blocks], "relevant_concepts": names.get(q, []), "implementing_packages": packs.get(q, []), "code_entry_points": points})
    return out


def debug(spark: SparkSession, nodes: DataFrame, edges: DataFrame, query: str, settings: Settings | None = None) -> dict[str, DataFrame]:
    """All owners' scores and confidences, all blocks with relevance, and the subgraph of agents and shown blocks."""
    s = settings or Settings()
    terms = settled(query_terms(spark, [("q", query)], s["tokenize.use_bigrams"]))
    scored = settled(owner_scores(nodes, terms, s))
    routed = routing.route(scored, s["routing.temperature"], s["routing.confidence_threshold"], s["routing.min_candidate_confidence"], s["routing.min_score"]).select("query_id", "owner")
    relevant = settled(relevant_blocks(nodes, edges, terms, settled(routed), s))
    shown = retrieval.blocks(relevant, s["retrieval.min_relevance"], max(1, round(s["retrieval.max_blocks"])))
    wanted = nodes.filter("type = 'agent'").select("id").unionAll(nodes.select("id", "file", F.coalesce("section", F.lit("")).alias("section")).join(shown.select("file", "section"), ["file", "section"], "left_semi").select("id"))
    sub_nodes, sub_edges = graph.induced(nodes, edges, wanted)
    return {"agents": routing.softmax(scored, s["routing.temperature"]).orderBy("doc"), "retrieval": relevant.orderBy(F.desc("relevance"), F.desc(retrieval.trust_rank(F.col("trust"))), "file", "section"), "nodes": sub_nodes, "edges": sub_edges}


def _concept_parts(terms: DataFrame, s: Settings, concepts: DataFrame | None, concept_edges: DataFrame | None) -> tuple[dict, dict, dict]:
    """Names of concepts, packages, and the packages' scores, by query."""
    names: dict[str, list] = {}
    packs: dict[str, list] = {}
    reach: dict[str, dict] = {}
    if concepts is None:
        return names, packs, reach
    asked, pairs = settled(expanded(terms)), s["retrieval.concept_use_bigrams"]
    docs = settled(concept_documents(concepts, pairs))
    reviewed = docs.filter("reviewed")
    own = asked
    if pairs and not s["tokenize.use_bigrams"]:
        listed = asked.groupBy("query_id").agg(F.collect_list("term").alias("t"))
        own = listed.select("query_id", F.explode(F.concat("t", text.bigrams(F.col("t")))).alias("term"))
    good = retrieval.concept_threshold(bm25.scores(reviewed, own, "id", concept_fields(s)), s["retrieval.concept_min_relevance"], s["retrieval.concept_min_fraction_of_top"])
    words = asked.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    shown = good.join(reviewed.select(F.col("id").alias("doc"), "name", F.concat("title", "description").alias("held")), "doc").join(words, "query_id").filter(retrieval.coverage(F.col("held"), F.col("terms")) >= s["retrieval.concept_min_query_coverage"])
    for r in bm25.top_k(shown, max(1, round(s["retrieval.max_relevant_concepts"])), [F.desc("score"), "name"]).orderBy("query_id", "rank").collect():
        names.setdefault(r.query_id, []).append(r["name"])
    if concept_edges is not None:
        leads = concept_edges.filter("type = 'implements' AND reviewed").select(F.col("from").alias("doc"), F.regexp_replace("to", "^code_package:", "").alias("package"))
        got = settled(retrieval.package_reach(bm25.scores(settled(concept_documents(concepts)), asked, "id", concept_fields(s)), leads))
        for r in got.collect():
            reach.setdefault(r.query_id, {})[r.package] = r.score
        for r in retrieval.implementing_packages(got, max(1, round(s["retrieval.max_implementing_packages"]))).orderBy("query_id", "rank").collect():
            packs.setdefault(r.query_id, []).append(r.package)
    return names, packs, reach


def _entry_points(nodes: DataFrame, terms: DataFrame, scope: list[str], reach: dict[str, float], s: Settings) -> list[dict]:
    """Symbols in the owner's scope or in packages that concepts lead to."""
    inside = F.lit(False)
    for x in scope:
        inside |= text.in_scope(F.col("file"), F.lit(x))
    own = nodes.filter((F.col("type") == "code_symbol") & (inside | F.coalesce("package", F.lit("")).isin(list(reach))))
    docs = settled(own.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("orig"), "file", F.col("name").alias("symbol"), F.col("symbol_kind").alias("kind_name"), "line", F.coalesce("package", F.lit("")).alias("package"), tokens(F.col("name")).alias("title"), path_tokens(F.col("package")).alias("path"), tokens(F.col("symbol_kind")).alias("kind")))
    fields = [Field("title", s["retrieval.fields.weight_title"], s["fields.b_text"]), Field("path", s["retrieval.fields.weight_path"], s["fields.b_path"]), Field("kind", s["retrieval.fields.weight_kind"], s["fields.b_text"])]
    got = bm25.scores(docs, expanded(terms), "row", fields, s["retrieval.bm25.k1"])
    score = F.lit(0.0)
    for package, value in reach.items():
        score = F.when(F.col("package") == package, float(value)).otherwise(score)
    rows = docs.join(got.select(F.col("doc").alias("row"), "score"), "row").select((F.col("score") * retrieval.CODE_BOOST * s["retrieval.agent_affinity"]).alias("relevance"), score.alias("reach"), "package", "file", "symbol", F.col("kind_name").alias("kind"), "line", "orig")
    return [{k: r[k] for k in ("file", "symbol", "kind", "line", "package", "relevance")} for r in retrieval.entry_points(rows, s["retrieval.min_relevance"], max(1, round(s["retrieval.max_code_entry_points"])))]


# ---- the service: one JSON-RPC request, one answer ----

TOOLS = {"query_graph": ("task",), "get_node": ("id",), "get_neighbors": ("id",), "agent_for_task": ("task",)}


def serve(spark: SparkSession, nodes: DataFrame, edges: DataFrame, line: str, settings: Settings | None = None) -> str | None:
    """The answer to one line; None for a notification."""
    try:
        request = json.loads(line)
    except ValueError:
        return _reply(None, error=(-32700, "parse error"))
    number, method, params = request.get("id"), request.get("method"), request.get("params") or {}
    if number is None:
        return None
    if method == "initialize":
        return _reply(number, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}})
    if method == "tools/list":
        return _reply(number, {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {p: {"type": "string"} for p in ps}, "required": list(ps)}} for n, ps in TOOLS.items()]})
    if method != "tools/call" or params.get("name") not in TOOLS:
        return _reply(number, error=(-32601, f"unknown: {params.get('name') or method}"))
    name, args = params["name"], params.get("arguments") or {}
    lacking = [p for p in TOOLS[name] if not isinstance(args.get(p), str)]
    if lacking:
        return _reply(number, error=(-32603, f"missing argument: {lacking[0]}"))
    if name == "get_node":
        got = graph.node(nodes, args["id"]).collect()
        if not got:
            return _reply(number, error=(-32603, f"node not found: {args['id']}"))
        result = {k: v for k, v in got[0].asDict().items() if v is not None}
    elif name == "get_neighbors":
        result = [{k: v for k, v in r.asDict().items() if v is not None} for r in graph.neighbours(nodes, edges, args["id"], args.get("edge_type")).orderBy("direction", "id").collect()]
    else:
        result = packet(spark, nodes, edges, [("q", args["task"])], settings)[0]
        if name == "agent_for_task":
            result = {k: result[k] for k in ("agent", "confidence", "reason") if k in result}
    return _reply(number, {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False, indent=2)}]})


def _reply(number, result=None, error: tuple[int, str] | None = None) -> str:
    body = {"error": {"code": error[0], "message": error[1]}} if error else {"result": result}
    return json.dumps({"jsonrpc": "2.0", "id": number, **body}, ensure_ascii=False)
