"""The overlay of concepts: parsing of responses, checks, merge, review, near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import bare_name

TAGS, AUTO_REVIEW = ("EXTRACTED", "INFERRED"), 0.85
EDGE_TYPES = ("agent_owns_concept", "implements_spec", "drifted_from", "semantically_similar_to", "implements")
RESPONSE = "struct<concepts:array<struct<id:string,name:string,description:string,source_files:array<string>,tag:string,confidence:double>>,edges:array<struct<from:string,to:string,type:string,tag:string,confidence:double>>>"


def unfenced(c: Column) -> Column:
    """A response without the fence that may stand around it."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    return F.when(t.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(t)


def _tag(c: Column) -> Column:
    return F.when(c.isin(*TAGS), c).otherwise(TAGS[0])


def _confidence(c: Column) -> Column:
    return F.when((c > 0) & (c <= 1), c).otherwise(1.0)


def parse(responses: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """responses with the column r of the parsed response; null where it is no JSON."""
    return responses.select(key, F.from_json(unfenced(F.col(text_col)), RESPONSE).alias("r"))


def concepts(parsed: DataFrame, key: str) -> DataFrame:
    """Concepts with an id and a name, with defaults for tag and confidence, not reviewed."""
    rows = parsed.select(key, F.inline("r.concepts"))
    good = rows.filter(F.col("id").startswith("concept:") & (F.coalesce("name", F.lit("")) != ""))
    return good.withColumns({"tag": _tag(F.col("tag")), "confidence": _confidence(F.col("confidence")), "reviewed": F.lit(False)})


def edges(parsed: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """Edges from concepts of the response to concepts or nodes (id), of a known type; the sure ones count as reviewed."""
    own = concepts(parsed, key).select(key, "id").distinct()
    rows = parsed.select(key, F.inline("r.edges")).filter(F.col("type").isin(*EDGE_TYPES))
    rows = rows.join(own.withColumnRenamed("id", "from"), [key, "from"], "left_semi")
    ends = rows.select(key, "to").distinct()
    good = ends.join(own.withColumnRenamed("id", "to"), [key, "to"], "left_semi").unionAll(ends.join(nodes.select(F.col("id").alias("to")), "to", "left_semi").select(key, "to")).distinct()
    kept = rows.join(good, [key, "to"], "left_semi").withColumns({"tag": _tag(F.col("tag")), "confidence": _confidence(F.col("confidence"))})
    return kept.withColumn("reviewed", F.col("confidence") >= AUTO_REVIEW)


def skipped(parsed: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """key, concepts, edges: how many items of a response were left out."""
    sizes = parsed.select(key, F.coalesce(F.size("r.concepts"), F.lit(0)).alias("c"), F.coalesce(F.size("r.edges"), F.lit(0)).alias("e"))
    a = concepts(parsed, key).groupBy(key).agg(F.count("*").alias("kc"))
    b = edges(parsed, key, nodes).groupBy(key).agg(F.count("*").alias("ke"))
    return sizes.join(a, key, "left").join(b, key, "left").select(key, (F.greatest("c", F.lit(0)) - F.coalesce("kc", F.lit(0))).alias("concepts"), (F.greatest("e", F.lit(0)) - F.coalesce("ke", F.lit(0))).alias("edges"))


def single(parsed_concepts: DataFrame, key: str) -> DataFrame:
    """Of each response that gave exactly one concept, that concept."""
    one = parsed_concepts.groupBy(key).agg(F.count("*").alias("n")).filter("n = 1").select(key)
    return parsed_concepts.join(one, key, "left_semi")


def merge_concepts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming, and what was reviewed and is not among it."""
    return incoming.unionByName(existing.filter("reviewed").join(incoming.select("id"), "id", "left_anti"))


def merge_edges(existing: DataFrame, incoming: DataFrame, merged_concepts: DataFrame) -> DataFrame:
    """The same for edges by (from, type, to); those from a concept that is gone are dropped."""
    every = incoming.unionByName(existing.filter("reviewed").join(incoming.select("from", "type", "to"), ["from", "type", "to"], "left_anti"))
    return every.join(merged_concepts.select(F.col("id").alias("from")), "from", "left_semi")


def allowed_ids(nodes: DataFrame, concepts_: DataFrame) -> DataFrame:
    """id of the nodes and reviewed concepts a proposal may name, sorted."""
    return nodes.select("id").union(concepts_.filter("reviewed").select("id")).distinct().orderBy("id")


def reviewed(items: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """items after decisions (key, accept): accepted ones are reviewed, rejected ones go, others stay as they are."""
    judged = items.join(decisions.select(*key, "accept").distinct(), key, "left")
    return judged.filter(F.coalesce("accept", F.lit(True))).withColumn("reviewed", F.col("reviewed") | F.coalesce("accept", F.lit(False))).drop("accept")


def near_duplicates(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """name, other, distance: existing names (name) at most 2 edits away, or 3 for names of over 10 characters.

    At most t edits leave one of t + 1 equal parts of a name as it is, moved by at most t places: both sides are joined on
    such parts and length, so no name meets all others.  Names shorter than the parts are joined on length alone.
    """
    most = F.when(F.length("norm") > 10, 3).otherwise(2)
    a = proposed.select("name", bare_name(F.col("name")).alias("norm")).distinct().withColumn("t", most)
    b = existing.select(F.col("name").alias("other"), bare_name(F.col("name")).alias("other_norm")).distinct()
    width = F.floor(F.length("norm") / (F.col("t") + 1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("t")), lambda i: F.struct((i * width + 1).alias("at"), F.substring("norm", i * width + 1, width).alias("part")))
    cut = a.withColumn("width", width)
    long_ = cut.filter("width > 0").withColumn("p", F.explode(parts)).withColumn("move", F.explode(F.sequence(-F.col("t"), F.col("t")))).withColumn("m", F.explode(F.sequence(F.greatest(F.length("norm") - F.col("t"), F.lit(0)), F.length("norm") + F.col("t"))))
    wanted = long_.select("name", "norm", "t", F.col("m").alias("n"), (F.col("p.at") + F.col("move")).alias("at"), F.col("p.part").alias("part"), "width").filter("at >= 1")
    shapes = wanted.select("n", "at", "width").distinct()
    spread = b.withColumn("n", F.length("other_norm")).join(F.broadcast(shapes), "n").withColumn("part", F.substring("other_norm", F.col("at"), F.col("width")))
    pairs = wanted.join(spread, ["n", "at", "width", "part"]).select("name", "norm", "t", "other", "other_norm")
    short = cut.filter("width = 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.length("norm") + F.col("t")))).join(b.withColumn("n", F.length("other_norm")), "n").select("name", "norm", "t", "other", "other_norm")
    found = pairs.unionAll(short).withColumn("distance", F.when(F.col("t") == 3, F.levenshtein("norm", "other_norm", 3)).otherwise(F.levenshtein("norm", "other_norm", 2)))
    # a pair that shares several parts is found several times; few are left of those compared
    return found.filter("distance >= 0").select("name", "other", F.col("distance").cast("int").alias("distance")).distinct()


def fresh(overlay: DataFrame, graph_hash: str, model: str) -> bool:
    """Whether an overlay of one row (graph_hash, model) was made for this graph by this model."""
    return bool(overlay.filter((F.col("graph_hash") == graph_hash) & (F.col("model") == model)).limit(1).count())


def prompt(nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """One row, text: what a model needs to name concepts: agents, sections and packages with symbols as JSON, and the ids
    it may lead to.  Equal for equal graphs.

    packages: (package, symbols).  The graph of one workspace fits a prompt, so it fits a row.
    """
    kinds = ("agent", "spec_section", "decision", "code_package")
    rows = nodes.filter(F.col("type").isin(*kinds)).select("id", "type", "name", "file", "package").join(packages, "package", "left")
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("id", "type", "name", "file", "symbols"))).alias("n"), F.array_sort(F.collect_set("id")).alias("ids"))
    rules = "Name the concepts that span several of these parts. Answer with one JSON object: concepts (id concept:<slug>, name, description, source_files, tag EXTRACTED or INFERRED, confidence) and edges (from a concept, to one of the ids, type " + ", ".join(EDGE_TYPES) + ", tag, confidence). Specs outrank docs, docs outrank code."
    return listed.select(F.concat_ws("\n\n", F.lit(rules), F.to_json("n"), F.array_join("ids", "\n")).alias("text"))


def concepts_of(concepts_: DataFrame, concept_edges: DataFrame, agent: str) -> DataFrame:
    """Reviewed concepts that reviewed edges give to an agent, by id."""
    own = concept_edges.filter("reviewed AND type = 'agent_owns_concept'")
    ids = own.filter(F.col("to") == f"agent:{agent}").select(F.col("from").alias("id")).unionAll(own.filter(F.col("from") == f"agent:{agent}").select(F.col("to").alias("id")))
    return concepts_.filter("reviewed").join(ids, "id", "left_semi").orderBy("id")


def packages_of(concept_edges: DataFrame, concept: str) -> DataFrame:
    """package of reviewed edges that implement a concept, sorted."""
    own = concept_edges.filter((F.col("from") == concept) & F.col("reviewed") & (F.col("type") == "implements"))
    return own.select(F.regexp_replace("to", "^code_package:", "").alias("package")).distinct().orderBy("package")
