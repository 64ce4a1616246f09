"""Workspaces as tables: markdown and code files, agents, nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph

TIERS = ("specs", "docs", "context", "notes")
#: Languages by file extension; what is registered here is scanned.
LANGUAGES = {".go": "go"}
NODE = "id string, type string, file string, name string, tier string, section string, language string, symbol_kind string, package string, line int, doc_comment string, role string, scope array<string>, responsibilities string, out_of_scope string, read_chain array<string>, rules array<string>, skills array<string>, skills_body string, context_topics array<string>, context_topics_body string"


def register(extension: str, language: str) -> None:
    LANGUAGES[extension if extension.startswith(".") else f".{extension}"] = language


def language(path: Column) -> Column:
    """The language of a path by its extension; null for none."""
    out = F.lit(None).cast("string")
    for ext, name in LANGUAGES.items():
        out = F.when(F.lower(path).endswith(ext), name).otherwise(out)
    return out


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path (below root), text of whole files whose names match."""
    base = root.rstrip("/")
    read = spark.read.text(base, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return read.select(path.alias("full"), F.col("value").alias("text")).withColumn("path", F.regexp_replace(F.split_part("full", F.lit(f"{base}/"), F.lit(-1)), "^/", "")).select("path", "text")


def ignored(found: DataFrame, prefixes: DataFrame) -> DataFrame:
    """files() without those below a prefix (prefix); # starts a comment.  Each path looks up its own parents."""
    rules = prefixes.select(F.regexp_replace(F.trim("prefix"), "/+$", "").alias("dir")).filter("dir <> '' AND NOT dir LIKE '#%'").distinct()
    parts = F.split("path", "/")
    ups = found.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir"))
    return found.join(ups.join(rules, "dir", "left_semi").select("path").distinct(), "path", "left_anti")


def markdown(spark: SparkSession, root: str, prefixes: DataFrame | None = None) -> DataFrame:
    """path, text, kind, tier, agent of agents' files and of those below specs, docs, context and notes."""
    found = files(spark, root, "*.md")
    found = ignored(found, prefixes) if prefixes is not None else found
    top = F.split_part("path", F.lit("/"), F.lit(1))
    agent = F.regexp_extract("path", "^agents/([^/]+)/AGENT[.]md$", 1)
    kind = F.when(agent != "", "agent").when(F.col("path").startswith("specs/decisions/"), "decision").when(top == "specs", "spec_section").when(top == "docs", "doc").when(top == "context", "context_snapshot").when(top == "notes", "note")
    return found.withColumns({"kind": kind, "tier": F.when(top.isin(*TIERS), top), "agent": F.nullif(agent, F.lit(""))}).filter(F.col("kind").isNotNull())


def code(spark: SparkSession, root: str) -> DataFrame:
    """path, text, language of code files; vendored, test data and test files are left out."""
    parts = [files(spark, root, f"*{ext}") for ext in LANGUAGES]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.filter(~F.col("path").rlike(r"(^|/)(vendor|testdata)/|_test\.[a-z]+$")).withColumn("language", language(F.col("path")))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """dir, module of go.mod files."""
    found = files(spark, root, "go.mod")
    return found.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("module"))


_ESCAPE = r"""\\[\\"'abfnrtvxuU0-7]"""
_PIECE = r"""(?s)//[^\n]*+|/\*.*?\*/|`[^`]*+`|"[^"\n]*+"|'[^'\n]*+'|[^/`"']++|."""
_NAME = r"[\p{L}_][\p{L}\p{Nd}_]*"


def go_code(text: Column) -> Column:
    """A Go source with comments blank and literals empty, line for line.

    Escapes go first: those that may stand in a string stand for nothing elsewhere that matters, as a backslash does not
    escape a back quote.  Then the text is cut, from left to right, into comments, literals and what lies between.
    """
    cut = F.regexp_extract_all(F.regexp_replace(text, _ESCAPE, "__"), F.lit(_PIECE), F.lit(0))

    def kept(piece: Column) -> Column:
        ends = F.regexp_replace(piece, r"[^\n]+", "")
        return F.when(piece.startswith("//") | piece.startswith("/*"), F.concat(F.lit(" "), ends)).when((F.length(piece) > 1) & piece.substr(1, 1).isin('"', "'", "`"), F.concat(F.lit('""'), ends)).otherwise(piece)

    return F.array_join(F.transform(cut, kept), "")


def symbols(sources: DataFrame, packages: DataFrame) -> DataFrame:
    """package, name, kind, file, line of the exported names that Go sources declare outside functions.

    sources: (path, text); packages: (file, package).  Statements are lines of go_code(), cut at semicolons; how deep each
    lies is a running sum of brackets, so that only declarations count, single or in groups, and not what looks like one in a
    literal, a comment, a body or the rest of a longer expression.  A file without a package clause, or whose brackets do not
    balance, has no symbols.
    """
    cut = sources.select(F.col("path").alias("file"), F.posexplode(F.split(go_code(F.col("text")), "\n")).alias("line", "x"))
    parts = cut.select("file", (F.col("line") + 1).alias("line"), F.posexplode(F.split("x", ";")).alias("nth", "x")).withColumn("x", F.trim(F.regexp_replace("x", r"\s+", " ")))

    def count(signs: str) -> Column:
        return F.length("x") - F.length(F.translate("x", signs, ""))

    w = graph.Window.partitionBy("file").orderBy("line", "nth")
    upto, every = w.rowsBetween(graph.Window.unboundedPreceding, 0), graph.Window.partitionBy("file")
    deep = parts.withColumn("step", count("{([") - count("})]")).withColumn("depth", F.sum("step").over(upto))
    deep = deep.withColumns({"before": F.col("depth") - F.col("step"), "sound": (F.sum("step").over(every) == 0) & (F.min("depth").over(every) >= 0) & F.max(F.col("x").rlike(r"^package \w")).over(every)}).filter("sound AND x <> ''")
    opens = F.regexp_extract("x", r"^(type|var|const) ?\(", 1)
    # the group that a statement lies in, and whether it goes on with the one before, whose end asks for more
    grouped = deep.withColumns({
        "block": F.last(F.when(F.col("before") == 0, opens), ignorenulls=True).over(upto),
        "goes_on": F.coalesce((F.lag("line").over(w) < F.col("line")) & F.lag("x").over(w).rlike(r"[-+*/%&|^<>=!,.:]$") & ~F.lag("x").over(w).rlike(r"(\+\+|--)$"), F.lit(False)),
    })
    alone = F.when(F.col("before") == 0, F.regexp_extract("x", rf"^(?:type|var|const) ({_NAME}(?: ?, ?{_NAME})*)", 1))
    inner = F.when((F.col("before") == 1) & (F.col("block") != ""), F.regexp_extract(F.regexp_replace("x", r"^(?:type|var|const) ?\( ?", ""), rf"^({_NAME}(?: ?, ?{_NAME})*)", 1))
    first = F.when((F.col("before") == 0) & (opens != ""), F.regexp_extract("x", rf"\( ?({_NAME}(?: ?, ?{_NAME})*)", 1))
    kind = F.when(F.coalesce(F.nullif(opens, F.lit("")), F.regexp_extract("x", "^(type|var|const) ", 1), F.lit("")) == "type", "type")
    kind = F.when(F.col("before") == 1, F.when(F.col("block") == "type", "type").otherwise("value")).otherwise(F.coalesce(kind, F.lit("value")))
    function = F.when(F.col("before") == 0, F.regexp_extract("x", rf"^func ?(?:\([^)]*\) ?)?({_NAME})", 1))
    names = F.concat(F.split(F.coalesce(F.nullif(function, F.lit("")), F.nullif(alone, F.lit("")), F.nullif(inner, F.lit("")), first, F.lit("")), " ?, ?"))
    said = grouped.filter(~F.col("goes_on")).select("file", "line", "nth", F.when(F.coalesce(function, F.lit("")) != "", "func").otherwise(kind).alias("kind"), F.explode(names).alias("name"))
    return said.filter(F.col("name").rlike(r"^\p{Lu}")).join(packages, "file", "left").select("package", "name", "kind", "file", F.col("line").cast("int").alias("line"))


def agents(found: DataFrame) -> DataFrame:
    """Agent nodes from markdown(): one row for each agent, its sections as columns."""
    own = found.filter("kind = 'agent'")
    parts = graph.sections(own, "agent").withColumn("h", F.lower("heading"))

    def part(*names: str) -> Column:
        return F.max(F.when(F.col("h").isin(*names), F.col("content")))

    wide = parts.groupBy("agent").agg(
        part("role").alias("role"), part("read-chain", "readchain", "read chain").alias("chain"), part("rules").alias("rule_text"), part("skills").alias("skills_body"),
        part("responsibilities").alias("duties"), part("out of scope", "out-of-scope").alias("out_of_scope"), part("context topics", "context-topics").alias("context_topics_body"),
    )
    prose, scope = responsibilities(F.coalesce("duties", F.lit("")))
    full = own.select("agent", "path").join(wide, "agent", "left")
    empty = F.array().cast("array<string>")
    return full.select(
        F.concat(F.lit("agent:"), "agent").alias("id"), F.lit("agent").alias("type"), F.col("path").alias("file"), F.col("agent").alias("name"), "role", scope.alias("scope"), prose.alias("responsibilities"), "out_of_scope",
        F.coalesce(graph.list_items(F.col("chain")), empty).alias("read_chain"), F.coalesce(graph.ticked_paths(F.col("rule_text")), empty).alias("rules"), F.coalesce(graph.ticked_paths(F.col("skills_body")), empty).alias("skills"), "skills_body",
        F.coalesce(graph.list_items(F.col("context_topics_body")), empty).alias("context_topics"), "context_topics_body",
    )


def responsibilities(c: Column) -> tuple[Column, Column]:
    """The prose and the scope paths of a responsibilities section: ticked list items below a line that says scope.

    The scope ends at the first other line; a mark opens it again.
    """
    state = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("scope"), F.array().cast("array<string>").alias("prose"))

    def step(acc, line):
        bare = F.trim(line)
        item = F.regexp_extract(bare, r"^[-*]\s+`([^`]+)`", 1)
        mark = F.lower(bare).isin("scope:", "**scope:**")
        inside = acc["open"] & ((bare == "") | (item != ""))
        return F.struct(
            (mark | inside).alias("open"),
            F.when(~mark & acc["open"] & (item != ""), F.array_append(acc["scope"], item)).otherwise(acc["scope"]).alias("scope"),
            F.when(mark | inside, acc["prose"]).otherwise(F.array_append(acc["prose"], line)).alias("prose"),
        )

    done = F.aggregate(F.split(c, "\n"), state, step)
    return F.regexp_replace(F.array_join(done["prose"], "\n"), r"^\s+|\s+$", ""), done["scope"]


def document_nodes(found: DataFrame) -> DataFrame:
    """Nodes of sections, one for a file without any, and one for each decision, snapshot and note; with text of each."""
    base = F.regexp_extract("path", "([^/]*)$", 1)
    parted = found.filter("kind IN ('spec_section', 'doc')")
    own = graph.sections(parted, "path").filter("heading NOT IN ('', '---')").join(parted.select("path", "kind", "tier"), "path")
    some = own.select(F.concat_ws(":", "kind", "path", "heading").alias("id"), F.col("kind").alias("type"), F.col("path").alias("file"), F.col("heading").alias("name"), "tier", F.col("heading").alias("section"), F.col("content").alias("text"))
    bare = parted.join(own.select("path").distinct(), "path", "left_anti").select(F.concat(F.concat_ws(":", "kind", "path"), F.lit(":")).alias("id"), F.col("kind").alias("type"), F.col("path").alias("file"), base.alias("name"), "tier", F.lit(None).cast("string").alias("section"), F.trim("text").alias("text"))
    stem = F.regexp_replace(base, r"\.md$", "")
    whole = found.filter("kind IN ('decision', 'context_snapshot', 'note')").select(F.when(F.col("kind") == "decision", F.concat(F.lit("decision:"), stem)).otherwise(F.concat_ws(":", "kind", "path")).alias("id"), F.col("kind").alias("type"), F.col("path").alias("file"), F.when(F.col("kind") == "decision", stem).otherwise(base).alias("name"), "tier", F.lit(None).cast("string").alias("section"), F.trim("text").alias("text"))
    return some.unionByName(bare).unionByName(whole)


def build(spark: SparkSession, root: str, prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph of a workspace: nodes (with text) and edges (from, to, type)."""
    found, sources = markdown(spark, root, prefixes), code(spark, root)
    own = agents(found)
    placed = graph.nearest_manifest(sources.select(F.col("path").alias("file")), manifests(spark, root)).select("file", "package")
    comment = F.regexp_replace(F.regexp_replace(F.regexp_extract("text", r"(?s)^((?://[^\n]*\n)+)package ", 1), r"(?m)^//[ \t]?", ""), r"^\s+|\s+$", "")
    code_files = sources.join(placed, F.col("path") == F.col("file"), "left").select(F.concat(F.lit("code_file:"), "path").alias("id"), F.lit("code_file").alias("type"), F.col("path").alias("file"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "language", "package", F.nullif(comment, F.lit("")).alias("doc_comment"))
    named = symbols(sources, placed).withColumn("id", F.concat(F.lit("code_symbol:"), F.coalesce("package", F.lit("")), F.lit("."), "name"))
    code_symbols = named.select("id", F.lit("code_symbol").alias("type"), "file", "name", F.lit("go").alias("language"), F.col("kind").alias("symbol_kind"), "package", "line")
    packs = graph.packages(code_files.filter(F.col("package").isNotNull()).select("package", "file", F.col("doc_comment").alias("doc"))).select(F.concat(F.lit("code_package:"), "package").alias("id"), F.lit("code_package").alias("type"), F.regexp_replace("file", "/?[^/]*$", "").alias("file"), F.regexp_extract("package", "([^/]*)$", 1).alias("name"), F.lit("go").alias("language"), "package", F.col("doc").alias("doc_comment"), F.col("doc").alias("text"))
    nodes = own
    for part in (document_nodes(found), code_files, code_symbols, packs):
        nodes = nodes.unionByName(part, allowMissingColumns=True)
    first = graph.first_node(nodes)
    texts = found.join(first.withColumnRenamed("file", "path"), "path").select("id", "text")
    edges = graph.read_edges(own, nodes).unionByName(graph.owner_edges(own, nodes)).unionByName(graph.reference_edges(texts, nodes))
    contains = named.select(F.concat(F.lit("code_file:"), "file").alias("from"), F.col("id").alias("to"), F.lit("contains").alias("type"))
    return nodes, edges.distinct().unionByName(contains)


def required(found: DataFrame) -> DataFrame:
    """path, severity of files that a workspace must or should have and has not; found: (path)."""
    from tessera.operators import audit

    return audit.required(found, [("AGENTS.md", "error"), ("README.md", "warning")])


#: Layers of a workspace in the order in which they are believed.
LAYERS = ("specs", "docs", "context", "notes")


def manifest(files: DataFrame, name: str) -> DataFrame:
    """project, description that the manifest of that name says (path, text), a "key: value" a line, the last one of a key;
    null where it does not say it."""

    def field(key: str) -> Column:
        return F.trim(F.element_at(F.filter(F.split("text", "\r?\n"), lambda x: x.startswith(f"{key}: ")), -1).substr(F.lit(len(key) + 3), F.length("text")))

    own = files.filter(F.col("path") == name)
    some = F.exists(F.split("text", "\r?\n"), lambda x: x.startswith("project: ")), F.exists(F.split("text", "\r?\n"), lambda x: x.startswith("description: "))
    return own.select(F.when(some[0], field("project")).alias("project"), F.when(some[1], field("description")).alias("description"))


def layers(files: DataFrame) -> DataFrame:
    """layer, files: the layers in their order, with the number of files below each (path)."""
    spark = files.sparkSession
    wanted = spark.createDataFrame(list(enumerate(LAYERS)), "rank int, layer string")
    counted = files.groupBy(F.regexp_extract("path", "^([^/]*)/", 1).alias("layer")).agg(F.count("*").alias("files"))
    return wanted.join(counted, "layer", "left").select("rank", "layer", F.coalesce("files", F.lit(0)).alias("files")).orderBy("rank").drop("rank")
