"""Audit checks over the graph, the disk and the overlay: each is one query that returns findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

COLUMNS = ["check", "code", "severity", "message", "file", "line", "refs"]
RANK = {"error": 0, "warn": 1, "info": 2}
_REFERRING = ("reads", "references", "supports")


def finding(rows: DataFrame, code: str, severity: str, message: Column, file: Column | None = None, line: Column | None = None, refs: Column | None = None) -> DataFrame:
    check = {"ORP": "orphans", "COV": "coverage", "STA": "staleness", "DRI": "drift"}[code[:3]]
    none = F.lit(None)
    return rows.select(F.lit(check).alias("check"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), (file if file is not None else none).cast("string").alias("file"), (line if line is not None else none).cast("long").alias("line"), (refs if refs is not None else F.array()).cast("array<string>").alias("refs"))


def inbound(edges: DataFrame) -> DataFrame:
    """id, referring, any: edges that lead to a node, those that refer to it and all."""
    return edges.groupBy(F.col("to").alias("id")).agg(F.count_if(F.col("type").isin(*_REFERRING)).alias("referring"), F.count("*").alias("any"))


def _unreferenced_files(nodes: DataFrame, edges: DataFrame, kind: str, count: str) -> DataFrame:
    own = nodes.filter(F.col("type") == kind).join(inbound(edges), "id", "left")
    return own.groupBy("file").agg(F.max(F.coalesce(count, F.lit(0))).alias("most"), F.array_sort(F.collect_set("id")).alias("ids")).filter("most = 0")


def orphan_specs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    got = _unreferenced_files(nodes, edges, "spec_section", "referring")
    return finding(got, "ORPH001", "error", F.format_string("spec file %s is not referenced by any agent or document", "file"), F.col("file"), refs=F.col("ids"))


def orphan_decisions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.filter(F.col("type").isin(*_REFERRING)).select(F.col("to").alias("id"))
    got = nodes.filter(F.col("type") == "decision").join(used, "id", "left_anti")
    return finding(got, "ORPH001", "error", F.format_string("decision %s is not referenced by any agent or document", "name"), F.col("file"), refs=F.array("id"))


def orphan_docs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    got = _unreferenced_files(nodes, edges, "doc", "any")
    return finding(got, "ORPH002", "warn", F.format_string("doc file %s has no inbound references", "file"), F.col("file"))


def orphan_snapshots(nodes: DataFrame, edges: DataFrame, topics: DataFrame) -> DataFrame:
    """topics: (topic) that agents declare; case is ignored."""
    got = nodes.filter(F.col("type") == "context_snapshot").join(edges.select(F.col("to").alias("id")), "id", "left_anti")
    got = got.withColumn("t", F.lower(F.split_part(F.col("file"), F.lit("/"), F.lit(2)))).join(topics.select(F.lower("topic").alias("t")), "t", "left_anti")
    return finding(got, "ORPH003", "info", F.format_string("context snapshot %s is not referenced by any agent", "file"), F.col("file"), refs=F.array("id"))


def dangling_paths(edges: DataFrame, disk: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Owned paths without pattern signs that are not among disk (path)."""
    owned = edges.filter((F.col("type") == "owns") & F.col("to").startswith("path:")).select("from", F.substring("to", F.lit(6), F.length("to")).alias("path")).filter(~F.col("path").rlike("[*?]")).distinct()
    got = owned.join(disk.select("path"), "path", "left_anti")
    if agents is not None:
        got = got.join(agents.select(F.col("id").alias("from"), "file"), "from", "left")
    else:
        got = got.withColumn("file", F.lit(None).cast("string"))
    return finding(got, "COV001", "error", F.format_string('%s owns "%s" which does not exist on disk', "from", "path"), F.col("file"), refs=F.array("from", "path"))


def unowned_dirs(dirs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Directories (dir) below code/ that no scope (scope) names: by equality, or all of them by a star."""
    parts = F.split("scope", "/")
    seconds = scopes.filter((F.size(parts) >= 2) & (F.get(parts, F.lit(0)) == "code")).select(F.get(parts, F.lit(1)).alias("dir")).distinct()
    stars = seconds.filter(F.col("dir").isin("*", "**")).limit(1).select(F.lit(True).alias("all"))
    got = dirs.join(seconds, "dir", "left_anti").join(F.broadcast(stars), how="left_anti")
    return finding(got, "COV002", "warn", F.format_string("code/%s/ is not owned by any agent", "dir"), F.concat(F.lit("code/"), "dir"))


def overlapping_scopes(scopes: DataFrame) -> DataFrame:
    """Pairs of scopes (agent, scope) of two agents of which one holds the other.

    Every scope looks up its own parent directories, so the join is on equality and grows with the matches.
    """
    plain = scopes.filter(~F.col("scope").rlike("[*?]")).select("agent", "scope", F.regexp_replace("scope", "/+$", "").alias("path")).distinct()
    parts = F.split("path", "/")
    ups = plain.select(F.col("agent").alias("b"), F.col("scope").alias("inner"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path"))
    pairs = ups.join(plain.select(F.col("agent").alias("a"), F.col("scope").alias("outer"), "path"), "path").filter("a <> b")
    one, two = F.struct(F.col("a").alias("agent"), F.col("outer").alias("scope")), F.struct(F.col("b").alias("agent"), F.col("inner").alias("scope"))
    got = pairs.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    return finding(got, "COV003", "warn", F.format_string('%s and %s have overlapping scope paths "%s" and "%s"', "x.agent", "y.agent", "x.scope", "y.scope"), refs=F.array("x.agent", "y.agent", "x.scope", "y.scope"))


def blank_responsibilities(agents: DataFrame) -> DataFrame:
    got = agents.filter((F.size("scope") > 0) & (F.trim(F.coalesce("responsibilities", F.lit(""))) == ""))
    return finding(got, "COV004", "info", F.format_string("%s declares scope paths but has no responsibilities description", "id"), F.col("file"), refs=F.array("id"))


def unimplemented(concepts: DataFrame, concept_edges: DataFrame) -> DataFrame:
    got = concepts.join(concept_edges.filter(F.col("type") == "implements").select(F.col("from").alias("id")), "id", "left_anti")
    return finding(got, "COV005", "warn", F.format_string('concept "%s" (%s) has no implementing code package', "name", "id"), refs=F.array("id"))


def stale_graph(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One finding if two one-row frames (hash) differ."""
    got = stored.select(F.col("hash").alias("a")).join(fresh.select(F.col("hash").alias("b")), F.col("a") != F.col("b"))
    return finding(got, "STALE001", "error", F.lit("graph differs from the workspace"))


def stale_overlay(overlay: DataFrame, graph: DataFrame) -> DataFrame:
    """One finding if the overlay names another graph; an empty hash is fresh."""
    got = overlay.select(F.col("graph_hash").alias("a")).filter("a <> ''").join(graph.select(F.col("hash").alias("b")), F.col("a") != F.col("b"))
    return finding(got, "STALE002", "warn", F.lit("overlay was made for another graph"))


def unreviewed(concepts: DataFrame, concept_edges: DataFrame) -> DataFrame:
    both = concepts.select("reviewed").unionAll(concept_edges.select("reviewed"))
    got = both.agg(F.count_if(~F.coalesce("reviewed", F.lit(False))).alias("n")).filter("n > 0")
    return finding(got, "STALE003", "warn", F.format_string("%d overlay items are not reviewed", "n"))


def no_overlay(spark, exists: bool) -> DataFrame:
    return finding(spark.range(0 if exists else 1), "STALE004", "info", F.lit("no semantic overlay"))


_EXPORTED = r"^(?:[A-Z][A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*\.[A-Z][A-Za-z0-9]*)$"


def candidates(rows: DataFrame, identifier: str = _EXPORTED) -> DataFrame:
    """file, line, text, kind from lines (file, line, x): ticked paths and identifiers, and linked paths."""
    ticked = rows.select("file", "line", F.explode(F.regexp_extract_all("x", F.lit("`([^`]+)`"))).alias("t")).withColumn("t", F.trim("t"))
    ticked = ticked.withColumn("kind", F.when(F.col("t").startswith("code/"), "path").when(F.col("t").rlike(identifier), "identifier"))
    linked = rows.select("file", "line", F.explode(F.regexp_extract_all("x", F.lit(r"\]\(([^)]+)\)"))).alias("t")).withColumn("t", F.trim("t")).filter(F.col("t").startswith("code/")).withColumn("kind", F.lit("path"))
    return ticked.unionAll(linked).filter(F.col("kind").isNotNull()).select("file", "line", F.col("t").alias("text"), "kind")


def _first(rows: DataFrame, *key: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("file", "line")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def missing_paths(found: DataFrame, disk: DataFrame) -> DataFrame:
    got = _first(found.filter("kind = 'path'").join(disk.select(F.col("path").alias("text")), "text", "left_anti"), "text")
    return finding(got, "DRIFT001", "error", F.format_string('spec references code path "%s" which does not exist', "text"), F.col("file"), F.col("line"), F.array("text"))


def missing_identifiers(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols: (pkg, name).  With a dot the package's last part and the name must fit, else the name."""
    last = F.regexp_extract("pkg", "([^/]*)$", 1)
    known = symbols.select(F.col("name").alias("text")).unionAll(symbols.filter(last != "").select(F.concat(last, F.lit("."), "name").alias("text"))).distinct()
    got = _first(found.filter("kind = 'identifier'").join(known, "text", "left_anti"), "file", "text")
    return finding(got, "DRIFT002", "error", F.format_string('spec references identifier "%s" which is not present in the codebase', "text"), F.col("file"), F.col("line"), F.array("text"))


def unmentioned(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols: (pkg, name, file, line)."""
    said = found.filter("kind = 'identifier'").select(F.regexp_extract("text", r"([^.]*)$", 1).alias("name")).distinct()
    got = symbols.join(said, "name", "left_anti")
    return finding(got, "DRIFT003", "info", F.concat(F.lit("exported symbol "), F.regexp_extract("pkg", "([^/]*)$", 1), F.lit("."), "name", F.lit(" is never mentioned in specs or docs")), F.col("file"), F.col("line"), F.array(F.concat("pkg", F.lit("."), "name")))


def report(parts: list[DataFrame], least: str | None = None) -> DataFrame:
    """All findings in their order, down to a least severity."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    every = reduce(DataFrame.unionByName, parts)
    if least:
        every = every.filter(rank <= RANK[least])
    return every.orderBy(rank, "check", "code", F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "message")


def one_pass(nodes: DataFrame, edges: DataFrame, concepts: DataFrame | None = None, concept_edges: DataFrame | None = None, topics: DataFrame | None = None) -> DataFrame:
    """The findings of all checks of nodes and of the overlay, each table read once: nodes meet their inbound counts in one
    join, are grouped once by what a check speaks of (a file, or a node), and each group says what is wrong with it; concepts
    and their edges are grouped together by concept, with the total beside them (a rollup)."""
    kinds = {"spec_section": "file", "doc": "file", "decision": "id", "context_snapshot": "id"}
    told = nodes.filter(F.col("type").isin(*kinds)).join(inbound(edges), "id", "left")
    key = F.when(F.col("type").isin(*[k for k, by in kinds.items() if by == "file"]), F.col("file")).otherwise(F.col("id"))
    groups = told.groupBy("type", key.alias("key")).agg(
        F.max(F.coalesce("referring", F.lit(0))).alias("referring"), F.max(F.coalesce("any", F.lit(0))).alias("any"), F.array_sort(F.collect_set("id")).alias("ids"), F.min("file").alias("file"), F.min("name").alias("name"),
        F.count("*").alias("n"),
    )
    if topics is not None:
        declared = topics.select(F.lower("topic").alias("topic")).distinct().withColumn("declared", F.lit(True))
        topic = F.when(F.col("type") == "context_snapshot", F.lower(F.split_part(F.coalesce("file", F.lit("")), F.lit("/"), F.lit(2))))
        groups = groups.withColumn("topic", topic).join(declared, "topic", "left")
    else:
        groups = groups.withColumn("declared", F.lit(True))
    kind, no_ids = F.col("type"), F.array().cast("array<string>")

    def said(code: str, severity: str, message: Column, refs: Column) -> Column:
        return F.struct(F.lit("orphans").alias("check"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.col("file").alias("file"), F.lit(None).cast("long").alias("line"), refs.alias("refs"))

    wrong = (
        F.when((kind == "spec_section") & (F.col("referring") == 0), said("ORPH001", "error", F.format_string("spec file %s is not referenced by any agent or document", "file"), F.col("ids")))
        .when((kind == "decision") & (F.col("referring") == 0), said("ORPH001", "error", F.format_string("decision %s is not referenced by any agent or document", "name"), F.col("ids")))
        .when((kind == "doc") & (F.col("any") == 0), said("ORPH002", "warn", F.format_string("doc file %s has no inbound references", "file"), no_ids))
        .when((kind == "context_snapshot") & (F.col("any") == 0) & F.col("declared").isNull(), said("ORPH003", "info", F.format_string("context snapshot %s is not referenced by any agent", "file"), F.col("ids")))
    )
    # a node id that several nodes share gives a finding each, as the single checks do
    times = F.when(kind.isin("decision", "context_snapshot"), F.col("n")).otherwise(1).cast("int")
    out = groups.withColumn("wrong", wrong).filter(F.col("wrong").isNotNull()).select(F.explode(F.array_repeat("wrong", times)).alias("w")).select("w.*")
    if concepts is None or concept_edges is None:
        return out
    open_ = (~F.coalesce("reviewed", F.lit(False))).cast("long")
    both = concepts.select("id", "name", open_.alias("open"), F.lit(1).alias("concept"), F.lit(0).alias("implements")).unionAll(concept_edges.select(F.col("from").alias("id"), F.lit(None).cast("string").alias("name"), open_.alias("open"), F.lit(0).alias("concept"), (F.col("type") == "implements").cast("int").alias("implements")))
    items = both.rollup("id").agg(F.grouping("id").alias("total"), F.sum("open").alias("open"), F.sum("concept").alias("concept"), F.max("implements").alias("implements"), F.min("name").alias("name"))
    code = F.when(F.col("total") == 1, "STALE003").otherwise("COV005")
    bad = items.filter(((F.col("total") == 1) & (F.col("open") > 0)) | ((F.col("total") == 0) & (F.col("concept") > 0) & (F.col("implements") == 0)))
    message = F.when(F.col("total") == 1, F.format_string("%d overlay items are not reviewed", "open")).otherwise(F.format_string('concept "%s" (%s) has no implementing code package', "name", "id"))
    more = bad.select(F.when(F.col("total") == 1, "staleness").otherwise("coverage").alias("check"), code.alias("code"), F.lit("warn").alias("severity"), message.alias("message"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), F.when(F.col("total") == 1, no_ids).otherwise(F.array("id")).alias("refs"))
    return out.unionByName(more)


def run(findings: DataFrame, write, at: str = "error", checks: tuple[str, ...] = ()) -> dict:
    """Writes the findings of the checks by write(report) and says, of that one action, how many there are of each severity,
    and whether one is as bad as at: {"error": n, "warn": n, "info": n, "failed": bool}."""
    chosen = selected(findings, list(checks))
    seen = Observation()
    # above the sort, whose sampling reads what lies below it a second time
    write(report([chosen]).observe(seen, *[F.count_if(F.col("severity") == s).alias(s) for s in RANK]))
    counts = seen.get
    return {**counts, "failed": any(counts[s] for s, r in RANK.items() if r <= RANK[at])}


def severity_counts(findings: DataFrame) -> DataFrame:
    """severity, n with a row for each severity."""
    spark = findings.sparkSession
    three = spark.createDataFrame([(s,) for s in RANK], "severity string")
    return three.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def shown(findings: DataFrame, cap: int = 25) -> DataFrame:
    """At most cap findings of each severity, in order."""
    w = Window.partitionBy("severity").orderBy("check", "code", "file", "line", "message")
    return findings.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def failed(findings: DataFrame, at: str = "error") -> bool:
    """Whether a finding is as bad as that; the exit policy."""
    return bool(findings.filter(F.col("severity").isin([s for s, r in RANK.items() if r <= RANK[at]])).limit(1).count())


def required(present: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """path, severity of what a workspace (path) must (error) or should (warning) have and has not."""
    want = present.sparkSession.createDataFrame(wanted, "path string, severity string")
    return want.join(present.select("path"), "path", "left_anti")


# The sections that an agent's file must have.
AGENT_SECTIONS = ("## Role", "## Read-chain", "## Rules", "## Skills", "## Responsibilities", "## Out of scope", "## Context topics")


def missing_sections(agents: DataFrame) -> DataFrame:
    """agent, section that agents' files (agent, text) lack."""
    lacking = F.filter(F.array(*[F.lit(s) for s in AGENT_SECTIONS]), lambda s: ~F.coalesce("text", F.lit("")).contains(s))
    return agents.select("agent", F.explode(lacking).alias("section"))


CHECKS = ("orphans", "coverage", "staleness", "drift")


def selected(findings: DataFrame, checks: list[str]) -> DataFrame:
    """Findings of some checks; an unknown name is an error, none means all."""
    unknown = sorted(set(checks) - set(CHECKS))
    if unknown:
        raise ValueError(f"unknown checks: {', '.join(unknown)}")
    return findings.filter(F.col("check").isin(checks)) if checks else findings


def as_json(findings: DataFrame) -> DataFrame:
    """value: one JSON object for each finding, without what is null."""
    return findings.select(F.to_json(F.struct(*[F.col(c) for c in COLUMNS])).alias("value"))


def as_text(findings: DataFrame) -> DataFrame:
    """value: severity, code, place and message on a line."""
    place = F.concat(F.col("file"), F.when(F.coalesce("line", F.lit(0)) > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    return findings.select(F.concat_ws(" ", F.rpad("severity", 5, " "), "code", place, "message").alias("value"))


# Headings of the styled report, and what sets them off on a terminal.
HEADINGS = {"error": ("Errors", "1;31"), "warn": ("Warnings", "1;33"), "info": ("Info", "1;36")}


def as_styled(findings: DataFrame, least: str = "info", cap: int = 25, colours: bool = True) -> DataFrame:
    """line, value: for each severity down to least its heading, with how many of how many are shown, and at most cap
    findings below; the counts of all stand first.  Colours are terminal codes.

    A task ranks its own findings before they meet, so a severity with most of them is no more than cap a task.
    """
    def styled(c: Column, code: str) -> Column:
        return F.concat(F.lit(f"\x1b[{code}m"), c, F.lit("\x1b[0m")) if colours else c

    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    counts = severity_counts(findings).withColumn("rank", rank)
    first = counts.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "n", "severity"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["severity"])), ", ").alias("value"))
    told = F.lit("")
    for name, (text, code) in HEADINGS.items():
        told = F.when(F.col("severity") == name, styled(F.lit(text), code)).otherwise(told)
    more = F.when(F.col("n") > cap, F.format_string("  (showing %d of %d)", F.lit(cap), F.col("n"))).otherwise("")
    heads = counts.filter((F.col("n") > 0) & (F.col("rank") <= RANK[least])).select("rank", F.lit(0).alias("at"), F.concat(told, more).alias("value"))
    w = Window.partitionBy("severity").orderBy("check", "code", F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "message")
    kept = findings.filter(rank <= RANK[least]).withColumn("at", F.row_number().over(w)).filter(F.col("at") <= cap)
    place = F.concat(F.col("file"), F.when(F.coalesce("line", F.lit(0)) > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    rows = kept.select(rank.alias("rank"), "at", F.concat_ws(" ", F.lit("  "), styled(F.col("code"), "2"), F.nullif(place, F.lit("")), "message").alias("value"))
    every = first.select(F.lit(-1).alias("rank"), F.lit(0).alias("at"), "value").unionAll(heads).unionAll(rows)
    return every.withColumn("line", F.row_number().over(Window.orderBy("rank", "at"))).select("line", "value").orderBy("line")
