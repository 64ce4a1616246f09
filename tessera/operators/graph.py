"""The typed graph: sections and references of texts, nodes and edges, neighbours, subgraphs, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LINK, _TICKED = r"\[[^\]]*\]\(([^)]+)\)", r"`([^`]*(?:/|\.[a-zA-Z]{1,6})[^`]*)`"


def lines(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, line (from 1), x: the lines of each text."""
    return texts.select(key, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("at", "x")).select(key, (F.col("at") + 1).alias("line"), "x")


def sections(texts: DataFrame, key: str, text_col: str = "text", mark: str = "## ") -> DataFrame:
    """key, nth, heading, content: what stands below each second-level heading, rule lines left out; text before the first is not in any.

    Works within each row's array of lines, so no text is taken apart over a shuffle.
    """
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text_col, F.lit(""))), "\n" + mark)
    each = texts.select(key, F.posexplode(parts).alias("nth", "part")).filter("nth > 0")
    own = F.split("part", "\n")
    body = F.array_join(F.filter(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), lambda x: F.trim(x) != "---"), "\n")
    return each.select(key, "nth", F.trim(F.element_at(own, 1)).alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content"))


def list_items(c: Column) -> Column:
    """Items of numbered and bulleted lists, without ticks and what follows a dash."""
    found = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*(?:[-*]|[0-9]+\.)\s+"))
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"^\s*(?:[-*]|[0-9]+\.)\s+", ""))
    return F.filter(F.transform(bare, lambda x: F.trim(F.translate(F.regexp_replace(x, " — .*$", ""), "`", ""))), lambda x: x != "")


def ticked_paths(c: Column) -> Column:
    """Distinct paths between ticks, by first occurrence."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(_TICKED)))


def references(c: Column) -> Column:
    """Distinct link targets, then ticked paths; web addresses are left out."""
    found = F.transform(F.concat(F.regexp_extract_all(c, F.lit(_LINK)), F.regexp_extract_all(c, F.lit(_TICKED))), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.rlike("^https?://")))


def clean_reference(c: Column) -> Column:
    """Without ticks, what follows a dash, and backslashes."""
    return F.replace(F.trim(F.regexp_replace(F.regexp_replace(c, "^`+|`+$", ""), " — .*$", "")), F.lit("\\"), F.lit("/"))


def section_body(c: Column, heading: Column) -> Column:
    """What stands below the first heading of that name, up to the next heading; the whole text where there is none."""
    rows = F.split(c, "\n")
    at = F.array_position(F.transform(rows, lambda x: F.when(x.startswith("## "), F.trim(F.substring(x, F.lit(4), F.length(x)))).otherwise(F.lit(None).cast("string"))), heading)
    rest = F.slice(rows, (F.greatest(at, F.lit(1)) + 1).cast("int"), F.size(rows))
    end = F.array_position(F.transform(rest, lambda x: x.startswith("## ")), True)
    own = F.when(end > 0, F.slice(rest, F.lit(1), (end - 1).cast("int"))).otherwise(rest)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.array_join(own, "\n")).otherwise(c)


def first_node(nodes: DataFrame) -> DataFrame:
    """file, id: the smallest node id of each file."""
    return nodes.filter(F.coalesce("file", F.lit("")) != "").groupBy("file").agg(F.min("id").alias("id"))


def read_edges(agents: DataFrame, nodes: DataFrame) -> DataFrame:
    """From agents (id, read_chain) to the nodes of the files they read."""
    asked = agents.select(F.col("id").alias("from"), F.explode("read_chain").alias("ref")).withColumn("file", clean_reference(F.col("ref")))
    return asked.join(first_node(nodes).withColumnRenamed("id", "to"), "file").select("from", "to", F.lit("reads").alias("type")).distinct()


def owner_edges(agents: DataFrame, nodes: DataFrame) -> DataFrame:
    """From agents (id, scope) to nodes, or to path:<scope> where no node has that file."""
    asked = agents.select(F.col("id").alias("from"), F.explode("scope").alias("ref")).withColumn("file", clean_reference(F.col("ref")))
    found = asked.join(first_node(nodes).withColumnRenamed("id", "to"), "file", "left")
    return found.select("from", F.coalesce("to", F.concat(F.lit("path:"), "ref")).alias("to"), F.lit("owns").alias("type")).distinct()


def reference_edges(texts: DataFrame, nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """From texts (id, text) to the nodes of the files they name; docs support specs, else it is a reference; no self edges."""
    asked = texts.select(F.col("id").alias("from"), F.explode(references(F.coalesce(text_col, F.lit("")))).alias("ref")).withColumn("file", clean_reference(F.col("ref")))
    found = asked.join(first_node(nodes).withColumnRenamed("id", "to"), "file").filter(F.col("from") != F.col("to"))
    spec, doc = F.col("to").rlike("^(spec_section|decision):"), F.col("from").startswith("doc:")
    return found.select("from", "to", F.when(spec & doc, "supports").otherwise("references").alias("type")).distinct()


def packages(files: DataFrame) -> DataFrame:
    """One row for each package of (package, file, doc): its first file and its first comment by file."""
    return files.groupBy("package").agg(F.min("file").alias("file"), F.min_by("doc", F.when(F.coalesce("doc", F.lit("")) != "", F.col("file"))).alias("doc"))


def ordered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.orderBy("id"), edges.orderBy("from", "to", "type")


def content_hash(rows: DataFrame) -> DataFrame:
    """hash: equal for equal sets of rows, whatever their order; every row is hashed where it is, only sums meet."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    parts = [F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(p, F.lit("0")) for p in parts]).cast("binary"), 256).alias("hash"))


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id).limit(1)


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str, kind: str | None = None) -> DataFrame:
    """direction, type, and the node at the other end; a loop is outbound only, ends that are no node are left out."""
    own = edges if kind is None else edges.filter(F.col("type") == kind)
    out = own.filter(F.col("from") == node_id).select(F.lit("outbound").alias("direction"), F.col("type").alias("edge"), F.col("to").alias("id"))
    back = own.filter((F.col("to") == node_id) & (F.col("from") != node_id)).select(F.lit("inbound").alias("direction"), F.col("type").alias("edge"), F.col("from").alias("id"))
    return out.unionAll(back).join(nodes, "id")


def induced(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes among wanted (id), and the edges with both ends there."""
    ids = wanted.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    return nodes.join(ids, "id", "left_semi"), kept


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (node, edge), type, n."""
    a = nodes.groupBy("type").count().select(F.lit("node").alias("what"), "type", F.col("count").alias("n"))
    return a.unionAll(edges.groupBy("type").count().select(F.lit("edge").alias("what"), "type", F.col("count").alias("n")))


def nearest_manifest(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """file, module, package: of manifests (dir, module), the one whose directory is the longest prefix of the file's.

    Each file tries its own directories, so the join is on equality.
    """
    parts = F.split("file", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = files.select("file", F.explode(ups).alias("dir"))
    best = tried.join(manifests, "dir").groupBy("file").agg(F.max_by(F.struct("dir", "module"), F.length("dir")).alias("m"))
    rest = F.regexp_replace(F.substring("file", F.length("m.dir") + 1, F.length("file")), "^/|/?[^/]*$", "")
    return best.select("file", F.col("m.module").alias("module"), F.concat_ws("/", "m.module", F.when(rest != "", rest)).alias("package"))


def prompt_packages(symbols: DataFrame) -> DataFrame:
    """package, symbols: sorted names of (package, name)."""
    return symbols.groupBy("package").agg(F.array_sort(F.collect_set("name")).alias("symbols"))


def carried_heading(rows: DataFrame, key: str) -> DataFrame:
    """lines() with the heading above each line."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last(F.when(F.col("x").startswith("## "), F.substring("x", F.lit(4), F.length("x"))), ignorenulls=True).over(w))
