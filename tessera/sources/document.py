"""The graph as one JSON document: hashed, the same bytes from the same rows, written and read by many tasks.

Nodes come by id, edges by (from, to, type), each element on a line of its own with its fields by name and without nulls.
Lines get their places from ranges of the total order; CHUNK lines in a row make a leaf of a hash tree, CHUNK digests in a
row the next level, so that the hash depends on every byte and on the order and no task holds more than a chunk.  Files
are cut by place, not by how the rows were dealt out; one after another they are the document.

The reader splits even a document of one line: records end at closing braces, wherever a split begins.  Whether a record
begins inside a string, how deep it lies and which element it belongs to are running sums, first within splits and then
over the splits, of which the driver gets three numbers each.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.store import settled, shared_folder

CHUNK, FILE_LINES = 1024, 1_000_000


#: Lists of a document: name -> (rows, the columns that order them).
Lists = dict[str, tuple[DataFrame, list[str]]]


def elements(lists: Lists) -> DataFrame:
    """list, key, line of all rows."""
    out = None
    for name, (rows, key) in lists.items():
        fields = F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
        own = rows.select(F.lit(name).alias("list"), F.array(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key]).alias("key"), F.to_json(fields).alias("line"))
        out = own if out is None else out.unionAll(own)
    return out


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows as files of columns, compressed, in the folder that all executors share; checkpoints hold rows as they are."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def graph_lists(nodes: DataFrame, edges: DataFrame) -> Lists:
    return {"nodes": (nodes, ["id"]), "edges": (edges, ["from", "to", "type"])}


def placed(rows: DataFrame) -> DataFrame:
    """list, line, place of elements(): places from 0 within each list.  The driver gets a number for each range and list."""
    spark = rows.sparkSession
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange("list", "key", "line").sortWithinPartitions("list", "key", "line").select("list", "line", F.spark_partition_id().alias("part"), at.alias("at"))
    ranged = stored(ranged, "placed")
    # numbers of a part follow each other
    counts = sorted((r.list, r.part, r.n, r.first) for r in ranged.groupBy("list", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect())
    before, offsets = {}, []
    for name, part, n, first in counts:
        offsets.append((name, part, before.get(name, 0) - first))
        before[name] = before.get(name, 0) + n
    known = spark.createDataFrame(offsets, "list string, part int, offset long")
    return ranged.join(F.broadcast(known), ["list", "part"]).select("list", "line", (F.col("offset") + F.col("at")).alias("place"))


def hash_tree(lines: DataFrame) -> DataFrame:
    """level, list, chunk, n, digest over placed lines: chunks of lines at level 0, of digests above, up to one a list."""
    level, rows, levels = 0, lines.select("list", "place", F.col("line").alias("said")), []
    while True:
        chunk = F.floor(F.col("place") / CHUNK)
        said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), "\n")
        leaves = settled(rows.groupBy("list", chunk.alias("chunk")).agg(F.count("*").alias("n"), F.sha2(said.cast("binary"), 256).alias("digest")))
        levels.append(leaves.select(F.lit(level).alias("level"), "list", "chunk", "n", "digest"))
        if (leaves.agg(F.max("chunk").alias("c")).first().c or 0) == 0:
            break
        level, rows = level + 1, leaves.select("list", F.col("chunk").alias("place"), F.col("digest").alias("said"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionAll(more)
    return out


def root(tree: DataFrame, names: list[str]) -> str:
    """The document's hash: over the last digests of its lists."""
    rows = tree.filter("chunk = 0").groupBy("list").agg(F.max_by("digest", "level").alias("digest")).collect()
    told = {r["list"]: r.digest for r in rows}
    return hashlib.sha256("\n".join(f"{name}:{told.get(name, '')}" for name in names).encode()).hexdigest()


def write_lists(lists: Lists, path: str, fields: dict[str, str], hash_field: str | None = None, file_lines: int = FILE_LINES) -> str:
    """Writes one JSON object of text fields and lists below path, in folders whose names sort as their text follows; returns
    the hash of the lists, which also becomes a field, if it has a name."""
    names = list(lists)
    spark = lists[names[0]][0].sparkSession
    lines = placed(elements(lists))
    found = root(hash_tree(lines), names)
    sizes = {r["list"]: r.n for r in lines.groupBy("list").agg(F.count("*").alias("n")).collect()}
    told = {**fields, **({hash_field: found} if hash_field else {})}
    file, part, frame = 0, F.lit(0), []
    first = F.lit(0)
    for i, name in enumerate(names):
        opening = "{" + "".join(f"{json.dumps(k)}:{json.dumps(v)}," for k, v in told.items()) if i == 0 else "],"
        frame.append((file, 2 * i, 0, f"{opening}{json.dumps(name)}:["))
        first, part = F.when(F.col("list") == name, file).otherwise(first), F.when(F.col("list") == name, 2 * i + 1).otherwise(part)
        last = file + max(0, sizes.get(name, 0) - 1) // file_lines
        file = last + 1
    frame.append((last, 2 * len(names), 0, "]}"))
    body = lines.select((first + F.floor(F.col("place") / file_lines)).cast("int").alias("file"), part.alias("part"), "place", F.concat(F.when(F.col("place") == 0, "").otherwise(","), F.col("line")).alias("value"))
    whole = body.unionByName(spark.createDataFrame(frame, "file int, part int, place long, value string")).withColumn("file", F.lpad(F.col("file").cast("string"), 9, "0"))
    whole.repartition("file").sortWithinPartitions("file", "part", "place").select("file", "value").write.partitionBy("file").mode("overwrite").text(path)
    return found


def write_document(nodes: DataFrame, edges: DataFrame, path: str, schema_version: str = "1", file_lines: int = FILE_LINES) -> str:
    """Writes the graph; returns its hash."""
    return write_lists(graph_lists(nodes, edges), path, {"schema_version": schema_version}, "content_hash", file_lines)


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def _summed(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the sum of a column over all records before each, in the order of the text."""
    split, order = ["file", "start"], Window.partitionBy("file", "start").orderBy("id")
    sums = sorted((r.file, r.start, r.s) for r in rows.groupBy(*split).agg(F.sum(column).alias("s")).collect())
    offsets, total = [], 0
    for file, start, s in sums:
        offsets.append((file, start, total))
        total += s
    known = rows.sparkSession.createDataFrame(offsets, "file string, start long, _offset long")
    own = F.sum(column).over(order) - F.col(column)
    return rows.withColumn("_own", own).join(F.broadcast(known), split).withColumn(out, F.col("_offset") + F.col("_own")).drop("_own", "_offset")


def read_document(spark: SparkSession, path: str, lists: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The elements (objects) of the named lists of one JSON object, by list with their schemas, and meta: the object's text
    fields (name, value).  path: a file, or the folder of a written document.

    Lists hold objects and lie in the outermost object; text fields beside them hold no braces.
    """
    found = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
    records = found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"))
    # a file's last record has no brace behind it where the file goes on after its last brace
    rest = records.groupBy("file").agg((F.sum(F.octet_length("value") + 1) > F.first("size")).alias("open"), F.max(F.struct("start", "id")).alias("last"))
    open_ = F.broadcast(rest.filter("open").select("file", "last.start", "last.id", F.lit(True).alias("open")))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    records = records.join(open_, ["file", "start", "id"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    quoted = _summed(records.withColumn("quotes", _count(bare, '"')), "quotes", "before").withColumn("bare", bare)
    inside = F.col("before") % 2 == 1
    outside = F.regexp_replace(F.regexp_replace(F.when(inside, F.regexp_replace("bare", r'(?s)^[^"]*("|$)', "")).otherwise(F.col("bare")), r'(?s)"[^"]*"', ""), r'(?s)"[^"]*$', "")
    closes = ((F.col("before") + F.col("quotes")) % 2 == 0) & ~F.col("open")
    shaped = stored(quoted.withColumns({"opens": _count(outside, "{"), "closes": closes.cast("int")}).withColumn("step", F.col("opens") - F.col("closes")).drop("bare", "quotes", "before", "size"), "shaped")
    deep = _summed(shaped, "step", "depth").withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") + F.col("step") == 1)).cast("int"))
    numbered = stored(_summed(deep, "ends", "number"), "numbered")
    # what lies before the brace that opens an element: the rest of a list, or the name of the next
    begins = F.col("depth") <= 1
    lead = F.when(F.col("depth") == 0, F.regexp_extract("value", r"(?s)^(\s*\{[^{]*)", 1)).when(F.col("depth") == 1, F.regexp_extract("value", r"(?s)^([^{]*)", 1))
    names = "|".join(lists)
    marks = numbered.filter(begins).select("number", F.regexp_extract(lead, rf'(?s).*"({names})"\s*:\s*\[\s*$', 1).alias("name")).filter("name <> ''")
    listed = F.lit(None).cast("string")
    for r in sorted(marks.collect(), key=lambda r: r.number):
        listed = F.when(F.col("number") >= r.number, F.lit(r["name"])).otherwise(listed)
    meta = numbered.filter(begins).select(F.explode(F.regexp_extract_all(lead, F.lit(r'"[^"]*"\s*:\s*"[^"]*"'), F.lit(0))).alias("x")).select(F.regexp_extract("x", '^"([^"]*)"', 1).alias("name"), F.regexp_extract("x", r':\s*"([^"]*)"$', 1).alias("value"))
    said = F.when(begins, F.substring("value", F.length(lead) + 1, F.length("value"))).otherwise(F.col("value"))
    said = F.concat(said, F.when(F.col("open"), "").otherwise("}"))
    parts = numbered.select("number", F.struct("file", "start", "id", said.alias("said")).alias("part"), "ends")
    whole = parts.groupBy("number").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.max("ends").alias("ends")).filter("ends = 1")
    texts = whole.select("number", F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("text")).withColumn("list", listed)
    return {name: texts.filter(F.col("list") == name).select(F.from_json("text", schema).alias("x")).select("x.*") for name, schema in lists.items()}, meta
