"""Compaction of command output and of files: repeats, elision, windows, fences, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import cut_to, let, numbered, token_estimate

LINES, ULTRA_LINES, LONGEST = 120, 60, 500
# Fences whose content is always shown.
KNOWN_FENCES = ("go", "json", "md", "markdown", "bash", "sh", "shell", "zsh", "python", "js", "ts", "tsx", "yaml", "yml", "toml")


def repeats(lines: DataFrame, key: str) -> DataFrame:
    """key, first, n, x: runs of equal neighbouring lines of (key, line, x), by gaps and islands."""
    w = Window.partitionBy(key).orderBy("line")
    starts = lines.withColumn("new", F.coalesce(F.col("x") != F.lag("x").over(w), F.lit(True)).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(w))
    return runs.groupBy(key, "run").agg(F.min("line").alias("first"), F.count("*").alias("n"), F.first("x").alias("x")).drop("run")


def collapsed(lines: Column) -> Column:
    """Lines with runs of equal ones as one line that says how often."""
    return let(lines, _collapsed)


def _collapsed(lines: Column) -> Column:
    # neighbours are compared by position, so that the array is not built up again for every line
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | (F.get(lines, i - 1) != F.get(lines, i - 2))))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.when(b - a > 1, F.concat(F.lit("[repeated "), (b - a).cast("string"), F.lit(" times] "), F.get(lines, a - 1))).otherwise(F.get(lines, a - 1)))
    return F.when(n > 0, runs).otherwise(lines)


def elided(lines: Column, most: int) -> Column:
    """At most that many lines: the first half, a mark, and the end."""
    return let(lines, lambda own: _elided(own, most))


def _elided(lines: Column, most: int) -> Column:
    first = most // 2
    last = most - first - 1
    mark = F.concat(F.lit("...("), (F.size(lines) - first - last).cast("string"), F.lit(" lines omitted)..."))
    return F.when(F.size(lines) <= most, lines).otherwise(F.concat(F.slice(lines, 1, first), F.array(mark), F.slice(lines, -last, last)))


def generic(c: Column, ultra: bool = False) -> Column:
    """Output without colours, margins and blank lines, long lines cut, repeats collapsed, the middle left out.

    A line is cut at 500 bytes in whole characters.
    """
    bare = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "\x1b\\[[0-9;]*m", ""), r"^\s+|\s+$", ""))
    short = F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.when(F.octet_length(x) > LONGEST, F.concat(_bytes(x, LONGEST), F.lit("...(truncated)"))).otherwise(x))
    return F.array_join(elided(collapsed(short), ULTRA_LINES if ultra else LINES), "\n")


def _bytes(c: Column, n: int) -> Column:
    """The whole characters within the first n bytes: a torn last one is dropped."""
    torn = F.substring(F.encode(c, "utf-8"), 1, n)
    ends = F.array(*[F.substring(torn, 1, n - k) for k in range(4)])
    return F.get(F.filter(F.transform(ends, lambda b: F.try_validate_utf8(b.cast("string"))), lambda x: x.isNotNull()), F.lit(0))


def window(lines: Column, first: int | None = None, last: int | None = None) -> Column:
    """The first or the last lines; not both."""
    if first is not None and last is not None:
        raise ValueError("first and last exclude each other")
    if first is not None:
        return F.slice(lines, 1, max(0, first)) if first > 0 else F.array().cast("array<string>")
    if last is not None:
        return F.slice(lines, F.greatest(F.size(lines) - last + 1, F.lit(1)), F.lit(last)) if last > 0 else F.array().cast("array<string>")
    return lines


def blame_ranges(lines: DataFrame, key: str) -> DataFrame:
    """key, hash, first, last of neighbouring lines of one commit; lines: (key, line, hash)."""
    w = Window.partitionBy(key).orderBy("line")
    runs = lines.withColumn("run", F.sum(F.coalesce(F.col("hash") != F.lag("hash").over(w), F.lit(True)).cast("int")).over(w))
    return runs.groupBy(key, "run", "hash").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("run")


def single_blanks(lines: Column) -> Column:
    """Lines without a blank one after a blank one."""
    blank = lambda x: F.trim(x) == ""
    return let(lines, lambda own: F.filter(own, lambda x, i: ~(blank(x) & (i > 0) & blank(F.coalesce(F.get(own, i - 1), F.lit("-"))))))


def fences(lines: DataFrame, key: str, most: int = 12) -> DataFrame:
    """Lines (key, line, x) of markdown, with the inside of long fences of unknown languages left out and counted.

    key, line, x, omitted: an elided block keeps its fence lines; omitted is the number of lines left out after a line.
    """
    mark = F.trim("x").startswith("```")
    w = Window.partitionBy(key).orderBy("line")
    at = lines.withColumn("mark", mark).withColumn("n", F.sum(mark.cast("int")).over(w))
    # an odd count is inside a fence; its block is numbered by the opening mark
    block = at.withColumn("block", F.when(F.col("mark") & (F.col("n") % 2 == 0), F.col("n") - 1).otherwise(F.when(F.col("n") % 2 == 1, F.col("n"))))
    own = Window.partitionBy(key, "block")
    known = F.max(F.when(F.col("mark") & (F.col("n") % 2 == 1), F.lower(F.trim(F.regexp_replace(F.trim("x"), "^```", ""))).isin(*KNOWN_FENCES))).over(own)
    closed = F.max(F.col("mark") & (F.col("n") % 2 == 0)).over(own)
    inside = F.sum((~F.col("mark")).cast("int")).over(own)
    long_ = F.col("block").isNotNull() & closed & ~known & (inside > most)
    out = block.withColumns({"cut": F.coalesce(long_, F.lit(False)), "inside": inside})
    kept = out.filter(~F.col("cut") | F.col("mark"))
    return kept.select(key, "line", "x", F.when(F.col("cut") & (F.col("n") % 2 == 1), F.col("inside")).otherwise(0).alias("omitted"))


def read(files: DataFrame, filtered: Column, text_col: str = "text", first: int | None = None, last: int | None = None, numbers: bool = False) -> DataFrame:
    """files with content: the filtered text, or the text itself where the filter left nothing or saved nothing; then a window and line numbers."""
    raw = F.col(text_col)
    empty = (F.trim(raw) != "") & (F.trim("_f") == "")
    chosen = F.when(empty | (token_estimate(F.col("_f")) > token_estimate(raw)), raw).otherwise(F.col("_f"))
    own = files.withColumn("_f", filtered).withColumn("_f", chosen)
    lines = let(F.split("_f", "\n"), lambda a: window(a, first, last))
    shown = F.array_join(numbered(lines) if numbers else lines, "\n")
    out = own.withColumn("content", shown).drop("_f")
    return out.withColumns({"tokens_before": token_estimate(raw), "tokens_after": token_estimate(F.col("content"))})


def reader_for(path: Column) -> Column:
    """The reader of a file by its extension."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(ext == ".go", "go").when(ext == ".json", "json").when(ext.isin(".md", ".markdown"), "markdown").otherwise("generic")


def json_kind(c: Column) -> Column:
    """The type of a JSON value as text; null where it is none."""
    kind = F.schema_of_variant(F.try_parse_json(c))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def json_summary(c: Column, keys: int = 20) -> Column:
    """Kind, number of keys or items, and the first keys of a JSON text."""
    own = F.array_sort(F.json_object_keys(c))
    return F.struct(json_kind(c).alias("kind"), F.coalesce(F.size(own), F.json_array_length(c)).alias("n"), F.array_join(F.slice(own, 1, keys), ",").alias("keys"))


def short(c: Column, n: int) -> Column:
    return cut_to(c, n)
