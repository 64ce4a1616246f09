"""Note classification by weighted signals, and where a classified note goes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let, slugify

TYPES = ("adr", "spec", "guide", "arch", "open-item")
WEIGHTS = {"strong": 3, "structure": 2, "supporting": 1, "anti": -2}
# The signals of each type; /.../ is a pattern at the start of the text, all else is looked for as it is.
SIGNALS = {
    "adr": {
        "strong": ["we decided", "we chose", "decision:", "rejected", "status: accepted", "status: proposed", "status: deprecated", "alternatives considered", "## decision", "# adr", "adr-"],
        "structure": ["## context", "## consequences", "## alternatives", "## status", "pros and cons", "tradeoff", "trade-off"],
        "supporting": ["rationale", "because", "instead of", "over ", "we rejected", "we considered"],
        "anti": ["## prerequisites", "step 1", "$ ", "```sh", "```bash"],
    },
    "spec": {
        "strong": [" must ", " must not ", " shall ", " shall not ", " should ", " should not ", " may ", "convention:", "required:", "normative", "## requirements", "## convention", "## rules"],
        "structure": ["## constraints", "## definitions", "## overview", "/^[0-9]+\\. .+(must|shall|should)/"],
        "supporting": ["compliance", "compliant", "enforce", "workspace must", "all agents"],
        "anti": ["step 1", "how to", "$ ", "```sh", "```bash", "## prerequisites"],
    },
    "guide": {
        "strong": ["how to", "step 1", "step 2", "## steps", "## prerequisites", "getting started", "walkthrough"],
        "structure": ["```sh", "```bash", "$ ", "## example", "## usage", "/^[0-9]+\\. (run|create|open|add|edit|install|configure|clone|copy|move|delete)/"],
        "supporting": ["run the following", "e.g.", "for example", "before you begin", "then run"],
        "anti": [" must ", " shall ", "we decided", "## decision"],
    },
    "arch": {
        "strong": ["architecture", "## architecture", "## design", "data flow", "system design", "component", "how .+ works"],
        "structure": ["```mermaid", "graph td", "sequencediagram", "+---", "## layers", "## components", "## overview", "## data flow", "## integration"],
        "supporting": ["layer", "interface", "pipeline", "subsystem", "module", "dependency"],
        "anti": ["step 1", "## steps", "how to", "we decided", "TODO", "open question"],
    },
    "open-item": {
        "strong": ["todo", "fixme", "open question", "tbd", "to be determined", "known issue", "not yet decided", "needs resolution", "to be investigated"],
        "structure": ["- [ ]", "## open", "## questions", "## issues", "## todos"],
        "supporting": ["?", "unclear", "unsure", "to be", "pending"],
        "anti": ["we decided", "## decision", " must ", "architecture", "step 1"],
    },
}
UNKNOWN = "unknown"


def score(text: Column, kind: str, signals: dict | None = None) -> Column:
    """Sum of the weights of a type's signals in a text, each once; the text is lower-cased first."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: _score(low, kind, signals))


def _hit(low: Column, pattern: str) -> Column:
    return low.rlike(pattern[1:-1]) if len(pattern) > 1 and pattern[0] == pattern[-1] == "/" else low.contains(pattern)


def _score(low: Column, kind: str, signals: dict | None) -> Column:
    total = F.lit(0)
    for strength, patterns in (signals or SIGNALS)[kind].items():
        for p in patterns:
            total = total + F.when(_hit(low, p), WEIGHTS[strength]).otherwise(0)
    return total


def scores(text: Column, signals: dict | None = None) -> Column:
    """An array of (type, score) in the order of TYPES; a signal of several types is looked for once."""
    said = signals or SIGNALS
    every = list(dict.fromkeys(p for t in TYPES for patterns in said[t].values() for p in patterns))

    def score_of(hits: Column, kind: str) -> Column:
        weights = [0] * len(every)
        for strength, patterns in said[kind].items():
            for p in patterns:
                weights[every.index(p)] += WEIGHTS[strength]
        used = [(i, w) for i, w in enumerate(weights) if w]
        return functools.reduce(lambda a, b: a + b, [F.when(F.get(hits, F.lit(i)), w).otherwise(0) for i, w in used], F.lit(0))

    def scored(hits: Column) -> Column:
        return F.array(*[F.struct(F.lit(t).alias("type"), score_of(hits, t).alias("score")) for t in TYPES])

    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: let(F.array(*[_hit(low, p) for p in every]), scored))


def decided(notes: DataFrame, text_col: str = "text", signals: dict | None = None) -> DataFrame:
    """notes with best, second, type and confidence; equal scores go to the type that TYPES names first."""
    # scores are rows of a generator, so that conditions on what follows from them do not compute them again
    own = notes.select("*", F.explode(F.array(scores(F.col(text_col), signals))).alias("_s"))
    ranked = F.array_sort(F.transform("_s", lambda x, i: F.struct((-x["score"]).alias("minus"), i.alias("at"), x["type"].alias("type"))))
    out = own.withColumn("_r", ranked).withColumns({"best": -F.get("_r", F.lit(0))["minus"], "second": -F.get("_r", F.lit(1))["minus"]})
    low, close = F.col("best") < 4, F.col("best") - F.col("second") < 2
    out = out.withColumn("type", F.when(low, UNKNOWN).otherwise(F.get("_r", F.lit(0))["type"]))
    return out.withColumn("confidence", F.when(low, "low").when(close, "medium").when(F.col("best") >= 6, "high").otherwise("medium")).drop("_s", "_r")


def auto_accepted(c: str = "confidence", kind: str = "type") -> Column:
    return (F.col(c) == "high") & (F.col(kind) != UNKNOWN)


def about(notes: DataFrame, topic: str, text_col: str = "text") -> DataFrame:
    """Notes that speak of a topic; case is ignored."""
    return notes.filter(F.lower(text_col).contains(topic.lower()))


def first_known(*parts: Column) -> Column:
    """The first classification there is: front matter, cache, model, signals."""
    return F.coalesce(*parts)


def front_matter(text: Column, name: str) -> Column:
    """A key of the block of key: value lines between --- lines that opens a text."""
    block = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))


def normal_type(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*TYPES), low).otherwise(UNKNOWN)


def normal_confidence(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("low")


def next_number(files: DataFrame) -> int:
    """One more than the largest four-digit number that opens a file name of files (name); 1 for none."""
    found = files.filter(F.col("name").rlike("^[0-9]{4}-")).agg(F.max(F.substring("name", 1, 4).cast("int")).alias("m")).first()
    return (found["m"] or 0) + 1


def target_path(kind: Column, title: Column, number: Column) -> Column:
    """Where a note of a type goes; null for other types."""
    name = F.concat(slugify(title), F.lit(".md"))
    return (
        F.when(kind == "adr", F.concat(F.lit("specs/decisions/"), F.lpad(number.cast("string"), 4, "0"), F.lit("-"), name))
        .when(kind == "spec", F.concat(F.lit("specs/"), name))
        .when(kind == "guide", F.concat(F.lit("docs/guides/"), name))
        .when(kind == "arch", F.concat(F.lit("docs/"), name))
        .when(kind == "open-item", F.lit("docs/open-items.md"))
    )


def collisions(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """Targets (path) that exist already; open items are appended and never collide."""
    return targets.filter(F.col("path") != "docs/open-items.md").join(existing.select("path"), "path", "left_semi")


def rewritten(before: Column, after: Column) -> Column:
    """All old lines with -, then all new ones with +."""
    return F.array_join(F.concat(F.transform(F.split(before, "\n"), lambda x: F.concat(F.lit("-"), x)), F.transform(F.split(after, "\n"), lambda x: F.concat(F.lit("+"), x))), "\n")


def proposed_content(kind: Column, title: Column, content: Column, number: Column, today: Column) -> Column:
    """What a note of a type becomes: a decision with its head, an open item with its heading, else as it is."""
    head = F.concat(F.lit("---\nstatus: accepted\ndate: "), F.date_format(today, "yyyy-MM-dd"), F.lit("\n---\n\n# ADR-"), F.lpad(number.cast("string"), 4, "0"), F.lit(": "), title, F.lit("\n\n"))
    item = F.concat(F.lit("## "), title, F.lit("\n\n"), content, F.when(content.endswith("\n"), "").otherwise("\n"))
    return F.when(kind == "adr", F.concat(head, content)).when(kind == "open-item", item).otherwise(content)


def with_open_items(existing: Column, items: Column) -> Column:
    """The open-items file with items (array, in order) at its end; it begins with a heading if it was empty."""
    ended = F.concat(existing, F.when(existing.endswith("\n"), "\n").otherwise("\n\n"))
    start = F.when(F.coalesce(existing, F.lit("")) == "", F.lit("# Open Items\n\n")).otherwise(ended)
    return F.concat(start, F.array_join(items, "\n"))


def type_counts(notes: DataFrame) -> DataFrame:
    """type, n: how many notes of each type wait for review."""
    return notes.groupBy("type").agg(F.count("*").alias("n"))
