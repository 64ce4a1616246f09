"""Command rewriting as columns: commands are cut at && || ; and |, each part is wrapped or becomes a read with a window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.rewrite import WRAPPER
from tessera.functions.text import let

_WHITE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_PART = r"(?s)(?:(?!&&|\|\||;|\|).)+|&&|\|\||;|\|"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WHITE}+|{_WHITE}+$", "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, f"{_WHITE}+"), lambda w: w != "")


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, "^[\"']+|[\"']+$", "")


def is_wrapped(words: Column) -> Column:
    """Whether a command, by its words, runs or reads through the tool already."""
    low = [F.lower(F.coalesce(F.get(words, F.lit(i)), F.lit(""))) for i in range(4)]
    first, second = WRAPPER.split()
    return (low[0] == first) & (low[1] == second) & ((low[2] == "read") | ((low[2] == "run") & (low[3] == "--")))


def as_read(body: Column, words: Column) -> Column:
    """The windowed read that a cat, head or tail of files stands for; null for anything else."""
    tool, rest = F.lower(_bare(F.get(words, F.lit(0)))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    plain = (F.size(rest) > 0) & F.forall(rest, lambda w: (w == "-") | ~w.startswith("-"))
    whole = F.concat(F.lit(f"{WRAPPER} read --line-numbers "), F.array_join(rest, " "))
    # a fold over the words: how many lines, which files, whether a number must come, and whether it can be read so far
    state = F.struct(F.lit("10").alias("lines"), F.array().cast("array<string>").alias("files"), F.lit(False).alias("asked"), F.lit(True).alias("ok"))

    def step(acc: Column, w: Column) -> Column:
        option = w.isin("-n", "--lines") & ~acc["asked"]
        number = F.when(acc["asked"], w).when(w.rlike("^-[0-9]+$"), F.substring(w, F.lit(2), F.length(w)))
        right = number.rlike(r"^\+?[0-9]+$") & number.rlike("[1-9]")
        return F.struct(
            F.when(number.isNotNull() & right, F.regexp_replace(number, r"^\+?0*", "")).otherwise(acc["lines"]).alias("lines"),
            F.when(~option & number.isNull() & ~w.startswith("-"), F.array_append(acc["files"], w)).otherwise(acc["files"]).alias("files"),
            option.alias("asked"),
            (acc["ok"] & F.when(option, True).when(number.isNotNull(), right).otherwise(~w.startswith("-"))).alias("ok"),
        )

    def window(done: Column) -> Column:
        flag = F.when(tool == "head", "--max-lines").otherwise("--tail-lines")
        return F.when(done["ok"] & ~done["asked"] & (F.size(done["files"]) > 0), F.concat(F.lit(f"{WRAPPER} read "), flag, F.lit(" "), done["lines"], F.lit(" "), F.array_join(done["files"], " ")))

    read = F.when(tool == "cat", F.when(plain, whole)).when(tool.isin("head", "tail"), let(F.aggregate(rest, state, step), window))
    return F.when(~body.rlike("[<>]"), read)


def _segment(part: Column, excluded: tuple[str, ...]) -> Column:
    """A part with its body rewritten, its margins as they are; redirections stay alone."""

    def body(b: Column) -> Column:
        def of(words: Column) -> Column:
            kept = (b == "") | is_wrapped(words) | F.lower(_bare(F.get(words, F.lit(0)))).isin(*excluded) if excluded else (b == "") | is_wrapped(words)
            new = F.coalesce(as_read(b, words), F.when(~b.rlike("[<>]"), F.concat(F.lit(f"{WRAPPER} run -- "), b)))
            margins = F.regexp_extract(part, r"^([ \t]*)", 1), F.regexp_extract(part, r"([ \t]*)$", 1)
            return F.when(kept | new.isNull(), part).otherwise(F.concat(margins[0], new, margins[1]))

        return let(_words(b), of)

    return let(_strip(part), body)


def rewrite(command: Column, exclude: tuple[str, ...] = ()) -> Column:
    """Each part between && || ; on its own; what follows the first pipe stays."""

    def parts(all_: Column) -> Column:
        pipe = F.array_position(all_, "|")
        own = F.when(pipe > 0, F.slice(all_, F.lit(1), (pipe - 1).cast("int"))).otherwise(all_)
        rest = F.when(pipe > 0, F.slice(all_, pipe.cast("int"), F.size(all_))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array_join(F.transform(own, lambda p: F.when(p.isin("&&", "||", ";"), p).otherwise(_segment(p, exclude))), ""), F.array_join(rest, ""))

    return let(F.regexp_extract_all(command, F.lit(_PART), F.lit(0)), parts)


def decide(command: Column, enabled: bool = True, mode: str = "suggest", exclude: tuple[str, ...] = ()) -> Column:
    """struct<allowed, reason, rewritten> of a command."""
    exclude = tuple(e.strip().lower() for e in exclude)

    def result(allowed: bool, reason: str, new: Column | None = None) -> Column:
        return F.struct(F.lit(allowed).alias("allowed"), F.lit(reason).alias("reason"), (new if new is not None else F.lit(None).cast("string")).alias("rewritten"))

    def of(text: Column) -> Column:
        words = _words(text)
        first = F.lower(_bare(F.get(words, F.lit(0))))
        out = F.when(text == "", result(False, "empty command"))
        if not enabled:
            return out.otherwise(result(False, "hooks disabled"))
        if exclude:
            out = out.when(first.isin(*exclude), result(False, "command excluded"))
        same = "rewrite opt-in enabled" if mode == "rewrite" else "suggest mode default"
        made = let(rewrite(text, exclude), lambda new: F.when(new == text, result(False, "command excluded")).otherwise(result(True, same, new)))
        return out.when(is_wrapped(words), result(False, "already wrapped")).otherwise(made)

    return let(_strip(F.coalesce(command, F.lit(""))), of)
