"""Command rewriting: wrap commands, and turn plain file reads into reads with a window."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The command line tool that runs and reads for the user.
WRAPPER = "tessera shell"
_SPLIT = re.compile(r"&&|\|\||;|\|")


def _bare(word: str) -> str:
    return word.strip("\"'")


def is_wrapped(command: str) -> bool:
    words = command.lower().split()
    return words[:2] == WRAPPER.split() and (words[2:3] == ["read"] or words[2:4] == ["run", "--"])


def as_read(command: str) -> str | None:
    """The windowed read that a cat, head or tail of files stands for; None for anything else."""
    words = command.split()
    if not words or re.search("[<>]", command):
        return None
    tool, rest = _bare(words[0]).lower(), words[1:]
    if tool == "cat":
        plain = rest and all(w == "-" or not w.startswith("-") for w in rest)
        return f"{WRAPPER} read --line-numbers {' '.join(rest)}" if plain else None
    if tool not in ("head", "tail"):
        return None
    lines, files, words = 10, [], iter(rest)
    for w in words:
        number = next(words, "") if w in ("-n", "--lines") else w[1:] if re.fullmatch(r"-[0-9]+", w) else None
        if number is not None:
            if not re.fullmatch(r"\+?[0-9]+", number) or int(number) <= 0:
                return None
            lines = int(number)
        elif w.startswith("-"):
            return None
        else:
            files.append(w)
    flag = "--max-lines" if tool == "head" else "--tail-lines"
    return f"{WRAPPER} read {flag} {lines} {' '.join(files)}" if files else None


def _segment(part: str, excluded: set[str]) -> str:
    body = part.strip()
    if not body or is_wrapped(body) or _bare(body.split()[0]).lower() in excluded:
        return part
    lead, trail = part[: len(part) - len(part.lstrip(" \t"))], part[len(part.rstrip(" \t")) :]
    new = as_read(body) or (None if re.search("[<>]", body) else f"{WRAPPER} run -- {body}")
    return part if new is None else lead + new + trail


def rewrite(command: str, excluded: set[str]) -> str:
    """Each part between && || ; on its own; what follows the first pipe stays."""
    out, at = [], 0
    while at < len(command):
        m = _SPLIT.search(command, at)
        end = m.start() if m else len(command)
        out.append(_segment(command[at:end], excluded))
        if m and m[0] == "|":
            out.append(command[end:])
            break
        out.append(m[0] if m else "")
        at = m.end() if m else end
    return "".join(out)


def decide(command: str | None, enabled: bool = True, mode: str = "suggest", exclude: tuple[str, ...] = ()) -> tuple[bool, str, str | None]:
    """(allowed, reason, new command)."""
    text, excluded = (command or "").strip(), {e.strip().lower() for e in exclude}
    if not text:
        return False, "empty command", None
    if not enabled:
        return False, "hooks disabled", None
    if _bare(text.split()[0]).lower() in excluded:
        return False, "command excluded", None
    if is_wrapped(text):
        return False, "already wrapped", None
    new = rewrite(text, excluded)
    if new == text:
        return False, "command excluded", None
    return True, "rewrite opt-in enabled" if mode == "rewrite" else "suggest mode default", new


def with_decision(commands: DataFrame, command_col: str = "command", out_col: str = "decision", enabled: bool = True, mode: str = "suggest", exclude: tuple[str, ...] = ()) -> DataFrame:
    """commands with struct<allowed, reason, rewritten>."""

    @F.arrow_udf("struct<allowed:boolean,reason:string,rewritten:string>")
    def run(rows: pa.Array) -> pa.Array:
        kind = pa.struct([("allowed", pa.bool_()), ("reason", pa.string()), ("rewritten", pa.string())])
        return pa.array([dict(zip(("allowed", "reason", "rewritten"), decide(c, enabled, mode, exclude), strict=True)) for c in rows.to_pylist()], kind)

    return commands.withColumn(out_col, run(F.col(command_col)))
