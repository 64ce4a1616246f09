"""Compact forms of files by language: outlines of code, summaries of JSON, long unknown fences of markdown left out."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.filters import _short, parsed
from tessera.operators import compact

PREVIEW, FENCE_LINES, ULTRA_FENCE_LINES = 4, 12, 6
_TOP = re.compile(r"(func|type|var|const|import)\b")
_STRINGS = re.compile(r'"(?:\\.|[^"\\])*"|`[^`]*`|\'(?:\\.|[^\'\\])*\'')


def _uncommented(line: str) -> str:
    """Without a comment that runs to the end of the line."""
    return "" if line.lstrip().startswith("//") else re.sub(r"//.*$", "", line).rstrip(" \t")


def _one_blank(lines: list[str]) -> str:
    out: list[str] = []
    for line in lines:
        if line.strip() or not out or out[-1]:
            out.append(line if line.strip() else "")
    return "\n".join(out).strip() + "\n"


def _depth(line: str) -> int:
    """Brackets a line opens minus those it closes, strings and comments aside."""
    bare = re.sub(r"//.*$", "", _STRINGS.sub("", line))
    return sum(bare.count(c) for c in "{(") - sum(bare.count(c) for c in "})")


def go_outline(text: str, ultra: bool = False) -> str:
    """Package line and declarations without comments; of longer function bodies the first lines, or none with ultra.

    Declarations are found by the shape of lines and balanced brackets.  A text without a package line, or whose
    brackets do not balance, only loses its comments and double blank lines.
    """
    bare = re.sub(r"(?s)/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text)
    lines = bare.split("\n")
    package = next((i for i, x in enumerate(lines) if x.startswith("package ")), None)

    def plain() -> str:
        return _one_blank([_uncommented(x) for x in re.sub(r"(?s)/\*.*?\*/", "", text).split("\n")])

    if package is None:
        return plain()
    depths = [_depth(x) for x in lines]
    out, at = [lines[package]], package + 1
    while at < len(lines):
        if not _TOP.match(lines[at]):
            at += 1
            continue
        end, depth, opened = at, depths[at], at
        while depth > 0 and end + 1 < len(lines):
            end += 1
            depth += depths[end]
        if depth != 0:
            return plain()
        if lines[at].startswith("func") and end > at:
            level = 0
            for opened in range(at, end + 1):
                level += depths[opened]
                if level > 0 and re.sub(r"//.*$", "", lines[opened]).rstrip().endswith("{"):
                    break
        out.append("")
        if not lines[at].startswith("func") or end == at or opened == end:
            out += [_uncommented(x) for x in lines[at : end + 1]]
        else:
            out += [_uncommented(x) for x in lines[at : opened + 1]]
            size = end - opened - 1
            shown = 0 if ultra else min(PREVIEW, size)
            out += [_uncommented(x) for x in lines[opened + 1 : opened + 1 + shown]]
            first, last = opened + 2 + shown, end
            if ultra:
                out.append(f"\t... (lines {first}-{last})")
            elif size > shown:
                out.append(f"\t... ({size - shown} lines omitted, lines {first}-{last})")
            out.append(lines[end])
        at = end + 1
    return _one_blank(out)


def markdown(text: str, ultra: bool = False) -> str:
    """Fenced blocks of unknown languages beyond some lines as a mark; an open fence at the end stays."""
    lines, out, start = text.split("\n"), [], None
    most = ULTRA_FENCE_LINES if ultra else FENCE_LINES
    for i, line in enumerate(lines):
        if line.strip().startswith("```"):
            if start is None:
                start = i
                continue
            name, size = lines[start].strip()[3:].strip().lower(), i - start - 1
            if name in compact.KNOWN_FENCES or size <= most:
                out += lines[start : i + 1]
            else:
                out += [lines[start], f"... ({size} lines omitted, lines {start + 2}-{i})", line]
            start = None
        elif start is None:
            out.append(line)
    return "\n".join(out if start is None else out + lines[start:])


def _kind(v) -> str:
    if isinstance(v, str):
        return f'string("{_short(v, 40).replace("…", "...")}")'
    if v is None or isinstance(v, bool):
        return "null" if v is None else f"bool({str(v).lower()})"
    if isinstance(v, dict | list):
        return f"object({len(v)} keys)" if isinstance(v, dict) else f"array(len={len(v)})"
    return f"number({v:.6g})" if isinstance(v, float) else f"number({v})"


def json_outline(text: str, ultra: bool = False) -> str:
    value = parsed(text.strip())
    if not isinstance(value, dict | list):
        return text
    keyed = isinstance(value, dict)
    rows = [(k, value[k]) for k in sorted(value)] if keyed else [(f"[{i}]", v) for i, v in enumerate(value)]
    most = (10 if ultra else 20) if keyed else (5 if ultra else 10)
    out = [f"json object: keys={len(rows)}" if keyed else f"json array: len={len(rows)}", *(f"  {k}: {_kind(v)}" for k, v in rows[:most])]
    return "\n".join(out + [f"  ... ({len(rows) - most} {'keys' if keyed else 'elements'} omitted)"] * (len(rows) > most))


READERS = {"go": go_outline, "markdown": markdown, "json": json_outline, "generic": lambda text, ultra=False: text}


def filtered(reader: Column, text: Column, ultra: bool = False) -> Column:
    """The compact form of a text by the name of its reader."""

    @F.arrow_udf("string")
    def run(names: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else READERS.get(n, READERS["generic"])(t, ultra) for n, t in zip(names.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    return run(reader, text)


def read(files: DataFrame, path_col: str = "path", text_col: str = "text", ultra: bool = False, no_filter: bool = False, first: int | None = None, last: int | None = None, numbers: bool = False) -> DataFrame:
    """files with language, content, tokens_before and tokens_after; raw text where a filter leaves nothing or saves nothing."""
    named = files.withColumn("language", compact.reader_for(F.col(path_col)))
    shown = F.col(text_col) if no_filter else filtered(F.col("language"), F.col(text_col), ultra)
    return compact.read(named, shown, text_col, first, last, numbers)
