"""Scoring settings: defaults, TOML files merged over them, checks, and access by dotted key."""

from __future__ import annotations

import math
import os
import tempfile
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

# Dotted key, default, check (positive, at least 0, a share above 0, a share from 0, a switch), meaning.
KEYS = [
    ("bm25.k1", 1.2, "positive", "term saturation of owner scores"),
    ("fields.b_text", 0.75, "positive", "length normalisation of text fields"),
    ("fields.b_path", 0.5, "positive", "length normalisation of path fields"),
    ("weights.scope", 4.0, "floor", "weight of scope paths"),
    ("weights.role", 2.5, "floor", "weight of the role"),
    ("weights.responsibilities", 2.5, "floor", "weight of responsibilities"),
    ("weights.readchain", 0.0, "floor", "weight of the read chain; it counts in document frequencies all the same"),
    ("weights.skills", 0.6, "floor", "weight of skills"),
    ("weights.context_topics", 0.6, "floor", "weight of context topics"),
    ("weights.rules", 0.5, "floor", "weight of rules"),
    ("weights.out_of_scope_penalty", 2.5, "positive", "taken off for terms that are out of scope"),
    ("routing.confidence_threshold", 0.7, "share", "below it, candidates are named"),
    ("routing.min_score", 0.01, "positive", "below it, there is no owner"),
    ("routing.temperature", 0.2, "positive", "softmax temperature"),
    ("routing.min_candidate_confidence", 0.2, "share", "least confidence of a candidate"),
    ("retrieval.include_notes", True, "switch", "whether notes are searched"),
    ("tokenize.use_bigrams", False, "switch", "whether neighbouring pairs are terms too"),
    ("retrieval.min_relevance", 0.05, "floor", "least relevance of a block"),
    ("retrieval.max_blocks", 12.0, "positive", "most blocks"),
    ("retrieval.max_code_entry_points", 5.0, "positive", "most entry points"),
    ("retrieval.max_implementing_packages", 5.0, "positive", "most packages"),
    ("retrieval.max_relevant_concepts", 10.0, "positive", "most concepts"),
    ("retrieval.concept_min_relevance", 0.1, "floor", "least score of a concept"),
    ("retrieval.concept_min_fraction_of_top", 0.5, "share0", "least share of the best concept's score"),
    ("retrieval.concept_min_query_coverage", 0.0, "share0", "least share of the query's words in a concept"),
    ("retrieval.concept_use_bigrams", False, "switch", "pairs for concepts"),
    ("retrieval.agent_affinity", 1.2, "positive", "factor for what the owner reads or holds"),
    ("retrieval.bm25.k1", 1.05, "positive", "term saturation of blocks"),
    ("retrieval.trust_boost.specs", 1.3, "positive", "factor for specs"),
    ("retrieval.trust_boost.docs", 1.0, "positive", "factor for docs"),
    ("retrieval.trust_boost.context", 1.0, "positive", "factor for context"),
    ("retrieval.trust_boost.notes", 0.6, "positive", "factor for notes"),
    ("retrieval.fields.weight_title", 2.5, "positive", "weight of titles"),
    ("retrieval.fields.weight_path", 1.7, "positive", "weight of paths"),
    ("retrieval.fields.weight_body", 0.62, "positive", "weight of bodies"),
    ("retrieval.fields.weight_kind", 1.0, "floor", "weight of symbol kinds"),
    ("retrieval.concepts.weight_name", 2.0, "positive", "weight of concept names"),
    ("retrieval.concepts.weight_description", 1.0, "positive", "weight of descriptions"),
    ("retrieval.concepts.weight_source_files", 1.2, "positive", "weight of source paths"),
]
_SPEC = {k: (default, check, meaning) for k, default, check, meaning in KEYS}


@dataclass(frozen=True)
class Settings:
    """Values by dotted key; what is not given has its default."""

    given: tuple[tuple[str, float | bool], ...] = ()

    def __getitem__(self, key: str) -> float | bool:
        return dict(self.given).get(key, _SPEC[key][0])

    def __post_init__(self):
        for key, value in self.given:
            problem = check(key, value)
            if problem:
                raise ValueError(problem)

    def with_value(self, key: str, text: str) -> Settings:
        return replace(self, given=(*((k, v) for k, v in self.given if k != key), (key, parse(key, text))))


assert [f.name for f in fields(Settings)] == ["given"]


def check(key: str, value: object) -> str | None:
    """What is wrong with a value, or None."""
    if key not in _SPEC:
        return f"unknown key {key}"
    kind = _SPEC[key][1]
    if kind == "switch":
        return None if isinstance(value, bool) else f"{key} must be true or false"
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        return f"{key} must be a finite number"
    fits = {"positive": value > 0, "floor": value >= 0, "share": 0 < value <= 1, "share0": 0 <= value <= 1}[kind]
    return None if fits else f"{key} is out of range: {value}"


def parse(key: str, text: str) -> float | bool:
    """A value of a key from text."""
    if key not in _SPEC:
        raise KeyError(key)
    if _SPEC[key][1] == "switch":
        if text.strip().lower() not in ("true", "false"):
            raise ValueError(f"{key} must be true or false")
        return text.strip().lower() == "true"
    return float(text)


def describe(key: str) -> str:
    default, kind, meaning = _SPEC[key]
    return f"{key}: {meaning} (default {default}, {kind})"


def flat(tables: dict, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in tables.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def problems(path: str | Path) -> list[str]:
    """Unknown keys and bad values of a file."""
    found = flat(tomllib.loads(Path(path).read_text()))
    return [p for k, v in found.items() if (p := check("retrieval.include_notes" if k == "routing.include_notes" else k, v))]


def load(path: str | Path) -> Settings:
    """The file's known keys over the defaults; a missing or unreadable file, and unknown keys, change nothing."""
    try:
        found = flat(tomllib.loads(Path(path).read_text()))
    except (OSError, tomllib.TOMLDecodeError):
        return Settings()
    if "routing.include_notes" in found:
        found.setdefault("retrieval.include_notes", found["routing.include_notes"])
    return Settings(tuple((k, v if isinstance(v, bool) else float(v)) for k, v in found.items() if k in _SPEC and check(k, v) is None))


def save(path: str | Path, settings: Settings) -> None:
    """All values as TOML, put in place at once."""
    tables: dict[str, list[str]] = {}
    for key in _SPEC:
        section, _, name = key.rpartition(".")
        value = settings[key]
        tables.setdefault(section, []).append(f"{name} = {str(value).lower() if isinstance(value, bool) else repr(float(value))}")
    text = "\n".join(f"[{section}]\n" + "\n".join(lines) + "\n" for section, lines in sorted(tables.items()))
    handle, name = tempfile.mkstemp(dir=Path(path).parent)
    with os.fdopen(handle, "w") as f:
        f.write(text)
    os.replace(name, path)
