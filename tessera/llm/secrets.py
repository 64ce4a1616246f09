"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Base spans come from three fixed patterns.  The method adds strings that a byte-pair vocabulary encodes badly: a run of
16 or more characters (24, if it has the shape of a word) of [A-Za-z0-9+/_-] with a letter whose characters per token fall below MAX_RATIO is reported as
`random`, unless it is a known digest (hex of a usual digest length), a UUID, an identifier put together from words and
short numbers, or touches a base span.  Of a run that is not reported as a whole, the stretches between separators and
parts encoded well (words) are judged in the same way, so that words of a path do not hide a string among them.

Defined results: null text is as empty text, no spans; spans are code points, end exclusive; each row is judged alone, also
equal ones; very long texts are read whole, in time that grows with their length; an empty table has no rows; only id and
text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import per_batch, table

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: MIN_WORD is for letters of one case or with a capital in front, which long words are too.
MIN_RANDOM, MIN_WORD, MAX_RATIO = 16, 24, 2.4
KINDS = ("assign", "access", "hex", "random")

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this keeps those of [0-9a-f]+ with 24 or more
LEAST_VALUE, LEAST_ACCESS = 6, 20

_RANDOM = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RANDOM)
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_WORD = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+)\Z")
_PART = re.compile(r"[A-Za-z0-9]+")
_PARTED = re.compile(r"[+/_-]*(?:[A-Za-z]+|[0-9]{1,4})(?:[+/_-]+(?:[A-Za-z]+|[0-9]{1,4}))+[+/_-]*\Z")

_encoders: dict[str, object] = {}


def vocabulary(path: str) -> bytes:
    """The vocabulary file; it goes to executors as a broadcast value of under a megabyte."""
    with open(path, "rb") as f:
        return f.read()


def encoder(data: bytes):
    """The byte-pair encoder of a vocabulary file, one for each Python worker."""
    import tiktoken

    key = hashlib.md5(data).hexdigest()
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def is_fixed(value: str) -> bool:
    """Digests of usual sizes and UUIDs."""
    bare = value.rstrip("=")
    return bool((len(bare) in _DIGEST_SIZES and _DIGEST.match(bare)) or _UUID.match(bare))


def is_known(value: str) -> bool:
    """Digests of usual sizes, UUIDs, and identifiers made of words and short numbers."""
    return is_fixed(value) or bool(_PARTED.match(value.rstrip("=")))


def _is_random(value: str, enc) -> bool:
    least = MIN_WORD if _WORD.match(value) else MIN_RANDOM
    return len(value) >= least and any(c.isalpha() for c in value) and not is_known(value) and len(value) < MAX_RATIO * len(enc.encode_ordinary(value))


def _stretches(value: str, enc) -> list[tuple[int, int]]:
    """The longest stretches of parts between separators that are not encoded well, each part by itself and then joined."""
    out: list[tuple[int, int]] = []
    last = None
    for m in _PART.finditer(value):
        if len(m[0]) >= MAX_RATIO * len(enc.encode_ordinary(m[0])):
            last = None
        elif last is None:
            out.append(last := m.span())
        else:
            out[-1] = last = (last[0], m.end())
    return out


def random_spans(text: str, base: list[tuple[int, int, str]], enc) -> list[tuple[int, int, str]]:
    out = []
    starts: list[int] = []
    ends: list[int] = []  # the base spans, merged where they overlap
    for x, y, _ in sorted(base):
        if ends and x < ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)

    def take(a: int, b: int) -> bool:
        i = bisect_right(ends, a)  # the first that ends behind a
        if (i < len(starts) and starts[i] < b) or not _is_random(text[a:b], enc):
            return False
        out.append((a, b, "random"))
        return True

    for m in _RANDOM.finditer(text):
        if is_fixed(m[0]) or take(*m.span()):
            continue
        for a, b in _stretches(m[0], enc):
            a, b = m.start() + a, m.start() + b
            if not take(a, b):  # short numbers and names beside a string must not hide it either
                for p in _PART.finditer(text, a, b):
                    take(*p.span())
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row for each row of docs: counts by kind, the digest of the base spans and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, rows = encoder(shared.value), []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            extra = random_spans(text, base, enc)
            n = [sum(k == kind for _, _, k in base + extra) for kind in KINDS]
            every = sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]], [c.split()[0] for c in SCHEMA.split(", ")])

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), fn, SCHEMA)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
