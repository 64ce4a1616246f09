"""Benchmark decontamination by Wu-Manber search over words.

Texts and test strings are lower-cased (A-Z) and cut into words; a pattern is a window of WINDOW consecutive words of
a test string, or the whole string if it has fewer.  For each pattern length a table gives, by the hash of a block of two
words, how far the search may jump; a block that may end a pattern leads to a bucket by that suffix block and the
pattern's first block, whose entries are compared byte by byte.  Patterns are offsets into one buffer of all test strings,
so building and holding the tables takes about 20 bytes for each byte of them.

A benchmark of more than PASS_BYTES is searched in several passes, one after another: each writes the finds of the rows
that have any, by a written key of the rows, and the tables of the next replace its own.

Defined results: a null or empty text has no words and hits nothing; a test string without words matches nothing; a
null item id is written as the empty string; equal ids or equal texts of several items are kept apart by id only; each
repeated document row is judged by itself; empty tables give no rows or no hits; very long texts are searched whole.  Only
the id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, keyed, packed, table, unpacked

WINDOW = 13
#: Bytes of test strings held by each task at once; a larger benchmark is searched in several passes.
PASS_BYTES = 8 << 20
#: Bits of the shift table at least and at most.
LEAST_BITS, MOST_BITS = 12, 22
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_WORDS).split() if text else []


class Strings:
    """The words of all test strings: one buffer with a space behind each, where they begin, and their hashes."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int):
        buffer, begins, hashes = bytearray(), [], array("q")
        self.names: list[str] = []
        windows: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for item_id, text in items:
            own = words(text)
            size = min(window, len(own))
            if not size:
                continue
            first = len(hashes)
            begins.append(len(buffer) + np.concatenate(([0], np.cumsum([len(w) + 1 for w in own[:-1]], dtype=np.int64))))
            buffer += b" ".join(own) + b" "
            hashes.extend(map(hash, own))
            at, owner = windows.setdefault(size, ([], []))
            at.append(np.arange(first, first + len(own) - size + 1))
            owner.append(np.full(len(own) - size + 1, len(self.names)))
            self.names.append("" if item_id is None else str(item_id))
        self.buffer, self.begins, self.hashes = bytes(buffer), np.concatenate([*begins, [len(buffer)]]), np.array(hashes, np.int64)
        self.windows = {size: (np.concatenate(at), np.concatenate(owner)) for size, (at, owner) in windows.items()}

    def bytes_of(self, at: int, length: int) -> bytes:
        return self.buffer[self.begins[at] : self.begins[at + length] - 1]


class WuManber:
    """All occurrences of the patterns of one length, each with the numbers of its owners."""

    def __init__(self, strings: Strings, length: int):
        self.strings, self.length, self.block = strings, length, min(2, length)
        self.reach = length - self.block + 1
        at, pattern, owner = self._distinct(*strings.windows[length])
        self.mask = (1 << min(MOST_BITS, max(LEAST_BITS, (8 * len(at)).bit_length()))) - 1
        shift = np.full(self.mask + 1, min(self.reach, 255), np.uint8)
        for end in range(self.block, length + 1):  # later ends overwrite with less
            shift[self._hashed(at + end - self.block) & self.mask] = min(length - end, 255)
        self.shift = shift.tobytes()
        keys = (self._hashed(at + length - self.block) << 32) | (self._hashed(at) & 0xFFFFFFFF)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order].astype(np.int32)
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(place[pattern], minlength=len(at)))))
        self.owners = owner[np.argsort(place[pattern], kind="stable")].astype(np.int32)

    def _hashed(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the blocks of words that begin there."""
        h = self.strings.hashes
        return h[at] if self.block == 1 else h[at] * 31 + h[at + 1]

    def _distinct(self, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One place for each different pattern, and pairs of a pattern and one of its owners."""
        h, bytes_of = self.strings.hashes, self.strings.bytes_of
        for factor in chain([1_000_003], range(1_000_033, 1 << 62, 2)):
            digest = np.zeros(len(at), np.int64)
            for i in range(self.length):
                digest = digest * factor + h[at + i]
            order = np.lexsort((owner, digest))
            sorted_at, same = at[order], np.nonzero(np.diff(digest[order]) == 0)[0]
            # equal digests are compared byte by byte; if two patterns share one, another factor is taken
            if all(bytes_of(a, self.length) == bytes_of(b, self.length) for a, b in zip(sorted_at[same].tolist(), sorted_at[same + 1].tolist(), strict=True)):
                break
        owner, fresh = owner[order], np.ones(len(at), bool)
        fresh[same + 1] = False
        pattern, new = np.cumsum(fresh) - 1, fresh.copy()
        new[1:] |= owner[1:] != owner[:-1]
        return sorted_at[fresh], pattern[new], owner[new]

    def find(self, text: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        m, b, n, mask, shift, keys = self.length, self.block, len(text), self.mask, self.shift, self.keys
        at = m - 1
        while at < n:
            h = hash(text[at]) if b == 1 else hash(text[at - 1]) * 31 + hash(text[at])
            step = shift[h & mask]
            if step:
                at += step
                continue
            start = at - m + 1
            first = hash(text[start]) if b == 1 else hash(text[start]) * 31 + hash(text[start + 1])
            key = ((h & 0xFFFFFFFF) << 32) | (first & 0xFFFFFFFF)
            key -= (key >> 63) << 64
            i = int(keys.searchsorted(key))
            if i < len(keys) and keys[i] == key:
                own = b" ".join(text[start : at + 1])
                while i < len(keys) and keys[i] == key:
                    if self.strings.bytes_of(int(self.at[i]), m) == own:
                        yield start, self.owners[self.ends[i] : self.ends[i + 1]]
                        break
                    i += 1
            at += 1

    def names(self, owners: Iterable[int]) -> set[str]:
        return {self.strings.names[i] for i in owners}


def build(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One matcher for each pattern length that occurs."""
    strings = Strings(items, window)
    return [WuManber(strings, size) for size in sorted(strings.windows)]


def search(text: list[bytes], matchers: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged hit intervals [start, end) in words, and the owners of the patterns found."""
    hits: list[tuple[int, int]] = []
    owners: set[str] = set()
    for m in matchers:
        own: set[int] = set()
        for start, found in m.find(text):
            hits.append((start, start + m.length))
            own.update(found.tolist())
        owners |= m.names(own)
    return merge(hits), owners


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_built: dict[str, list[WuManber]] = {}


def _matchers(shared, window: int) -> list[WuManber]:
    """The matchers of a broadcast pass, built once in each Python worker."""
    key, rows = shared.value
    if key not in _built:
        _built.clear()
        _built[key] = build(rows, window)
    return _built[key]


def _passes(benchmark: DataFrame, item_col: str, text_col: str, pass_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in lists of bounded bytes, fetched one partition at a time; at least one list, maybe empty."""
    rows, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).filter(F.col("t").isNotNull()).toLocalIterator():
        n = len(r.t.encode())
        if rows and size + n > pass_bytes:
            yield rows
            rows, size = [], 0
        rows.append((r.i, r.t))
        size += n
    yield rows


_SPANS = "array<struct<a:long,b:long>>"
FOUND = f"struct<n_words:long,spans:{_SPANS},items:array<string>>"
_KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _finder(shared, window: int):
    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        matchers, out = _matchers(shared, window), []
        for text in texts:
            own = words(text.as_py())
            spans, owners = search(own, matchers)
            out.append({"n_words": len(own), "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(owners)})
        return pa.array(out, _KIND)

    return find


@F.arrow_udf(T.LongType())
def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(words(t.as_py())) for t in texts], pa.int64())


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))
def _merged(spans: pa.Array) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in merge((s["a"], s["b"]) for s in x.as_py())] for x in spans], _KIND.field("spans").type)


def with_occurrences(docs: DataFrame, benchmark: DataFrame, out_col: str = "found", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with a column of (n_words, merged spans of hit words, ids of the items found).

    The test strings go to the executors in passes of bounded bytes; of several, only one is held at a time.
    """
    spark = docs.sparkSession
    passes = _passes(benchmark, item_col, item_text_col, pass_bytes)
    first, second = next(passes), next(passes, None)

    def finds(rows: list[tuple[object, str | None]], text: Column):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
        return shared, _finder(shared, window)(text.cast("string"))

    if second is None:
        return docs.withColumn(out_col, finds(first, F.col(text_col))[1])
    rows, text = keyed(docs), F.col("doc").getField(text_col).cast("string")
    hits = None
    for part in chain([first, second], passes):
        shared, found = finds(part, text)
        own = cut(rows.select("row", found.alias("f")).filter(F.size("f.spans") > 0))
        shared.destroy()
        hits = own if hits is None else hits.unionAll(own)
    both = hits.groupBy("row").agg(F.flatten(F.collect_list("f.spans")).alias("spans"), F.flatten(F.collect_list("f.items")).alias("items"))
    both = both.select("row", _merged("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    no_spans, no_items = F.array().cast(_SPANS), F.array().cast("array<string>")
    found = F.struct(_n_words(text).alias("n_words"), F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items"))
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c != out_col]
    return rows.join(both, "row", "left").withColumn("found", found).select(*kept, F.col("found").alias(out_col))


def with_verdict(docs: DataFrame, found: str = "found") -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated, from the column of with_occurrences."""
    n_hit = F.aggregate(f"{found}.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    out = docs.withColumns({"n_words": F.col(f"{found}.n_words"), "n_hit": n_hit, "n_items": F.size(f"{found}.items").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", f"{found}.items").cast("binary"), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_verdict(with_occurrences(docs, table(spark, sf_dir, "benchmark"))).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, without the contaminated documents."""
    inner = docs.select(packed(docs).alias("doc"), F.col("text"))
    return unpacked(with_verdict(with_occurrences(inner, benchmark)).filter(~F.col("contaminated")))


OP8_SQL = """
WITH dw AS (
  SELECT doc_id, rid, w, len(w) AS n FROM (
    SELECT doc_id, row_number() OVER () AS rid,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
    FROM documents)
), bw AS (
  SELECT item_id, w, len(w) AS n, least(13, len(w)) AS k FROM (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
    FROM benchmark)
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(1, n - k + 2)) AS i FROM bw WHERE n > 0)
), ks AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, n - k + 2)) AS i FROM dw, ks WHERE n >= k)
), hit AS (SELECT rid, i, dg.k AS k, item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
