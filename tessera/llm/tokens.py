"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A byte-pair encoder never merges across pre-tokens, so a text's token count is the sum over its pre-tokens.  A tree
keeps, for each pre-token, its characters and tokens (leaves), and over blocks of leaves a binary tree of sums.  Edits
replace characters [start, end) by strings.  For each the tree is descended to its block, and pre-tokens are cut anew from
the last boundary that lies at least CONTEXT characters before the edit (no rule of the split pattern looks further ahead)
until a new boundary behind the edit falls on an old one (the pattern never looks back, so all later boundaries agree);
only these pre-tokens are encoded, and the sums of the blocks above them are updated.  All edits of a text go in one sweep.

Trees live whole in a table, leaves and sums, as struct<lens, counts, sizes, chars, tokens> beside the text, so that later
edits need no new count: lens and counts of the leaves, leaves of each block, and the sums as an implicit binary tree, its
root at index 1.

Defined results: null text counts as empty; edits of a document are given in the coordinates of the text before all of
them and clipped to it; what an earlier one (by start, then end; of those alike, in a list by its order, in a table by the new text, whatever
the order of rows) replaces is left out of a later one; a null replacement is empty; an empty table has no rows; columns other than those named are not read; repeated rows are counted one by one; an edit of an unknown document changes nothing; very long texts are read whole.
A document and its edits must fit into one task's memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import pii
from tessera.llm.common import table
from tessera.llm.secrets import DEFAULT_VOCABULARY, PRETOKENS, encoder, vocabulary

CONTEXT, BLOCK, MEMO = 2, 128, 400_000
_SPLIT = regex.compile(PRETOKENS)


class Counter:
    """Tokens of single pre-tokens, remembered up to MEMO of them."""

    def __init__(self, data: bytes):
        self.enc, self.memo = encoder(data), {}

    def of(self, pretoken: str) -> int:
        n = self.memo.get(pretoken)
        if n is None:
            n = len(self.enc.encode_ordinary(pretoken))
            if len(pretoken) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[pretoken] = n
        return n


class TokenTree:
    """Leaves in blocks, and a binary tree of (characters, tokens) sums over the blocks."""

    def __init__(self, text: str, counter: Counter, kept: dict | None = None):
        """kept: the arrays of an earlier tree of the same text, which are taken as they are."""
        self.text, self.counter = text, counter
        if kept is not None:
            self.lens, self.counts, self.sizes, self.chars, self.tokens = (np.array(kept[k]) for k in PARTS)
            return
        pieces = _SPLIT.findall(text)
        n = len(pieces)
        self.lens, self.counts = np.fromiter(map(len, pieces), np.int32, n), np.fromiter(map(counter.of, pieces), np.int32, n)
        self._grow(np.diff(np.append(np.arange(0, max(n, 1), BLOCK), n)))

    def _grow(self, sizes: np.ndarray) -> None:
        """The sums over blocks of so many leaves."""
        self.sizes = sizes.astype(np.int32)
        size = 1 << max(0, (len(sizes) - 1).bit_length())
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        out = []
        for values in (self.lens, self.counts):
            sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[cuts]
            tree = np.zeros(2 * size, np.int64)
            tree[size : size + len(sizes)] = np.diff(sums)
            level = size
            while level > 1:
                tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(1)
                level //= 2
            out.append(tree)
        self.chars, self.tokens = out

    def arrays(self) -> dict:
        return {k: getattr(self, k) for k in PARTS}

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.lens.tolist(), self.counts.tolist()

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character at (the last one for the end of the text) and where it begins."""
        node, begin, low, span = 1, 0, 0, len(self.chars) // 2
        while span > 1:
            span //= 2
            node *= 2
            if low + span < len(self.sizes) and at >= begin + self.chars[node]:
                begin += int(self.chars[node])
                low += span
                node += 1
        return low, begin

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces [start, end); returns how many pre-tokens were encoded."""
        return self.edit_all([(start, end, new)])

    def _spliced(self, edits: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
        """Makes the new text; the edits as (start, end) before and after."""
        size, done, at = len(self.text), 0, 0
        pieces, spans = [], []
        for a, b, new in sorted(edits, key=lambda e: e[:2]):
            a = max(done, min(a, size))
            b = max(a, min(b, size))
            pieces += [self.text[done:a], new]
            at += a - done
            spans.append((a, b, at, at + len(new)))
            done, at = b, at + len(new)
        self.text = "".join([*pieces, self.text[done:]])
        return spans

    def edit_all(self, edits: Iterable[tuple[int, int, str]]) -> int:
        """Replaces all [start, end) of the text as it is; returns how many pre-tokens were encoded."""
        spans = self._spliced(edits)
        lens, starts = self.lens, np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))
        changes: list[tuple[int, int, int, list[int], list[int]]] = []  # block, leaves from p to q, what takes their place
        k, n = 0, len(lens)
        while k < len(spans):
            # the last boundary at least CONTEXT characters before the edit
            limit = spans[k][0] - CONTEXT
            block, at = self._find(max(0, limit))
            p, last = int(starts[block]), int(starts[block + 1])
            while p < last and at + lens[p] <= limit:
                at += int(lens[p])
                p += 1
            q, old = p, at
            new_lens: list[int] = []
            new_counts: list[int] = []
            for m in _SPLIT.finditer(self.text, at + (spans[k - 1][3] - spans[k - 1][1] if k else 0)):
                here = m.start()
                while k + 1 < len(spans) and here > spans[k + 1][2] - CONTEXT:
                    k += 1  # too near to the next edit to stop before it
                shift = spans[k][3] - spans[k][1]
                if here >= spans[k][3]:
                    while old < here - shift:
                        old += int(lens[q])
                        q += 1
                    if old == here - shift:
                        break
                new_lens.append(m.end() - here)
                new_counts.append(self.counter.of(m[0]))
            else:
                q, k = n, len(spans)  # cut anew to the end
            changes.append((block, p, q, new_lens, new_counts))
            k += 1
        self._put(changes, starts)
        return sum(len(c[3]) for c in changes)

    def _put(self, changes: list[tuple[int, int, int, list[int], list[int]]], starts: np.ndarray) -> None:
        """Takes the changes over into leaves and blocks, and updates the sums above them."""
        sizes, touched = self.sizes.copy(), set()
        parts: tuple[list, list] = ([], [])
        done = 0
        for block, p, q, lens, counts in changes:
            for out, old, new in zip(parts, (self.lens, self.counts), (lens, counts), strict=True):
                out += [old[done:p], np.array(new, np.int32)]
            done = q
            sizes[block] += len(lens)
            touched.add(block)
            b = block
            while b < len(sizes) and starts[b] < q:
                sizes[b] -= max(0, min(q, int(starts[b + 1])) - max(p, int(starts[b])))
                touched.add(b)
                b += 1
        self.lens, self.counts = (np.concatenate([*out, old[done:]]) for out, old in zip(parts, (self.lens, self.counts), strict=True))
        if sizes.max() > 4 * BLOCK:
            self._grow(np.concatenate([np.diff(np.append(np.arange(0, max(s, 1), BLOCK), s)) for s in sizes]))
            return
        self.sizes = sizes
        starts, size = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), len(self.chars) // 2
        for b in touched:
            self.chars[size + b] = self.lens[starts[b] : starts[b + 1]].sum()
            self.tokens[size + b] = self.counts[starts[b] : starts[b + 1]].sum()
        nodes = {(size + b) // 2 for b in touched}
        while nodes and 0 not in nodes:
            for node in nodes:
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            nodes = {node // 2 for node in nodes}


PARTS = {"lens": pa.int32(), "counts": pa.int32(), "sizes": pa.int32(), "chars": pa.int64(), "tokens": pa.int64()}
TREE = f"struct<{','.join(f'{k}:array<{v}>'.replace('int32', 'int').replace('int64', 'long') for k, v in PARTS.items())}>"


def _trees(trees: list[TokenTree | None]) -> pa.StructArray:
    parts = []
    for k, kind in PARTS.items():
        own = [getattr(t, k) if t else np.empty(0, kind.to_pandas_dtype()) for t in trees]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in own], dtype=np.int64))).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else [], kind)))
    return pa.StructArray.from_arrays(parts, list(PARTS), mask=pa.array([t is None for t in trees], pa.bool_()))


_counters: dict[int, Counter] = {}


def _counter(shared) -> Counter:
    data = shared.value
    key = hash(data)
    if key not in _counters:
        _counters[key] = Counter(data)
    return _counters[key]


def tree_of(spark, text: Column, vocabulary_path: str = DEFAULT_VOCABULARY) -> Column:
    """The tree of a text."""
    shared = spark.sparkContext.broadcast(vocabulary(vocabulary_path))

    @F.arrow_udf(TREE)
    def grow(texts: pa.Array) -> pa.Array:
        counter = _counter(shared)
        return _trees([TokenTree(t.as_py() or "", counter) for t in texts])

    return grow(text)


def n_tokens(tree: Column) -> Column:
    """The sum at the root."""
    return F.element_at(tree["tokens"], 2)


def edited(spark, text: Column, tree: Column, edits: Column, vocabulary_path: str = DEFAULT_VOCABULARY) -> Column:
    """struct<text, tree, n_encoded> after edits, an array<struct<a,b,new>>."""
    shared = spark.sparkContext.broadcast(vocabulary(vocabulary_path))

    @F.arrow_udf(f"struct<text:string,tree:{TREE},n_encoded:long>")
    def apply(texts: pa.Array, trees: pa.Array, changes: pa.Array) -> pa.Array:
        counter, grown, counted = _counter(shared), [], []
        for t, old, e in zip(texts, trees, changes, strict=True):
            own = [(x["a"], x["b"], x["new"] or "") for x in (e.as_py() or [])]
            if own:
                grown.append(TokenTree(t.as_py() or "", counter, {k: old[k].values.to_numpy() for k in PARTS}))
                counted.append(grown[-1].edit_all(own))
            else:
                grown.append(None)
                counted.append(0)
        text = pa.array([g.text if g else t.as_py() for g, t in zip(grown, texts, strict=True)], pa.string())
        return pa.StructArray.from_arrays([text, _trees(grown), pa.array(counted, pa.int64())], ["text", "tree", "n_encoded"])

    done = apply(text, tree, edits)
    return F.struct(done["text"].alias("text"), F.coalesce(done["tree"], tree).alias("tree"), done["n_encoded"].alias("n_encoded"))


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """trees (doc_id, text, tree) after a table of edits (doc_id, a, b, new); a document's edits go to its row."""
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "b", "new"))).alias("edits"))
    joined = trees.join(listed, "doc_id", "left")
    after = edited(trees.sparkSession, F.col("text"), F.col("tree"), F.col("edits"), vocabulary_path)
    return joined.withColumn("after", after).select("doc_id", "after.text", "after.tree", "after.n_encoded")


def redactions(spark, text: Column) -> Column:
    """Edits that put <KIND> in place of personal data."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("new", pa.string())]))

    @F.arrow_udf("array<struct<a:int,b:int,new:string>>")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[{"a": a, "b": b, "new": f"<{k.upper()}>"} for a, b, k in pii.detect(t.as_py())] for t in texts], kind)

    return find(text)


def recounted(docs: DataFrame, find, vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_edits, n_encoded, n_tokens_after of docs (doc_id, text): the sums of each text's tree
    before and after its edits, find(text) -> (a, b, new) of each.  A task holds one tree at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    kind = dict(docs.dtypes)["doc_id"]
    names = ["n_tokens", "n_pretokens", "n_edits", "n_encoded", "n_tokens_after"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared)
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                tree, edits = TokenTree(text, counter), find(text)
                before, pieces = tree.total, len(tree.lens)
                rows.append((before, pieces, len(edits), tree.edit_all(edits) if edits else 0, tree.total))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]], names=["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def _redacted(text: str) -> list[tuple[int, int, str]]:
    return [(a, b, f"<{k.upper()}>") for a, b, k in pii.detect(text)]


def op3_edit_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every whole document before and after the redaction of personal data, by trees and edits."""
    return recounted(table(spark, sf_dir, "documents"), _redacted)
