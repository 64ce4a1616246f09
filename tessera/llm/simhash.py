"""SimHash near-duplicates: fingerprints, a segment-popcount grid join, exact distances, connected components.

Fingerprint: over the 3-word shingles of the lower-cased (A-Z) text, repeats included, a bit is 1 if it is set in over
half of the XXH64 values (seed 42).  Equal fingerprints are one class; classes, not ids, are linked, so rows that repeat
an id link nothing.

Candidate search between classes: a fingerprint is embedded as the vector of bit counts of its 32 two-bit segments.  The
Manhattan distance of two vectors is at most the Hamming distance of the fingerprints.  The vector is cut into BLOCKS
equal blocks; two vectors at distance <= RADIUS agree in at least BLOCKS - RADIUS of them, so they share a cell of the
grid of at least one choice of that many blocks.  Cells are joined, the Manhattan distance of the whole vectors filters,
the Hamming distance verifies.

The classes of a cell of more than CELL_LIMIT classes are joined in a finer grid, of 16 blocks and choices of 14, over
the fingerprints' own segments, not only their counts: its cells hold at most 256 classes, as 8 bits are left open.  The
same two tests follow.  Of the cells that two classes share, one is named by the blocks in which they differ: only there
the pair is made.

Defined results: null, empty or blank text has fingerprint zero and is linked like any other; a null doc_id keeps its
fingerprint, links like any other, and names a component only if no row of it has an id (then component_id is null);
repeated ids and texts are kept row by row, and a repeated id may be in several components; an empty table has no rows.
Very long texts are hashed whole.  Only id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, keyed, lookup, packed, per_batch, table, unpacked

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
BLOCKS, FINE_BLOCKS, CELL_LIMIT = 8, 16, 64
CELL = ["pick", "bits"]
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    k = min(SHINGLE, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[k:], strict=False)], dtype="<u8")
    n = len(hashes)
    by_byte = hashes.view(np.uint8).reshape(n, 8)
    out = 0
    for byte in range(8):
        ones = np.bincount(by_byte[:, byte], minlength=256) @ _BYTE_BITS
        for bit in np.nonzero(2 * ones > n)[0]:
            out |= 1 << (8 * byte + int(bit))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a long of the same bits."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return per_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), fn, "doc_id long, fp long")


def embedded(fp: Column) -> Column:
    """The bit counts (0, 1, 2) of the fingerprint's 32 segments, each as 00, 01 or 11, so that the number of differing
    bits of two embeddings is the Manhattan distance of their vectors of counts."""
    upper = F.shiftrightunsigned(fp, 1)
    low = F.lit(0x5555555555555555).cast("long")
    return fp.bitwiseOR(upper).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(low), 1))


def _masks(blocks: int, radius: int) -> list[tuple[tuple[int, ...], int]]:
    """The blocks left out of each choice of blocks - radius blocks, and the bits of those chosen."""
    width = BITS // blocks
    out = []
    for open_ in combinations(range(blocks), radius):
        mask = sum(((1 << width) - 1) << (width * b) for b in range(blocks) if b not in open_)
        out.append((open_, mask - (1 << 64) if mask >> 63 else mask))
    return out


def cells(e: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """An array with the cell of e in the grid of every choice of blocks - radius blocks: its number and the chosen bits."""
    return F.array(*[F.struct(F.lit(i).alias("pick"), e.bitwiseAND(F.lit(mask).cast("long")).alias("bits")) for i, (_, mask) in enumerate(_masks(blocks, radius))])


def _named(pick: Column, differ: Column, blocks: int) -> Column:
    """Whether the cell of this choice is the one where a pair that differs in these bits is made: of two left-out blocks,
    both where it differs, or the one, and the first other block beside it."""
    width = BITS // blocks
    out = F.lit(False)
    for i, ((low, high), _) in enumerate(_masks(blocks, 2)):
        there = [differ.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) != 0 for m in (((1 << width) - 1) << (width * b) for b in (low, high))]
        own = there[0] & there[1]
        if low == 0:
            own = own | (~there[0] & there[1])
        if (low, high) == (0, 1):
            own = F.lit(True)
        out = F.when(pick == i, own).otherwise(out)
    return out


def _spread(classes: DataFrame, by: str, blocks: int) -> DataFrame:
    """A row (fp, e, node, pick, bits) for each cell of a class, written once."""
    return cut(classes.select("fp", "e", "node", F.explode(cells(F.col(by), blocks)).alias("cell")).select("fp", "e", "node", "cell.*"))


def _met(spread: DataFrame, by: str, blocks: int) -> DataFrame:
    """Pairs (a, b) of rows of a cell that are within RADIUS, by the Manhattan distance of the embeddings and then exactly;
    by: what the cells are cut from."""
    left = spread.select(*CELL, F.col("fp").alias("fp_a"), F.col("e").alias("e_a"), F.col("node").alias("a"))
    right = spread.select(*CELL, F.col("fp").alias("fp_b"), F.col("e").alias("e_b"), F.col("node").alias("b"))
    near = left.join(right, CELL).filter((F.col("fp_a") < F.col("fp_b")) & (F.bit_count(F.col("e_a").bitwiseXOR(F.col("e_b"))) <= RADIUS))
    near = near.filter(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= RADIUS)
    return near.filter(_named(F.col("pick"), F.col(f"{by}_a").bitwiseXOR(F.col(f"{by}_b")), blocks)).select("a", "b")


def links(classes: DataFrame, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges (a, b) between all pairs of different fingerprints within RADIUS.

    classes: one row for each fingerprint fp with its node id.
    """
    spread = _spread(classes.withColumn("e", embedded(F.col("fp"))), "e", BLOCKS)
    sizes = spread.groupBy(*CELL).agg(F.count("*").alias("n")).filter("n > 1")
    # cells with over a 500th of all rows are fewer than 500: their rows are told by a broadcast and not shuffled by cell
    huge = F.broadcast(sizes.filter(F.col("n") > max(cell_limit, spread.count() // 500)).select(*CELL))
    others = spread.join(huge, CELL, "left_anti")
    pairs = _met(others.join(sizes.filter(F.col("n") <= cell_limit).select(*CELL), CELL, "left_semi"), "e", BLOCKS)
    full = others.join(sizes.filter(F.col("n") > cell_limit).select(*CELL), CELL, "left_semi").unionByName(spread.join(huge, CELL, "left_semi"))
    fine = _spread(full.select("fp", "e", "node").distinct(), "fp", FINE_BLOCKS)
    return pairs.unionAll(_met(fine, "fp", FINE_BLOCKS)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) can reach.

    Alternating large-star and small-star rounds; each round is written to the checkpoint folder.  They are over when a
    round leaves the edges as they are, by their number and the sum of their hashes.  A root has as many edges as its
    component has nodes, so the large star looks roots up without shuffling the edges of big ones.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        own = edges.select(F.col("a").alias("u"), F.col("b").alias("m"), F.lit(0).alias("over")).unionAll(down.select("u", F.col("u").alias("m"), F.lit(1).alias("over")))
        least = own.groupBy("u").agg(F.min("m").alias("m"), F.sum("over").alias("n")).filter("n > 0")
        large = lookup(down, least, "u", "n", total=state[0] if state else edges.count()).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = cut(small)
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_limit: int = CELL_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(classes.select("fp", F.col("fp").alias("node")), cell_limit))
    placed = cut(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    labelled = lookup(placed, names, "root", "size").select("fp", "n", "component_id")
    return lookup(prints, labelled, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that have the smallest doc_id of their component.

    Rows without a doc_id cannot be told apart and stay; so do all rows of a doc_id of which one stays.
    """
    kept = near_duplicates(docs.filter(F.col("doc_id").isNotNull())).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(packed(docs).alias("doc"), F.col("doc_id").alias("id"))
    return unpacked(rows.join(kept, "id", "left_semi").select("doc").unionAll(rows.filter(F.col("id").isNull()).select("doc")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns as they are: that of the smallest doc_id, one without a doc_id only if all
    rows of the component are.  Rows are told apart by a key of their own, not by their ids."""
    rows = keyed(docs)
    found = near_duplicates(rows.select("row", "doc.text"), "row").select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    first = found.join(rows.select("row", "doc.doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    return unpacked(rows.join(first, "row", "left_semi"))
