"""Hard-negative mining with a pivot table.

Vectors are multiplied by SCALE and floored, scores are integer inner products.  A further component, the root of M - |x|^2
with M the largest |x|^2 of all rows (0 for an anchor), makes a greater inner product a smaller Euclidean distance:
d^2 = M + |q|^2 - 2 <q, x>.  Pivots are drawn from a bounded sample; every row is stored with its distances to them, and
rows are laid out by nearest pivot and distance to it, so that what is read together lies together.  By the triangle
inequality the distances bracket a score: first for all rows of a batch at once (the least and greatest stored distances),
then for each row.  Whatever can neither be among an anchor's best nor in its window is left out; what survives is scored
exactly.  Brackets are widened by far more than rounding, so no row is lost.

Anchors come in blocks of bounded size, which all rows are read against: once for the positives, once for the negatives
of those.  A task keeps the best rows of each anchor so far, and nothing else leaves it.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; only vectors
of one length are compared; a row's own id is never among its positives or negatives, and rows that repeat an id are
candidates each, as are equal vectors; an anchor without a row of its label has no positives and no rows in the result,
nor has a positive whose window holds no row (as every window of a score below 0).  Scores outside 64 bits are held at its
ends.  An empty table has no rows.  Only the id, label and vector columns are read, so further columns may have any name.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder, table, written

#: A component times SCALE, floored, is an integer.  Positives of an anchor, negatives of a positive, the window in per cent.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256.0, 5, 10, 30, 90
#: Rows that pivots are drawn from, pivots, anchors that rows are read against at once.
DRAWN, PIVOTS, ANCHORS = 1024, 12, 8192
_ROWS = "vec_id long, label string, v array<double>, norm double, near int, dist array<double>"


def usable(rows: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """vec_id, label, v of the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(~bad)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors of a list column: which rows have it, and they as a matrix."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    values = column.flatten().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        yield which, values[begins[which][:, None] + np.arange(size)]


def _integers(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of integers held as doubles."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ x.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)


def _chosen(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Pivots for each length of vector: the first, then again and again what is farthest from those chosen."""
    out = {}
    for size in {len(v) for v in sample}:
        m = np.array([v for v in sample if len(v) == size])
        at, gap = [0], ((m - m[0]) ** 2).sum(1)
        while len(at) < min(PIVOTS, len(m)) and gap.max() > 0:
            at.append(int(gap.argmax()))
            gap = np.minimum(gap, ((m - m[at[-1]]) ** 2).sum(1))
        out[size] = m[at]
    return out


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray, most: float) -> np.ndarray:
    """Of vectors with a further component to pivots with theirs."""
    beside = np.sqrt(np.maximum(most - (pivots**2).sum(1), 0))
    squares = (v**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (v @ pivots.T) + (extra[:, None] - beside) ** 2
    return np.sqrt(np.maximum(squares, 0))


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = [float((_integers(m) ** 2).sum(1).max(initial=0)) for _, m in _matrices(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([max(tops, default=0.0)])], names=["norm"])


def pivot_table(rows: DataFrame, most: float, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Rows with integer vectors, squared norms, the nearest pivot and the distances to all, laid out by both and written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, v in _matrices(batch.column(2)):
                v = _integers(v)
                norm = (v**2).sum(1)
                near = pivots.get(v.shape[1], v[:0])
                dist = _distances(v, np.sqrt(np.maximum(most - norm, 0)), near, most)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in (v, dist)]
                own = [c.take(pa.array(which)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, lists[0], pa.array(norm), pa.array(dist.argmin(1).astype(np.int32) if dist.shape[1] else np.zeros(len(v), np.int32)), lists[1]], names=["vec_id", "label", "v", "norm", "near", "dist"])

    laid = rows.mapInArrow(run, _ROWS).repartitionByRange("near", F.get("dist", F.col("near")), "vec_id").sortWithinPartitions("near", F.get("dist", F.col("near")))
    return written(laid.withColumn("row", F.monotonically_increasing_id()), f"{shared_folder(rows.sparkSession)}/pivots-{uuid.uuid4().hex}")


class _Best:
    """The best k rows of each query so far: by score, then by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, np.iinfo(np.int64).min)
        self.q, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ok: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> None:
        """scores of queries x ids, of which ok may count."""
        ok = ok & (scores >= self.least[queries][:, None])
        if ok.sum() > 8 * self.k * len(queries) and scores.shape[1] > self.k:
            held = np.where(ok, scores, np.iinfo(np.int64).min)
            ok &= held >= np.partition(held, -self.k, axis=1)[:, -self.k][:, None]
        at, of = np.nonzero(ok)
        if not len(at):
            return
        q, score, own = np.concatenate([self.q, queries[at]]), np.concatenate([self.score, scores[at, of]]), np.concatenate([self.id, ids[of]])
        order = np.lexsort((own, -score.astype(np.float64) if abs(int(score.min())) < 2**53 and abs(int(score.max())) < 2**53 else ~score, q))
        q, score, own = q[order], score[order], own[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[keep], own[keep]
        full = rank == self.k - 1
        self.least[q[full]] = score[full]


class _Anchors:
    """A block of anchors of one length of vector, ready for scans."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, labels: list[str], v: np.ndarray, pivots: np.ndarray, most: float):
        self.at, self.ids, self.v, self.names = at, ids, v, {}
        self.labels = np.array([self.names.setdefault(x, len(self.names)) for x in labels], np.int64)
        self.square = most + (v**2).sum(1)
        self.dist = _distances(v, np.zeros(len(v)), pivots, most)
        self.slack = 1e-9 * self.square + 1e-6

    def highest(self, gap: np.ndarray, which=slice(None)) -> np.ndarray:
        """The greatest score at this distance or beyond."""
        s, e = self.square[which], self.slack[which]
        return ((s - gap.T**2) / 2 + e).T

    def scan(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, dist: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """anchors, rows, scores, survives for anchors x rows whose score may lie from least to most (of each anchor)."""
        if not self.dist.shape[1]:
            every = np.arange(len(v))
            yield np.arange(len(self.ids)), every, products(self.v, v), np.ones((len(self.ids), len(v)), bool)
            return
        # all rows of the batch at once
        gap = np.maximum(np.maximum(self.dist - dist.max(0), dist.min(0) - self.dist), 0).max(1)
        far = (self.dist + dist.max(0)).min(1)
        open_ = np.flatnonzero((self.highest(gap) >= least) & (self.highest(far) - 2 * self.slack <= most))
        for part in np.array_split(open_, max(1, len(open_) * len(v) // 4_000_000)):
            if not len(part):
                continue
            # then each row
            gap, far = np.zeros((len(part), len(v))), np.full((len(part), len(v)), np.inf)
            for p in range(dist.shape[1]):
                own, other = self.dist[part, p][:, None], dist[:, p]
                np.maximum(gap, np.abs(own - other), out=gap)
                np.minimum(far, own + other, out=far)
            survives = (self.highest(gap, part) >= least[part][:, None]) & (self.highest(far, part) - 2 * self.slack[part][:, None] <= most[part][:, None])
            rows = np.flatnonzero(survives.any(0))
            if len(rows):
                yield part, rows, products(self.v[part], v[rows]), survives[:, rows]


def _blocks_of(data: bytes) -> list[_Anchors]:
    columns, pivots, most = pickle.loads(data)
    at, ids, labels, v = columns
    out = []
    for size in {len(x) for x in v}:
        which = np.array([i for i, x in enumerate(v) if len(x) == size])
        out.append(_Anchors(at[which], ids[which], [labels[i] for i in which], np.array([v[i] for i in which], float).reshape(len(which), size), pivots.get(size, np.empty((0, size))), most))
    return out


def _read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """ids, labels, vectors and distances of the rows of a batch, for each length of vector."""
    for which, v in _matrices(batch.column(2)):
        dist = batch.column(3).take(pa.array(which))
        width = len(dist.flatten()) // len(which)
        yield batch.column(0).to_numpy(zero_copy_only=False)[which], batch.column(1).take(pa.array(which)), v, dist.flatten().to_numpy(zero_copy_only=False).reshape(len(which), width)


def _codes(labels: pa.Array, names: dict[str, int]) -> np.ndarray:
    coded = labels.dictionary_encode()
    return np.array([names.get(x, -1) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def _positives(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks_of(shared.value)
        best = [_Best(len(b.ids), k) for b in blocks]
        for batch in batches:
            for ids, names, v, dist in _read(batch):
                for b, top in zip(blocks, best, strict=True):
                    if b.v.shape[1] != v.shape[1]:
                        continue
                    labels = _codes(names, b.names)
                    for part, rows, scores, ok in b.scan(ids, labels, v, dist, top.least.astype(float), np.full(len(b.ids), np.inf)):
                        top.add(scores, ok & (b.labels[part][:, None] == labels[rows]) & (b.ids[part][:, None] != ids[rows]), part, ids[rows])
        for b, top in zip(blocks, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(b.at[top.q]), pa.array(top.id), pa.array(top.score)], names=["at", "vec_id", "score"])

    return run


def _negatives(shared, found, k: int, low: int, high: int):
    """found: at, rank of the positive, score of the positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks_of(shared.value)
        at, rank, score = found.value
        ranks = int(rank.max(initial=0))
        windows = []
        for b in blocks:
            place = {a: i for i, a in enumerate(b.at.tolist())}
            least, most = (np.full((ranks, len(b.ids)), x, np.int64) for x in (1, 0))
            for a, r, s in zip(at.tolist(), rank.tolist(), score.tolist(), strict=True):
                if a in place:
                    least[r - 1, place[a]], most[r - 1, place[a]] = -((-low * s) // 100), (high * s) // 100
            windows.append((least, most, [_Best(len(b.ids), k) for _ in range(ranks)]))
        for batch in batches:
            for ids, names, v, dist in _read(batch):
                for b, (least, most, best) in zip(blocks, windows, strict=True):
                    if b.v.shape[1] != v.shape[1]:
                        continue
                    labels = _codes(names, b.names)
                    floors = np.array([np.maximum(x, t.least) for x, t in zip(least, best, strict=True)]).reshape(ranks, -1)
                    some = np.where(floors <= most, floors, np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max).astype(float)
                    for part, rows, scores, ok in b.scan(ids, labels, v, dist, some, most.max(0, initial=0).astype(float)):
                        ok = ok & (b.labels[part][:, None] != labels[rows]) & (b.ids[part][:, None] != ids[rows])
                        for lo, hi, top in zip(least, most, best, strict=True):
                            top.add(scores, ok & (scores >= lo[part][:, None]) & (scores <= hi[part][:, None]), part, ids[rows])
        for b, (_, _, best) in zip(blocks, windows, strict=True):
            for r, top in enumerate(best, 1):
                yield pa.RecordBatch.from_arrays([pa.array(b.at[top.q]), pa.array(np.full(len(top.q), r, np.int32)), pa.array(top.id), pa.array(top.score)], names=["at", "of", "vec_id", "score"])

    return run


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: a condition on vec_id; label: a column of rows.  The driver holds DRAWN vectors for the pivots, then one block
    of anchors at a time with their positives.
    """
    spark = rows.sparkSession
    own = usable(rows, id_col, F.col("label") if label is None else label, vector_col)
    most = own.select("v").mapInArrow(_norms, "norm double").agg(F.max("norm").alias("m")).first().m or 0.0
    drawn = own.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(DRAWN).collect()
    pivots = _chosen([_integers(np.array(r.v, float)) for r in drawn])
    stored = pivot_table(own, most, pivots)
    asked = stored.filter(anchors)
    blocks = -(-asked.count() // ANCHORS)
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], kinds)
    scanned = stored.select("vec_id", "label", "v", "dist")
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).select("row", "vec_id", "label", "v").collect()
        columns = np.array([r.row for r in block], np.int64), np.array([r.vec_id for r in block], np.int64), [r.label for r in block], [r.v for r in block]
        shared = spark.sparkContext.broadcast(pickle.dumps((columns, pivots, most)))
        best = _ranked(scanned.mapInArrow(_positives(shared, positives), "at long, vec_id long, score long"), ["at"], positives).collect()
        found = spark.sparkContext.broadcast(tuple(np.array([r[i] for r in best], np.int64) for i in (0, 3, 2)))
        chosen = spark.createDataFrame([(r.at, r.rank, r.vec_id, r.score) for r in best], "at long, of int, positive_id long, positive_score long")
        named = spark.createDataFrame([(r.row, r.vec_id) for r in block], "at long, anchor_id long")
        worst = _ranked(scanned.mapInArrow(_negatives(shared, found, negatives, low, high), "at long, of int, vec_id long, score long"), ["at", "of"], negatives)
        told = worst.join(F.broadcast(chosen), ["at", "of"]).join(F.broadcast(named), "at")
        out = out.unionAll(written(told.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), f"{folder}/{k}"))
        shared.unpersist()
        found.unpersist()
    return out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
