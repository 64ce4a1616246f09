"""Toxic passages by maximum-scoring segments over token log-odds.

Learning: labelled documents of both classes, at most SAMPLE_ROWS of each (those with the smallest hashes of their
ids), are cut into lower-cased words.  Features of a word are the word and its PREFIXES leading letters.  A feature's
score is its log-odds between the classes, by the number of documents that have it, under a Dirichlet prior in
proportion to its overall frequency; features below MIN_Z standard deviations are left at the background score.  A word
takes the score of its most telling feature.  Half of the sample gives the log-odds, the other half calibrates.

Scoring: the words' scores are scanned once in linear time for all maximal-scoring segments.  In a text of n words a
segment's score S has, without toxicity, the extreme-value tail 1 - exp(-K n exp(-L S)), where L and K are the most
likely ones for the best segments of clean sample documents and their lengths.  n counts all words of the text, so it does
not matter where in it a passage stands.  The log tails of a document's segments are added up, and a logistic curve fitted
on the held-back half turns the sum into a score from 0 to 1.

Defined results: null or empty text has no segment and gets the curve's value at 0; a null label does not train; a null
id does not train and is not held out; equal rows train once and are scored one by one; an id with several labels is toxic
if one of them is.  Without toxic or clean rows the score is the share of toxic labels, or 0.  Very long texts are scored
whole.  Words may be long; only their leading letters and the whole count.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fold, hash_sample, per_batch, sampled, table

SAMPLE_ROWS, PREFIXES, MIN_Z, MIN_COUNT = 1000, (3, 4, 5, 6), 4.0, 4
#: Features that the driver and each worker hold at most, those with the largest |z|.
MAX_FEATURES = 100_000
#: The prior's weight, as a share of all counts; the score of words that tell nothing, which keeps the expected score of
#: clean text below 0, as the extreme-value tail demands.
PRIOR, BACKGROUND, THRESHOLD, MEMO = 0.1, -0.5, 0.3, 400_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word, and its leading letters marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), by start; linear time (Ruzzo and Tompa)."""
    kept: list[tuple[int, int, float, float]] = []  # start, end, cumulated before, cumulated after
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = (i, i + 1, total, total + s)
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = (kept[j][0], new[1], kept[j][2], new[3])
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after in kept]


class Scorer:
    """Word scores, segments and the calibrated score of a text."""

    def __init__(self, model: dict):
        self.table, self.background = model["scores"], model["background"]
        self.rate, self.log_k, self.slope, self.base = model["rate"], model["log_k"], model["slope"], model["base"]
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        own = [self.table[f] for f in features(w) if f in self.table]
        score = max(own, key=abs) if own else self.background
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[w] = score
        return score

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """The segments of a text, and the number of its words."""
        own, memo = words(text), self.memo
        return segments([memo[w] if w in memo else self.word(w) for w in own]), len(own)

    def tails(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """The segments with -ln of their extreme-value tails."""
        found, n = self.passages(text)
        log_n = math.log(max(1, n))
        return [(a, b, s, tail_of(s, log_n, self.rate, self.log_k)) for a, b, s in found]

    def evidence(self, text: str | None) -> float:
        """Sum of -ln of the tails of the segments that are unlikely by themselves, from the least on, so that the sum is
        the same in any order of the passages."""
        return math.fsum(tail for *_, tail in self.tails(text) if tail > 1.0)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.base + self.slope * math.log1p(self.evidence(text))))))


def tail_of(score: float, log_n: float, rate: float, log_k: float) -> float:
    """-ln(1 - exp(-K n exp(-rate score)))."""
    x = log_k + log_n - rate * score
    if x < -30:
        return -x
    return -math.log(-math.expm1(-math.exp(min(x, 30.0))) or 1e-300)


def log_odds(c1: Column, c0: Column, n1: float, n0: float) -> tuple[Column, Column]:
    """A feature's log-odds between the classes and its z, from counts c1 of n1 and c0 of n0.

    The Dirichlet prior spreads PRIOR of all counts over the features by their overall frequency.
    """
    pooled = PRIOR * (c1 + c0) / F.lit(float(n1 + n0))
    x1, x0 = c1 + pooled * n1, c0 + pooled * n0
    delta = F.log(x1 / (n1 * (1 + PRIOR) - x1)) - F.log(x0 / (n0 * (1 + PRIOR) - x0))
    return delta, delta / F.sqrt(1 / x1 + 1 / x0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model as a dict of bounded size.

    The sample is chosen on ids; its documents are counted in Spark; only counts of features, at most MAX_FEATURES scores
    and one number pair for each sample document reach the driver.
    """
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).select(F.col(label_id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    own = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = sampled(own, hash_sample(marked, "id", "toxic", sample_rows), sample_rows, ["id"]).select(F.col("group").alias("toxic"), (F.col("k") % 2).alias("half"), "text")
    share = marked.agg(F.avg("toxic").alias("s")).first()["s"] or 0.0

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {0: Counter(), 1: Counter()}
        for text, toxic, half in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), batch.column("half").to_pylist(), strict=True):
            if half == 1:
                found[toxic].update({f for w in set(words(text)) for f in features(w)})
        rows = [(k, f, n) for k, c in found.items() for f, n in c.items()]
        kinds = (pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], ["toxic", "feature", "n"])

    counted = per_batch(sample, count, "toxic int, feature string, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c0"))
    counts = counted.filter(F.col("c1") + F.col("c0") >= MIN_COUNT)
    sums = counted.agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")).first()
    n1, n0 = sums["n1"] or 0, sums["n0"] or 0
    flat = {"scores": {}, "background": -1.0, "rate": 1.0, "log_k": 0.0, "slope": 0.0, "base": math.log(max(share, 1e-9) / max(1 - share, 1e-9))}
    if not n1 or not n0:
        return flat
    delta, z = log_odds(F.col("c1"), F.col("c0"), float(n1), float(n0))
    scored = counts.select("feature", delta.alias("delta"), z.alias("z"))
    telling = scored.filter(F.abs("z") >= MIN_Z).orderBy(F.desc(F.abs("z")), "feature").limit(MAX_FEATURES).collect()
    model = flat | {"scores": {r.feature: r.delta for r in telling}, "background": BACKGROUND}
    return calibrate(model, sample, share)


_scorers: dict[str, Scorer] = {}


def _scorer(shared) -> Scorer:
    key, model = shared.value
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def calibrate(model: dict, sample: DataFrame, share: float) -> dict:
    """Fits the tail to the best segments of clean documents and the logistic curve to both classes of the other half."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, model))

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _scorer(shared)
        rows = []
        for text in batch.column("text").to_pylist():
            found, n = own.passages(text)
            rows.append((max((s for _, _, s in found), default=0.0), max(1, n)))
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], ["toxic", "best", "n"])

    other = sample.filter("half = 0")
    seen = per_batch(other, best, "toxic int, best double, n long").toPandas()
    clean = seen[seen.toxic == 0]
    if not len(clean):
        return model
    rate, log_k = tail_fit(clean.best.to_numpy(float), clean.n.to_numpy(float))
    model = model | {"rate": rate, "log_k": log_k}
    shared2 = spark.sparkContext.broadcast((uuid.uuid4().hex, model))

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _scorer(shared2)
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([math.log1p(own.evidence(t)) for t in batch.column("text").to_pylist()], pa.float64())], ["toxic", "x"])

    seen = per_batch(other, weigh, "toxic int, x double").toPandas()
    y, x = seen.toxic.to_numpy(float), seen.x.to_numpy(float)
    if 0 < y.sum() < len(y):
        part = y.mean()
        weight = np.where(y > 0, share / part, (1 - share) / (1 - part))  # back to the classes' real shares
        model["slope"], model["base"] = logistic(x, y, weight)
    return model


def tail_fit(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """The most likely L and ln K for best scores S of texts of n words, where P(S < x) = exp(-K n exp(-L x)).

    At a given L the best K is N / sum(n exp(-L S)); the derivative of what is left falls in L, so its zero is bisected.
    """
    low, high = 0.02, 20.0
    for _ in range(80):
        rate = (low + high) / 2
        weight = n * np.exp(-rate * (best - best.min()))
        slope = 1 / rate - best.mean() + (weight @ best) / weight.sum()
        low, high = (rate, high) if slope > 0 else (low, rate)
    return rate, float(np.log(len(best)) - np.log(np.sum(n * np.exp(-rate * (best - best.min())))) + rate * best.min())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a small ridge on the slope."""
    b = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -40, 40)))
        grad = design.T @ (weight * (y - p)) - ridge * b
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, grad)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def with_score(docs: DataFrame, model: dict, out_col: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a column of the score of the text."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        own = _scorer(shared)
        return pa.array([own.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(out_col, judge(F.col(text_col).cast("string")))


def with_passages(docs: DataFrame, model: dict, out_col: str = "passages", text_col: str = "text") -> DataFrame:
    """docs with the maximal-scoring segments of each text: words from a to b (exclusive), score and -ln of the tail."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64()), ("tail", pa.float64())]))

    @F.arrow_udf("array<struct<a:long,b:long,score:double,tail:double>>")
    def find(texts: pa.Array) -> pa.Array:
        own, out = _scorer(shared), []
        for t in texts:
            out.append([{"a": a, "b": b, "score": s, "tail": tail} for a, b, s, tail in own.tails(t.as_py())])
        return pa.array(out, kind)

    return docs.withColumn(out_col, find(F.col(text_col).cast("string")))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs.filter(~fold("doc_id", 4, 2)), labels.filter(~fold("doc_id", 4, 2)))
    scored = with_score(docs, model)
    return scored.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
