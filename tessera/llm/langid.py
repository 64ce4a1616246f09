"""Language identification with language-bitmask n-gram filters.

Training takes whole texts of labelled rows, at most SAMPLE_ROWS for each language (those with the smallest hashes of
their ids), counts their character n-grams in Spark, and keeps the KEPT_NGRAMS most frequent of each language.  These
go into one bit-sliced Bloom filter: a table of 2^FILTER_BITS words in which bit l of a word belongs to language l.
ANDing the words at an n-gram's HASHES positions gives the mask of all languages that hold it.  A text's popcount for
a language is the number of its n-grams with that bit; with f the filter's false-positive rate of the language and n
the number of n-grams, (popcount - n*f) / (1 - f) corrects it.  The largest corrected count decides (ties: the first
language by name); the score is that count over n.

Defined results: null text, or text without a letter, is `und` with score 0; text whose n-grams no language holds gets
the language with most training n-grams, score 0; without any labelled row every text is `und`; a null id is not held
out and does not train; equal rows are judged one by one and train once; very long texts are read whole.  The model has
KEPT_NGRAMS n-grams a language and 2^FILTER_BITS words for each 64 languages; no language is left out.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fold, hash_sample, packed, per_batch, sampled, table, unpacked

NGRAM, SAMPLE_ROWS, KEPT_NGRAMS = 4, 1000, 12_000
FILTER_BITS, HASHES = 19, 3
UNKNOWN = "und"
#: The pipeline rejects texts below this score, and `und`.
LEAST_SCORE = 0.2
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_MIX = [np.uint64(x) for x in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x10000)])
    low = codes < 0x10000
    out = _letters[np.where(low, codes, 0)]
    if not low.all():
        out[~low] = [chr(c).isalpha() for c in codes[~low]]
    return out


def ngrams(text: str | None) -> tuple[np.ndarray, bool]:
    """64-bit codes of the n-grams of a text's lower-cased letters, with one gap between words; whether it has a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _is_letter(codes)
    if not letter.any():
        return np.empty(0, np.uint64), False
    codes = np.where(letter, codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    codes = np.concatenate(([0], codes[keep], [0])).astype(np.uint64)
    if len(codes) < NGRAM:
        codes = np.concatenate((codes, np.zeros(NGRAM - len(codes), np.uint64)))
    n = len(codes) - NGRAM + 1
    out = np.zeros(n, np.uint64)
    for i in range(NGRAM):
        part = codes[i : i + n] + np.uint64(1)
        part *= _ODD[i]
        part ^= part >> np.uint64(29)
        out ^= part * _ODD[(i + 1) % len(_ODD)]
        out = (out << np.uint64(7)) | (out >> np.uint64(57))
    return out, True


def _positions(grams: np.ndarray) -> list[np.ndarray]:
    return [((grams * m) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for m in _MIX[:HASHES]]


class Filters:
    """The bit-sliced filter of up to any number of languages, 64 to a plane."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.langs = sorted(grams)
        self.planes = []
        self.false_rate = np.zeros(len(self.langs))
        for first in range(0, len(self.langs), 64):
            own = self.langs[first : first + 64]
            plane = np.zeros(1 << FILTER_BITS, np.uint8 if len(own) <= 8 else np.uint64)
            for bit, lang in enumerate(own):
                for at in _positions(grams[lang]):
                    plane[at] |= plane.dtype.type(1 << bit)
                self.false_rate[first + bit] = ((plane >> plane.dtype.type(bit)) & plane.dtype.type(1)).mean() ** HASHES
            self.planes.append(plane)
        self.largest = max(self.langs, key=lambda x: (len(grams[x]), x)) if self.langs else UNKNOWN

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each plane, the languages of each n-gram."""
        at = _positions(grams)
        out = []
        for plane in self.planes:
            mask = plane[at[0]]
            for x in at[1:]:
                mask &= plane[x]
            out.append(mask)
        return out

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Corrected popcount of each language."""
        raw = []
        for plane, mask in enumerate(self.masks(grams)):
            for bit in range(len(self.langs[64 * plane : 64 * plane + 64])):
                raw.append(np.count_nonzero(mask & mask.dtype.type(1 << bit)))
        n = len(grams)
        return np.maximum(0, (np.array(raw) - n * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, some = ngrams(text)
        if not some or not self.langs:
            return UNKNOWN, 0.0
        counts = self.counts(grams)
        best = int(np.argmax(counts))
        if counts[best] <= 0:
            return self.largest, 0.0
        return self.langs[best], min(1.0, float(counts[best]) / len(grams))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, kept: int = KEPT_NGRAMS) -> dict[str, np.ndarray]:
    """The n-gram codes of each language, from a bounded sample of the labelled rows of docs."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    own = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("group"), F.col(text_col).cast("string").alias("text"))
    # ids only: the texts are not moved for the choice
    sample = sampled(own, hash_sample(own, "id", "group", sample_rows), sample_rows, ["id", "group"])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("group").to_pylist(), batch.column("text").to_pylist(), strict=True):
            grams, some = ngrams(text)
            if some:
                found.setdefault(lang, []).append(grams)
        langs, codes, counts = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lang, parts in found.items():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            langs += [lang] * len(code)
            codes.append(code.view(np.int64))
            counts.append(n)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))], ["lang", "gram", "n"])

    counted = per_batch(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= kept)
    out: dict[str, list[int]] = {}
    for r in top.select("lang", "gram").toLocalIterator():
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(grams, np.int64).view(np.uint64) for lang, grams in out.items()}


_models: dict[str, Filters] = {}


def with_language(docs: DataFrame, grams: dict[str, np.ndarray], out_col: str = "language", text_col: str = "text") -> DataFrame:
    """docs with a column struct<lang_pred, score>."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, grams))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        key, own = shared.value
        if key not in _models:
            _models.clear()
            _models[key] = Filters(own)
        found = [_models[key].predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(out_col, predict(F.col(text_col).cast("string")))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grams = train(docs.select("doc_id", "text", "lang").filter(~fold("doc_id", 3, 1)))
    return with_language(docs.select("doc_id", "text"), grams).select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "language.lang_pred", "language.score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is in one of the languages of docs; `und` and texts that hardly share n-grams with any language go."""
    grams = train(docs.select("doc_id", "text", "lang"))
    inner = docs.select(packed(docs).alias("doc"), F.col("text"))
    return unpacked(with_language(inner, grams).filter((F.col("language.lang_pred") != UNKNOWN) & (F.col("language.score") >= LEAST_SCORE)))
