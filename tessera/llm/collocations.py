"""Phrase collocations from vertical positional inverted lists.

Texts are cut to pieces, pieces to words.  Words are numbered along blocks of bounded size, with a gap wherever a piece
ends; a block holds an inverted list of positions for each of its words.  Level by level, the lists of frequent phrases
are extended: the positions that follow a phrase are merge-joined with the postings of the frequent words, and what meets
is the list of a longer phrase.  The lengths of a phrase's lists in all blocks add up to its exact frequency.  Between
levels only keys travel: every list has a 48-bit key, keys with enough occurrences in all are told to the blocks that have
them, and the phrases of those lists are counted again by their words, so that keys that collide change nothing.

A candidate's score is the least, over its cuts in two, of floor(10^6 a a / (l r)), in decimals of 38 digits: exact up to
10^16 occurrences.

Defined results: null text is empty, null lang is 'und' and meets documents of that lang; equal rows count one by one; a
text larger than a block is cut where a piece ends; empty tables, and tables without a frequent phrase, have no rows;
ties of score and frequency come by the phrase's bytes.  Only the text and lang columns are read, so further columns may
have any name.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free, removed, shared_folder, table, written

#: Bytes of text that a block holds; a piece is never cut, so that a longer one makes a larger block.
BLOCK_BYTES = 8 << 20
LEAST, LONGEST, SHARE, TOP, MILLION = 10, 3, 50, 2000, 1_000_000
#: A-Z to a-z, tab to space, the ends of pieces to line feeds.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if chr(b) in ".,;:!?\n\v\f\r" else b for b in range(256))
_BLOCK = "block long, lang string, words array<string>, lens array<int>, positions binary, phrases array<string>, counts array<int>, starts array<int>, alive binary, lists long, keys binary, sizes binary"
#: Keys of lists that one task compares; keys have so many bits.
PART_KEYS, KEY_BITS = 2_000_000, 48
_CODEC = pa.Codec("zstd", 1)


def _packed(numbers: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers as differences, their bytes by place, compressed."""
    raw = np.ascontiguousarray(np.diff(numbers.astype(kind), prepend=np.zeros(1, kind)).view(np.uint8).reshape(len(numbers), -1).T).tobytes() if len(numbers) else b""
    return len(raw).to_bytes(8, "little") + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def _unpacked(data: bytes, kind: str = "<i4") -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.empty(0, kind)
    raw = np.frombuffer(_CODEC.decompress(data[8:], size, asbytes=True), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(kind).ravel(), dtype=kind)


def _grouped(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and places (neither negative) sorted by group, then place: as one number, where both have room in 63 bits."""
    bits = int(place.max(initial=0)).bit_length()
    if int(group.max(initial=0)).bit_length() + bits > 63:
        order = np.lexsort((place, group))
        return group[order], place[order]
    both = np.sort(group.astype(np.int64) << bits | place)
    return both >> bits, (both & ((1 << bits) - 1)).astype(np.int32)


def inverted(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """words, the length of each word's list, and the lists one after another, of translated bytes."""
    data = np.frombuffer(raw, np.uint8)
    word = (data != 32) & (data != 10)
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum(data == 10, dtype=np.int32)[begin]
    at = np.arange(len(begin), dtype=np.int32) + np.cumsum(np.diff(ends, prepend=ends[:1]) > 0, dtype=np.int32)
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[word].tobytes())]).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, np.bincount(number, minlength=len(coded.dictionary)).astype(np.int32), _grouped(number, at)[1]


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Translated text in parts of up to so many bytes, cut where pieces end."""
    text = text.translate(_TABLE)
    while len(text) > size:
        at = text.rfind(b"\n", 0, size)
        at = text.find(b"\n", size) if at < 0 else at
        if at < 0:
            break
        yield text[: at + 1]
        text = text[at + 1 :]
    yield text


def _word_keys(lang: str, words: list[bytes | str]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _longer(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases of these keys extended by words of those."""
    x = keys * np.uint64(0x9E3779B97F4A7C15) + (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Lists:
    """Phrases of one length in a block, by key: for each, its words' numbers, its key, and the positions where it begins."""

    def __init__(self, words: np.ndarray, keys: np.ndarray, lens: np.ndarray, starts: np.ndarray):
        self.words, self.keys, self.lens, self.starts = words, keys, lens, starts

    def by_key(self) -> _Lists:
        keys = self.keys >> np.uint64(64 - KEY_BITS)
        order = np.argsort(keys)
        if (np.diff(keys[order]) == 0).any():  # else there is one order only, however it was found
            order = np.argsort(keys, kind="stable")
        lens, begins = self.lens[order], (np.cumsum(self.lens) - self.lens)[order]
        at = np.arange(len(self.starts)) + np.repeat(begins - (np.cumsum(lens) - lens), lens)
        return _Lists(self.words[order], self.keys[order], lens, self.starts[at])

    def only(self, which: np.ndarray) -> _Lists:
        keep = np.zeros(len(self.lens), bool)
        keep[which] = True
        return _Lists(self.words[keep], self.keys[keep], self.lens[keep], self.starts[np.repeat(keep, self.lens)])

    def extended(self, postings: _Lists) -> _Lists:
        """Merge join of the positions that follow each phrase with the postings of all words: lists of longer phrases."""
        order = np.argsort(postings.starts)
        places, owner = postings.starts[order], np.repeat(np.arange(len(postings.lens)), postings.lens)[order]
        order = np.argsort(self.starts)
        phrase, starts = np.repeat(np.arange(len(self.lens)), self.lens)[order], self.starts[order]
        follow = starts + self.words.shape[1]
        at = np.searchsorted(places, follow)
        met = np.flatnonzero(at < len(places))
        met = met[places[at[met]] == follow[met]]
        # the words that come next, numbered apart within each phrase
        pair, starts = _grouped(phrase[met] * len(postings.lens) + owner[at[met]], starts[met])
        begin = np.flatnonzero(np.diff(pair, prepend=-1))
        pairs, lens = pair[begin], np.diff(np.append(begin, len(pair)))
        first, last = pairs // max(1, len(postings.lens)), pairs % max(1, len(postings.lens))
        return _Lists(np.column_stack([self.words[first], last]).astype(np.int32), _longer(self.keys[first], postings.keys[last]), lens.astype(np.int32), starts).by_key()


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "lang": pa.string(), "words": pa.list_(pa.string()), "lens": pa.list_(pa.int32()), "positions": pa.binary(), "phrases": pa.list_(pa.string()), "counts": pa.list_(pa.int32()), "starts": pa.list_(pa.int32()), "alive": pa.binary(), "lists": pa.int64(), "keys": pa.binary(), "sizes": pa.binary()}

    def column(name: str, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_list(kind):
            return pa.array([r[name] for r in rows], kind)
        parts = [r[name] if isinstance(r[name], pa.Array) else pa.array(r[name], kind.value_type) for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(parts))

    return pa.RecordBatch.from_arrays([column(n, k) for n, k in kinds.items()], names=list(kinds))


def _row(block: int, lang: str, words: pa.Array, postings: _Lists, now: _Lists | None, following: _Lists) -> dict:
    """A block's row: postings, the frequent phrases (now) with their lists, and the keys of the next length (following)."""
    held = now if now is not None else postings.only(np.empty(0, np.int64))
    said = words.take(pa.array(held.words[:, 0]))
    for k in range(1, held.words.shape[1]):
        said = pc.binary_join_element_wise(said, words.take(pa.array(held.words[:, k])), " ")
    return {
        "block": block, "lang": lang, "words": words, "lens": postings.lens, "positions": _packed(postings.starts), "phrases": said, "counts": held.lens,
        "starts": held.words.ravel(), "alive": _packed(held.starts if held.words.shape[1] > 1 else held.starts[:0]), "lists": len(following.lens),
        "keys": _packed(following.keys >> np.uint64(64 - KEY_BITS), "<u8"), "sizes": _packed(following.lens),
    }


def _postings(lang: str, words: pa.Array, lens: np.ndarray, positions: np.ndarray) -> _Lists:
    return _Lists(np.arange(len(words), dtype=np.int32)[:, None], _word_keys(lang, words.to_pylist()), lens, positions)


def _block(number: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    words, lens, positions = inverted(b"\n".join(texts))
    postings = _postings(lang, words, lens, positions).by_key()
    words = words.take(pa.array(postings.words[:, 0]))
    postings.words = np.arange(len(words), dtype=np.int32)[:, None]
    return _batch([_row(number, lang, words, postings, None, postings)])


def _dealt(bits: int):
    """The keys of blocks' lists, dealt by their first bits: part, block, the number of the first list, keys and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, sizes in zip(*(batch.column(n).to_pylist() for n in ("block", "keys", "sizes")), strict=True):
                keys, sizes = _unpacked(keys, "<u8"), _unpacked(sizes)
                if not len(keys):
                    continue
                part = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
                begin = np.flatnonzero(np.diff(part, prepend=-1))
                end = np.append(begin[1:], len(part))
                rows = [(int(part[b]), block, int(b), _packed(keys[b:e], "<u8"), _packed(sizes[b:e])) for b, e in zip(begin, end, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "block", "first", "keys", "sizes"])

    return run


def _common(least: int):
    """Of all blocks' lists with keys of a part, those whose keys occur often enough in all: block and list numbers."""

    def run(group: pa.Table) -> pa.Table:
        keys, sizes = [_unpacked(x, "<u8") for x in group["keys"].to_pylist()], [_unpacked(x) for x in group["sizes"].to_pylist()]
        of, ends = np.concatenate(keys), np.cumsum([len(k) for k in keys])
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0]))
        often = np.add.reduceat(np.concatenate(sizes).astype(np.int64)[order], first) >= least
        keep = np.empty(len(of), bool)
        keep[order] = np.repeat(often, np.diff(np.append(first, len(of))))
        numbers = [np.flatnonzero(k) + f for k, f in zip(np.split(keep, ends[:-1]), group["first"].to_pylist(), strict=True)]
        rows = [(b, _packed(n)) for b, n in zip(group["block"].to_pylist(), numbers, strict=True) if len(n)]
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "own": pa.array([n for _, n in rows], pa.binary())})

    return run


def _cut_blocks(size: int):
    """Blocks of one lang each; a task holds at most two blocks' worth of texts before it closes the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in _pieces(text.as_py().encode(), size):
                    while sizes and (lang in sizes and sizes[lang] + len(part) > size or sum(sizes.values()) > 2 * size):
                        full = max(sizes, key=sizes.get)
                        number += 1
                        del sizes[full]
                        yield _block(number, full, held.pop(full))
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
        for lang, texts in held.items():
            number += 1
            yield _block(number, lang, texts)

    return run


def _extend(words_before: int, last: bool):
    """From a block of phrases of so many words, with the numbers of the frequent lists among those one word longer (own),
    to the block of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i] for n in batch.schema.names}
                lang, words, own = r["lang"].as_py(), r["words"].values, np.sort(np.concatenate([_unpacked(x) for x in r["own"].as_py()]))
                postings = _postings(lang, words, np.asarray(r["lens"].values), _unpacked(r["positions"].as_py()))
                if words_before == 1:
                    now = postings.extended(postings).only(own)
                elif words_before:
                    held = np.asarray(r["starts"].values).reshape(-1, words_before)
                    keys = postings.keys[held[:, 0]]
                    for k in range(1, held.shape[1]):
                        keys = _longer(keys, postings.keys[held[:, k]])
                    now = _Lists(held, keys, np.asarray(r["counts"].values), _unpacked(r["alive"].as_py())).extended(postings).only(own)
                else:  # the first length: only frequent words stay
                    now = postings.only(own)
                    words = words.take(pa.array(own))
                    postings = now = _Lists(np.arange(len(own), dtype=np.int32)[:, None], now.keys, now.lens, now.starts)
                following = now.only(np.empty(0, np.int64)) if last else now.extended(postings)
                yield _batch([_row(r["block"].as_py(), lang, words, postings, now, following)])

    return run


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder, and where."""
    path = f"{shared_folder(df.sparkSession)}/lists-{uuid.uuid4().hex}"
    return written(df, path), path


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of the phrases of up to longest words that occur at least so often, and (lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lists, path = _kept(texts.mapInArrow(_cut_blocks(block_bytes), _BLOCK))
    sizes, _ = _kept(lists.groupBy("lang").agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")))
    levels = []
    for words in range(1, longest + 1):
        total = lists.agg(F.sum("lists").alias("n")).first().n or 0
        bits = max(6, (total // PART_KEYS).bit_length())
        parts = lists.select("block", "keys", "sizes").mapInArrow(_dealt(bits), "part long, block long, first long, keys binary, sizes binary")
        own = parts.groupBy("part").applyInArrow(_common(least), "block long, own binary").groupBy("block").agg(F.collect_list("own").alias("own"))
        following = lists.select("block", "lang", "words", "lens", "positions", "counts", "starts", "alive").join(own, "block")
        before = path
        lists, path = _kept(following.mapInArrow(_extend(words - 1, words == longest), _BLOCK))
        found, _ = _kept(lists.select("lang", F.inline(F.arrays_zip("phrases", "counts"))).groupBy("lang", F.col("phrases").alias("phrase")).agg(F.sum("counts").alias("f")).filter(F.col("f") >= least))
        levels.append(found.select("lang", "phrase", F.lit(words).alias("words"), "f"))
        removed(spark, before)
        free(spark)
    removed(spark, path)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionAll(more)
    return out, sizes


def _part(words: str, begin, count):
    """Words begin.. (from 1), so many, of the array, as a phrase."""
    return F.array_join(F.slice(words, begin, count), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best phrases of 2 to longest words."""
    phrases, sizes = frequent(docs, text_col, lang_col, least, longest, block_bytes)
    several = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("said"))
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("said", F.lit(1), F.col("k")).alias("first"), _part("said", F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left, right = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    each = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns({"above": F.lit(MILLION).cast("decimal(38,0)") * big("a") * big("a"), "below": big("l") * big("r")})
    scored = each.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the most frequent longer candidate around each shorter phrase
    inner = several.filter("words > 2").select("lang", "a", "words", "said", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "said", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("at"))
    around = inner.select("lang", "a", _part("said", F.col("at"), F.col("m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (big("longer") * 100 < big("a") * share))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # the best of each lane, then of all lanes of a lang: no task gets all phrases of a lang
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lane = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = kept.withColumn("lane", lane).withColumn("at", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*by))).filter(F.col("at") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, unnest(ws) AS phrase, 1 AS k FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 2 FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])), 3 FROM w
), f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, k, a, 1 AS cut, ws[1] AS p1, array_to_string(ws[2:], ' ') AS p2 FROM c
  UNION ALL SELECT lang, phrase, k, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3
), s AS (
  SELECT cuts.*, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f y ON y.lang = cuts.lang AND y.phrase = p2
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, ws[1] || ' ' || ws[2] AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, ws[2] || ' ' || ws[3] FROM c WHERE k = 3) GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2 WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
