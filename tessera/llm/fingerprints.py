"""Order MinHash: document fingerprints that are sensitive to edit distance.

A text is a row of units: runs of up to twelve letters of the Latin, Greek and Cyrillic alphabets and digits, and every
other character that is not white space by itself, so that scripts without spaces are read character by character.  Its
k-mers are K units in a row (all units, if fewer), each with the number of its earlier occurrences in the text, so that
repeats are elements of their own.  One hash orders the elements, and its range is divided into SLOTS parts: a slot selects
the TUPLE least elements from the beginning of its part on, beyond its end and again from the first part where it holds
fewer.  The selected k-mers are put back into text order and hashed as a tuple, which is the slot's entry.  The share of
equal entries is the likeness of two texts: it falls with the k-mers that differ and with those that changed places.

All of it is array and string functions inside one row, so nothing is shuffled for a fingerprint and whole texts of any
length are read in time n log n.  To meet its next document a text moves once: documents are dealt to ranges of ids, and
the first one of a range is also sent to the range before.

Defined results: null text is empty; a text without units has zeros as entries, and is like others without units; equal
texts have equal fingerprints.  Documents follow each other by id, rows that share an id by the hashes of their texts; the
first follows the last, so a single row follows itself.  Rows without an id have no next document: their ends are cut off,
and near_next is 0.  An empty table has no rows.  Only the id and text columns are read, so further columns may have any
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Units in a k-mer, k-mers in a tuple, entries (a power of two).
K, TUPLE, SLOTS = 3, 2, 64
UNIT = r"[0-9A-Za-z\u00C0-\u024F\u0370-\u052F]{1,12}|\S"
#: Documents of a range, and most ranges.
RANGE_ROWS, RANGES = 2_000, 65_536
_PLACE = (1 << 31) - 1


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _head(x: Column) -> Column:
    """The 33 bits that order a packed number; the other 31 are a place in the text."""
    return F.shiftright(x, 31)


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(_head(hashed), 31).bitwiseOR(place.cast("long"))


def signature(text: Column, k: int = K, size: int = TUPLE, slots: int = SLOTS) -> Column:
    """The entries of a text's fingerprint, an array of slots integers."""
    bits = slots.bit_length() - 1
    if slots != 1 << bits:
        raise ValueError("slots must be a power of two")

    def slot(x: Column) -> Column:
        return (F.shiftright(x, 64 - bits) + slots // 2).cast("int")

    def kmers(units: Column) -> Column:
        hashed = F.transform(F.slice(units, 1, F.greatest(F.size(units) - k + 1, F.lit(1))), lambda x, i: F.xxhash64(x, *[F.get(units, i + j) for j in range(1, k)]))
        return _let(hashed, selected)

    def selected(mers: Column) -> Column:
        return _let(F.sort_array(F.transform(mers, _packed)), lambda by_mer: numbered(mers, by_mer))

    def numbered(mers: Column, by_mer: Column) -> Column:
        # equal k-mers lie together, in text order: where each run begins, then the occurrences of each
        first = F.filter(F.sequence(F.lit(0), F.size(by_mer) - 1), lambda i: (i == 0) | (_head(F.get(by_mer, i)) != _head(F.get(by_mer, i - 1))))

        def element(at: Column, occurrence: Column) -> Column:
            x = F.get(by_mer, at)
            return _packed(F.xxhash64(_head(x), occurrence), x.bitwiseAND(F.lit(_PLACE).cast("long")))

        def runs(begin: Column) -> Column:
            def run(b: Column, j: Column) -> Column:
                return _let(
                    F.coalesce(F.get(begin, j + 1), F.size(by_mer)) - b,
                    lambda n: F.when(n == 1, F.array(element(b, F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda o: element(b + o, o))),
                )

            return F.flatten(F.transform(begin, run))

        return _let(F.sort_array(_let(first, runs)), lambda elements: least(mers, elements))

    def least(mers: Column, elements: Column) -> Column:
        # the first elements of each part; what a slot selects is among them, and in a row
        return _let(F.filter(elements, lambda x, i: (i < size) | (slot(F.get(elements, i - size)) != slot(x))), lambda near: tuples(mers, near))

    def tuples(mers: Column, near: Column) -> Column:
        begins = F.flatten(F.transform(near, lambda x, i: F.array_repeat(i, slot(x) - F.coalesce(slot(F.get(near, i - 1)), F.lit(-1)))))
        begins = F.concat(begins, F.array_repeat(F.lit(0), slots - 1 - slot(F.element_at(near, -1))))

        def entry(i: Column) -> Column:
            places = F.sort_array(F.transform(F.sequence(F.lit(0), F.least(F.lit(size), F.size(near)) - 1), lambda t: F.get(near, (i + t) % F.size(near)).bitwiseAND(F.lit(_PLACE).cast("long"))))
            return F.shiftright(F.xxhash64(F.transform(places, lambda p: F.get(mers, p.cast("int")))), 32).cast("int")

        return F.transform(begins, entry)

    found = F.transform(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    return _let(found, lambda units: F.when(F.size(units) == 0, F.array_repeat(F.lit(0), slots)).otherwise(kmers(units)))


def likeness(a: Column, b: Column) -> Column:
    """The share of entries that are equal."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def digest(entries: Column) -> Column:
    """A fingerprint as hexadecimal digits, eight an entry."""
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, fingerprint (an array of integers) of each row."""
    return docs.select(F.col(id_col).alias("doc_id"), signature(F.col(text_col), **settings).alias("fingerprint"))


def bounds(ids: DataFrame) -> list[int]:
    """The least ids of ranges that hold about RANGE_ROWS rows (more, beyond RANGES ranges): the least of all, and every
    so-manyth of a sample by hash that the driver gets, of about 20 ids a range."""
    n, least = ids.agg(F.count("*"), F.min("doc_id")).first()
    ranges = min(RANGES, -(-n // RANGE_ROWS))
    every = max(1, n // (20 * ranges)) if n else 1
    drawn = sorted(r.doc_id for r in ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).distinct().collect())
    step = max(1, len(drawn) // ranges) if ranges else 1
    return sorted({least, *drawn[step::step]}) if n else []


def _range_of(c: Column, lows: list[int]) -> Column:
    """The number of the range that an id lies in, by bisection."""
    held = F.array(*[F.lit(x).cast("long") for x in lows])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(lows).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step) <= c, at + step).otherwise(at))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, n_chars, edited_sha256, entries, edited_entries, next_entries of each row: the hash of its text with the last
    half replaced by the beginning of the next document's, and the three fingerprints (null, where there is no next)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = rows.filter("doc_id IS NOT NULL")
    lows = bounds(named.select("doc_id"))
    own = rows.withColumn("entries", signature(F.col("text"), **settings))
    half = F.floor(F.length("text") / 2).cast("int")

    def edited(following: Column) -> Column:
        return F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(following, F.lit(1), half))

    def told(df: DataFrame) -> DataFrame:
        return df.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "entries", signature(F.col("edited"), **settings).alias("edited_entries"), "next_entries")

    nameless = own.filter("doc_id IS NULL").select("*", edited(F.lit("")).alias("edited"), F.lit(None).cast("array<int>").alias("next_entries"))
    if not lows:
        return told(nameless)
    at, last = _range_of(F.col("doc_id"), lows), len(lows) - 1
    # a guest is the first of its range, and comes after all documents of the range before
    firsts = F.array(*[F.lit(x).cast("long") for x in lows])
    placed = own.filter("doc_id IS NOT NULL").withColumn("range", at)
    before = F.when(F.col("range") == 0, F.lit(last)).otherwise(F.col("range") - 1)
    seats = F.when(F.get(firsts, F.col("range")) == F.col("doc_id"), F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(before.alias("range"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))))
    seated = placed.select("doc_id", "text", "entries", F.explode(seats).alias("seat")).select("doc_id", "text", "entries", "seat.range", "seat.guest")
    w = Window.partitionBy("range").orderBy("guest", "doc_id", F.xxhash64("text"))
    met = seated.repartition("range").withColumns({"next_text": F.lead("text").over(w), "next_entries": F.lead("entries").over(w)}).filter("guest = 0")
    return told(met.withColumn("edited", edited(F.col("next_text")))).unionByName(told(nameless))


def op13_order_minhash(spark, sf_dir: str) -> DataFrame:
    out = with_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("entries")).alias("fingerprint"), digest(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"), F.coalesce(likeness(F.col("entries"), F.col("next_entries")), F.lit(0.0)).alias("near_next"),
    )
