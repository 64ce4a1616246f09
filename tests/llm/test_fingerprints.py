"""Order MinHash against a second writing of it in plain Python, and its properties."""

import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, n_chars long, fingerprint string, head string, mark long"


def h(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def signature(text, k=3, size=2, slots=64):
    units = [h(u) for u in re.findall(r"[0-9A-Za-z\u00C0-\u024F\u0370-\u052F]{1,12}|[^ \t\n\x0b\f\r]", text or "")]
    if not units:
        return [0] * slots
    mers = [h(*units[i : i + k]) for i in range(max(1, len(units) - k + 1))]
    seen, elements = {}, []
    for i, m in enumerate(mers):
        o = seen.get(m >> 31, 0)
        seen[m >> 31] = o + 1
        elements.append((h(m >> 31, (o,)) >> 31, i))
    elements.sort()
    out = []
    bits = slots.bit_length() - 1
    for s in range(slots):
        begin = next((j for j, (e, _) in enumerate(elements) if (e >> (33 - bits)) + slots // 2 >= s), 0)
        places = sorted(elements[(begin + t) % len(elements)][1] for t in range(min(size, len(elements))))
        x = h(*[mers[p] for p in places]) >> 32
        out.append(x)
    return out


def texts():
    r = random.Random(9)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 90))) for _ in range(25)]
    return out + ["", None, "   \t\n", "one", "one two", "a a a a a a a a", "na " * 400, "北京是中华人民共和国的首都", "Straße, naïve; état!", "x" * 3000, "1.2.3", "\U0001f600\U0001f600 ok"]


def test_signature_equals_plain_python(spark):
    data = texts()
    for k, size, slots in ((3, 2, 64), (2, 3, 16), (1, 1, 4)):
        df = fp.fingerprints(spark.createDataFrame([(i, t, 0, "", "", 0) for i, t in enumerate(data)], SCHEMA), k=k, size=size, slots=slots)
        got = {r.doc_id: r.fingerprint for r in df.collect()}
        assert got == {i: signature(t, k, size, slots) for i, t in enumerate(data)}


def edited(rows):
    """What the contract says, for different ids."""
    order = sorted(rows)
    out = {}
    for i, d in enumerate(order):
        t, n = rows[d] or "", rows[order[(i + 1) % len(order)]] or ""
        out[d] = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
    return out


def answered(df):
    return {r.doc_id: r for r in df.collect()}


def query(docs, **settings):
    out = fp.with_edits(docs, **settings)
    return out.select("*", fp.likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"), fp.likeness(F.col("entries"), F.col("next_entries")).alias("near_next"))


def test_edits_and_neighbours(spark):
    data = {7 * i - 20: t for i, t in enumerate(texts())}
    got = answered(query(spark.createDataFrame([(i, t, 0, "", "", 0) for i, t in data.items()], SCHEMA).repartition(5)))
    want, order = edited(data), sorted(data)
    for j, d in enumerate(order):
        r, following = got[d], signature(data[order[(j + 1) % len(order)]])
        assert r.n_chars == len(data[d] or "") and r.edited_sha256 == hashlib.sha256(want[d].encode()).hexdigest()
        own, other = signature(data[d]), signature(want[d])
        assert r.entries == own and r.edited_entries == other and r.next_entries == following
        assert r.near_edited == sum(a == b for a, b in zip(own, other)) / 64 and r.near_next == sum(a == b for a, b in zip(own, following)) / 64


def test_rows_that_share_an_id_and_rows_without(spark):
    a, b, c = "first text of all " * 9, "second one " * 20, "third, and last " * 8
    rows = [(1, a), (1, a), (1, b), (2, c), (None, c), (None, a)]
    got = query(spark.createDataFrame([(i, t, 0, "", "", 0) for i, t in rows], SCHEMA)).collect()
    told = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    half = lambda t, n: t[: len(t) - len(t) // 2] + n[: len(t) // 2]
    one = [t for _, t in sorted((h(t), t) for t in (a, a, b))]
    first = one[0]
    assert told == sorted([(1, len(t), sha(half(t, n))) for t, n in zip(one, [*one[1:], c], strict=True)] + [(2, len(c), sha(half(c, first))), (0, len(c), sha(half(c, ""))), (0, len(a), sha(half(a, "")))])
    assert all(r.near_next is None for r in got if r.doc_id is None)


def test_empty_and_single(spark):
    assert query(spark.createDataFrame([], SCHEMA)).collect() == []
    (r,) = query(spark.createDataFrame([(5, "abc def", 0, "", "", 0)], SCHEMA)).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest()


def test_likeness_falls_with_edits_and_with_moves(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(600)]
    few, many = list(words), list(words)
    for w, n in ((few, 6), (many, 120)):
        for i in r.sample(range(600), n):
            w[i] = "changed"
    moved = words[300:] + words[:300]
    rows = [(i, " ".join(w), 0, "", "", 0) for i, w in enumerate((words, few, many, moved))]
    got = {x.doc_id: x.fingerprint for x in fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    same = [sum(a == b for a, b in zip(got[0], got[i])) / 64 for i in range(4)]
    assert same[0] == 1 and same[1] > 0.8 and 0.8 > same[3] > same[2] and 0.3 < same[3]


def test_query(spark):
    out = fp.op13_order_minhash(spark, "/root/testdata/sf0.001")
    assert [c for c, _ in out.dtypes] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = out.collect()
    assert len(rows) == 200 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 512 for r in rows)
    assert sum(r.near_edited > r.near_next for r in rows) > 180
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
