"""Collocations against brute force and SQL, with awkward rows."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tessera.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, words string, block string, phrase string"


def brute(rows, least=10, longest=3, share=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    good = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in good.items():
        if any(g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for (g, q), b in good.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(g, i, p.decode(), -a, x, y, n[g], -s) for g, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1)}


def found(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def texts():
    r = random.Random(5)
    words = "red Green blue, tea cup. new York city; été Übung 北 京 a b c".split()
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(1, 60))), r.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [("new york city " * 300, "en"), (None, "en"), ("", None), (" \t\n..", "de"), ("x" * 5000 + " y z " * 200, "de"), ("a\x0bb\rc\td  e\x1cf g", "de")]
    return rows * 2


@pytest.mark.parametrize("size", [c.BLOCK_BYTES, 300])
def test_collocations_equal_brute_force(spark, size):
    rows = texts()
    df = spark.createDataFrame([(i % 50, t, g, "w", "b", "p") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    got = found(c.collocations(df, block_bytes=size))
    assert got == brute(rows) and any(len(p[2].split()) == 3 for p in got)


def test_longer_phrases_and_few_rows(spark):
    rows = texts()
    df = spark.createDataFrame([(0, t, g, "w", "b", "p") for t, g in rows], SCHEMA)
    assert found(c.collocations(df, least=6, longest=4, share=30, top=5)) == brute(rows, 6, 4, 30, 5)


def test_blocks_are_cut_where_pieces_end():
    text = b"one two, three four five; six " * 20
    for size in (40, 64, 10_000):
        parts = list(c._pieces(text, size))
        assert b"".join(parts) == text.translate(c._TABLE) and all(p.endswith(b"\n") for p in parts[:-1]) and all(len(p) <= size for p in parts)


def test_empty_and_rare(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(c.collocations(none)) == set()
    assert found(c.collocations(spark.createDataFrame([(1, "a b c", "en", None, None, None), (2, None, None, None, None, None)], SCHEMA))) == set()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = db.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({c.OP12_SQL})").fetchall()
    assert found(c.op12_collocations(spark, sf)) == {tuple(r) for r in want} and want


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    a, left, right = 3_000_000_019, 9_000_000_011, 7_000_000_033
    rows = spark.createDataFrame([("en", "p", 1, left), ("en", "q", 1, right), ("en", "p q", 2, a)], "lang string, phrase string, words int, f long")
    monkeypatch.setattr(c, "frequent", lambda *_: (rows, spark.createDataFrame([("en", 99)], "lang string, n long")))
    assert found(c.collocations(None)) == {("en", 1, "p q", a, left, right, 99, 1_000_000 * a * a // (left * right))}
