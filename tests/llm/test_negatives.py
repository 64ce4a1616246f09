"""Hard negatives against brute force and SQL, with awkward rows."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.llm import negatives as g

SCHEMA = "vec_id long, embedding array<float>, label int, near int, dist string, row long"


def brute(rows):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y, *_ in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, y in ok:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in ok if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == y][:5]:
            worse = [(n, i) for n, i, z in scored if z != y and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(worse, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def mined(df, **settings):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return g.hard_negatives(df, F.col("vec_id") % 100 == 0, label=label, **settings)


def rows(n=900, d=8, seed=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    out = [(i, [x + r.gauss(0, 0.3) for x in r.choice(centres)], r.randrange(3)) for i in range(n)]
    hot = out[5][1]
    out += [(n + i, hot, i % 4) for i in range(n // 2)]  # a third of all rows are one vector
    return out


AWKWARD = [(None, [1.0] * 8, 1), (10_001, None, 1), (10_002, [1.0] * 7 + [None], 1), (10_003, [float("nan")] + [0.0] * 7, 1), (10_004, [float("inf")] * 8, 1), (10_005, [1.0] * 8, None), (10_100, [0.0] * 8, 2), (10_006, [0.5, 0.5], 1), (10_200, [0.5, 0.25], 1), (10_007, [0.4, 0.25], 2), (10_300, [], 1), (-100, [0.1] * 8, 1), (3, [0.2] * 8, 1)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, y, 0, "x", 1) for i, v, y in data], SCHEMA)


def test_hard_negatives_equal_brute_force(spark):
    data = rows() + AWKWARD
    assert found(mined(frame(spark, data).repartition(3))) == brute(data)


def test_anchors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(g, "ANCHORS", 3)
    data = rows(600, seed=2)
    got = found(mined(frame(spark, data)))
    assert got == brute(data) and len({x[0] for x in got}) > 3


def test_large_integers_are_exact(spark):
    r = random.Random(4)
    data = [(i, [r.uniform(-1e6, 1e6) for _ in range(5)], i % 3) for i in range(300)]
    assert found(mined(frame(spark, data))) == brute(data)
    a = np.array([[2.0**40, 3.0]])
    assert g.products(a, a).tolist() == [[2**63 - 1]] and g.products(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])).tolist() == [[2**60 + 1]]


def test_empty_and_without_anchors(spark):
    assert found(mined(frame(spark, []))) == []
    assert found(mined(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]))) == []


def test_brackets_leave_out_rows_but_none_that_counts():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 6)) * 2
    v = g._integers(np.concatenate([c + 0.05 * rng.normal(size=(200, 6)) for c in centres]))
    most, pivots = float((v**2).sum(1).max()), g._chosen(list(v[::20]))[6]
    block = g._Anchors(np.arange(4), np.arange(4), ["a"] * 4, v[:4], pivots, most)
    dist = g._distances(v, np.sqrt(np.maximum(most - (v**2).sum(1), 0)), pivots, most)
    exact = g.products(v[:4], v)
    least = np.sort(exact, axis=1)[:, -10].astype(float)
    kept = np.zeros(exact.shape, bool)
    for part, at, scores, ok in block.scan(np.arange(len(v)), None, v, dist, least, np.full(4, np.inf)):
        assert (scores == exact[np.ix_(part, at)]).all()
        kept[np.ix_(part, at)] |= ok
    assert kept[exact >= least[:, None]].all() and kept.mean() < 0.3


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        want = db.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({g.OP11_SQL})").fetchall()
    assert found(g.op11_hard_negatives(spark, sf)) == sorted(want)
