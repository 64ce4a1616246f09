"""Neighbours among vectors of very different lengths, and double precision at its ends."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann


def test_lengths_over_two_magnitudes(spark):
    rng, n, d = np.random.default_rng(1), 5200, 16
    x = rng.standard_normal((n, d))
    x *= (np.exp(rng.uniform(0, np.log(100), n)) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        sims = x @ x[q]
        sims[q] = -np.inf
        hits += int((sims[own.vec_id] >= np.sort(sims)[-20] - 1e-9).sum())
    assert len(got) == 20 * n // 20 and hits >= 0.9 * len(got)


def test_doubles_stay_doubles(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.1, 5.0]), (2, [1e60, 0.0]), (3, [1e-60, 0.0]), (3, [0.3, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"node": F.lit("x"), "q": F.lit(0)})
    got = [(r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(2, 1e60), (3, 0.3), (1, 0.1), (3, 1e-60)]


def test_many_rows_of_the_query_do_not_hide_others(spark):
    rows = [(0, [1.0, 0.0])] * 30 + [(5, [1.0, 0.0])] * 2 + [(7, [1.0, 0.5])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert got.count() == 90 and {r.vec_id for r in got.collect()} == {5, 7}
