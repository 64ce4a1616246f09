"""The pipeline's stages decide each row by itself, also without an id or with a repeated one."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()) for _ in range(n))


def test_one_row_of_a_group_stays(spark):
    r = random.Random(2)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    rows = [(7, a), (None, a), (None, a), (None, b), (None, b), (3, c), (3, c), (3, d)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3), "")
    assert sorted((x.doc_id or 0, x.text) for x in kept.collect()) == sorted([(7, a), (0, b), (3, c), (3, d)])


def test_each_row_has_its_own_copies(spark):
    r = random.Random(4)
    rows = [(None if i % 3 == 0 else i % 50, prose(r, r.randint(1, 40)), "en", "abb"[i % 3 - i % 2], 0) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.with_copies(docs).withColumn("own", mixing.word_count(F.col("text"))).collect()
    assert len(got) == 600 and all(x.n_tokens == x.own for x in got)
    total = sum(x.own for x in got)
    for source in {x.source for x in got}:
        mine = [x for x in got if x.source == source]
        assert len({x.weight for x in mine}) == 1
        budget = int(mine[0].weight * total)
        assert budget - 41 < sum(x.own * x.copies for x in mine) <= budget
        assert len({x.block for x in mine if x.doc_id is None}) > 1
