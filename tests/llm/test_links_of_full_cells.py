"""Links of crowded cells: every pair within two bits, each once, by whichever grid."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, simhash, tokens, toolcalls


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("limit", [0, 4, 64, 10**6])
def test_links_are_all_pairs_within_two_bits(spark, limit):
    r = random.Random(limit)
    base = r.getrandbits(64)
    prints = {r.getrandbits(64) for _ in range(100)} | {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(500)} | {0, (1 << 64) - 1, 1 << 63, 3}
    prints = sorted(signed(p) for p in prints)
    df = spark.createDataFrame([(p, p) for p in prints], "fp long, node long")
    got = sorted((min(x.a, x.b), max(x.a, x.b)) for x in simhash.links(df, limit).collect())
    assert got == [(p, q) for i, p in enumerate(prints) for q in prints[i + 1 :] if bin((p ^ q) & (1 << 64) - 1).count("1") <= 2]


def test_fine_cells_are_small(spark):
    fps = [signed((0xABCDEF << 40) | i) for i in range(2048)]
    df = spark.createDataFrame([(p, p) for p in fps], "fp long, node long").withColumn("e", simhash.embedded(F.col("fp")))
    assert simhash._spread(df, "fp", simhash.FINE_BLOCKS).groupBy("pick", "bits").count().agg(F.max("count")).first()[0] <= 256


def test_names_are_found_in_time_that_grows_with_the_text():
    import time

    r = random.Random(0)
    names = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)).capitalize() for _ in range(4000)]
    text = " ".join(f"Mr {n} met Anna {n}." for n in names)
    began = time.process_time()
    found = pii.detect(text)
    assert time.process_time() - began < 1 and sum(k == "name" for _, _, k in found) >= 8000
    assert [text[a:b] for a, b, _ in found[:2]] == [names[0], f"Anna {names[0]}"]


def test_words_of_names_where_the_text_has_them():
    text = "Dr. Jean-Luc Oneil and Mrs Rose Field. Oneil saw Field, Luc and a rose; Rosemary; x_Field Field's"
    found = {text[a:b] for a, b, _ in pii.detect(text)}
    assert found == {"Jean-Luc Oneil", "Rose Field", "Oneil", "Field", "Luc"}


def test_tied_edits_have_one_result(spark):
    trees = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    grown = trees.withColumn("tree", tokens.tree_of(spark, F.col("text")))
    edits = [(1, 5, 5, "B"), (1, 5, 5, "A"), (1, 0, 1, None)]
    for order in (edits, edits[::-1]):
        (row,) = tokens.apply_edits(grown, spark.createDataFrame(order, "doc_id long, a int, b int, new string").coalesce(1)).collect()
        assert row.text == "elloAB world"


def test_calls_behind_white_space_are_linked(spark):
    rows = [(1, 0, "assistant", ' \n\t{"tool_calls":[{"id":"c","name":"reply","arguments":{"prompt":"p","turn":1}}]}'), (1, 1, "tool", '\r {"tool_call_id":"c","content":1}'), (1, 2, "assistant", "\x0b{"), (1, 3, "assistant", None)]
    got = {(r.turn, r.kind): r for r in toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got[0, "call"].linked and got[0, "call"].valid and got[1, "result"].linked and {(2, "result"), (3, "result")} <= got.keys()
