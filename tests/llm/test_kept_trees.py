"""Trees that are kept whole, and many edits in one sweep."""

import random

import numpy as np
import pytest

from tessera.llm import secrets, tokens


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(secrets.vocabulary(secrets.DEFAULT_VOCABULARY))


def test_sweeps_equal_full_counts(counter):
    r = random.Random(6)
    bits = list("ab'sl  \n\té1 2.,!-ï") + ["'ll", "   ", "\n\n", "hello", " world"]
    for _ in range(250):
        text = "".join(r.choice(bits) for _ in range(r.choice([0, 3, 40, 700, 3000])))
        tree = tokens.TokenTree(text, counter)
        for _ in range(3):
            edits, want, done = [], [], 0
            for a in sorted(r.randint(0, len(text)) for _ in range(r.choice([0, 1, 2, 9, 40]))):
                a = max(a, done)
                b = min(len(text), a + r.choice([0, 0, 1, 2, 5, 60, 300]))
                new = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 6, 50])))
                edits.append((a, b, new))
                want += [text[done:a], new]
                done = b
            text = "".join([*want, text[done:]])
            tree = tokens.TokenTree(tree.text, counter, tree.arrays())  # as loaded from a table
            tree.edit_all(edits)
            fresh = tokens.TokenTree(text, counter)
            assert tree.text == text and tree.leaves() == fresh.leaves()
            assert tree.total == len(counter.enc.encode_ordinary(text)) and tree.chars[1] == len(text)
            sizes = np.concatenate(([0], np.cumsum(tree.sizes)))
            blocks = len(tree.chars) // 2
            for i in range(len(tree.sizes)):
                assert tree.chars[blocks + i] == tree.lens[sizes[i] : sizes[i + 1]].sum()


def test_overlapping_and_outlying_edits(counter):
    tree = tokens.TokenTree("one two three", counter)
    tree.edit_all([(4, 7, "X"), (5, 9, "Y"), (90, 99, "!"), (-3, 0, ">")])
    assert tree.text == ">one XYhree!" and tree.total == len(counter.enc.encode_ordinary(tree.text))


def test_little_is_encoded_by_many_edits(counter):
    text = "alpha beta gamma " * 20_000
    tree = tokens.TokenTree(text, counter)
    assert tree.edit_all([(i * 170 + 3, i * 170 + 4, "q") for i in range(1900)]) < 5 * 1900


def test_empty_tables(spark, counter):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([], "doc_id long, text string")
    trees = docs.withColumn("tree", tokens.tree_of(spark, F.col("text")))
    assert tokens.apply_edits(trees, spark.createDataFrame([], "doc_id long, a int, b int, new string")).count() == 0
    some = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string").withColumn("tree", tokens.tree_of(spark, F.col("text")))
    edits = spark.createDataFrame([(1, 0, 1, "xyz"), (7, 0, 1, "q")], "doc_id long, a int, b int, new string")
    assert sorted((r.text or "", r.tree.tokens[1]) for r in tokens.apply_edits(some, edits).collect())[1:] == [("xyz b", len(counter.enc.encode_ordinary("xyz b")))] * 2
