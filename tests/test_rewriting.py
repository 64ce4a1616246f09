"""Command rewriting as columns against the plain version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import rewrite as plain
from tessera.operators import rewriting

PARTS = ["cat a b", "cat", "cat -n x", "cat -", "head f", "head -n 3 f g", "head -n f", "head -5 f", "tail -20 x", "tail --lines 007 x", "tail -n +4 x", "tail -n", "head -0 f", "head -c 3 f", "'cat' x", "\"Head\" y", "ls -l", "grep -r x .", "make > out", "cat < in", "", "  ", "tessera shell run -- ls", "tessera shell read x", "Tessera Shell Run -- y", "echo a&b", "tail -n 3 -n 4 f", "head f -- g", "tail -n -n f", "cat x", "head -n\t3 f"]
SEPARATORS = [" && ", "&&", " || ", "; ", ";", " | ", "|", "|||", " &&& "]


@pytest.mark.parametrize(("enabled", "mode", "exclude"), [(True, "suggest", ()), (True, "rewrite", ("GREP", " ls ")), (False, "suggest", ()), (True, "suggest", ("cat", "head"))])
def test_decisions_equal_the_plain_ones(spark, enabled, mode, exclude):
    r = random.Random(2)
    rows = PARTS + ["".join(r.choice(["", " ", "\t"]) + r.choice(PARTS) + (r.choice(SEPARATORS) if k else "") for k in reversed(range(r.randint(1, 4)))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], "id int, command string")
    got = {x.id: tuple(x.d) for x in df.select("id", rewriting.decide(F.col("command"), enabled, mode, exclude).alias("d")).collect()}
    for i, c in enumerate(rows):
        assert got[i] == plain.decide(c, enabled, mode, exclude), c


def test_rewriting_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("cat a",)], "command string").select(rewriting.decide(F.col("command")).alias("d"))
    assert not re.search("Python|InArrow|InPandas", df._jdf.queryExecution().executedPlan().toString())
