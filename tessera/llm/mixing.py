"""Mixing sources to target weights by temperature.

A source's share p of all tokens becomes the weight p^a / sum(p^a).  The exponent a, from 1 (as found) to 0 (uniform),
is bisected: first to the target entropy, then, if a source would be repeated more often than the limit, up to the
least flattening that holds the limit.  The weights times the token budget are the sources' budgets, realised as block
permutations: a source's documents are dealt by a keyed hash to 4,096 blocks, and block by block, by that hash within
the block, they make one pass; a budget takes as many whole passes as it holds and the leading part of another, as many
documents as fit.  Only block sums are cumulated; single documents only in the block where the last pass ends.

Tokens are words between ASCII white space.  Defined results: null source is the source ''; null, empty or blank text
has 0 tokens and rides along with whole passes (and in the last pass wherever the budget still has room); a source
without tokens, or a corpus without any, gets weight 0 and no copies; equal rows are kept row by row; a null id is
permuted as the id ''.  Columns beyond those named are not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, keyed, lookup, table

#: The target entropy lies this far between that of the token shares (0) and the uniform one (1).
FLATTEN, REPEAT_LIMIT, SEED, STEPS = 0.5, 4.0, "mix-1", 60


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(bare, r"[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))).cast("long")


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def weights_at(shares: list[float], a: float) -> list[float]:
    powers = [p**a if p > 0 else 0.0 for p in shares]
    total = math.fsum(powers)
    return [p / total for p in powers]


def bisect(holds, steps: int = STEPS) -> float:
    """The largest exponent in [0, 1], up to 2^-steps, for which a decreasing condition holds."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        if holds(mid):
            low = mid
        else:
            high = mid
    return low


def solve(tokens: dict[str, int], budget: int | None = None, target_entropy: float | None = None, flatten: float = FLATTEN, repeat_limit: float = REPEAT_LIMIT) -> tuple[float, dict[str, float]]:
    """The exponent and the weight of each source."""
    total = sum(tokens.values())
    budget = total if budget is None else budget
    if not total:
        return 1.0, dict.fromkeys(tokens, 0.0)
    names = sorted(tokens)
    shares = [tokens[n] / total for n in names]
    some = sum(p > 0 for p in shares)
    target = entropy(shares) + flatten * (math.log(some) - entropy(shares)) if target_entropy is None else target_entropy
    a = bisect(lambda x: entropy(weights_at(shares, x)) >= target)

    def worst(x: float) -> float:
        return max(w * budget / (p * total) for w, p in zip(weights_at(shares, x), shares, strict=True) if p > 0)

    if worst(a) > repeat_limit and worst(1.0) <= repeat_limit:
        low, high = a, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            if worst(mid) <= repeat_limit:
                high = mid
            else:
                low = mid
        a = high
    elif worst(1.0) > repeat_limit:
        a = 1.0  # the budget itself repeats everything more often
    return a, dict(zip(names, weights_at(shares, a), strict=True))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: int | None = None, target_entropy: float | None = None, flatten: float = FLATTEN, repeat_limit: float = REPEAT_LIMIT, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, weight (of the source), block, copies, for each row of docs.

    row_col: a key of the rows, which comes along as _row; rows without an id are then permuted by their texts.  The driver gets one row for each source (name and sums), no more.
    """
    nameless = F.concat(F.lit("#"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))) if row_col else F.lit("")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), nameless)).cast("binary"))
    own = [F.col(row_col).alias("_row")] if row_col else []
    slim = docs.select(*own, F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), word_count(F.col(text_col).cast("string")).alias("n_tokens"), key.alias("key"))
    slim = cut(slim.withColumn("block", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))
    blocks = cut(slim.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")))
    sums = blocks.groupBy("source").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
    tokens = {r.source: r.t for r in sums}
    total = sum(tokens.values()) if budget is None else budget
    _, weights = solve(tokens, budget, target_entropy, flatten, repeat_limit)
    plan = []
    for r in sums:
        passes, rest = divmod(math.floor(weights[r.source] * total), r.t) if r.t else (0, 0)
        plan.append((r.source, float(weights[r.source]), passes, rest, r.n))
    planned = docs.sparkSession.createDataFrame(plan, "source string, weight double, passes long, rest long, rows long")
    run = blocks.withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy("block")))
    # the block in which the last pass ends: the first whose cumulated tokens exceed the rest
    ends = run.join(planned, "source").filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("block", (F.col("rest") - F.col("upto") + F.col("t")).alias("room"))).alias("e")).select("source", F.col("e.block").alias("last"), F.col("e.room").alias("room"))
    sources = planned.join(ends, "source", "left").select("source", "weight", "passes", "last", "room", "rows")
    dealt = lookup(slim, sources, "source", "rows")
    within = Window.partitionBy("source", "block").orderBy("key", "doc_id", "n_tokens", *["_row"] * bool(row_col)).rowsBetween(Window.unboundedPreceding, 0)
    edge = dealt.filter(F.col("block") == F.col("last")).withColumn("used", F.sum("n_tokens").over(within)).withColumn("more", F.col("used") <= F.col("room"))
    rest = dealt.filter(F.coalesce(F.col("block") != F.col("last"), F.lit(True))).withColumn("more", F.coalesce(F.col("block") < F.col("last"), F.lit(False)))
    cols = [*["_row"] * bool(row_col), "doc_id", "source", "n_tokens", "weight", "block", (F.col("passes") + F.col("more").cast("long")).alias("copies")]
    return edge.select(*cols).unionAll(rest.select(*cols))


def with_copies(docs: DataFrame, **settings) -> DataFrame:
    """docs with n_tokens, weight, block and copies; each row gets its own, also rows that share an id and those without
    one.  Columns of docs of these names make way."""
    new = ("n_tokens", "weight", "block", "copies")
    rows = keyed(docs)
    mixed = mix(rows.select("row", "doc.doc_id", "doc.source", "doc.text"), **settings, row_col="row").select(F.col("_row").alias("row"), F.struct(*new).alias("mixed"))
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in new]
    return rows.join(mixed, "row", "left").select(*kept, "mixed.*")


def draws(mixed: DataFrame) -> DataFrame:
    """One row for each copy, with its pass number from 0."""
    return mixed.filter("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


def op2_temperature_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n_tokens,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), b AS (SELECT *, CAST('0x' || substr(k, 1, 3) AS INTEGER) AS block FROM d),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS t FROM b GROUP BY 1),
p AS (SELECT source, t, t / (SELECT sum(t) FROM s) AS p FROM s),
goal AS (SELECT h + 0.5::DOUBLE * (ln(n) - h) AS target FROM (SELECT -sum(p * ln(p)) AS h, count(*) AS n FROM p WHERE p > 0)),
steps(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT -sum(w * ln(w)) FROM (SELECT pow(p, (lo + hi) / 2) / sum(pow(p, (lo + hi) / 2)) OVER () AS w FROM p WHERE p > 0)) >= (SELECT target FROM goal) AS ok FROM steps WHERE i < 60)
), expo AS (SELECT lo AS a FROM steps WHERE i = 60),
w AS (SELECT source, t, pow(p, a) / sum(pow(p, a)) OVER () AS weight, (SELECT CAST(sum(t) AS BIGINT) FROM s) AS total FROM p, expo),
pl AS (SELECT source, weight, t, CAST(floor(weight * total) AS BIGINT) // t AS passes, CAST(floor(weight * total) AS BIGINT) % t AS rest FROM w),
c AS (SELECT b.*, sum(n_tokens) OVER (PARTITION BY source ORDER BY block, k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS used FROM b)
SELECT c.doc_id, c.source, c.n_tokens::BIGINT AS n_tokens, pl.weight, c.block, CAST(pl.passes + CASE WHEN used <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM c JOIN pl USING (source)
"""
