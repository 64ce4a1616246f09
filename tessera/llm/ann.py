"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy graph search.

Equal vectors are one node, with a number of its own.  The graph starts from random-projection trees (planes drawn
from a bounded sample, blocks of bounded size, every node in one block of each tree) and is improved in rounds of joins
of neighbours of neighbours: each node gathers a sample of its neighbours and of the nodes it is a neighbour of, they
are compared with each other, and each takes what beats the last entry of its own list.  Only pairs with an entry not
compared before are tried.  Rounds end when few lists change (LEAST_CHANGE of their entries).

A search starts at the query's own list and goes on greedily: of the best POOL nodes seen, those not yet opened are
opened together, their neighbours in both directions scored, until no query has one left to open.

Long vectors are near to most others by inner product: rows of nodes that are neighbours of many are parted by Spark's skew
join where they meet those nodes.  Vectors travel as 16-bit integers with a scale; the nearest found are scored again in
double precision on the original vectors.  Defined results: rows with a null id or vector, a vector of zeros, with null or non-finite components, or of
another length than most vectors take no part; equal vectors tie and come by id; with fewer candidates than k all are
returned.  Rows that repeat an id are separate candidates; a query leaves out the rows of its own id; an empty table has no
rows.  Only the id and vector columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, lookup, table

#: Neighbours in a list, sampled neighbours of a kind in a round, most proposals that one comparison makes to one node.
NEIGHBOURS, SAMPLE, PROPOSALS = 40, 24, 8
#: Trees, nodes of a block, first neighbours from a block, vectors drawn for the planes, levels of a tree.
TREES, BLOCK, FIRST, PLANES, DEPTH = 4, 512, 12, 2048, 12
LEAST_CHANGE, POOL = 0.03, 120


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    own = own.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return own.filter(F.size("v") == (sizes.d if sizes else 0))


def _stack(vectors: pa.Array) -> np.ndarray:
    """A matrix from binary vectors of one length."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    n = len(vectors)
    if not n:
        return np.empty((0, 0), np.float32)
    return np.frombuffer(b"".join(vectors.to_pylist()), np.int16).reshape(n, -1).astype(np.float32)


@F.arrow_udf(T.StructType([T.StructField("q", T.BinaryType()), T.StructField("s", T.DoubleType())]))
def _packed(vectors: pa.Array) -> pa.Array:
    if not len(vectors):
        return pa.StructArray.from_arrays([pa.array([], pa.binary()), pa.array([], pa.float64())], ["q", "s"])
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    most = np.abs(m).max(1)
    q = np.round(m / most[:, None] * 32767).astype(np.int16)
    return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in q], pa.binary()), pa.array(most / 32767)], ["q", "s"])


def _tree_codes(nodes: DataFrame, n: int) -> Column:
    """For each tree, the code of the leaf that holds the vector."""
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(PLANES).select("q", "s").toPandas()
    if not len(rows):
        return F.array(F.lit(0).cast("long"))
    sample = np.frombuffer(b"".join(rows.q), np.int16).reshape(len(rows), -1).astype(np.float64) * rows.s.to_numpy()[:, None]
    depth = int(np.ceil(np.log2(max(1.0, n / BLOCK))))
    rng = np.random.default_rng(7)
    trees = []
    for _ in range(TREES):
        planes, cuts = [], []
        for _ in range(depth):
            a, b = rng.choice(len(sample), 2, replace=len(sample) < 2)
            plane = sample[a] - sample[b] if len(planes) < DEPTH else rng.standard_normal(sample.shape[1])
            planes.append(plane)
            cuts.append(float(np.median(sample @ plane)))
        trees.append((np.array(planes, np.float64).reshape(depth, sample.shape[1]), np.array(cuts, np.float64)))

    @F.arrow_udf("array<long>")
    def codes(vectors: pa.Array, scales: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int64()))
        m = _stack(vectors) * scales.to_numpy(zero_copy_only=False)[:, None]
        out = np.zeros((len(m), TREES), np.int64)
        for t, (planes, cuts) in enumerate(trees):
            if len(cuts):
                bits = (m @ planes.T > cuts).astype(np.int64)
                out[:, t] = bits @ (1 << np.arange(len(cuts), dtype=np.int64))
            out[:, t] = out[:, t] * TREES + t
        return pa.array(out.tolist(), pa.list_(pa.int64()))

    return codes(F.col("q"), F.col("s"))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal key of sorted batches, several whole runs at a time."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        split = int(np.searchsorted(keys, keys[-1]))
        if keys[0] != keys[-1] or (kept and kept[-1].column(key)[-1].as_py() != keys[0]):
            head = batch.slice(0, split)
            rows = [*kept, head] if head.num_rows else kept
            if rows:
                yield pa.Table.from_batches(rows)
            kept = [batch.slice(split)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def _best(sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row, which entries are among its best."""
    if sims.shape[1] <= most:
        return np.ones(sims.shape, bool)
    at = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    out = np.zeros(sims.shape, bool)
    np.put_along_axis(out, at, True, 1)
    return out


_EDGES = "u long, w long, sim double"


def _edges(u: list[np.ndarray], w: list[np.ndarray], sim: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(w)), pa.array(np.concatenate(sim).astype(np.float64))], ["u", "w", "sim"])


def _compare(group: pa.Table, key: str, fresh: bool, most: int) -> Iterator[pa.RecordBatch]:
    """All members of each run of key with each other; fresh: only pairs with a fresh member, beating the member's worst."""
    keys = group.column(key).to_numpy()
    ids, scales = group.column("member").to_numpy(), group.column("s").to_numpy()
    m = _stack(group.column("q"))
    new = group.column("fresh").to_numpy() if fresh else None
    worst = group.column("worst").to_numpy() if fresh else None
    starts = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]))
    us, ws, ss, held = [], [], [], 0
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a < 2:
            continue
        with np.errstate(over="ignore"):
            sims = (m[a:b] @ m[a:b].T) * scales[a:b, None] * scales[None, a:b]
        np.fill_diagonal(sims, -np.inf)
        if fresh:
            sims[~(new[a:b, None] | new[None, a:b])] = -np.inf
            good = (sims > worst[a:b, None]) & _best(sims, most)
        else:
            good = _best(sims, most) & (sims > -np.inf)
        x, y = np.nonzero(good)
        if len(x):
            us.append(ids[a + x])
            ws.append(ids[a + y])
            ss.append(sims[x, y])
            held += len(x)
        if held > 100_000:
            yield _edges(us, ws, ss)
            us, ws, ss, held = [], [], [], 0
    if held:
        yield _edges(us, ws, ss)


def _joined(df: DataFrame, key: str, fresh: bool, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, key):
            yield from _compare(group, key, fresh, most)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, _EDGES)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The best k of each u."""
    return edges.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "w"))).filter(F.col("k") <= k).drop("k")


def first_graph(nodes: DataFrame, n: int, k: int) -> DataFrame:
    """u, w, sim, fresh from blocks of bounded size."""
    coded = cut(nodes.select("node", "q", "s", F.explode(_tree_codes(nodes, n)).alias("code")))
    sizes = coded.groupBy("code").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / (2 * BLOCK)))
    placed = lookup(coded, sizes, "code", "n").withColumn("block", F.xxhash64("code", F.pmod(F.xxhash64("node"), "parts")))
    edges = _joined(placed.select("block", F.col("node").alias("member"), "q", "s"), "block", False, FIRST)
    return cut(_top(edges.groupBy("u", "w").agg(F.max("sim").alias("sim")), k).withColumn("fresh", F.lit(True)))


def build(nodes: DataFrame, n: int, k: int = NEIGHBOURS) -> DataFrame:
    """The graph (u, w, sim) over nodes (node, q, s): NN-descent."""
    graph = first_graph(nodes, n, k)
    for step in count():
        draw = F.xxhash64("u", "w", F.lit(step))
        mine = Window.partitionBy("u", "fresh").orderBy(draw, "w")
        graph = graph.withColumn("drawn", F.row_number().over(mine) <= SAMPLE)
        forth = graph.filter("drawn").select(F.col("u").alias("owner"), F.col("w").alias("member"), "fresh")
        theirs = Window.partitionBy("w", "fresh").orderBy(draw, "u")
        back = graph.withColumn("k", F.row_number().over(theirs)).filter(F.col("k") <= SAMPLE).select(F.col("w").alias("owner"), F.col("u").alias("member"), "fresh")
        members = cut(forth.unionAll(back).groupBy("owner", "member").agg(F.max("fresh").alias("fresh")), False)
        last = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("sim")).select(F.col("u").alias("node"), F.when(F.col("n") >= k, F.col("sim")).otherwise(F.lit(float("-inf"))).alias("worst"))
        carried = nodes.join(last, "node", "left").select(F.col("node").alias("member"), "q", "s", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
        # a frequent member's rows are parted by Spark's skew join
        found = _joined(members.join(carried, "member", "left"), "owner", True, PROPOSALS)
        both = graph.select("u", "w", "sim", (F.col("fresh") & ~F.col("drawn")).alias("fresh"), F.lit(False).alias("found")).unionAll(found.withColumns({"fresh": F.lit(True), "found": F.lit(True)}))
        merged = both.repartition("u").groupBy("u", "w").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.min("found").alias("found"))
        seen = Observation()
        graph = cut(_top(merged, k).observe(seen, F.count("*").alias("n"), F.count_if("found").alias("new"))).drop("found")
        if not seen.get["n"] or seen.get["new"] < LEAST_CHANGE * seen.get["n"]:
            break
    return graph.select("u", "w", "sim")


@F.arrow_udf(T.DoubleType())
def _dot(a: pa.Array, sa: pa.Array, b: pa.Array, sb: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    dots = np.einsum("ij,ij->i", _stack(a), _stack(b)).astype(np.float64)
    with np.errstate(over="ignore"):
        return pa.array(dots * sa.to_numpy(zero_copy_only=False) * sb.to_numpy(zero_copy_only=False))


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, pool: int = POOL) -> DataFrame:
    """q, w, sim: the best pool nodes found for each query node q of queries (node).

    Each hop writes only what it adds; nodes scored before are looked up for the queries that are still on their way.
    """
    back = graph.select(F.col("w").alias("u"), F.col("u").alias("w"), "sim")
    both = graph.select("u", "w").unionAll(_top(back, NEIGHBOURS).select("u", "w"))
    ways = cut(both.groupBy(F.col("u").alias("w")).agg(F.collect_set("w").alias("nexts")))  # at most two lists a node
    asked = queries.select(F.col("node").alias("q")).join(nodes.select(F.col("node").alias("q"), F.col("q").alias("qv"), F.col("s").alias("qs")), "q")
    asked = cut(asked)
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "w")
    held = cut(graph.join(asked.select(F.col("q").alias("u")), "u", "left_semi").select(F.col("u").alias("q"), "w", "sim", F.lit(False).alias("open")))
    seen = held.select("q", "w")
    left = bool(held.limit(1).count())
    while left:
        front = held.filter("NOT open").select("q", "w")
        # hubs are frequent on the left; Spark's skew join parts their rows
        reached = front.join(ways, "w").select("q", F.explode("nexts").alias("w")).filter("q <> w").distinct()
        fresh = cut(reached.join(seen.join(front.select("q").distinct(), "q", "left_semi"), ["q", "w"], "left_anti"), False)
        seen = seen.unionAll(fresh)
        scored = fresh.join(nodes.select(F.col("node").alias("w"), F.col("q").alias("wv"), "s"), "w").join(asked, "q").select("q", "w", _dot("qv", "qs", "wv", "s").alias("sim"), F.lit(False).alias("open"))
        every = held.withColumn("open", F.lit(True)).unionAll(scored)
        more = Observation()
        held = cut(every.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= pool).drop("k").observe(more, F.count_if(~F.col("open")).alias("n")))
        left = more.get["n"] > 0
    return held.select("q", "w", "sim")


def exact(a: str, b: str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, neighbours: int = NEIGHBOURS, pool: int = POOL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of the rows for which is_query (of vec_id) holds."""
    own = cut(usable(rows, id_col, vector_col))
    # numbered by partition and place in it, which are the same for the same table; ids may repeat
    classes = own.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).sortWithinPartitions("v")
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    nodes = cut(classes.select("node", _packed("v").alias("p")).select("node", "p.q", "p.s"))
    graph = build(nodes, classes.count(), neighbours)
    # the classes' rows: k of each of k + 1 ids are enough, one id may be that of the query itself
    several = classes.filter("n > 1")
    first, same = Window.partitionBy("node").orderBy("vec_id"), Window.partitionBy("node", "vec_id").orderBy("vec_id")
    members = lookup(own, several.select("v", "node", "n"), "v", "n").filter(F.col("node").isNotNull()).select("node", "vec_id")
    members = members.withColumn("k", F.row_number().over(same)).filter(F.col("k") <= k)
    members = members.withColumn("k", F.dense_rank().over(first)).filter(F.col("k") <= k + 1).select("node", "vec_id").unionAll(classes.filter("n = 1").select("node", F.col("least").alias("vec_id")))
    asked = cut(lookup(own.filter(is_query), classes.select("v", "node", "n"), "v", "n").select(F.col("vec_id").alias("query_id"), "node"))
    askers = cut(asked.groupBy("node").agg(F.count("*").alias("n")))
    found = search(nodes, graph, askers.select("node"), pool)
    near = _top(found.select(F.col("q").alias("u"), "w", "sim"), 2 * k).select(F.col("u").alias("q"), "w").unionAll(askers.select(F.col("node").alias("q"), F.col("node").alias("w")))
    vectors = classes.select("node", "v")
    scored = near.join(vectors.select(F.col("node").alias("q"), F.col("v").alias("a")), "q").join(vectors.select(F.col("node").alias("w"), F.col("v").alias("b")), "w").select("q", "w", exact("a", "b").alias("score"))
    listed = scored.join(members.withColumnRenamed("node", "w"), "w")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    # k rows of an id at most, so that among 2k rows k are of other ids than the query's
    own_best = Window.partitionBy("q", "vec_id").orderBy(F.desc("score"))
    listed = listed.withColumn("k", F.row_number().over(own_best)).filter(F.col("k") <= k)
    listed = listed.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= 2 * k)
    packed = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near")).select(F.col("q").alias("node"), "near").join(askers, "node")
    packed = cut(packed)
    answered = lookup(asked, packed, "node", "n", total=asked.count()).withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return answered.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def op1_nn_descent_search(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
