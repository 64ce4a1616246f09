"""Ranked blocks for a query: boosts, thresholds, survivors, concepts, packages, entry points."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let, scope_pattern
from tessera.operators.bm25 import broadcast_if_small
from tessera.sources.store import settled

# Trust by tier, boosts, thresholds, and stems that speak of code.
TRUST = {"specs": "high", "docs": "medium", "context": "medium", "notes": "low"}
BOOST = {"specs": 1.3, "docs": 1.0, "context": 1.0, "notes": 0.6, "high": 1.3, "medium": 1.0, "low": 0.6}
AFFINITY, LEAST, BLOCKS, ENTRY_POINTS, PACKAGES, CONCEPTS, CODE_BOOST, NEAR_TIE = 1.2, 0.05, 12, 5, 5, 10, 0.9, 0.12
CONCEPT_LEAST, CONCEPT_OF_TOP = 0.1, 0.5
#: Symbols of a block, of which only those that can matter for the first places go on.
BLOCK_SYMBOLS = 8192
CODE_STEMS = ("index", "symbol", "packag", "graph", "load", "build", "api", "func", "type", "test", "debug", "migrat")


def trust(tier: Column) -> Column:
    out = F.lit("medium")
    for t, name in TRUST.items():
        out = F.when(tier == t, name).otherwise(out)
    return out


def trust_rank(name: Column) -> Column:
    return F.when(name == "high", 3).when(name == "medium", 2).when(name == "low", 1).otherwise(0)


def boost(tier: Column, trusted: Column) -> Column:
    """By the tier if it has a boost, else by the trust."""
    out = F.lit(None).cast("double")
    for key, value in BOOST.items():
        out = F.coalesce(out, F.when(tier == key, F.lit(value)))
    for key, value in BOOST.items():
        out = F.coalesce(out, F.when(trusted == key, F.lit(value)))
    return F.coalesce(out, F.lit(1.0))


def with_relevance(scored: DataFrame, affine: Column | None = None) -> DataFrame:
    """Adds trust and relevance to rows of (query_id, file, section, tier, score); affine: where the owner reads or holds the block."""
    out = scored.withColumn("trust", trust(F.col("tier")))
    factor = F.when(F.coalesce(affine, F.lit(False)), AFFINITY).otherwise(1.0) if affine is not None else F.lit(1.0)
    return out.withColumn("relevance", F.col("score") * boost(F.col("tier"), F.col("trust")) * factor)


def block_order_of(*by: str):
    return Window.partitionBy(*by).orderBy(F.desc("relevance"), F.desc(trust_rank(F.col("trust"))), "file", "section")


def block_order(by: str = "query_id"):
    return block_order_of(by)


def blocks(relevant: DataFrame, least: float = LEAST, cap: int = BLOCKS) -> DataFrame:
    """The first cap blocks of each query that reach the threshold, with rank."""
    return relevant.filter(F.col("relevance") >= least).withColumn("rank", F.row_number().over(block_order())).filter(F.col("rank") <= cap).withColumn("rank", F.col("rank").cast("long"))


def with_scope_survivor(relevant: DataFrame, scoped: Column, least: float = LEAST, cap: int = BLOCKS) -> DataFrame:
    """blocks(), but if none is in scope and a later one is, the first such takes the last place.

    First the best cap blocks in scope and the best cap others of each query are taken, which a task does for its own rows
    before anything moves; all that counts is among them.
    """
    passed = relevant.filter(F.col("relevance") >= least).withColumn("scoped", F.coalesce(scoped, F.lit(False)))
    near = passed.withColumn("_k", F.row_number().over(block_order_of("query_id", "scoped"))).filter(F.col("_k") <= cap).drop("_k")
    q = Window.partitionBy("query_id")
    ranked = near.withColumn("rank", F.row_number().over(block_order()))
    first = F.min(F.when(F.col("scoped"), F.col("rank"))).over(q)
    last = F.least(F.max("rank").over(q), F.lit(cap))
    marked = ranked.withColumns({"first": first, "last": last})
    swap = F.col("first").isNotNull() & (F.col("first") > cap)
    keep = F.when(swap, (F.col("rank") < F.col("last")) | (F.col("rank") == F.col("first"))).otherwise(F.col("rank") <= cap)
    return marked.filter(keep).withColumn("rank", F.least("rank", "last").cast("long")).drop("first", "last")


def with_code_survivor(kept: DataFrame, passed: DataFrame, code_query: Column, cap: int = BLOCKS, prefix: str = "code/") -> DataFrame:
    """kept, but a query that speaks of code, without a code block and not led by specs, gets its best code block: as a
    further one if there is room, else in the last place if it is better.

    code_query: a condition on the query's rows of kept; kept and passed have (query_id, file, section, trust, relevance),
    kept also rank.
    """
    state = kept.groupBy("query_id").agg(
        F.max(F.col("file").startswith(prefix)).alias("has_code"),
        F.min(F.when(F.col("rank") <= 3, F.col("trust") == "high").otherwise(True)).alias("specs_lead"),
        F.max("rank").alias("n"),
        F.min_by("relevance", -F.col("rank")).alias("tail"),
        F.max(code_query).alias("asks"),
    )
    best = passed.filter(F.col("file").startswith(prefix)).withColumn("k", F.row_number().over(block_order())).filter("k = 1").drop("k")
    add = best.join(state.filter("asks AND NOT has_code AND NOT specs_lead"), "query_id").filter((F.col("n") < cap) | (F.col("relevance") > F.col("tail")))
    added = add.withColumn("rank", F.when(F.col("n") < cap, F.col("n") + 1).otherwise(F.col("n")))
    cols = ["query_id", "file", "section", "trust", "relevance", "rank"]
    rest = kept.join(added.select("query_id", "rank"), ["query_id", "rank"], "left_anti")
    return rest.select(*cols).unionByName(added.select(*cols))


def in_scopes(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """The columns of paths (path, ...) and of scopes (scope, ...) for each path that lies in a scope.

    A trie of literal prefixes, by equality: a scope lies under what it says before its first wildcard, a path looks up its
    own beginnings of the lengths that scopes have (the driver gets these lengths, a number each).  Only scopes with
    wildcards before their end are tested as patterns, and only on paths that share their prefix.  Equal scopes are looked
    up and tested once, whoever has them, and as patterns that are made once.
    """
    others = [c for c in scopes.columns if c != "scope"]
    owners = scopes.filter(F.col("scope") != "").groupBy("scope").agg(F.collect_list(F.struct(F.lit(1).alias("_"), *others)).alias("_owners"))
    bare = F.regexp_replace(F.regexp_replace("scope", r"\*\*$", ""), r"\*$", "")
    known = owners.withColumn("_bare", bare).withColumn("_prefix", F.regexp_extract("_bare", r"^[^*?\[\\]*", 0)).withColumn("_plain", F.col("_prefix") == F.col("_bare")).withColumn("_pattern", scope_pattern(F.col("scope")))
    known = settled(known)
    own = F.col("path").startswith(F.col("_bare"))
    parts = []
    for rows, test in ((known.filter("_plain"), F.lit(True)), (known.filter("NOT _plain"), F.when(F.col("_bare").endswith("/"), own).otherwise(own | F.regexp_like("path", F.col("_pattern"))))):
        lengths = sorted(r.n for r in rows.select(F.length("_prefix").alias("n")).distinct().collect())
        begins = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
        looked = paths.filter(F.col("path").isNotNull()).withColumn("_prefix", F.explode(F.transform(begins, lambda n: F.substring(F.col("path"), F.lit(1), n))))
        parts.append(looked.join(broadcast_if_small(rows), "_prefix").filter(test).select(*paths.columns, "scope", F.explode("_owners").alias("_owner")))
    return parts[0].unionAll(parts[1]).select(*paths.columns, *[F.col("scope") if c == "scope" else F.col(f"_owner.{c}").alias(c) for c in scopes.columns])


def connected(nodes: DataFrame, edges: DataFrame, scopes: DataFrame) -> DataFrame:
    """id, agent: agents that read a node, and agents with a scope (agent, scope) that holds its file."""
    reads = edges.filter(F.col("type") == "reads").select(F.col("to").alias("id"), F.regexp_replace("from", "^agent:", "").alias("agent"))
    held = in_scopes(nodes.filter(F.coalesce("file", F.lit("")) != "").select("id", F.col("file").alias("path")), scopes.select("agent", "scope")).select("id", "agent")
    return reads.unionAll(held).distinct()


def excluded(nodes: DataFrame, include_notes: bool) -> DataFrame:
    """The prefix that is left out where notes are off but there are some."""
    return nodes.filter((F.col("type") == "note") & F.lit(not include_notes)).limit(1).select(F.lit("notes/").alias("prefix"))


def concept_threshold(scores: DataFrame, least: float = CONCEPT_LEAST, of_top: float = CONCEPT_OF_TOP) -> DataFrame:
    """Scores (query_id, doc, score) that reach both the floor and a share of the query's best; the best is aggregated where
    the scores lie, and only scores that can pass are compared with it."""
    if of_top <= 0:
        return scores.withColumn("threshold", F.lit(float(least))).filter(F.col("score") >= least)
    top = scores.groupBy("query_id").agg(F.greatest(F.lit(float(least)), F.max("score") * of_top).alias("threshold"))
    return scores.filter(F.col("score") >= least).join(top, "query_id").filter(F.col("score") >= F.col("threshold")).select(*scores.columns, "threshold")


def coverage(concept_words: Column, terms: Column) -> Column:
    """Share of a query's single words that a concept's name and description hold; 1 without any."""
    single = F.filter(terms, lambda t: ~t.contains("_"))
    return F.when(F.size(single) == 0, 1.0).otherwise(F.size(F.filter(single, lambda t: F.array_contains(concept_words, t))) / F.size(single))


def package_reach(scores: DataFrame, implements: DataFrame) -> DataFrame:
    """query_id, package, score: the best concept above the threshold that reviewed edges (doc, package) lead from."""
    return concept_threshold(scores).join(implements, "doc").groupBy("query_id", "package").agg(F.max("score").alias("score"))


def implementing_packages(reach: DataFrame, cap: int = PACKAGES) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "package")
    return reach.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).withColumn("rank", F.col("rank").cast("long"))


def near_tie_order(symbols: DataFrame, cap: int = ENTRY_POINTS, tie: float = NEAR_TIE) -> DataFrame:
    """The first cap symbols of each query, with rank; symbols: query_id, relevance, reach, package, file, symbol, line and
    orig, the place in which the graph names them.

    Relevance counts only where it differs by more than tie; else reach, package (both descending), file, symbol, line and
    orig decide.  Such an order is not transitive, so it is defined by insertion: symbols are taken as the graph names them,
    each goes behind the last one that it does not precede.

    A histogram in steps of half a tie comes first: symbols on either side of three empty steps are further apart than the
    tie, so what lies beyond those, once cap symbols are counted, is left out before anything is sorted.

    Of two symbols the one with no less relevance and no later keys stands in the way of all that the other does.  So a
    symbol behind cap such ones neither comes among the first cap nor decides who does: blocks of BLOCK_SYMBOLS in the order
    of the graph drop those by themselves, on executors.  What is left is inserted, but only the first cap places are held,
    and of what lies behind them the symbols that no other of them stands in for.  A query whose keys hold nulls, which
    leave the keys without an order, keeps all its symbols.
    """
    step = tie / 2
    names = ("reach", "package", "file", "symbol", "line", "orig")
    empty = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
    binned = symbols.withColumn("_bin", F.floor(F.col("relevance") / step).cast("long"))
    w = Window.partitionBy("query_id").orderBy(F.desc("_bin"))
    bins = binned.groupBy("query_id", "_bin").agg(F.count("*").alias("n"), F.max(empty).alias("empty")).withColumns({"before": F.sum("n").over(w) - F.col("n"), "gap": F.lag("_bin").over(w) - F.col("_bin")})
    # the first bin behind an empty step with cap symbols before it
    ends = bins.groupBy("query_id").agg(F.max(F.when((F.col("before") >= cap) & (F.col("gap") > 3), F.col("_bin"))).alias("_end"), F.max("empty").alias("_loose"))
    near = binned.join(broadcast_if_small(ends), "query_id", "left").filter(F.col("_end").isNull() | (F.col("_bin") > F.col("_end")))
    rest = [c for c in symbols.columns if c != "query_id"]
    item = F.struct("orig", F.coalesce("_loose", F.lit(True)).alias("_loose"), *[c for c in rest if c != "orig"])
    ranged = near.select("query_id", item.alias("x")).repartitionByRange("query_id", "x.orig").sortWithinPartitions("query_id", "x.orig")
    blocks_ = ranged.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK_SYMBOLS)).groupBy("query_id", "block").agg(F.sort_array(F.collect_list("x")).alias("all"))

    def keys(x: Column, y: Column) -> Column:
        """Whether the keys of x come before those of y."""
        out = F.when(x["reach"] != y["reach"], x["reach"] > y["reach"]).when(x["package"] != y["package"], x["package"] > y["package"])
        for name in ("file", "symbol", "line", "orig"):
            out = out.when(x[name] != y[name], x[name] < y[name])
        return out.otherwise(F.lit(False))

    def precedes(x: Column, y: Column) -> Column:
        """Whether x goes before y."""
        return F.when(F.abs(x["relevance"] - y["relevance"]) > tie, x["relevance"] > y["relevance"]).otherwise(keys(x, y))

    def covers(y: Column, x: Column) -> Column:
        """Whether y stands in the way of all that x does."""
        return ~x["_loose"] & (y["relevance"] >= x["relevance"]) & ~keys(x, y)

    def kept(done: Column, x: Column) -> Column:
        return F.when(F.size(F.filter(done, lambda y: covers(y, x))) < cap, F.concat(done, F.array(x))).otherwise(done)

    def insert(held: Column, x: Column) -> Column:
        first, behind = held["first"], held["behind"]
        at = F.when(~F.exists(behind, lambda y: ~precedes(x, y)), F.coalesce(F.array_max(F.transform(first, lambda y, i: F.when(~precedes(x, y), i + 1))), F.lit(0)))
        grown = let(at, lambda p: F.when(p.isNull(), F.concat(first, F.array(x))).otherwise(F.concat(F.slice(first, F.lit(1), p), F.array(x), F.slice(first, p + 1, F.size(first)))))

        def parted(all_: Column) -> Column:
            out = F.get(all_, F.lit(cap))
            more = F.when(out.isNull() | F.exists(behind, lambda y: covers(y, out)), behind).otherwise(F.concat(F.filter(behind, lambda y: ~covers(out, y)), F.array(out)))
            return F.struct(F.slice(all_, 1, cap).alias("first"), more.alias("behind"))

        return let(grown, parted)

    few = blocks_.select("query_id", F.explode(F.aggregate("all", F.slice("all", 1, 0), kept)).alias("x"))
    listed = few.groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("all"))
    none = F.slice("all", 1, 0)
    ordered = F.aggregate("all", F.struct(none.alias("first"), none.alias("behind")), insert)["first"]
    return listed.select("query_id", F.posexplode(ordered).alias("_n", "x")).select("query_id", (F.col("_n") + 1).alias("rank"), *[F.col(f"x.{c}").alias(c) for c in rest])


def entry_points(symbols: DataFrame, least: float = LEAST, cap: int = ENTRY_POINTS) -> list[dict]:
    """The first cap of one query's symbols (relevance, reach, package, file, symbol, line), as rows of the driver; without
    a place in the graph (orig) they are named by relevance and the further keys."""
    good = symbols.filter(F.col("relevance") >= least)
    if "orig" not in symbols.columns:
        names = F.struct(-F.col("relevance"), -F.col("reach"), "package", "file", "symbol", "line")
        good = good.withColumn("orig", names)
    rows = near_tie_order(good.withColumn("query_id", F.lit("q")), cap).orderBy("rank").collect()
    return [{k: v for k, v in r.asDict().items() if k not in ("query_id", "rank", "orig")} for r in rows]
