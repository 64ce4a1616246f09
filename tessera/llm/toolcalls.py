"""Tool-call linking for chat data, with DataFrame functions only.

Calls and results are joined by hash on (conversation, call id); calls are ordered topologically by round and turn, where
the round of a call is the largest number of late dependencies (at the same or a later turn) on a chain behind it, so that
in most conversations the turns alone are the order; arguments are checked against the tool's schema; every message is
written as canonical JSON: keys sorted at all depths, no white space.

Messages (conv_id, turn, role, text) give calls in two ways.  An assistant's text that is a JSON object with tool_calls
gives its calls, and a tool's text with tool_call_id a result.  Any other user turn is the call `reply` with id
conv_id:turn and its text as argument; the assistant's turn right after it is the result by that id; it depends on the
call two turns before.  A call also depends on each call that its arguments name as "${id}".

Schemas: tool -> argument -> (kind, required).  A kind is the name of a JSON type, or a dict with `type` and, as wanted,
`enum`, `minimum`, `maximum`, `items` (a kind, of arrays) and `properties` (argument -> (kind, required), of objects).

Defined results: null text is a missing argument (not valid); null conv_id or turn gives a null id, never linked; the
first of several results (by turn, then content) counts; equal messages are kept row by row; calls of a conversation that
share an id are one, at the first turn, to what depends on them; a call on a cycle, or behind one, has null round; an
unknown tool, bad JSON, a missing, unknown or mistyped argument is not valid; an empty table has no rows; very long texts
are read whole; white space may stand before a JSON object; integers of more than 38 digits become doubles.  Only the four columns are read, so further ones may have any name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, lookup, table

#: Schemas travel inside the plan.
Kind = str | dict
Params = dict[str, tuple[Kind, bool]]
SCHEMAS: dict[str, Params] = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}
_REFERENCE = r"\$\{([^}]+)\}"


def quoted(c: Column) -> Column:
    """A JSON string."""
    text = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no white space; null where it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def _typed(kind: Column, wanted: str) -> Column:
    if wanted == "number":
        return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    if wanted in ("object", "array"):
        return kind.startswith(wanted.upper())
    return kind == _TYPES[wanted]


def fits(value: Column, kind: Kind) -> Column:
    """Whether a variant is of the kind."""
    kind = {"type": kind} if isinstance(kind, str) else kind
    out = _typed(F.schema_of_variant(value), kind["type"])
    if "enum" in kind:
        out &= F.to_json(value).isin([json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in kind["enum"]])
    number = F.try_variant_get(value, "$", "double")
    if "minimum" in kind:
        out &= number >= F.lit(float(kind["minimum"]))
    if "maximum" in kind:
        out &= number <= F.lit(float(kind["maximum"]))
    if "items" in kind:
        out &= F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: fits(x, kind["items"]))
    if "properties" in kind:
        out &= fits_object(value, kind["properties"])
    return F.coalesce(out, F.lit(False))


def fits_object(value: Column, params: Params) -> Column:
    """Whether a variant is an object with no other members, the required ones, and each of its kind."""
    names = F.array().cast("array<string>") if not params else F.array(*[F.lit(p) for p in params])
    members = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    out = F.schema_of_variant(value).startswith("OBJECT") & (F.size(F.array_except(members, names)) == 0)
    for name, (kind, required) in params.items():
        got = F.try_variant_get(value, f'$["{name}"]', "variant")
        there = got.isNotNull() & (F.schema_of_variant(got) != "VOID")
        out &= F.when(there, fits(got, kind)).otherwise(F.lit(not required))
    return F.coalesce(out, F.lit(False))


def valid(name: Column, arguments: Column, schemas: dict[str, Params]) -> Column:
    """Whether arguments (variant) meet the schema of the tool."""
    checks = F.lit(False)
    for tool, params in schemas.items():
        checks = F.when(name == tool, fits_object(arguments, params)).otherwise(checks)
    return F.coalesce(checks, F.lit(False))


def events(messages: DataFrame) -> DataFrame:
    """kind (call, result, message), conv_id, turn, role, text, call_id, name, arguments (JSON), content, after (array of ids)."""
    rows = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    parsed = rows.withColumn("v", F.when(F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^[ \t\n\r]*\{"), F.try_parse_json("text")))
    listed = parsed.withColumn("calls", F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))).withColumn("answers", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))
    explicit = listed.filter(F.size("calls") > 0).withColumn("c", F.explode("calls"))
    raw = F.try_variant_get("c", "$.arguments", "variant")
    asked = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get("c", "$.arguments", "string")).otherwise(F.to_json(raw))
    no_ids, at = F.array().cast("array<string>"), F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn")).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()

    def near(back: int) -> Column:
        return F.when(known, F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string")))

    none = F.lit(None).cast("string")
    cols = ["conv_id", "turn", "role", "text"]
    named = explicit.select(F.lit("call").alias("kind"), *cols, F.try_variant_get("c", "$.id", "string").alias("call_id"), F.try_variant_get("c", "$.name", "string").alias("name"), asked.alias("arguments"), none.alias("content"), no_ids.alias("after"))
    rest = listed.filter(F.coalesce(F.size("calls") <= 0, F.lit(True)))
    user, tool, reply = F.col("role") == "user", F.col("answers").isNotNull(), F.col("role") == "assistant"
    kind = F.when(user, "call").when(tool | reply, "result").otherwise("message")
    plain = rest.select(
        kind.alias("kind"), *cols,
        F.when(user, near(0)).when(tool, F.col("answers")).when(reply, near(1)).alias("call_id"),
        F.when(user, F.lit("reply")).alias("name"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))).alias("arguments"),
        F.when(tool, F.to_json(F.try_variant_get("v", "$.content", "variant"))).when(reply, quoted(F.col("text"))).alias("content"),
        F.when(user & known, F.array(near(2))).otherwise(no_ids).alias("after"),
    )
    return named.unionByName(plain)


def _jumped(ways: DataFrame) -> DataFrame:
    """u, v, w of nodes with one way out each: where they lead in the end, past other such nodes, and the sum of w; v is
    one of them only on or behind a cycle.  Every step doubles the reach, so a chain of n nodes takes log2(n) steps."""
    ways, left = cut(ways), None
    while True:
        into = ways.groupBy(F.col("v").alias("u")).agg(F.count("*").alias("n"))
        targets = ways.join(into, "u").select(F.struct("v", "w").alias("on"), F.col("u").alias("v"), "n")
        reached = lookup(ways, targets, "v", "n")
        ways = cut(reached.select("u", F.coalesce("on.v", "v").alias("v"), (F.col("w") + F.coalesce("on.w", F.lit(0))).alias("w"), F.col("on").isNotNull().alias("more")).drop("n"))
        before, left = left, ways.filter("more").count()
        ways = ways.drop("more")
        if left in (0, before):
            return ways


def rounds_of(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, round for calls (conv_id, turn, call_id, after) that must wait: 0 is left out.

    Only conversations with a late dependency (at the same or a later turn) are looked at; the round of a call is the
    largest number of late dependencies on a chain behind it.  Calls with one dependency are passed over by doubling steps.
    What remains are calls with several: they are settled from the ends of the chains on, so there are as many rounds as
    such calls on the longest chain.  On or behind a cycle the round is null.  Ids that name no call are no dependency;
    calls of a conversation that share an id are one, at its first turn.
    """
    named = calls.filter(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    first = named.groupBy("conv_id", "call_id").agg(F.min("turn").alias("at"))
    edges = named.select("conv_id", "turn", "call_id", F.explode("after").alias("dep")).distinct()
    known = edges.join(first.select("conv_id", F.col("call_id").alias("dep"), "at"), ["conv_id", "dep"]).withColumn("w", (~F.coalesce(F.col("at") < F.col("turn"), F.lit(False))).cast("long"))
    known = cut(known.groupBy("conv_id", "call_id", "dep").agg(F.max("w").alias("w")))
    late = known.filter("w > 0").select("conv_id").distinct()
    own = known.join(late, "conv_id", "left_semi").select(F.struct("conv_id", "call_id").alias("u"), F.struct("conv_id", F.col("dep").alias("call_id")).alias("v"), "w")
    own = cut(own)
    kind = "struct<conv_id:{},call_id:string>".format(dict(calls.dtypes)["conv_id"])
    settled = calls.sparkSession.createDataFrame([], f"u {kind}, round long")
    if not own.limit(1).count():
        return settled.select("u.conv_id", "u.call_id", "round", F.lit(True).alias("waits"))
    fan = own.groupBy("u").agg(F.count("*").alias("n"))
    chains = _jumped(own.join(fan.filter("n = 1"), "u", "left_semi"))
    passed = chains.select(F.col("u").alias("v"), F.col("v").alias("end"), F.col("w").alias("more"))
    several = own.join(fan.filter("n > 1"), "u", "left_semi").join(passed, "v", "left").select("u", F.coalesce("end", "v").alias("v"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
    several = several.groupBy("u", "v").agg(F.max("w").alias("w"))
    # ends of all chains have round 0
    open_ = cut(several.join(own.select(F.col("u").alias("v"), F.lit(True).alias("on")).distinct(), "v", "left").select("u", "v", F.when(F.col("on").isNull(), F.col("w")).alias("got"), "w"))
    while True:
        new = cut(open_.groupBy("u").agg(F.max("got").alias("round"), F.count("got").alias("known"), F.count("*").alias("all")).filter(F.col("known") == F.col("all")).select("u", "round"))
        if not new.limit(1).count():
            break
        settled = settled.unionAll(new)
        rest = open_.join(new.select("u"), "u", "left_anti").join(new.select(F.col("u").alias("v"), F.col("round").alias("r")), "v", "left")
        open_ = cut(rest.select("u", "v", F.coalesce("got", F.col("w") + F.col("r")).alias("got"), "w"))
    stuck = open_.select("u", F.lit(None).cast("long").alias("round")).distinct()
    done = settled.unionAll(stuck)
    ends = chains.join(done.select(F.col("u").alias("v"), F.col("round"), F.lit(True).alias("several")), "v", "left").join(chains.select(F.col("u").alias("v"), F.lit(True).alias("cycle")).distinct(), "v", "left")
    single = ends.select("u", F.when(F.col("cycle").isNotNull(), F.lit(None)).when(F.col("several").isNotNull(), F.col("w") + F.col("round")).otherwise(F.col("w")).cast("long").alias("round"))
    return done.unionAll(single).select("u.conv_id", "u.call_id", "round", F.lit(True).alias("waits"))


def link(messages: DataFrame, schemas: dict[str, Params] | None = None) -> DataFrame:
    """One row for each call, result and other message: conv_id, turn, kind, call_id, name, round, linked, valid, json.

    Ordering by (conv_id, round, turn, call_id) runs every call after those it depends on.
    """
    schemas = SCHEMAS if schemas is None else schemas
    own = cut(events(messages))
    calls, results = own.filter("kind = 'call'"), own.filter("kind = 'result'")
    first = results.filter(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    args = F.try_parse_json("arguments")
    refs = calls.select("conv_id", "turn", "call_id", F.array_union("after", F.when(F.col("arguments").contains("${"), F.regexp_extract_all("arguments", F.lit(_REFERENCE))).otherwise(F.array().cast("array<string>"))).alias("after"))
    ordered = rounds_of(refs)
    # rows without an id meet nothing, and are not shuffled to one place
    known = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    none_of = {"r": F.lit(None).cast(dict(first.dtypes)["r"]), "round": F.lit(None).cast("long"), "waits": F.lit(None).cast("boolean")}
    linked = calls.filter(known).join(first, ["conv_id", "call_id"], "left").join(ordered, ["conv_id", "call_id"], "left")
    linked = linked.unionByName(calls.filter(~known).withColumns(none_of))
    linked = linked.withColumns({"round": F.when(F.col("waits").isNull(), F.lit(0).cast("long")).otherwise(F.col("round")), "linked": F.col("r").isNotNull(), "valid": valid(F.col("name"), args, schemas)})
    shown = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(args), quoted(F.col("arguments"))), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), F.coalesce(F.col("r.content"), F.lit("null")), F.lit(',"type":"tool_call"}'))
    cols = ["conv_id", "turn", "kind", "call_id", "name", "round", "linked", "valid"]
    asked = linked.select(*cols, shown.alias("json"))
    answered = results.filter(known).join(calls.filter(known).select("conv_id", "call_id", F.lit(True).alias("asked")).distinct(), ["conv_id", "call_id"], "left").withColumn("linked", F.col("asked").isNotNull())
    answered = answered.unionByName(results.filter(~known).withColumns({"asked": F.lit(None).cast("boolean"), "linked": F.lit(False)}))
    none = {"round": F.lit(None).cast("long"), "valid": F.lit(None).cast("boolean"), "name": F.lit(None).cast("string")}
    told = F.concat(F.lit('{"content":'), F.coalesce("content", F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"type":"tool_result"}'))
    other = own.filter("kind = 'message'").withColumn("linked", F.lit(False))
    said = F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"type":"message"}'))
    return asked.unionAll(answered.withColumns(none).select(*cols, told.alias("json"))).unionAll(other.withColumns(none).select(*cols, said.alias("json")))


def op10_tool_call_linking(spark, sf_dir: str) -> DataFrame:
    """All messages; what a message has not is written as '', -1 or false."""
    return link(table(spark, sf_dir, "conversations")).fillna({"name": "", "call_id": "", "round": -1, "valid": False})


OP10_SQL = """
WITH m AS (SELECT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, text FROM m WHERE role = 'user'),
r AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text FROM m WHERE role = 'assistant')
SELECT c.conv_id, c.turn, 'call' AS kind, c.call_id, 'reply' AS name, 0::BIGINT AS round, r.turn IS NOT NULL AS linked, c.text IS NOT NULL AS valid,
  '{"arguments":{' || coalesce('"prompt":' || CAST(to_json(c.text) AS VARCHAR) || ',', '') || '"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"reply","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || ',"type":"tool_call"}' AS json
FROM c LEFT JOIN r USING (conv_id, call_id)
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.call_id, '', -1, c.turn IS NOT NULL, false,
  '{"content":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || ',"id":"' || r.call_id || '","type":"tool_result"}'
FROM r LEFT JOIN c USING (conv_id, call_id)
UNION ALL
SELECT conv_id, turn, 'message', '', '', -1, false, false,
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":"' || role || '","type":"message"}'
FROM m WHERE role NOT IN ('user', 'assistant')
"""
