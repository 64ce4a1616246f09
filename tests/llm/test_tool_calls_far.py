"""Tool calls with late dependencies over long conversations, nested schemas, and rows without ids."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import toolcalls

MESSAGES = "conv_id long, turn long, role string, text string"


def asks(calls):
    return json.dumps({"tool_calls": [{"id": i, "name": "t", "arguments": {"x": " ".join("${%s}" % d for d in deps)}} for i, deps in calls]})


def order_of(rows):
    """Calls by (round, turn), in the order of the conversation."""
    return {r.call_id: (r["round"], r.turn) for r in rows if r.kind == "call"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_order_random_dependencies(spark, seed):
    r = random.Random(seed)
    n = 60
    deps = {f"c{i}": sorted({f"c{r.randrange(n)}" for _ in range(r.choice([0, 1, 1, 1, 2, 3]))}) for i in range(n)}
    turn = {c: r.randrange(25) for c in deps}
    rows = [(1, t, "assistant", asks([(c, deps[c]) for c in deps if turn[c] == t])) for t in range(25)]
    got = order_of(toolcalls.link(spark.createDataFrame(rows, MESSAGES), {}).collect())
    state, value = {}, {}

    def visit(c):
        """None on or behind a cycle, else the largest number of late dependencies behind."""
        if state.get(c) == 1:
            return None
        if state.get(c) == 2:
            return value[c]
        state[c] = 1
        parts = [visit(d) for d in deps[c]]
        state[c] = 2
        value[c] = None if None in parts else max([0, *(p + (turn[d] >= turn[c]) for p, d in zip(parts, deps[c], strict=True))])
        return value[c]

    def cyclic(c, seen=()):
        return c in seen or any(cyclic(d, (*seen, c)) for d in deps[c])

    order = [c for c in deps if not cyclic(c)]
    for c in order:
        visit(c)
    if any(turn[d] >= turn[c] for c in deps for d in deps[c]):
        assert {c: got[c][0] for c in deps} == {c: value[c] if c in order else None for c in deps}
    for c in order:
        assert all(got[d] < got[c] for d in deps[c])


def test_long_conversations_take_few_rounds(spark, monkeypatch):
    n, cuts = 2000, []
    rows = [(1, 2 * i, "user", f"q{i}") for i in range(n)] + [(1, 2 * i + 1, "assistant", "a") for i in range(n)]
    rows[3] = (1, 6, "user", "see ${1:4000}")
    rows.append((1, 4000, "assistant", asks([("1:4000", [])])))
    real = toolcalls.cut
    monkeypatch.setattr(toolcalls, "cut", lambda df: cuts.append(1) or real(df))
    got = order_of(toolcalls.link(spark.createDataFrame(rows, MESSAGES)).collect())
    assert got["1:4"][0] == 0 and got["1:6"][0] == 1 and got["1:3998"][0] == 1 and got["1:4000"][0] == 0
    assert len(cuts) < 25


def test_nested_schemas(spark):
    kind = {"type": "object", "properties": {"to": ({"type": "array", "items": {"type": "string", "enum": ["a", "é"]}}, True), "n": ({"type": "integer", "minimum": 1, "maximum": 5}, False)}}
    schemas = {"send": {"mail": (kind, True), "odd name": ("boolean", False)}, "stop": {}}
    cases = [
        ("send", {"mail": {"to": ["a", "é"], "n": 5}}, True), ("send", {"mail": {"to": []}, "odd name": True}, True), ("send", {"mail": {"to": ["b"]}}, False), ("send", {"mail": {"to": "a"}}, False),
        ("send", {"mail": {"to": ["a"], "n": 6}}, False), ("send", {"mail": {"to": ["a"], "n": 0}}, False), ("send", {"mail": {"n": 1}}, False), ("send", {"mail": {"to": ["a"], "x": 1}}, False),
        ("send", {"mail": {"to": [1]}}, False), ("send", {"mail": [1]}, False), ("send", {}, False), ("stop", {}, True), ("stop", {"a": 1}, False), ("go", {}, False),
    ]
    text = json.dumps({"tool_calls": [{"id": f"c{i}", "name": name, "arguments": args} for i, (name, args, _) in enumerate(cases)]}, ensure_ascii=False)
    got = {r.call_id: r.valid for r in toolcalls.link(spark.createDataFrame([(1, 0, "assistant", text)], MESSAGES), schemas).collect()}
    assert got == {f"c{i}": want for i, (_, _, want) in enumerate(cases)}


def test_rows_without_ids_stay(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "y"), (None, 1, "assistant", "z"), (1, 0, "assistant", '{"tool_calls":[{"name":"t"}]}'), (1, 1, "tool", '{"tool_call_id":null}')]
    df = spark.createDataFrame(rows, MESSAGES).withColumns({"r": F.lit(1), "waits": F.lit("x"), "kind": F.lit(0)})
    got = toolcalls.link(df).collect()
    assert len(got) == 5 and not any(r.linked for r in got)


def test_registered_query_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(c, t, ("user", "assistant", "system")[(t + (c == 2)) % 2 if t < 5 else 2], f'say "{c}" \\ é {t}' if t != 2 else None) for c in (1, 2, 3) for t in range(6)]
    spark.createDataFrame(rows, MESSAGES).write.parquet(f"{tmp_path}/conversations.parquet")
    got = toolcalls.op10_tool_call_linking(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(toolcalls.OP10_SQL).fetch_df()
    cols = sorted(got.columns)
    assert sorted(map(str, got.toPandas()[cols].itertuples(index=False))) == sorted(map(str, want[cols].itertuples(index=False)))
