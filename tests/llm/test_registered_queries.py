"""Every registered query on small tables: awkward rows, empty tables, SQL where there is some."""

import random
import zlib

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row long, doc string, fp string, score double"
TABLES = {
    "documents": DOCS,
    "labels": "doc_id long, quality int, toxic int, text string",
    "benchmark": "item_id long, text string, doc_id long",
    "embeddings": "vec_id long, embedding array<float>, label int, row long, score double",
    "conversations": "conv_id long, turn int, role string, text string, kind string",
    "pages": "page_id long, url string, html string",
}


def rows_of(name):
    r = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    if name == "documents":
        texts = [said(40) for _ in range(20)] + [None, "", "  ", "...", "x " * 4000, "Mr Jones wrote to ann@example.com. token=abcdefgh1", "Grüße, été 北京"]
        texts += [texts[0], texts[0] + " more"]
        own = [(i, t, ["en", "de", None][i % 3], ["s1", None][i % 2], 0, "z", 1, "d", "f", 0.5) for i, t in enumerate(texts)]
        return own + [own[3], (None, texts[1], "en", "s1", 0, "z", 1, "d", "f", 0.5), (None, None, None, None, None, None, None, None, None, None), (3, "other text", "de", "s2", 0, "z", 1, "d", "f", 0.5)]
    if name == "labels":
        return [(i, i % 2, i % 3 == 0, "t") for i in range(20)] + [(None, 1, 1, "t"), (5, None, None, None), (0, 1, 0, "t")]
    if name == "benchmark":
        return [(1, said(20), 0), (2, None, 0), (3, "", 0), (4, "alpha beta", 0), (4, "alpha beta", 0), (None, "gamma delta", 0)]
    if name == "embeddings":
        own = [(i, [r.gauss(0, 1) for _ in range(8)], i % 3, 0, 0.0) for i in range(60)]
        return own + [own[7], (None, own[1][1], 1, 0, 0.0), (61, None, 1, 0, 0.0), (62, [0.0] * 8, None, 0, 0.0), (63, [float("nan")] * 8, 1, 0, 0.0), (64, [1.0, None] * 4, 1, 0, 0.0), (65, [], 1, 0, 0.0), (66, [1.0], 1, 0, 0.0)]
    if name == "conversations":
        return [(1, 0, "user", "hi", "k"), (1, 1, "assistant", "ho", "k"), (1, 1, "assistant", "ho", "k"), (2, 0, "system", None, "k"), (None, None, None, None, None), (3, 0, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{}}]}', "k"), (3, 1, "tool", '{"tool_call_id":"a","content":{}}', "k")]
    return [(1, "http://x.example.com", "<p>x</p>"), (2, None, None)]


def write(spark, path, empty):
    for name, schema in TABLES.items():
        rows = [] if empty else [tuple(int(v) if isinstance(v, bool) else v for v in x) for x in rows_of(name)]
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("awkward"), False)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nothing"), True)


N_DOCS, HELD_OUT = 33, lambda i, m, k: i is not None and zlib.crc32(str(i).encode()) % m == k
COLUMNS = {
    1: {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    2: {"doc_id": "bigint", "source": "string", "copies": "bigint"},
    3: {"doc_id": "bigint", "n_tokens": "bigint", "n_tokens_after": "bigint"},
    4: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    5: {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    6: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    7: {"doc_id": "bigint", "text": "string", "n_entities": "bigint", "entities": "string"},
    8: {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    9: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    10: {"conv_id": "bigint", "kind": "string", "json": "string"},
    11: {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    12: {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    13: {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
}
NUMBERED = {int(name[2:].split("_")[0]): name for name in queries.QUERIES}


def test_all_thirteen_are_registered():
    assert set(NUMBERED) == set(COLUMNS)


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_awkward_rows(spark, awkward, n):
    df = queries.QUERIES[NUMBERED[n]](spark, awkward)
    assert COLUMNS[n].items() <= dict(df.dtypes).items()
    rows = df.collect()
    if n in (2, 3, 4, 5, 6, 7, 8, 9, 13):
        assert len(rows) == N_DOCS and sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 3 for r in rows) == 3
    if n in (4, 9):
        assert all(r.held_out == HELD_OUT(r.doc_id, *((3, 1) if n == 4 else (4, 2))) and 0 <= r.score <= 1 for r in rows)
    if n == 1:
        assert {r.query_id for r in rows} == {0, 20, 40} and max(r["rank"] for r in rows) == 20
    if n == 11:
        assert {r.anchor_id for r in rows} <= {0} and all(r.rank <= 10 for r in rows)
    if n == 13:
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_empty_tables(spark, nothing, n):
    df = queries.QUERIES[NUMBERED[n]](spark, nothing)
    assert COLUMNS[n].items() <= dict(df.dtypes).items() and df.collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = db.execute(queries.ORACLE_SQL[name])
        names, want = [c[0] for c in found.description], found.fetchall()
    got = [tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, SF).collect()]
    shown = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(got) == shown(want) and want
