"""Plans: filters and columns reach the scan, joins are on equality, Python stays out of the hot paths; SQL and queries agree on names."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import audit, overlay, usage
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_usage_scan_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([(1, "ls", "s", 5, 1, 1, 1, 0, 0.0, "", 0)], usage.SCHEMA).write.parquet(f"{tmp_path}/runs")
    p = plan(usage.scan(spark.read.parquet(f"{tmp_path}/runs"), since=3, session="s", limit=5).select("id", "command"))
    assert "GreaterThanOrEqual(recorded_at,3)" in p and "EqualTo(session,s)" in p and "TakeOrderedAndProject" in p
    read = re.search(r"ReadSchema: (struct<[^>]*>)", p)[1]
    assert "token_before" not in read and "duration_ms" not in read


@pytest.mark.parametrize("name", ["usage_by_command", "top_savers", "classify_label", "md_sections", "findings_report", "tokens_bigram", "overlay_validate", "filter_dispatch", "compact_generic", "near_duplicates", "overlapping_scopes", "induced_subgraph"])
def test_plans_stay_in_the_jvm_without_products(spark, name):
    p = plan(registry.QUERIES[name](spark, SF))
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapInArrow|MapInPandas|CartesianProduct", p)
    assert "BroadcastNestedLoopJoin" not in p or "LeftAnti" in p


def test_prefix_checks_join_on_equality(spark):
    scopes = spark.createDataFrame([("a", "code/x"), ("b", "code/x/y")], "agent string, scope string")
    assert "NestedLoop" not in plan(audit.overlapping_scopes(scopes))
    names = spark.createDataFrame([("graph",)], "name string")
    assert "NestedLoop" not in plan(overlay.near_duplicates(names, names))


def test_entry_and_registry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "score"] and df.count() > 0
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    """Every query with SQL, against DuckDB on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{v + 0.0:.5f}" if isinstance(v, float) else str(int(v)) if hasattr(v, "dtype") and v.dtype.kind in "iu" else str(v)

    a = sorted(tuple(cell(r[c]) for c in cols) for r in got.select(*[F.col(f"`{c}`") for c in cols]).collect())
    b = sorted(tuple(cell(v) for v in r) for r in want[cols].itertuples(index=False, name=None))
    assert a == b
