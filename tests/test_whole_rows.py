"""Registered queries cover whole documents and all rows."""

from tessera.plans import registry


def test_go_outline_has_all_words(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "(96 lines omitted, lines 9-104)" in registry.QUERIES["go_outline"](spark, str(tmp_path)).first().outline


def test_tokens_are_stemmed_in_all_rows(spark, tmp_path):
    spark.createDataFrame([(1, "graph graph", "en"), (2, "graph", "de"), (3, "graph", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n for r in registry.QUERIES["tokens_stemmed"](spark, str(tmp_path)).collect()] == [4]
