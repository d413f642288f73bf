"""Every registered query: with SQL, its rows against DuckDB's; else that it runs and has rows."""

import pytest
from oracle import compare

from docloom.plans.registry import ORACLE_SQL, QUERIES

EMPTY = {"clear_collection", "dimension_check", "extract_references", "time_references", "hybrid_contains_topk"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, sf, name):
    assert compare(spark, sf, QUERIES[name], ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_has_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns == list(dict.fromkeys(df.columns)) and (df.count() > 0 or name in EMPTY)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and max(r["rank"] for r in rows) == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_contains_finds_all(spark, tmp_path):
    name = "hybrid_contains_topk"
    texts = ["foo bar", "我们研究医疗数据的方法", "x foo bar y", "red green blue", "redder green bluest", "a the of b", "医疗", "!! ??", "", None, "foo.bar, baz"]
    asked = ["foo ba", "医疗数据", "医", "foo", "red green blu", "oo.bar, b", "!!", "", None, "the", "green", "研究 医疗"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert compare(spark, str(tmp_path), QUERIES[name], ORACLE_SQL[name]) == ""
    found = {(r.query_id, r.doc_id) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert {(0, 0), (0, 2), (1, 1), (2, 1), (2, 6), (4, 3), (5, 10)} <= found
