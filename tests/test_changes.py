"""Streams of changes, filter expressions, metadata without a schema, commits of collections."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import metadata as M
from docloom.operators.catalog import ChangedMeanwhile, Collections
from docloom.operators.filters import boolean_filter
from docloom.storage import put_new
from docloom.streaming.changes import ChangedTable

SCHEMA = "id long, at long, op string, v string"


def last(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        out[r[0]] = r
    return sorted(r for r in out.values() if r[2] != "delete")


def test_changes(spark, tmp_path):
    rng = random.Random(6)
    schema = spark.createDataFrame([], SCHEMA).schema
    table = ChangedTable(spark, f"{tmp_path}/t", schema, "id", ["at"])
    assert table.current().count() == 0
    table.compact()
    given = []
    for step in range(4):
        rows = [(rng.randint(0, 30), rng.randint(0, 200), rng.choice(["insert", "update", "delete"]), rng.choice("abc")) for _ in range(60)]
        rows += rng.sample(given, min(len(given), 20))  # once more
        given += rows
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        table.follow(f"{tmp_path}/in", files_per_batch=1)
        assert sorted(map(tuple, table.current().collect())) == last(given)
        if step % 2:
            table.compact()
            assert sorted(map(tuple, table.current().collect())) == last(given)
        table = ChangedTable(spark, f"{tmp_path}/t", schema, "id", ["at"])


def test_a_batch_that_fails_in_the_middle(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = ChangedTable(spark, f"{tmp_path}/t", schema, "id", ["at"])
    rows = [(i % 5, i, "update", str(i)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put, seen = table.put, []

    def broken(batch, number):
        put(batch, number)
        seen.append(number)
        if len(seen) == 2:
            raise RuntimeError("lost after it was written")

    table.put = broken
    with pytest.raises(Exception, match="lost after it was written"):
        table.follow(f"{tmp_path}/in", files_per_batch=1)
    again = ChangedTable(spark, f"{tmp_path}/t", schema, "id", ["at"])
    again.follow(f"{tmp_path}/in", files_per_batch=1)
    assert sorted(map(tuple, again.current().collect())) == last(rows)


def test_filter_expressions(spark, tmp_path):
    rows = [(1, "a", '{"k": 1, "s": "x"}'), (2, "it's", '{"k": 20}'), (3, None, None), (4, 'say "b"', '{"k": "3"}')]
    df = spark.createDataFrame(rows, "id long, name string, metadata string")
    ids = lambda text, **how: [r.id for r in df.filter(boolean_filter(text, df.columns, **how)).orderBy("id").collect()]
    assert ids('id in [1, 2] and not name == "a"') == [2] and ids("name == 'it\\'s' || id >= 4") == [2, 4]
    assert ids("(id = 1 or id = 2) && id != 2") == [1] and ids("name is null") == [3] and ids('name in ["say \\"b\\""]') == [4]
    assert ids("metadata['s'] == 'x'") == [1] and ids("metadata['k'] > 2") == [2, 4] and ids("2 < metadata['k']") == [2, 4] and ids("name like 'i%'") == [2]
    held = M.with_metadata(df, "metadata")
    assert [r.id for r in held.filter(boolean_filter("metadata['k'] >= 1 and metadata[\"k\"] < 5", df.columns, kind="variant")).collect()] == [1, 4]
    for bad in ("", "id", "nope == 1", "upper(name) == 'A'", "id == 1; drop", "id in [1", "name == 'a", "metadata[k] == 1", "metadata['a]b'] == 1", "id == (select 1)", "name(1) == 2"):
        with pytest.raises((ValueError, Exception)):
            df.filter(boolean_filter(bad, df.columns)).collect()
    for bad in ("nope == 1", "upper(name) == 'A'", "id == 1; drop", "id == (select 1)"):
        with pytest.raises(ValueError):
            boolean_filter(bad, df.columns)
    df.write.parquet(f"{tmp_path}/p")
    read = spark.read.parquet(f"{tmp_path}/p")
    plan = read.filter(boolean_filter("id in [1, 2] and (name == 'a' or name == 'b')", read.columns))._jdf.queryExecution().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\n", plan)[1]
    assert "In(id, [1,2])" in pushed and "Or(EqualTo(name,a),EqualTo(name,b))" in pushed


def test_metadata(spark, tmp_path):
    kept = Collections(spark, f"{tmp_path}/c")
    rows = M.with_metadata(spark.createDataFrame([(1, '{"k": 1, "a b": {"c": [1]}}'), (2, '{"k": "1"}'), (3, "no json"), (4, None), (5, '{"k": 2}')], "id int, m string"), "m")
    kept.create("x", rows)
    kept.delete_where("x", M.field("m", "k", "long") == 1)
    assert [r.id for r in kept.read("x").orderBy("id").collect()] == [3, 4, 5]
    assert rows.select(M.field("m", "a b", "variant").alias("v")).select(F.to_json("v").alias("v")).collect()[0].v == '{"c":[1]}'


def test_commits(spark, tmp_path):
    kept = Collections(spark, f"{tmp_path}/c")
    rows = spark.createDataFrame([(i, "x") for i in range(10)], "id long, v string")
    kept.create("a", rows)
    with pytest.raises(FileExistsError):
        put_new(spark, f"{tmp_path}/c/a/commits/{1:012}", "other")
    assert (tmp_path / "c/a/commits" / f"{1:012}").read_text() != "other"
    before = kept._current("a")
    for n in range(4):
        kept.upsert("a", spark.createDataFrame([(n, "y")], "id long, v string"), "id")
    with pytest.raises(ChangedMeanwhile):  # of a writer that began with the first version
        kept.write("a", rows, before)
    with pytest.raises(ChangedMeanwhile):
        kept.write("a", rows, kept._current("a") - 1)
    assert kept.read("a").filter("v = 'y'").count() == 4 and len(list((tmp_path / "c/a").glob("version=*"))) == 2
    # a job that is lost before its commit leaves the collection as it was
    rows.write.parquet(f"{tmp_path}/c/a/version=lost")
    (tmp_path / "c/a/commits/.half").write_text("")
    assert kept.read("a").count() == 10
    kept.insert("a", rows.limit(0).repartition(3), "id")
    kept.compact("a")
    assert kept.read("a").count() == 10 and len(kept.read("a").inputFiles()) == 1
