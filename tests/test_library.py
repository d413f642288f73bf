"""Markdown, text functions, collections, sources and streams on literals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import markdown as M, text as T
from docloom.operators import collection as K, incremental as I, lsh, vector
from docloom.operators.lsh import candidates
from docloom.plans.pipelines import Pipeline, register
from docloom.plans.relational_queries import term_filter, where
from docloom.sources import files
from docloom.streaming.ingest import ingest, windowed

MD = "intro\n# A\none\n## B\n```\n# not\n```\ntwo [x](#a) [[B]] [ref:zzz] 「参见：A」\n### C\n# D\n| a | b |\n|---|---|\n| 1 | 2 |\n"


@pytest.fixture(scope="module")
def md(spark):
    return spark.createDataFrame([(1, MD), (2, "no headings"), (3, None), (4, "")], "id int, md string")


def test_sections(md):
    rows = {(r.id, r.title): r for r in M.sections(md, "id", "md").collect()}
    assert {k: v.breadcrumb for k, v in rows.items()} == {(1, "A"): "A", (1, "B"): "A > B", (1, "C"): "A > B > C", (1, "D"): "D"}
    assert rows[1, "A"].content == "one" and rows[1, "B"].content.startswith("two [x]") and rows[1, "C"].content == ""
    chunks = M.section_chunks(md, "id", "md").orderBy("chunk_index").collect()
    assert [c.text.split("\n\n")[0] for c in chunks] == ["A", "A > B", "D"]
    assert [(r.start_line, r.end_line, r.n_rows) for r in M.table_blocks(md, "id", "md").collect()] == [(10, 12, 3)]


def test_references(md):
    found = M.headings(md, "id", "md")
    got = {r.target: r.heading_id for r in M.resolved_references(md, found, "id", "md").collect()}
    assert got == {"a": "a", "B": "b", "zzz": None, "A": "a"}


def test_text(spark):
    text = "王小明先生 met Ada Lovelace in Paris. It was 2021年 and 2020-05! See [3], https://x.org/a b. The Café"
    row = spark.createDataFrame([(text,)], "t string").select(
        T.entities(F.col("t")).alias("e"), T.time_references(F.col("t")).alias("d"), T.references(F.col("t")).alias("r"), T.tokens(F.lit("我 AI-医疗, ok")).alias("k"), T.sentences(F.lit("a. b!c? d")).alias("s"),
        T.keyword_relevance(F.lit("The Cat sat"), F.lit("cat dog")).alias("q"), T.keyword_relevance(F.lit("x"), F.lit("a b")).alias("h"), T.slug(F.lit("Hello, <b>World</b> 世界!")).alias("g"), T.topic_areas(F.array(F.lit("java"), F.lit("医生"))).alias("p"),
    ).first()
    assert set(row.e) == {"Ada Lovelace", "Paris", "王小明"} or set(row.e) == {"Ada Lovelace", "Paris", "小明", "王小明"} or "Ada Lovelace" in row.e
    assert row.d == ["2021年", "2020-05"] and [tuple(x) for x in row.r] == [("url", "https://x.org/a"), ("citation", "3")]
    assert row.k == ["AI", "医", "疗", "ok"] and row.s == ["a.", "b!c?", "d"] and (row.q, row.h) == (0.5, 0.5) and row.g == "hello-world-世界" and row.p == ["技术", "医疗"]


def test_life_cycle(spark, tmp_path):
    rows = spark.createDataFrame([(f"id{i}", [float(i), 1.0], i % 3) for i in range(10)], "id string, vector array<double>, source int")
    rows.write.parquet(f"{tmp_path}/v1")
    store = spark.read.parquet(f"{tmp_path}/v1")
    keys = spark.createDataFrame([("id1",), ("id2",), ("nope",)], "id string")
    assert store.count() == 10 and K.get(store, keys).count() == 2 and K.delete(store, keys).count() == 8
    assert {r.id: r.deleted for r in K.delete_result(store, keys).collect()} == {"id1": True, "id2": True, "nope": False}
    new = spark.createDataFrame([("id3", [9.0, 9.0], 7), ("id99", [1.0], 7)], "id string, vector array<double>, source int")
    both = K.upsert(store, new, "id")
    assert both.count() == 11 and K.wrong_dimension(both, "vector", 2).count() == 1 and K.clear(both).count() == 0
    assert K.insert(store, new.withColumn("id", F.lit(None).cast("string")), "id").select("id").distinct().count() == 12
    assert K.add_missing(store, new, "id").count() == 11


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a\nb\nb"), (2, "x"), (3, "same")], "id int, t string")
    new = spark.createDataFrame([(1, "a\nc\nb"), (3, "same"), (4, "q\nr")], "id int, t string")
    chunk = lambda d: I.hashed_chunks(d, "id", F.split("t", "\n"))
    got = {r.id: (r.status, r.n_added, r.n_removed, r.n_unchanged) for r in I.status(chunk(old), chunk(new), "id").collect()}
    assert got == {1: ("update", 1, 0, 2), 2: ("reprocess", 0, 1, 0), 3: ("unchanged", 0, 0, 1), 4: ("new", 2, 0, 0)}
    assert I.diff(chunk(old), chunk(old), "id").filter("change <> 'unchanged'").count() == 0


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_blocks_change_nothing(spark, sf, metric):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    one, many = (sorted(map(tuple, vector.top_k(queries, rows, 5, metric, block=b).collect())) for b in (10_000, 37))
    assert one == many
    assert {r[:2] for r in one} <= {tuple(r)[:2] for r in vector.top_k(queries, rows, 6, metric).collect()}


def test_approximate_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vector.top_k(queries, rows, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in candidates(queries, rows, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, y string")
    assert [r.x for r in where(df, y="a", z=4, x=None).collect()] == [1]
    assert [r.x for r in df.filter(term_filter({"bool": {"must": [{"range": {"x": {"gt": 0}}}], "must_not": [{"terms": {"x": [1]}}], "should": [{"term": {"y": "b"}}, {"term": {"x": 3}}]}})).collect()] == [2, 3]
    with pytest.raises(ValueError):
        term_filter({"fuzzy": {"x": 1}})


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.MD").write_text("# T\nbody")
    (row,) = files.read(spark, "text", path=str(tmp_path / "in")).collect()
    assert row.file_type == "md" and row.text == "# T\nbody"
    assert files.read(spark, "binary", path=str(tmp_path / "in")).first().length == 8
    files.write_metadata(spark.range(2), str(tmp_path / "out"))
    assert files.read(spark, "json", path=str(tmp_path / "out"), schema="id long").count() == 2
    with pytest.raises(ValueError):
        files.read(spark, "nothing")


def test_pipeline(spark):
    register("upper", ["md"])(lambda df: df.withColumn("t", F.upper("t")))
    register("count")(lambda df: df.withColumn("n", F.length("t")))
    df = spark.createDataFrame([("ab",)], "t string")
    assert Pipeline.named(["upper", "count"], "md")(df).first() == ("AB", 2)
    with pytest.raises(ValueError):
        Pipeline.named(["upper"], "pdf")


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert ingest(spark, f"{sf}/events.parquet", str(tmp_path / "a"), "event_id").count() == events.count()
    events.repartition(3).write.parquet(str(tmp_path / "b"))
    assert ingest(spark, str(tmp_path / "b"), str(tmp_path / "c"), "event_id", 1).count() == events.count()
    want = {tuple(r) for r in windowed(events, "ts", "1 day", "1 hour", "event_type").select("window.start", "event_type", "n").collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "b"))
    job = windowed(stream, "ts", "1 day", "1 hour", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    job.processAllAvailable()
    job.stop()
    assert {tuple(r) for r in spark.sql("select window.start, event_type, n from counts").collect()} == want


def test_hyperplanes_shuffle_no_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    bits, tables = lsh.sizes(600)
    codes = lsh.signs(x, bits, tables)
    for block in (100, 1000):  # several cells, or one
        found = lsh.candidates(queries, rows, 5, block)
        got = {(r.query_id, r["rank"]): (r.vec_id, r.n_found) for r in found.collect()}
        for q in range(0, 600, 20):
            met = [i for i in range(600) if any(bin(a ^ b).count("1") <= 1 for a, b in zip(codes[q], codes[i]))]
            s = {i: round(float(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])), 6) for i in met}
            best = sorted(met, key=lambda i: (-s[i], i))[:5]
            assert [got[q, n + 1] for n in range(len(best))] == [(i, len(met)) for i in best]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_vector_cells_are_bounded(spark):
    rows = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    queries = rows.filter("vec_id < 70").withColumnRenamed("vec_id", "query_id")
    q, x = vector.grid(queries, rows)
    assert x.select("xb").distinct().count() > 1 and vector.AT_ONCE * vector.BLOCK <= 1 << 21  # 16 MB a matrix
    assert vector.top_k(queries, rows, 1).filter("query_id <> vec_id").count() == 0
