"""Entries by type and name, search requests, collections on disk, kept indexes, failures."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import dispatch as D
from docloom.operators import bm25, boundaries as B, chunkers, vector
from docloom.operators.catalog import Collections
from docloom.operators.search import Request
from docloom.plans.relational_queries import expression_filter
from docloom.sources import files
from docloom.storage import remove, shared_folder
from docloom.tables import spread


def test_kinds(spark):
    rows = spark.createDataFrame([("MD",), ("docx",), ("py",), ("xyz",), (None,), ("pptx",)], "t string").select(D.kind_of(F.col("t")).alias("k"))
    assert [r.k for r in rows.collect()] == ["markdown", "word", "code", "generic", "generic", "slides"]


def test_extracted_features(spark):
    df = spark.createDataFrame([(12, ["a|b"] + ["x" * 40] * 11, 0, [1, 2, 2])], "n long, pages array<string>, images int, toc array<int>")
    pdf = df.select(*(c.alias(n) for n, c in D.pdf_features(*map(F.col, df.columns)).items())).first()
    assert (pdf.pages, pdf.tokens, pdf.has_tables, pdf.has_images, pdf.heading_levels, pdf.text_density) == (12, 363 // 4, True, False, 2, 36.3)
    df = spark.createDataFrame([(["p" * 9] * 100, 0, 1, 5)], "paragraphs array<string>, tables int, images int, n int")
    word = df.select(*(c.alias(n) for n, c in D.word_features(*map(F.col, df.columns)).items())).first()
    assert (word.pages, word.tokens, word.has_tables, word.has_images, word.heading_levels) == (2, 999 // 4, False, True, 2)
    df = spark.createDataFrame([(7, ["abcd", "efgh"], 1, 0)], "slides long, shapes array<string>, tables int, images int")
    slides = df.select(*(c.alias(n) for n, c in D.slide_features(*map(F.col, df.columns)).items())).first()
    assert tuple(slides) == (7, 2, True, False)


def test_features_of_nothing(spark):
    rows = spark.createDataFrame([("md", None), ("txt", ""), ("bin", None), (None, "abc")], "t string, text string")
    kind = D.kind_of(F.col("t"))
    made = rows.select(D.features(kind, F.col("text")).alias("f"), kind.alias("k")).withColumn("c", D.complexity(F.col("f")))
    got = made.withColumn("p", D.chunk_parameters(F.col("k"), F.col("c"), F.col("f"))).collect()
    assert len(got) == 4 and got[1].c == "low" and got[1].p.chunk_size == 1228


def test_chunkers(spark):
    docs = spark.createDataFrame([(1, "# A\none\n\n# B\ntwo"), (2, ""), (3, "x" * 2500)], "id int, text string")
    for name in chunkers.CHUNKERS:
        rows = chunkers.chunker(name)(docs, "id", "text")
        assert rows.columns == ["id", "chunk_index", "text"] and rows.count() >= 1
    assert chunkers.chunker("no such") is chunkers.CHUNKERS["sentence"]
    typed = docs.withColumn("file_type", F.when(F.col("id") == 1, "md"))
    got = {(r.id, r.chunk_index): (len(r.text), r.chunk_count) for r in chunkers.by_type(typed, "id", "text").collect()}
    assert got == {(1, 0): (6, 2), (1, 1): (6, 2), (3, 0): (1000, 3), (3, 1): (1000, 3), (3, 2): (500, 3)}


def test_requests():
    assert Request().mode == "hybrid"
    for bad in ({"mode": "x"}, {"top_k": 0}, {"top_k": 21}, {"min_score": 1.5}):
        with pytest.raises(ValueError):
            Request(**bad)


def test_collections(spark, tmp_path):
    kept = Collections(spark, f"{tmp_path}/c")
    assert kept.names() == [] and kept.drop("a") is False
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    kept.create("a", rows)
    with pytest.raises(ValueError):
        kept.create("a", rows)
    with pytest.raises(ValueError):
        kept.read("b")
    before = kept.read("a")
    kept.upsert("a", spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string"), "id")
    assert sorted(map(tuple, before.collect())) == [(1, "x"), (2, "y")]  # a reader of the version before
    kept.insert("a", spark.createDataFrame([(4, "q")], "id long, v string"), "id")
    kept.delete("a", spark.createDataFrame([(1,)], "id long"))
    assert sorted(map(tuple, kept.read("a").collect())) == [(2, "z"), (3, "w"), (4, "q")]
    assert {r.collection: r.n_rows for r in kept.listing().collect()} == {"a": 3}
    assert len([p for p in (tmp_path / "c" / "a").iterdir() if p.name.startswith("version=")]) == 2
    assert kept.drop("a") and not kept.exists("a")


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish"), (3, None), (4, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red"), (2, None)], "query_id long, text string")
    index = bm25.build(docs)
    index.save(f"{tmp_path}/i")
    again = bm25.load(spark, f"{tmp_path}/i")
    assert bm25.search(again, queries).collect() == bm25.search(index, queries).collect() != []
    assert again.sizes.first().asDict() == {"n_docs": 4, "avg_dl": 4 / 3}


def test_saved_index_reads_the_folders_of_its_terms(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[(i * k) % 60] for k in range(1, 12))) for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w3 w7"), (2, "w7 w50 w7"), (3, "none")], "query_id long, text string")
    index = bm25.build(docs)
    index.save(f"{tmp_path}/i", per_bucket=50)
    again = bm25.load(spark, f"{tmp_path}/i")
    assert again.buckets > 20 and again.postings.count() == index.postings.count()
    found = bm25.search(again, queries, 9)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, bm25.search(index, queries, 9).collect()))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and " IN (" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_failures_stay_with_their_rows(spark):
    rows = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "id int, t string")
    got = {r.id: (r.value, r.error) for r in B.apply_or(rows, "id", ["t"], lambda x: [int(x)], lambda x: [], "array<int>").collect()}
    assert got[1] == ([4], None) and got[2][0] == [] and got[2][1].startswith("ValueError") and got[3][0] == []


def test_vectors_by_source(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(8)], "vec_id long, embedding array<double>, source int")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "query_id long, embedding array<double>")
    got = vector.top_k(queries, rows, 2, "dot", by="source", block=3).collect()
    assert {(r.by, r.vec_id, r["rank"]) for r in got} == {("0", 6, 1), ("0", 4, 2), ("1", 7, 1), ("1", 5, 2)}
    assert vector.top_k(queries.limit(0), rows, 2).count() == 0


def test_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(10).repartition(8).write.parquet(f"{tmp_path}/many")
    assert "Exchange" in spread(spark.read.parquet(f"{tmp_path}/one"))._jdf.queryExecution().toString()
    assert "Exchange" not in spread(spark.read.parquet(f"{tmp_path}/many"))._jdf.queryExecution().toString()


def test_shared_folder(spark, tmp_path):
    assert shared_folder(spark)
    assert remove(spark, f"{tmp_path}/nothing") is False


def test_expressions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, y string")
    assert [r.x for r in df.filter(expression_filter(" y == 'a' ")).collect()] == [1] and [r.x for r in df.filter(expression_filter('x == "2"')).collect()] == [2]
    for bad in ("y > 1", "y == a", "y == 'a' or 1 == 1", ""):
        with pytest.raises(ValueError):
            expression_filter(bad)


def test_sources(spark, tmp_path):
    @files.source("mine")
    def mine(session, n):
        return session.range(n)

    assert "mine" in files.sources() and files.health(spark, "mine", n=3)["healthy"] and not files.health(spark, "parquet", path=f"{tmp_path}/none")["healthy"]
    assert files.remove_source("mine") and not files.remove_source("mine")
    with pytest.raises(ValueError):
        files.read(spark, "mine", n=1)
