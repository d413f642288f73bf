"""Chunkers as table functions of SQL."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import chunking as C
from docloom.operators import boundaries as B, table_functions as P


def test_twins(spark):
    texts = ["", "a", "one. two. three\nfour " * 200, "\n\n".join("p" * n for n in (5, 300, 9, 600, 1, 1, 2500, 0, 0, 7)), ". . \n\n\n\nx" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", C.paragraph_chunks(F.col("text")).alias("p"), C.paragraph_chunks(F.col("text"), separator="\n").alias("l")).collect():
        assert r.p == B.paragraph_pieces(texts[r.i]) and r.l == B.paragraph_pieces(texts[r.i], "\n")


def test_own_chunkers(spark):
    words = P.Plugin(lambda text: ((w, len(w)) for w in text.split()), "word string, n int")
    P.register(spark, "cut_up", {**P.CHUNKERS, "words": words})
    spark.createDataFrame([(1, "ab c"), (2, ""), (3, None)], "id int, text string").createOrReplaceTempView("cut_up_texts")
    found = spark.sql("SELECT id, c.* FROM cut_up_texts, LATERAL cut_up(text, 'words') c ORDER BY chunk_index")
    assert found.columns == ["id", "chunk_index", "word", "n"] and [tuple(r) for r in found.collect()] == [(1, 0, "ab", 2), (1, 1, "c", 1)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM cut_up('T:\nbody', 'generic')").collect()] == [(0, "T:", "body")]
    for bad in ("SELECT * FROM cut_up('x', 'no such')", "SELECT c.* FROM cut_up_texts, LATERAL cut_up('x', text) c"):
        with pytest.raises(Exception, match="chunker"):
            spark.sql(bad).collect()
