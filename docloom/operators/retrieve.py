"""Fusion, several query variants, reranking: DataFrames of hits to DataFrames of hits (query_id, doc_id, score)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.bm25 import top
from docloom.operators.vector import cosine_of


def scaled(hits: DataFrame) -> DataFrame:
    """Scores of each query brought to 0 ... 1; 1 where all are equal."""
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return hits.withColumn("score", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def weighted(vector_hits: DataFrame, keyword_hits: DataFrame, vector_weight: float) -> DataFrame:
    """query_id, doc_id, vector_similarity, term_similarity, score: the weighted sum of both lists' scaled scores; 0 where a list lacks the document."""
    v = scaled(vector_hits).select("query_id", "doc_id", F.col("score").alias("vector_similarity"))
    w = scaled(keyword_hits).select("query_id", "doc_id", F.col("score").alias("term_similarity"))
    both = v.join(w, ["query_id", "doc_id"], "full").na.fill(0.0, ["vector_similarity", "term_similarity"])
    return both.withColumn("score", F.round(F.col("vector_similarity") * vector_weight + F.col("term_similarity") * (1 - vector_weight), 6))


def reciprocal_rank(*lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, doc_id, score: the sum of 1 / (k + rank) over the lists (query_id, doc_id, rank)."""
    parts = None
    for hits in lists:
        own = hits.select("query_id", "doc_id", (1 / (F.lit(k) + F.col("rank"))).alias("part"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def first_seen(hits: DataFrame, order: str = "variant_no") -> DataFrame:
    """Of hits on the same document the one of the earliest variant, with its own score."""
    return top(hits, 1, ["query_id", "doc_id"], F.asc(order)).drop("rank")


def _texts(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(docs.select("doc_id", "text"), "doc_id")


def reranked(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = T.keyword_relevance) -> DataFrame:
    """The hits scored anew by ``scorer`` of text and query (``queries``: query_id, text), such as a pandas UDF around a model; else the share of query terms that the text holds."""
    scored = _texts(hits, queries, docs).select("query_id", "doc_id", F.round(scorer(F.col("text"), F.col("query")), 6).alias("score"))
    return top(scored, k, "query_id", F.desc("score"), "doc_id")


def reranked_by_embedding(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, embed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The hits scored anew by the cosine of the embeddings of text and query; hits without one count 0.

    ``embed(rows, key)`` gives key, embedding; it gets the documents that were hit only.
    """
    met = docs.select("doc_id", "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    a, b = embed(queries.select("query_id", "text"), "query_id"), embed(met, "doc_id")
    both = hits.select("query_id", "doc_id").join(a.select("query_id", F.col("embedding").alias("a")), "query_id", "left").join(b.select("doc_id", F.col("embedding").alias("b")), "doc_id", "left")
    scored = both.select("query_id", "doc_id", F.coalesce(F.round(cosine_of(F.col("a"), F.col("b")), 6), F.lit(0.0)).alias("score"))
    return top(scored, k, "query_id", F.desc("score"), "doc_id")


def page_of(hits: DataFrame, page: int, size: int, *columns: str) -> DataFrame:
    """The ``page``-th page (from 1) of each query's hits, with rank and total: how many hits the query has.  A query's hits are few enough for a sort."""
    own = Window.partitionBy("query_id")
    counted = hits.withColumns({"total": F.count("*").over(own), "rank": F.row_number().over(own.orderBy(F.desc("score"), F.asc("doc_id"))).cast("long")})
    kept = counted.filter((F.col("rank") > (page - 1) * size) & (F.col("rank") <= page * size))
    return kept.select("query_id", "doc_id", "score", *columns, "rank", "total")


def highlighted(text: Column, terms: Column, before: str = "<em>", after: str = "</em>") -> Column:
    """The text with every term marked where it occurs, the longest first; terms are words without signs."""
    order = F.array_sort(F.transform(F.array_distinct(terms), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    pattern = F.concat(F.lit("("), F.array_join(F.transform(order, lambda x: x["t"]), "|"), F.lit(")"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit(f"{before}$1{after}"))).otherwise(text)


def variants(queries: DataFrame, most: int = 3) -> DataFrame:
    """query_id, variant_no, text: the query, its first and its last half; equal ones once, the query first, at most ``most`` more."""
    half = F.floor(F.length("text") / 2).cast("int")
    made = F.slice(F.array_distinct(F.array("text", F.trim(F.substring(F.col("text"), F.lit(1), half)), F.trim(F.substring(F.col("text"), half + 1, F.length("text"))))), 1, most + 1)
    return queries.select("query_id", F.posexplode(made).alias("variant_no", "text"))
