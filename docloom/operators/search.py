"""One entry to retrieval: mode, filters, rewriting, reranking, cutoff and number of hits as parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import bm25, retrieve as R, vector

MODES = ("vector", "keyword", "hybrid")
#: Hits fetched of each list for every hit that is returned.
MORE = 5


@dataclass(frozen=True)
class Request:
    mode: str = "hybrid"
    top_k: int = 5
    min_score: float = 0.7
    filters: dict = field(default_factory=dict)  # column -> value, all must hold
    rewrite: bool = False
    rerank: bool = False
    vector_weight: float = 0.7

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; known: {MODES}")
        if not 1 <= self.top_k <= 20 or not 0 <= self.min_score <= 1:
            raise ValueError("top_k goes from 1 to 20, min_score from 0 to 1")


def _lists(docs: DataFrame, where: Column, queries: DataFrame, embed: Callable[[DataFrame, str], DataFrame], request: Request, k: int) -> DataFrame:
    """query_id, doc_id, score (0 to 1 but for keyword mode's, which are scaled too) of the best ``k``."""

    def keyword() -> DataFrame:
        return bm25.search(bm25.build(docs, where=where), queries, k)

    def near() -> DataFrame:
        rows = embed(docs.filter(where), "doc_id")
        return vector.top_k(embed(queries, "query_id"), rows, k, "cosine", "query_id", "doc_id", n_rows=docs.count()).withColumnRenamed("vec_id", "doc_id")

    if request.mode == "vector":
        return near().drop("rank")
    if request.mode == "keyword":
        return R.scaled(keyword().drop("rank"))
    return R.weighted(near(), keyword(), request.vector_weight).select("query_id", "doc_id", "score")


def search(
    docs: DataFrame,
    queries: DataFrame,
    embed: Callable[[DataFrame, str], DataFrame],
    request: Request,
    rewriter: Callable[[DataFrame], DataFrame] = R.variants,
    reranker: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame] = R.reranked,
) -> DataFrame:
    """query_id, doc_id, score, rank of the hits of every query (query_id, text) among ``docs`` (doc_id, text and the filters' columns).

    ``embed(rows, key)`` gives key, embedding.  A filter on a column that ``docs``
    lacks is ignored.  With ``rewrite``, hits of a query's variants count too, the
    first variant's score of a document; keyword mode doesn't rewrite.  The variants
    come from ``rewriter(queries)`` (query_id, variant_no, text), by default halves of
    the query.  With ``rerank``, scores are those of ``reranker(hits, queries, docs, k)``,
    by default term overlap.  Hits under ``min_score`` go.
    """
    where = F.lit(True)
    for column, value in request.filters.items():
        if column in docs.columns:
            where &= F.col(column) == value
    k = request.top_k * MORE
    if request.rewrite and request.mode != "keyword":
        made = rewriter(queries).withColumn("variant_no", F.col("variant_no").cast("int"))
        key = F.struct("query_id", "variant_no")
        each = _lists(docs, where, made.select(F.to_json(key).alias("query_id"), "text"), embed, request, k)
        parts = each.select(F.from_json("query_id", f"query_id {queries.schema['query_id'].dataType.simpleString()}, variant_no int").alias("v"), "doc_id", "score")
        hits = R.first_seen(parts.select("v.query_id", "v.variant_no", "doc_id", "score")).drop("variant_no")
    else:
        hits = _lists(docs, where, queries, embed, request, k)
    if request.rerank:
        hits = reranker(hits, queries, docs, k).drop("rank")
    return bm25.top(hits.filter(F.col("score") >= request.min_score), request.top_k, "query_id", F.desc("score"), "doc_id").select("query_id", "doc_id", "score", "rank")
