"""Queries of the entries: by file type, by chunker's name, search, collections, failures, observed runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docloom.functions import chunking as C, dispatch as D
from docloom.operators import bm25, boundaries as B, chunkers, incremental as I, vector
from docloom.operators.catalog import Collections
from docloom.operators.incremental import State
from docloom.operators.search import Request, search
from docloom.plans import chunk_queries as Q, collection_queries as K, pipelines, retrieval_queries as R, text_queries as TX
from docloom.plans.registry import query
from docloom.plans.text_queries import SQL_HTML, TEXT_FEATURES
from docloom.sources.files import converted
from docloom.storage import fresh_folder, remove, settled
from docloom.tables import Tables

#: Types that documents get in turn.
TYPES = ("md", "txt", "html", "py", "csv", "bin")

_TYPED = f"(SELECT *, [{', '.join(map(repr, TYPES))}][doc_id % {len(TYPES)} + 1] AS file_type FROM documents)"
_LINES = "(length(text) - length(replace(text, chr(10), '')))"
_FEATURES = rf"""SELECT doc_id, file_type,
    CAST(CASE file_type WHEN 'md' THEN {_LINES} // 40 + 1 WHEN 'txt' THEN {_LINES} // 40 + 1 WHEN 'html' THEN length({SQL_HTML.format('text')}) // 3000 + 1 WHEN 'py' THEN {_LINES} // 50 + 1
        WHEN 'csv' THEN greatest(1, len(string_split(text, chr(10))) // 100) ELSE 1 END AS BIGINT) AS pages,
    CAST(CASE file_type WHEN 'md' THEN length(text) // 4 WHEN 'txt' THEN length(text) // 4 WHEN 'html' THEN length({SQL_HTML.format('text')}) // 4 WHEN 'py' THEN length(text) // 3 WHEN 'csv' THEN length(text) // 5 ELSE strlen(text) // 10 END AS BIGINT) AS tokens,
    CASE file_type WHEN 'md' THEN contains(text, '|---') OR contains(text, '| ---') WHEN 'html' THEN regexp_matches(text, '(?i)<(table)[\s>/]') WHEN 'txt' THEN
        len(string_split(text, chr(10))) > 3 AND len(list_filter(string_split(text, chr(10)), lambda x: length(x) - length(replace(x, chr(9), '')) > 2 OR length(x) - length(replace(x, '|', '')) > 2)) > 3 ELSE false END AS has_tables,
    CASE file_type WHEN 'md' THEN contains(text, '![') WHEN 'html' THEN regexp_matches(text, '(?i)<(img)[\s>/]') ELSE false END AS has_images,
    CASE file_type WHEN 'md' THEN regexp_matches(text, '(?s)```.*?```') WHEN 'html' THEN regexp_matches(text, '(?i)<(code|pre)[\s>/]') ELSE false END AS has_code,
    CASE file_type WHEN 'md' THEN len(list_distinct(regexp_extract_all(text, '(?m)^(#{{1,6}})[\x20\x09]+[^\n]+$', 1))) WHEN 'html' THEN len(list_distinct(regexp_extract_all(text, '(?i)<h([1-6])[\s>]', 1))) ELSE 0 END AS heading_levels,
    CASE WHEN file_type = 'txt' THEN list_sum(list_transform(string_split_regex(text, '[.!?]+'), lambda x: length(x))) / len(string_split_regex(text, '[.!?]+')) END AS mean_sentence FROM {_TYPED}"""
_ANALYZED = f"""WITH f AS ({_FEATURES}), c AS (SELECT *, CASE WHEN pages > 50 OR tokens > 50000 OR ((has_tables OR has_images) AND pages > 20) THEN 'high'
    WHEN pages > 10 OR tokens > 10000 OR has_tables OR has_images OR has_code THEN 'medium' ELSE 'low' END AS complexity FROM f)
    SELECT doc_id, file_type, pages, tokens, has_tables, complexity,
        CAST(CASE WHEN file_type IN ('py', 'csv') THEN 1024
            WHEN file_type = 'md' THEN CASE complexity WHEN 'high' THEN CASE WHEN heading_levels > 3 THEN 768 ELSE 512 END WHEN 'low' THEN CASE WHEN heading_levels > 3 THEN 2048 ELSE 1536 END ELSE CASE WHEN heading_levels > 3 THEN 1536 ELSE 1024 END END
            ELSE CASE complexity WHEN 'high' THEN 682 WHEN 'low' THEN 1228 ELSE 1024 END END AS INTEGER) AS chunk_size,
        CAST(CASE WHEN file_type = 'csv' THEN 0 WHEN file_type = 'py' THEN 20 WHEN file_type = 'md' THEN CASE WHEN complexity = 'high' THEN 40 ELSE 20 END
            WHEN file_type = 'txt' THEN CASE WHEN mean_sentence > 100 THEN 30 ELSE 20 END ELSE CASE WHEN complexity = 'high' THEN 30 ELSE 20 END END AS INTEGER) AS chunk_overlap FROM c"""


def typed(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, TYPES))
    return t.documents.withColumn("file_type", F.get(names, (F.col("doc_id") % len(TYPES)).cast("int")))


@query(_ANALYZED)
def analyze_documents(t: Tables) -> DataFrame:
    kind = D.kind_of(F.col("file_type"))
    rows = typed(t).select("doc_id", "file_type", kind.alias("kind"), D.features(kind, F.col("text")).alias("f")).withColumn("complexity", D.complexity(F.col("f")))
    made = rows.withColumn("p", D.chunk_parameters(F.col("kind"), F.col("complexity"), F.col("f")))
    return made.select("doc_id", "file_type", "f.pages", "f.tokens", "f.has_tables", "complexity", "p.chunk_size", "p.chunk_overlap")


_BY_TYPE = f"""SELECT 'p' || page_id AS doc, chunk_index, text FROM ({{md}}) UNION ALL SELECT 'd' || doc_id, chunk_index, text FROM ({{txt}})"""


@query(f"SELECT doc, chunk_index, md5(text) AS hash, count(*) OVER (PARTITION BY doc) AS chunk_count FROM ({_BY_TYPE.format(md=Q.SECTION_CHUNKS, txt=Q._PARAGRAPHS)})")
def chunk_by_type(t: Tables) -> DataFrame:
    md = Q.pages_md(t).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc"), F.lit("md").alias("file_type"), F.col("md").alias("text"))
    txt = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), F.lit("txt").alias("file_type"), "text")
    return chunkers.by_type(md.unionByName(txt), "doc", "text", other="line").select("doc", "chunk_index", F.md5("text").alias("hash"), "chunk_count")


@query(f"""SELECT 'line' AS chunker, count(*) AS n_chunks FROM ({Q._PARAGRAPHS}) UNION ALL SELECT 'sentence', count(*) FROM ({Q._SENTENCES}) UNION ALL SELECT 'no such name', count(*) FROM ({Q._SENTENCES})
    UNION ALL SELECT 'fixed', CAST(sum(ceil(length(text) / 1000)) AS BIGINT) FROM documents""")
def chunker_by_name(t: Tables) -> DataFrame:
    parts = [chunkers.chunker(n)(t.documents, "doc_id", "text").agg(F.count("*").alias("n_chunks")).select(F.lit(n).alias("chunker"), "n_chunks") for n in ("line", "sentence", "no such name", "fixed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""SELECT doc_id, CAST(i // size AS BIGINT) AS chunk_index, substr(text, i + 1, size) AS text, CASE WHEN size = 1000 THEN 'ValueError: a pipe' END AS error
    FROM (SELECT doc_id, text, size, unnest(range(0, length(text), size)) AS i FROM (SELECT *, CASE WHEN contains(text, '|') THEN 1000 ELSE 500 END AS size FROM documents))""")
def chunk_with_fallback(t: Tables) -> DataFrame:
    # a chunker that fails for some texts; these get another one, and the failure is kept
    def first(x: str) -> list[str]:
        if "|" in x:
            raise ValueError("a pipe")
        return [x[i : i + 500] for i in range(0, len(x), 500)]

    found = B.apply_or(t.documents, "doc_id", ["text"], first, lambda x: [x[i : i + 1000] for i in range(0, len(x), 1000)], Q.CHUNKS)
    return found.select("doc_id", F.posexplode("value").alias("chunk_index", "text"), "error").withColumn("chunk_index", F.col("chunk_index").cast("long"))


_ALLOWED = "(SELECT s.* FROM ({0}) s JOIN documents a ON a.doc_id = s.doc_id WHERE a.lang = 'en')"
_KEYWORD = R.ranked(_ALLOWED.format(R._SCORE), 25)
_VECTOR = R.ranked(_ALLOWED.format("SELECT * FROM near"), 25)


@query(f"WITH {R.BM25}, {R.QUERIES_SQL}, {R.HASHED} SELECT query_id, doc_id, score, rank FROM {R.ranked('SELECT * FROM (' + R.weighted_sql(_VECTOR, _KEYWORD, 0.7) + ') WHERE score >= 0.3', 5)}")
def search_hybrid(t: Tables) -> DataFrame:
    return search(t.documents, R.text_queries(t), R.embed, Request(min_score=0.3, filters={"lang": "en", "no_such_field": 1}))


@query(f"WITH {R.BM25}, {R.QUERIES_SQL} SELECT query_id, doc_id, score, rank FROM {R.ranked('SELECT * FROM (' + R.rerank_sql(_KEYWORD) + ') WHERE score >= 0.7', 5)}")
def search_keyword_reranked(t: Tables) -> DataFrame:
    return search(t.documents, R.text_queries(t), R.embed, Request("keyword", rerank=True, rewrite=True, filters={"lang": "en"}))


_ENDS = "(SELECT * FROM (SELECT item_id * 4 AS query_id, text FROM benchmark UNION ALL SELECT item_id * 4 + 1, trim(right(text, length(text) // 3)) FROM benchmark) WHERE text <> '')"


@query(f"""WITH queries AS {_ENDS}, {R.HASHED}, hits AS (SELECT query_id // 4 AS query_id, query_id % 4 AS variant_no, doc_id, score FROM {R.ranked('SELECT * FROM near', 25)}),
    first AS (SELECT query_id, doc_id FROM {R.ranked('SELECT * FROM hits', 1, 'variant_no', 'query_id, doc_id')}),
    again AS (SELECT f.query_id, f.doc_id, round(1 / (1 + abs(length(d.text) - length(b.text)) / 1000), 6) AS score FROM first f JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = f.query_id)
    SELECT query_id, doc_id, score, rank FROM {R.ranked('SELECT * FROM again WHERE score >= 0.4', 5)}""")
def search_own_models(t: Tables) -> DataFrame:
    """A search with a rewriter and a reranker of the caller's own: the query's last third as a second variant, and nearness of lengths as the score."""
    from docloom.operators.retrieve import reranked

    def rewriter(queries: DataFrame) -> DataFrame:
        last = F.trim(F.right("text", F.floor(F.length("text") / 3).cast("int")))
        return queries.select("query_id", F.posexplode(F.array("text", last)).alias("variant_no", "text")).filter("text <> ''")

    def lengths(text: Column, query: Column) -> Column:
        return 1 / (1 + F.abs(F.length(text) - F.length(query)) / 1000)

    again = lambda hits, queries, docs, k: reranked(hits, queries, docs, k, lengths)
    return search(t.documents, R.text_queries(t), R.embed, Request("vector", min_score=0.4, rewrite=True, rerank=True), rewriter, again)


@query(f"WITH {R.BM25}, {R.QUERIES_SQL} SELECT query_id, doc_id, score, rank FROM {R.keyword_sql(R.TOP_K)}")
def bm25_saved_index(t: Tables) -> DataFrame:
    """Search in an index that was written and read again."""
    folder = fresh_folder(t.spark, "index")
    bm25.build(t.documents).save(folder)
    found = settled(bm25.search(bm25.load(t.spark, folder), R.text_queries(t), R.TOP_K).select("query_id", "doc_id", "score", "rank"))
    remove(t.spark, folder)
    return found


@query("""SELECT 'vectors' AS collection, count(*) AS n_rows, CAST(sum(CASE WHEN label = 1 THEN -vec_id ELSE vec_id END) AS BIGINT) AS total FROM embeddings WHERE label <> 2 OR label IS NULL
    UNION ALL SELECT 'texts', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents""")
def collection_catalog(t: Tables) -> DataFrame:
    """Collections created, changed, dropped and listed."""
    root = fresh_folder(t.spark, "collections")
    kept = Collections(t.spark, root)
    kept.create("vectors", t.embeddings.select("vec_id", "label", F.col("vec_id").alias("value")))
    kept.create("texts", t.documents.select(F.col("doc_id").alias("value")))
    kept.create("gone", t.nation)
    kept.upsert("vectors", t.embeddings.filter("label = 1").select("vec_id", "label", (-F.col("vec_id")).alias("value")), "vec_id")
    kept.delete("vectors", t.embeddings.filter("label = 2").select("vec_id"))
    kept.drop("gone")
    kept.drop("never there")
    totals = None
    for name in kept.names():
        own = kept.read(name).agg(F.count("*").alias("n_rows"), F.sum("value").alias("total")).select(F.lit(name).alias("collection"), "n_rows", "total")
        totals = own if totals is None else totals.unionByName(own)
    out = settled(totals)
    remove(t.spark, root)
    return out


def _vectors(chunks: str, key: str = "doc_id || '_' || chunk_index") -> str:
    """Per document of the chunks (doc_id, chunk_index, text): their number, those with a vector, and the sum of all vectors' components."""
    return f"""SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE n > 0) AS n_embedded, CAST(sum(n) AS BIGINT) AS n_tokens FROM (
        SELECT doc_id, chunk_index, len({R.toks('text')}) AS n FROM ({chunks})) GROUP BY doc_id"""


def _counted(nodes: DataFrame) -> DataFrame:
    total = F.coalesce(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("n_embedded"), F.sum(total).cast("long").alias("n_tokens"))


@query(_vectors(Q._PARAGRAPHS))
def pipeline_standard(t: Tables) -> DataFrame:
    """Validated documents to chunks to vectors; here the vectors' components add up to the tokens."""
    return _counted(pipelines.standard("doc_id", R.embed, "line")(t.documents))


_CHANGED = f"WITH {K.V2} SELECT v.doc_id, v.text FROM v2 v JOIN documents d ON d.doc_id = v.doc_id WHERE md5(v.text) <> md5(d.text) AND v.text <> ''"


@query(_vectors(f"SELECT * FROM ({Q._PARAGRAPHS.replace('FROM documents', f'FROM ({_CHANGED})')})"))
def pipeline_incremental(t: Tables) -> DataFrame:
    """The second run of a pipeline takes changed documents only."""
    root = fresh_folder(t.spark, "state")
    state = State(Collections(t.spark, root), "documents", "doc_id", "hash")
    hashed = {"hash": F.md5("text")}
    state.done(t.documents.withColumns(hashed))
    found = settled(_counted(pipelines.incremental("doc_id", state, hashed, R.embed, "line")(K.edited(t))))
    remove(t.spark, root)
    return found


@query(f"""SELECT doc_id, chunk_index, n_keywords, topics FROM (SELECT doc_id, chunk_index, CAST(len(w) AS BIGINT) AS n_keywords FROM (SELECT doc_id, chunk_index, {TX.SQL_WORDS.format('text')} AS w FROM ({Q._PARAGRAPHS}))) LEFT JOIN (
    SELECT doc_id, list_sort(list_distinct(flatten(list(topics)))) AS topics FROM (SELECT doc_id, {TX._TOPIC_SQL} AS topics FROM (SELECT doc_id, {TX.SQL_WORDS.format('text')} AS w FROM ({Q._PARAGRAPHS}))) GROUP BY doc_id HAVING len(flatten(list(topics))) > 0) USING (doc_id)""")
def pipeline_described(t: Tables) -> DataFrame:
    """Chunks with the number of their keywords and the topics of their document."""
    return pipelines.metadata_aware("doc_id", "line")(t.documents).select("doc_id", "chunk_index", "n_keywords", "topics")


@query(f"""WITH {K.V2} SELECT 1 AS run, count(*) AS n_due FROM documents UNION ALL
    SELECT 2, count(*) FROM v2 v JOIN documents d ON d.doc_id = v.doc_id WHERE md5(v.text) <> md5(d.text) UNION ALL SELECT 3, 0""")
def incremental_runs(t: Tables) -> DataFrame:
    """Documents due in three runs that share a stored state: all, those edited, none."""
    root = fresh_folder(t.spark, "state")
    state = State(Collections(t.spark, root), "documents", "doc_id", "hash")
    old, new = (df.select("doc_id", F.md5("text").alias("hash")) for df in (t.documents, K.edited(t)))
    counts = []
    for number, docs in enumerate((old, new, new), 1):
        counts.append((number, state.due(docs).count()))
        state.done(docs)
    remove(t.spark, root)
    return t.spark.createDataFrame(counts, "run int, n_due long")


_SEGMENTS = "(SELECT doc_id, md5(x) AS hash FROM (SELECT doc_id, unnest(list_transform(range(0, length(text), 300), lambda i: substr(text, i + 1, 300))) AS x FROM {0}))"


@query(f"""WITH {K.V2}, a AS {_SEGMENTS.format('documents')}, b AS {_SEGMENTS.format('v2')},
    diff AS (SELECT doc_id, hash, CASE WHEN x.p IS NULL THEN 'added' WHEN y.q IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT *, 1 AS p FROM a) x FULL JOIN (SELECT DISTINCT *, 1 AS q FROM b) y USING (doc_id, hash)),
    n AS (SELECT doc_id, count(*) FILTER (WHERE change = 'added') AS n_added, count(*) FILTER (WHERE change = 'unchanged') AS n_unchanged, count(*) AS n_new FROM b JOIN diff USING (doc_id, hash) GROUP BY doc_id),
    o AS (SELECT doc_id, count(*) FILTER (WHERE change = 'removed') AS n_removed, count(*) AS n_old FROM a JOIN diff USING (doc_id, hash) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n_old IS NULL THEN 'new' WHEN coalesce(n_added, 0) + n_removed = 0 THEN 'unchanged' WHEN coalesce(n_added, 0) + n_removed > coalesce(n_new, 0) * 0.5 THEN 'reprocess' ELSE 'update' END AS status,
        coalesce(n_added, 0) AS n_added, coalesce(n_removed, 0) AS n_removed FROM n FULL JOIN o USING (doc_id)""")
def large_document_segments(t: Tables) -> DataFrame:
    """Documents cut into segments, and what of them must be processed anew."""
    cut = lambda df: I.hashed_chunks(df.filter("text <> ''"), "doc_id", C.windows(F.col("text"), 300))
    return I.status(cut(t.documents), cut(K.edited(t)), "doc_id").select("doc_id", "status", "n_added", "n_removed")


@query(f"""SELECT doc_id, md5(CASE WHEN file_type = 'html' THEN '# ' || text WHEN file_type = 'md' THEN text ELSE text END) AS hash, file_type NOT IN ('html', 'md') AS conversion_failed,
    CASE WHEN file_type NOT IN ('html', 'md') THEN 'LookupError: ' || file_type END AS error FROM {_TYPED}""")
def convert_documents(t: Tables) -> DataFrame:
    """Conversion to markdown; types without a converter keep their raw text and are marked."""

    def convert(text: str, file_type: str) -> str:
        if file_type not in ("html", "md"):
            raise LookupError(file_type)
        return text if file_type == "md" else "# " + text

    return converted(typed(t), convert).select("doc_id", F.md5("markdown").alias("hash"), "conversion_failed", "error")


@query(f"""SELECT query_id, vec_id AS doc_id, vec_id || '_chunk_0' AS chunk_id, left(d.text, 80) AS text, d.lang, score AS distance FROM ({R._knn_sql("sqrt(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))", R._NEAR)}) h
    JOIN documents d ON d.doc_id = h.vec_id""")
def vector_search_rows(t: Tables) -> DataFrame:
    """Hits with what is stored of them: text, metadata and distance."""
    hits = vector.top_k(R.vector_queries(t), t.embeddings, 10, "l2").withColumnRenamed("vec_id", "doc_id").withColumnRenamed("score", "distance")
    chunk = F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_0")).alias("chunk_id")
    return hits.join(t.documents, "doc_id").select("query_id", "doc_id", chunk, F.left("text", F.lit(80)).alias("text"), "lang", "distance")


@query("SELECT 'segments' AS step, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS n_failed FROM documents WHERE text <> ''")
def observed_run(t: Tables) -> DataFrame:
    """Figures of a run that Spark gathers while the rows go by."""
    seen = Observation(f"run-{uuid.uuid4().hex}")
    rows = t.documents.filter("text <> ''").observe(seen, F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("doc_id").isNull()).alias("n_failed"))
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return t.spark.createDataFrame([("segments", got["n_rows"], got["n_chars"], got["n_failed"])], "step string, n_rows long, n_chars long, n_failed long")
