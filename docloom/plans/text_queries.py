"""Queries over single documents: scans, features, enrichment, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import analyze, text as T
from docloom.operators import bm25
from docloom.plans.registry import query
from docloom.tables import Tables

#: File types and the size that a document may have.
FILE_TYPES, MAX_BYTES = ("pdf", "md", "markdown", "docx", "txt", "html"), 10 * 1024 * 1024
#: SQL for the functions of docloom.functions.text, in DuckDB's dialect.
WS = r"[\x20\x09-\x0D]"
SQL_STRIP = rf"regexp_replace(regexp_replace({{0}}, '^{WS}+', ''), '{WS}+$', '')"
SQL_NORM = rf"trim(regexp_replace(regexp_replace({{0}}, '[^\p{{{{L}}}}\p{{{{N}}}}_\x20\x09-\x0D]', ' ', 'g'), '{WS}+', ' ', 'g'))"
SQL_HTML = rf"trim(regexp_replace(regexp_replace({{0}}, '<[^>]*>', ' ', 'g'), '{WS}+', ' ', 'g'))"
STOP = ", ".join(f"'{w}'" for w in T.SEARCH_STOPWORDS)
SQL_TOKENS = rf"list_filter(string_split(regexp_replace({SQL_NORM}, '([\x{{{{4e00}}}}-\x{{{{9fff}}}}])', ' \1 ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ({STOP}))"
SQL_WORDS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1 AND x NOT IN (%s))" % ", ".join(f"'{w}'" for w in T.KEYWORD_STOPWORDS)
SQL_SENTENCES = rf"string_split(regexp_replace({{0}}, '([.!?。！？]){WS}+', '\1' || chr(1), 'g'), chr(1))"



def norm(c: str) -> str:
    return SQL_NORM.format(c)


def toks(c: str) -> str:
    return SQL_TOKENS.format(c)


@query("SELECT doc_id, length(text) AS file_size, length(text) <= 10485760 AND text <> '' AND trim(lang) <> '' AS validation_passed, "
       "CASE WHEN text = '' THEN 'empty' WHEN length(text) > 10485760 THEN 'too large' END AS error FROM documents")
def validate_docs(t: Tables) -> DataFrame:
    size = F.length("text")
    passed = (size <= MAX_BYTES) & (F.col("text") != "") & (F.trim("lang") != "")
    error = F.when(F.col("text") == "", "empty").when(size > MAX_BYTES, "too large")
    return t.documents.select("doc_id", size.cast("long").alias("file_size"), passed.alias("validation_passed"), error.alias("error"))


@query("SELECT doc_id, text, source, lang FROM documents")
def scan_documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text", "source", "lang")


@query(f"SELECT page_id, {SQL_HTML.format('html')} AS text FROM pages")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {SQL_STRIP.format('x')}), lambda x: x <> ''), chr(10) || chr(10)) AS markdown FROM documents")
def basic_markdown(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.basic_markdown(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("markdown"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS paragraph_count FROM documents")
def paragraph_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("paragraph_count"))


@query("SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars, 'hash': md5(text)}) AS VARCHAR) AS metadata FROM documents")
def doc_metadata_json(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", "n_chars", F.md5("text").alias("hash"))).alias("metadata"))


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(md, '(?m)^(#{1,6})[\x20\x09]+[^\n]+$', 1))) AS heading_levels,
    regexp_matches(md, '(?s)```.*?```') AS has_code, contains(md, '|---') OR contains(md, '| ---') AS has_tables, contains(md, '![') AS has_images,
    (length(md) - length(replace(md, chr(10), ''))) // 40 + 1 AS pages, length(md) // 4 AS tokens FROM (
    SELECT page_id, regexp_replace(regexp_replace(""" + "".join(f"regexp_replace(" for _ in range(6)) + "html" + "".join(
    rf", '(?is)<h{k}[^>]*>(.*?)</h{k}>', chr(10) || '{'#' * k} \1' || chr(10), 'g')" for k in range(1, 7)) + r""", '(?i)</p>|<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS md FROM pages)""")
def doc_features_markdown(t: Tables) -> DataFrame:
    from docloom.functions.markdown import from_html

    return t.pages.select("page_id", from_html(F.col("html")).alias("md")).select("page_id", *(c.alias(n) for n, c in analyze.markdown_features(F.col("md")).items()))


TEXT_FEATURES = r"""SELECT doc_id, (length(text) - length(replace(text, chr(10), ''))) // 40 + 1 AS pages, length(text) // 4 AS tokens,
    len(ls) > 3 AND len(list_filter(ls, lambda x: length(x) - length(replace(x, chr(9), '')) > 2 OR length(x) - length(replace(x, '|', '')) > 2)) > 3 AS has_tables,
    list_sum(list_transform(ps, lambda x: length(x))) / len(ps) AS mean_sentence
    FROM (SELECT *, string_split(text, chr(10)) AS ls, string_split_regex(text, '[.!?]+') AS ps FROM documents)"""


@query(TEXT_FEATURES)
def doc_features_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *(c.alias(n) for n, c in analyze.text_features(F.col("text")).items()))


@query(rf"""SELECT page_id, regexp_matches(html, '(?i)<(table)[\s>/]') AS has_tables, regexp_matches(html, '(?i)<(img)[\s>/]') AS has_images,
    regexp_matches(html, '(?i)<(code|pre)[\s>/]') AS has_code, length({SQL_HTML.format('html')}) // 4 AS tokens, length({SQL_HTML.format('html')}) // 3000 + 1 AS pages,
    len(list_distinct(regexp_extract_all(html, '(?i)<h([1-6])[\s>]', 1))) AS heading_levels FROM pages""")
def doc_features_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", *(c.alias(n) for n, c in analyze.html_features(F.col("html")).items()))


@query(r"""SELECT doc_id, (length(text) - length(replace(text, chr(10), ''))) // 50 + 1 AS pages, length(text) // 3 AS tokens,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^(#|//|/\*|\*)'))) / len(string_split(text, chr(10))) AS comment_ratio FROM documents""")
def doc_features_code(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *(c.alias(n) for n, c in analyze.code_features(F.col("text")).items()))


@query("SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_rows, greatest(1, len(ls) // 100) AS pages, length(text) // 5 AS tokens, length(ls[1]) - length(replace(ls[1], ',', '')) + 1 AS n_columns "
       "FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)")
def doc_features_table(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *(c.alias(n) for n, c in analyze.table_features(F.col("text")).items()))


@query(r"SELECT doc_id, CASE WHEN text = '' THEN 'unknown' WHEN len(regexp_extract_all(left(text, 100), '[\x{4e00}-\x{9fff}]')) > length(left(text, 100)) * 0.2 THEN 'zh' ELSE 'en' END AS language FROM documents")
def detect_language(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", analyze.language(F.col("text")).alias("language"))


def _with_features(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *(c.alias(n) for n, c in analyze.text_features(F.col("text")).items()))


_LEVEL = "CASE WHEN pages > 50 OR tokens > 50000 OR (has_tables AND pages > 20) THEN 'high' WHEN pages > 10 OR tokens > 10000 OR has_tables THEN 'medium' ELSE 'low' END"


@query(f"SELECT doc_id, {_LEVEL} AS complexity FROM ({TEXT_FEATURES})")
def doc_complexity(t: Tables) -> DataFrame:
    no = F.lit(False)
    return _with_features(t).select("doc_id", analyze.complexity(F.col("pages"), F.col("tokens"), F.col("has_tables"), no, no).alias("complexity"))


@query(f"""SELECT doc_id, level AS complexity, CAST(CASE level WHEN 'high' THEN 682 WHEN 'low' THEN 1228 ELSE 1024 END AS INTEGER) AS chunk_size,
    CAST(CASE WHEN mean_sentence > 100 THEN 30 ELSE 20 END AS INTEGER) AS chunk_overlap FROM (SELECT *, {_LEVEL} AS level FROM ({TEXT_FEATURES}))""")
def chunk_params(t: Tables) -> DataFrame:
    no = F.lit(False)
    rows = _with_features(t).withColumn("complexity", analyze.complexity(F.col("pages"), F.col("tokens"), F.col("has_tables"), no, no))
    size, overlap = analyze.chunk_parameters("text", F.col("complexity"), mean_sentence=F.col("mean_sentence"))
    return rows.select("doc_id", "complexity", size.alias("chunk_size"), overlap.alias("chunk_overlap"))


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.floor(F.length("text") / 4).alias("tokens"))


@query(f"SELECT doc_id, {norm('text')} AS text FROM documents")
def normalize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.normalize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {toks('text')} AS tokens FROM documents")
def tokenize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.tokens(F.col("text")).alias("tokens"))


@query(f"""SELECT doc_id, word, n, rank FROM (SELECT doc_id, word, count(*) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS BIGINT) AS rank
    FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {SQL_WORDS.format('text')} AS w FROM documents)) GROUP BY doc_id, word) WHERE rank <= 10""")
def keywords_by_frequency(t: Tables) -> DataFrame:
    return bm25.keywords_by_frequency(t.documents, "doc_id", "text", 10)


@query(f"""WITH w AS (SELECT doc_id, unnest({SQL_WORDS.format('text')}) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
    df AS (SELECT word, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
    s AS (SELECT tf.doc_id, word, round(tf / dl * ln(n / df), 6) AS score FROM tf JOIN df USING (word) JOIN dl USING (doc_id), n)
    SELECT doc_id, word, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS BIGINT) AS rank FROM s) WHERE rank <= 10""")
def keywords_tfidf(t: Tables) -> DataFrame:
    return bm25.keywords_tfidf(t.documents, "doc_id", "text", 10)


# RE2 has no look-ahead: other signs are doubled, so that one can end an entity and the other begin the next
_SIGNS = r"regexp_replace(text, '([^\p{L}\p{N}_\x20\x09-\x0D])', '\1\1', 'g')"
_RUNS = rf"regexp_extract_all({_SIGNS}, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-zA-Z]*(?:{WS}+[A-Z][a-zA-Z]*)*)(?:$|[^\p{{L}}\p{{N}}_])', 1)"
_ENTITIES = rf"""list_filter({_RUNS}, lambda x: x NOT IN ({', '.join(f"'{w}'" for w in T.COMMON_WORDS)}) AND (length(x) > 3 OR regexp_matches(x, '{WS}')))
    || regexp_extract_all(text, '([\x{{4e00}}-\x{{9fff}}]{{2,3}})(?:{'|'.join(T.NAME_TITLES)})', 1)"""


@query(f"SELECT doc_id, list_filter(found, lambda x, i: list_position(found, x) = i) AS entities FROM (SELECT doc_id, {_ENTITIES} AS found FROM documents)")
def extract_entities(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.entities(F.col("text")).alias("entities"))


_TOPIC_SQL = " || ".join(f"CASE WHEN list_has_any(w, [{', '.join(repr(x) for x in terms)}]) THEN ['{name}'] ELSE [] END" for name, terms in T.TOPICS.items())


@query(f"SELECT doc_id, {_TOPIC_SQL} AS topics FROM (SELECT doc_id, {SQL_WORDS.format('text')} AS w FROM documents)")
def topic_areas(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.topic_areas(T.words(F.col("text"))).alias("topics"))


@query("SELECT doc_id, regexp_extract_all(text, '[0-9]{4}年|[0-9]{4}-[0-9]{2}|[0-9]{4}/[0-9]{2}|[0-9]{4}\\.[0-9]{2}') AS times FROM documents")
def time_references(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.time_references(F.col("text")).alias("times"))


_CITING = "(SELECT doc_id, text || ' see https://example.org/' || doc_id || '?q=[1] and [' || length(text) || '], [x], [2]' AS text FROM documents)"


@query(rf"""SELECT doc_id, unnest.type AS type, unnest.value AS value FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, 'https?://[^\x20\x09-\x0D]+'), lambda x: {{'type': 'url', 'value': x}})
    || list_transform(regexp_extract_all(text, '\[([0-9]+)\]', 1), lambda x: {{'type': 'citation', 'value': x}})) AS unnest FROM {_CITING})""")
def extract_references(t: Tables) -> DataFrame:
    # the documents hold none, so each gets some
    made = F.concat("text", F.lit(" see https://example.org/"), F.col("doc_id").cast("string"), F.lit("?q=[1] and ["), F.length("text").cast("string"), F.lit("], [x], [2]"))
    return t.documents.select("doc_id", F.explode(T.references(made)).alias("r")).select("doc_id", "r.type", "r.value")


@query(f"""SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS title, len(regexp_extract_all(html, '(?i)<h[1-6][\\s>]')) AS n_headings,
    len(regexp_extract_all(html, '(?i)<img[\\s>/]')) AS n_images, len(regexp_extract_all(html, '(?i)<code[\\s>]')) AS n_code, md5(html) AS hash FROM pages""")
def doc_metadata(t: Tables) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t.pages.select("page_id", F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("title"), count(r"(?i)<h[1-6][\s>]").alias("n_headings"), count(r"(?i)<img[\s>/]").alias("n_images"), count(r"(?i)<code[\s>]").alias("n_code"), F.md5("html").alias("hash"))


@query("SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5("text").alias("content_hash"))


#: The queries that scores in this module are taken for: one text for all documents.
QUERY_TEXT = "the river and worthless nations of heathland"
_TERMS = "list_filter(string_split(lower('%s'), ' '), lambda q: length(q) > 2)" % QUERY_TEXT


def _relevance_sql(text: str) -> str:
    return f"(len(list_filter({_TERMS}, lambda q: contains(lower({text}), q))) / len({_TERMS}))"


@query(f"SELECT doc_id, {_relevance_sql('text')} AS relevance FROM documents")
def keyword_relevance(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.keyword_relevance(F.col("text"), F.lit(QUERY_TEXT)).alias("relevance"))


_CORE = f"""SELECT doc_id, CASE WHEN len(ss) <= 3 THEN text ELSE array_to_string(list_filter(ss, lambda s: list_contains(list_transform(list_slice(list_sort(list_transform(ss, lambda s, i: {{'r': -{_relevance_sql('s')}, 'i': i, 's': s}})),
    1, greatest(1, CAST(floor(len(ss) * 0.7::DOUBLE) AS BIGINT))), lambda x: x.s), s)), ' ') END AS core, text, ss FROM (SELECT doc_id, text, {SQL_SENTENCES.format('text')} AS ss FROM documents)"""


@query(f"SELECT doc_id, core FROM ({_CORE})")
def core_sentences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.core_sentences(F.col("text"), F.lit(QUERY_TEXT)).alias("core"))


_SUMMARY = "CASE WHEN length(array_to_string(list_slice(ss, 1, 3), ' ')) > 200 THEN left(array_to_string(list_slice(ss, 1, 3), ' '), 197) || '...' ELSE array_to_string(list_slice(ss, 1, 3), ' ') END"


@query(f"SELECT doc_id, {_SUMMARY} AS summary FROM ({_CORE})")
def summarize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.summary(F.col("text")).alias("summary"))


_COMPRESSED = f"SELECT doc_id, CASE WHEN {_relevance_sql('text')} > 0.8 THEN text WHEN {_relevance_sql('text')} > 0.5 THEN core WHEN length(text) > 50 THEN {_SUMMARY} END AS compressed FROM ({_CORE})"


@query(f"SELECT * FROM ({_COMPRESSED}) WHERE compressed IS NOT NULL")
def compress_context(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.compressed(F.col("text"), F.lit(QUERY_TEXT)).alias("compressed")).filter("compressed is not null")


@query(f"SELECT count(*) AS n, CAST(sum(length(compressed)) AS BIGINT) AS chars FROM ({_COMPRESSED.replace('0.7::DOUBLE', '0.6::DOUBLE')}) WHERE compressed IS NOT NULL")
def pipeline_compress(t: Tables) -> DataFrame:
    rows = t.documents.select(T.compressed(F.col("text"), F.lit(QUERY_TEXT), 0.6).alias("c")).filter("c is not null")
    return rows.agg(F.count("*").alias("n"), F.sum(F.length("c")).alias("chars"))


@query("SELECT doc_id, map(['doc_id', 'lang', 'source', 'level'], [CAST(doc_id AS VARCHAR), lang, source, 'chunk'])['level'] AS level, lang, text || chr(10) || chr(10) || '---' || chr(10) || '元数据: ' || "
       f"CASE WHEN len({_TOPIC_SQL}) > 0 THEN 'topic_areas=[' || array_to_string({_TOPIC_SQL}, ', ') || ']; ' ELSE '' END AS text FROM (SELECT *, {SQL_WORDS.format('text')} AS w FROM documents)")
def chunk_metadata(t: Tables) -> DataFrame:
    of_doc = {"doc_id": F.col("doc_id").cast("string"), "lang": F.col("lang"), "source": F.col("source"), "level": F.lit("document")}
    of_chunk = {"level": F.lit("chunk")}
    both = of_doc | of_chunk  # the chunk's own values win
    made = F.create_map(*(x for k, v in both.items() for x in (F.lit(k), v)))
    rows = t.documents.select("doc_id", made.alias("m"), T.embedded_metadata(F.col("text"), topic_areas=T.topic_areas(T.words(F.col("text")))).alias("text"))
    return rows.select("doc_id", F.col("m")["level"].alias("level"), F.col("m")["lang"].alias("lang"), "text")


@query(f"""SELECT source, list_sort(list_distinct(flatten(list({_TOPIC_SQL})))) AS topics, count(*) AS n_docs, CAST(sum(length(left(text, 200))) AS BIGINT) AS preview_chars FROM (SELECT *, {SQL_WORDS.format('text')} AS w FROM documents) GROUP BY source""")
def keyword_union(t: Tables) -> DataFrame:
    rows = t.documents.select("source", T.topic_areas(T.words(F.col("text"))).alias("topics"), F.length(F.substring("text", 1, 200)).alias("p"))
    # topics are at most as many as the dictionaries
    return rows.groupBy("source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics"), F.count("*").alias("n_docs"), F.sum("p").alias("preview_chars"))


@query(f"""SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, CAST((instr('0123456789abcdef', h[1]) - 1) * 4 + (instr('0123456789abcdef', h[2]) - 1) % 4 AS INTEGER) AS bucket
    FROM (SELECT doc_id, md5(unnest({toks('text')})) AS h FROM documents)) GROUP BY ALL""")
def hash_embedding(t: Tables) -> DataFrame:
    terms = t.documents.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return terms.select("doc_id", T.hash_bucket(F.col("term")).alias("bucket")).groupBy("doc_id", "bucket").agg(F.count("*").alias("n"))
