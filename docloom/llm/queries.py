"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, exact_dedup, line_dedup, media, packing, phrases, rule_ledger, simhash, suffix_dedup, token_files, toxicity, urls, vector_codes
from docloom.llm.common import table
from docloom.tables import spread

#: Ids of the end of a document, in flat token files and in packed sequences.
END_OF_TEXT, END_OF_DOCUMENT = 50256, 1
#: Sites at which a line must occur to be boilerplate.
MIN_SITES = 5
#: The url rules.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def vocabulary(path: str | None = None) -> str:
    """Path of the tokenizer file, from the package of public tokenizers unless given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def severity_labels(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in a text of poor quality."""
    return labels.filter("toxic is not null").select("doc_id", (F.col("toxic") * (F.lit(2) - F.coalesce("quality", F.lit(1)))).cast("int").alias("grade"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(table(spark, sf_dir, "documents"), vocabulary(), END_OF_TEXT)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, severity_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).drop("text")


def op5_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), END_OF_DOCUMENT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_spread_lines(table(spark, sf_dir, "documents"), MIN_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    words = pages.select(urls.visible("html").alias("words"))
    return urls.judge(pages, URL_RULES, words, "words").select("page_id", "host", "path", "rule", "verdict")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), min_count=100, top=2000)


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = vector_codes.train(spread(table(spark, sf_dir, "embeddings")))
    return vector_codes.with_group_error(trained.coded).select("vec_id", "code", "error", "label_error", F.lit(trained.digest()).alias("codebooks_sha256"))


def op13_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = rule_ledger.verdict(rule_ledger.ledger(table(spark, sf_dir, "documents")), rule_ledger.POLICIES[3])
    base = F.col("failed").bitwiseAND(F.lit(rule_ledger.mask(rule_ledger.POLICIES[1].rules)).cast("long")) != 0
    return held.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_bpe_round_trip, op3_exact_dedup, op4_toxicity, op5_media_webp, op6_packing, op7_suffix_dedup, op8_simhash, op9_line_dedup, op10_url_filter, op11_phrases, op12_yinyang_codes, op13_rule_ledger)
}


def _codes_sql(rounds: int) -> str:
    """Exhaustive Lloyd rounds, one pair of tables for each."""
    far = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"near{i} AS MATERIALIZED (SELECT a.r, a.p, min({far} * 256 + e) AS m FROM cells a JOIN book{i} b USING (p) GROUP BY a.r, a.p)")
        if i < rounds:
            steps.append(f"""sums{i} AS (SELECT p, e, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (
                SELECT p, m % 256 AS e, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM near{i} JOIN cells USING (r, p)) GROUP BY p, e, j)""")
            steps.append(f"""book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM book{i} b LEFT JOIN (
                SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY j) AS x FROM sums{i} GROUP BY p, e) n USING (p, e))""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cells AS MATERIALIZED (
            SELECT r, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) parts(p)
        ), book0 AS MATERIALIZED (
            SELECT p, e, x FROM cells JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept) USING (r) WHERE e < 16
        ), {", ".join(steps)}, coded AS (
            SELECT r, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM near{rounds} GROUP BY r
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM book{rounds})) AS codebooks_sha256
        FROM kept JOIN coded USING (r)
    """


ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
        FROM rows WINDOW best AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
    """,
    "op9_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
        ), trimmed AS (
            SELECT *, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS own FROM lines
        ), spread AS (
            SELECT own FROM trimmed WHERE own <> '' GROUP BY own HAVING count(DISTINCT coalesce(source, chr(1))) >= CASE WHEN length(own) < 20 THEN {2 * MIN_SITES} ELSE {MIN_SITES} END
        ), marked AS (
            SELECT t.doc_id, t.line, t.k, s.own IS NOT NULL AS gone FROM trimmed t LEFT JOIN spread s ON t.own = s.own
        )
        SELECT d.doc_id, count(m.k) AS n_lines, CAST(coalesce(sum(CASE WHEN m.gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.k) FILTER (WHERE NOT m.gone), '')) AS text_sha256
        FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
    """,
    "op11_phrases": r"""
        WITH pieces AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
        ), grams AS (
            SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) sizes(k))
        ), f AS MATERIALIZED (
            SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100
        ), totals AS (
            SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
        ), cuts AS (
            SELECT lang, phrase, a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)
        ), scores AS (
            SELECT c.lang, c.phrase, c.a, c.c, x.a AS l, y.a AS r, n, CAST(CAST(c.a AS HUGEINT) * n * 1000 // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
        ), lowest AS (
            SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
        ), held AS (
            SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
                SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY 1, 2
        ), ranked AS (
            SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank
            FROM lowest l LEFT JOIN held h ON h.lang = l.lang AND h.phrase = l.phrase WHERE longer IS NULL OR longer < a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
    "op12_yinyang_codes": _codes_sql(6),
    "op13_rule_ledger": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
        ), words AS (
            SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)
        ), windows AS (
            SELECT r, i, word, array_to_string(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS w,
                   count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) = 8 AS whole FROM words
        ), found AS (
            SELECT r, i, word, whole AND count(*) OVER (PARTITION BY r, w, whole) > 1 AS again FROM windows
        ), inside AS (
            SELECT r, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS repeated FROM found
        ), by_word AS (
            SELECT r, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (WHERE repeated) AS n_repeat_words FROM inside GROUP BY r
        ), lines AS (
            SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts
        ), by_line AS (
            SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
        ), measured AS (
            SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                   coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM texts LEFT JOIN by_word USING (r) LEFT JOIN by_line USING (r)
        ), judged AS (
            SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
                      + 8 * (10 * n_symbols > n_words)::INT + 16 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT AS BIGINT) AS failed FROM measured
        )
        SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM judged
    """,
}
