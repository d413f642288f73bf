"""Chunking and markdown structure, over ``documents`` and, for headings, over ``pages`` as markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import chunking as C, markdown as M, text as T
from docloom.operators import boundaries as B
from docloom.plans.registry import query
from docloom.tables import Tables

CHUNKS = "array<string>"


def pages_md(t: Tables) -> DataFrame:
    return t.pages.select("page_id", M.from_html(F.col("html")).alias("md"))


_MD = "".join("regexp_replace(" for _ in range(6)) + "html" + "".join(rf", '(?is)<h{k}[^>]*>(.*?)</h{k}>', chr(10) || '{'#' * k} \1' || chr(10), 'g')" for k in range(1, 7))
PAGES_MD = f"pages_md AS (SELECT page_id, regexp_replace(regexp_replace({_MD}, '(?i)</p>|<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS md FROM pages)"
STRIP = r"regexp_replace(regexp_replace(%s, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
SLUG = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(title, '<[^>]*>', '', 'g')), '[^a-z0-9一-龥]+', '-', 'g'), '^-+', ''), '-+$', '')"
LINES = rf"""{PAGES_MD}, raw AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT page_id, string_split(md, chr(10)) AS ls FROM pages_md)),
    fenced AS (SELECT *, starts_with(trim(line), '```') AS fence, sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no) AS fences FROM raw),
    typed AS (SELECT *, fence OR fences % 2 = 1 AS in_code, NOT (fence OR fences % 2 = 1) AND regexp_matches(line, '^(#{{1,6}})[\x20\x09]+(.+)$') AS heading FROM fenced),
    lines AS (SELECT page_id, line_no, line, in_code, CASE WHEN heading THEN length(regexp_extract(line, '^(#{{1,6}})[\x20\x09]+(.+)$', 1)) END AS level,
        CASE WHEN heading THEN {STRIP % "regexp_extract(line, '^(#{1,6})[\x20\x09]+(.+)$', 2)".replace("{", "{{").replace("}", "}}")} END AS title,
        CAST(sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no) AS BIGINT) AS heading_no FROM typed),
    headings AS (SELECT page_id, heading_no, line_no, level, title, {SLUG} AS heading_id FROM lines WHERE level IS NOT NULL)""".replace("{{", "{").replace("}}", "}")
CRUMBS = """crumbs AS (SELECT h.page_id, h.heading_no, h.level, h.title, h.heading_id, coalesce((SELECT string_agg(a.title, ' > ' ORDER BY a.heading_no) FROM headings a WHERE a.page_id = h.page_id AND a.heading_no < h.heading_no AND a.level < h.level
    AND NOT EXISTS (SELECT 1 FROM headings b WHERE b.page_id = a.page_id AND b.heading_no > a.heading_no AND b.heading_no < h.heading_no AND b.level <= a.level)) || ' > ', '') || h.title AS breadcrumb FROM headings h)"""
SECTIONS = f"""{CRUMBS}, sections AS (SELECT c.*, coalesce((SELECT {STRIP % "string_agg(l.line, chr(10) ORDER BY l.line_no)"} FROM lines l WHERE l.page_id = c.page_id AND l.heading_no = c.heading_no AND l.level IS NULL AND NOT l.in_code), '') AS content FROM crumbs c)"""


def _fold_sql(pieces: str, size: int, joiner: str, counted: int, opening: int, table: str = "documents", key: str = "doc_id") -> str:
    """Greedy packing as a recursive query: a piece that doesn't fit opens a chunk with ``opening`` more than its length."""
    return f"""WITH RECURSIVE p AS ({pieces}), packed AS (SELECT {key}, i, x, CAST(length(x) + {counted} AS BIGINT) AS size, CAST(0 AS BIGINT) AS chunk_index FROM p WHERE i = 1
        UNION ALL SELECT p.{key}, p.i, p.x, CASE WHEN k.size + length(p.x) > {size} THEN length(p.x) + {opening} ELSE k.size + length(p.x) + {counted} END, k.chunk_index + CASE WHEN k.size + length(p.x) > {size} THEN 1 ELSE 0 END
        FROM packed k JOIN p ON p.{key} = k.{key} AND p.i = k.i + 1)
        SELECT {key}, chunk_index, array_to_string(list(x ORDER BY i), '{joiner}') AS text FROM packed GROUP BY {key}, chunk_index"""


def _pieces(expr: str, key: str = "doc_id", table: str = "documents") -> str:
    return f"SELECT {key}, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT {key}, {expr} AS ls FROM {table})"


def _packed_sql(name: str, pieces: str, keys: str, size: int, per_piece: int) -> str:
    """CTE ``name``: keys, g, big, xs, the groups that greedy packing of pieces (keys, i, x) makes; an over-long piece is a group of its own.

    A piece that opens a chunk after a full one counts its length, any other ``per_piece`` more.
    """
    same = " AND ".join(f"p.{k} = k.{k}" for k in keys.split(", "))
    own = ", ".join(f"p.{k}" for k in keys.split(", "))
    n = "length(p.x)"
    return f"""{name}_p AS ({pieces}), {name}_k AS (SELECT {keys}, i, x, CAST(CASE WHEN length(x) > {size} THEN 0 ELSE length(x) + {per_piece} END AS BIGINT) AS size, CAST(0 AS BIGINT) AS g, length(x) > {size} AS big FROM {name}_p WHERE i = 1
        UNION ALL SELECT {own}, p.i, p.x, CASE WHEN {n} > {size} THEN 0 WHEN k.size + {n} > {size} THEN {n} ELSE k.size + {n} + {per_piece} END,
            k.g + CASE WHEN {n} > {size} OR k.big OR k.size + {n} > {size} THEN 1 ELSE 0 END, {n} > {size} FROM {name}_k k JOIN {name}_p p ON {same} AND p.i = k.i + 1),
        {name} AS (SELECT {keys}, g, bool_or(big) AS big, min(i) AS first, list(x ORDER BY i) AS xs FROM {name}_k GROUP BY {keys}, g)"""


def greedy_sql(name: str, pieces: str, keys: str, size: int, counted: int) -> str:
    """CTE ``name``: keys, g, xs, the groups that packing of pieces (keys, i, x) makes while lengths, each plus ``counted``, stay within ``size``."""
    same, own = " AND ".join(f"p.{k} = k.{k}" for k in keys.split(", ")), ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""{name}_p AS MATERIALIZED ({pieces}), {name}_k AS (SELECT {keys}, i, x, CAST(length(x) + {counted} AS BIGINT) AS size, CAST(0 AS BIGINT) AS g FROM {name}_p WHERE i = 1
        UNION ALL SELECT {own}, p.i, p.x, CASE WHEN k.size + length(p.x) > {size} THEN 0 ELSE k.size END + length(p.x) + {counted}, k.g + CASE WHEN k.size + length(p.x) > {size} THEN 1 ELSE 0 END
        FROM {name}_k k JOIN {name}_p p ON {same} AND p.i = k.i + 1),
        {name} AS (SELECT {keys}, g, list(x ORDER BY i) AS xs FROM {name}_k GROUP BY {keys}, g)"""


def _text_sql(joiner: str) -> str:
    """A group's text: its pieces joined, without empty ones at the beginning; null where all are empty."""
    return f"array_to_string(list_slice(xs, list_position(list_transform(xs, lambda x: x <> ''), true), len(xs)), {joiner})"


def _numbered(rows: str, key: str, order: str) -> str:
    return f"SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS BIGINT) AS chunk_index, text FROM ({rows}) WHERE text <> ''"


def _sentences_sql(name: str, source: str, keys: str) -> str:
    """CTEs whose last, ``name``_all, has keys, g, j, text: the sentence chunks of ``source`` (keys, x)."""
    pieces = f"SELECT {keys}, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT {keys}, string_split(replace(x, '. ', '.' || chr(10)), chr(10)) AS ls FROM {source})"
    return f"""{_packed_sql(name, pieces, keys, 1000, 1)}, {name}_all AS (SELECT {keys}, g, 0 AS j, {_text_sql("' '")} AS text FROM {name} WHERE NOT big
        UNION ALL SELECT {keys}, g, j, substr(xs[1], j + 1, 1000) FROM (SELECT {keys}, g, xs, unnest(range(0, length(xs[1]), 1000)) AS j FROM {name} WHERE big))"""


_SENTENCES = f"WITH RECURSIVE docs AS (SELECT doc_id, text AS x FROM documents), {_sentences_sql('s', 'docs', 'doc_id')} {_numbered('SELECT * FROM s_all', 'doc_id', 'g, j')}"
_PARAGRAPHS = f"""WITH RECURSIVE {_packed_sql('q', _pieces('string_split(text, chr(10))'), 'doc_id', 1000, 0)}, long AS (SELECT doc_id, g AS top, xs[1] AS x FROM q WHERE big), {_sentences_sql('s', 'long', 'doc_id, top')}
    {_numbered(f"SELECT doc_id, g AS top, 0 AS g, 0 AS j, {_text_sql('chr(10)')} AS text FROM q WHERE NOT big UNION ALL SELECT doc_id, top, g, j, text FROM s_all", 'doc_id', 'top, g, j')}"""


@query(_PARAGRAPHS)
def chunk_paragraphs(t: Tables) -> DataFrame:
    return C.exploded(t.documents, "doc_id", C.paragraph_chunks(F.col("text"), separator="\n"))


@query(_SENTENCES)
def chunk_sentences(t: Tables) -> DataFrame:
    return C.exploded(t.documents, "doc_id", C.sentence_chunks(F.col("text")))


@query("SELECT doc_id, CAST(i // 180 AS BIGINT) AS chunk_index, substr(text, i + 1, 200) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 180)) AS i FROM documents)")
def chunk_fixed_overlap(t: Tables) -> DataFrame:
    return C.exploded(t.documents.filter("text <> ''"), "doc_id", C.windows(F.col("text"), 200, 20))


@query(f"""WITH RECURSIVE {PAGES_MD}, p AS ({_pieces('string_split(md, chr(10))', 'page_id', 'pages_md')}), k AS (SELECT page_id, i, x, CAST(length(x) + 1 AS BIGINT) AS size, CAST(0 AS BIGINT) AS chunk_index FROM p WHERE i = 1
    UNION ALL SELECT p.page_id, p.i, p.x, CASE WHEN starts_with(p.x, '#') OR k.size > 1000 THEN 0 ELSE k.size END + length(p.x) + 1, k.chunk_index + CASE WHEN starts_with(p.x, '#') OR k.size > 1000 THEN 1 ELSE 0 END FROM k JOIN p ON p.page_id = k.page_id AND p.i = k.i + 1)
    SELECT page_id, chunk_index, array_to_string(list(x ORDER BY i), chr(10)) || chr(10) AS text FROM k GROUP BY page_id, chunk_index""")
def chunk_by_headings(t: Tables) -> DataFrame:
    return C.exploded(pages_md(t), "page_id", C.heading_chunks(F.col("md"), "#"))


_ENDS = r"string_split(regexp_replace(text, '([.!?。！？；;][\x20\x09-\x0D]*)', '\1' || chr(1), 'g'), chr(1))"


@query(f"SELECT doc_id, list_filter({_ENDS}, lambda x: {STRIP % 'x'} <> '') AS sentences FROM documents")
def split_sentences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.sentences_keeping_ends(F.col("text")).alias("sentences"))


def _ends_of(text: str) -> str:
    return rf"string_split(regexp_replace({text}, '([.!?。！？；;][\x20\x09-\x0D]*)', '\1' || chr(1), 'g'), chr(1))"


def _overlapping_sql(name: str, source: str, keys: str) -> str:
    """CTEs whose last, ``name``, has keys, low, text: overlapping sentence chunks of ``source`` (keys, x)."""
    by = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    over = "e.upto[s.i] - e.upto[k.low + 1] + s.n > 1000 AND s.i - 1 > k.low"
    return f"""{name}_d AS (SELECT {keys}, list_transform(list_filter({_ends_of('x')}, lambda x: {STRIP % 'x'} <> ''), lambda x: {STRIP % 'x'}) AS ls FROM {source}),
    {name}_p AS (SELECT {keys}, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM {name}_d), {name}_s AS (SELECT {keys}, i, length(x) AS n, CAST(sum(length(x) + 1) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) AS upto FROM {name}_p),
    {name}_e AS (SELECT {keys}, list_prepend(0, list(upto ORDER BY i)) AS upto, max(i) AS total FROM {name}_s GROUP BY {keys}),
    {name}_k AS (SELECT {keys}, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS low, CAST(0 AS BIGINT) AS before, false AS over FROM {name}_e
        UNION ALL SELECT {of('s')}, s.i, CASE WHEN {over} THEN greatest(s.i - 3, k.low + 1) ELSE k.low END, k.low, {over}
        FROM {name}_k k JOIN {name}_s s ON {by('s', 'k')} AND s.i = k.i + 1 JOIN {name}_e e ON {by('e', 'k')}),
    {name}_m AS (SELECT {keys}, before AS low, i - 1 AS high FROM {name}_k WHERE over UNION ALL SELECT {of('k')}, low, total FROM {name}_k k JOIN {name}_e e ON {by('e', 'k')} AND k.i = e.total),
    {name} AS (SELECT {of('m')}, m.low, array_to_string(list_slice(d.ls, m.low + 1, m.high), ' ') AS text FROM {name}_m m JOIN {name}_d d ON {by('d', 'm')})"""


_OVERLAPPING = f"""WITH RECURSIVE docs AS (SELECT doc_id, text AS x FROM documents), {_overlapping_sql('v', 'docs', 'doc_id')}
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY low) - 1 AS BIGINT) AS chunk_index, text FROM v"""


@query(_OVERLAPPING)
def chunk_sentence_overlap(t: Tables) -> DataFrame:
    return C.exploded(t.documents, "doc_id", C.overlapping_sentences(F.col("text")))


def _last_sql(parts: str, room: str, joiner: str) -> str:
    """The last of ``parts`` that fit into ``room`` when joined, as a struct of their number and text."""
    joined = f"array_to_string(list_slice({parts}, len({parts}) - j + 1, len({parts})), {joiner})"
    return f"""list_transform([len(list_filter(range(1, len({parts}) + 1), lambda j: length({joined}) + CASE WHEN j = 1 THEN length({joiner}) ELSE 0 END <= {room}))],
        lambda j: {{'n': j, 'text': CASE WHEN j > 0 THEN {joined} ELSE '' END}})[1]"""


_BREAK = "(chr(10) || chr(10))"


def overlap_sql(x: str, size: int) -> str:
    """What the next chunk repeats of the text ``x``."""
    lead = f"list_filter({_ends_of('coalesce(ps[len(ps) - tail.n], ' + repr('') + ')')}, lambda x: {STRIP % 'x'} <> '')"
    to_last = "list_slice(all_ps, 1, coalesce(list_max(list_transform(all_ps, lambda y, i: CASE WHEN y <> '' THEN i END)), 0))"
    return f"""CASE WHEN length({x}) <= {size} THEN {x} ELSE list_transform([string_split({x}, {_BREAK})], lambda all_ps: list_transform([{to_last}], lambda ps: list_transform([{_last_sql('ps', str(size), _BREAK)}], lambda tail: list_transform([{lead}], lambda ss:
    list_transform([{_last_sql('ss', f'({size} - length(tail.text))', "' '")}], lambda lead: list_transform([lead.text || CASE WHEN lead.text <> '' AND tail.text <> '' THEN {_BREAK} ELSE '' END || tail.text],
    lambda o: CASE WHEN length(o) * 2 < {size} THEN right({x}, {size}) ELSE o END)[1])[1])[1])[1])[1])[1] END"""


_OVERLAP = overlap_sql("now", 100)
_RECURSIVE = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, {STRIP % 'x'} AS x, i FROM ({_pieces('string_split(text, chr(10))', table="(SELECT * FROM documents WHERE length(replace(text, chr(10), chr(10) || chr(10))) > 1000)")})) WHERE x <> ''),
    k AS (SELECT doc_id, i, CASE WHEN length(x) > 1000 THEN '' ELSE x END AS now, '' AS out FROM p WHERE i = 1
        UNION ALL SELECT p.doc_id, p.i, CASE WHEN length(x) > 1000 THEN '' WHEN now <> '' AND length(now) + length(x) + 2 > 1000 THEN CASE WHEN length(now) > 100 THEN {_OVERLAP} || {_BREAK} || x ELSE x END WHEN now = '' THEN x ELSE now || {_BREAK} || x END,
            CASE WHEN length(x) > 1000 OR length(now) + length(x) + 2 > 1000 THEN now ELSE '' END FROM k JOIN p ON p.doc_id = k.doc_id AND p.i = k.i + 1),
    huge AS (SELECT doc_id, i AS para, x FROM p WHERE length(x) > 2000), {_overlapping_sql('v', 'huge', 'doc_id, para')}, long AS (SELECT doc_id, i AS para, x FROM p WHERE length(x) > 1000 AND length(x) <= 2000), {_sentences_sql('s', 'long', 'doc_id, para')},
    every AS (SELECT doc_id, i, 0 AS a, 0 AS b, 0 AS c, out AS text FROM k UNION ALL SELECT doc_id, para, 1, low, 0, text FROM v UNION ALL SELECT doc_id, para, 1, g, j, text FROM s_all
        UNION ALL SELECT doc_id, i, 2, 0, 0, now FROM k QUALIFY i = max(i) OVER (PARTITION BY doc_id)
        UNION ALL SELECT doc_id, 0, 0, 0, 0, replace(text, chr(10), {_BREAK}) FROM documents WHERE length(replace(text, chr(10), {_BREAK})) <= 1000)
    {_numbered('SELECT * FROM every', 'doc_id', 'i, a, b, c')}"""


@query(_RECURSIVE)
def chunk_recursive_overlap(t: Tables) -> DataFrame:
    # lines count as paragraphs
    return C.exploded(t.documents, "doc_id", C.recursive_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query(_fold_sql(_pieces("string_split(text, chr(10))"), 1024, "' || chr(10) || '", 0, 0))
def node_chunks(t: Tables) -> DataFrame:
    return C.exploded(t.documents, "doc_id", C.packed(F.split("text", "\n"), 1024, "\n", 0))


@query("SELECT doc_id, CAST(ceil(length(text) / 1024) AS BIGINT) AS node_count, TRUE AS vectorized FROM documents")
def node_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(C.windows(F.col("text"), 1024)).cast("long").alias("node_count"), F.lit(True).alias("vectorized"))


SECTION_CHUNKS = f"WITH {LINES}, {SECTIONS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY heading_no) - 1 AS BIGINT) AS chunk_index, breadcrumb || chr(10) || chr(10) || content AS text FROM sections WHERE content <> ''"


@query(SECTION_CHUNKS)
def chunk_markdown_sections(t: Tables) -> DataFrame:
    return M.section_chunks(pages_md(t), "page_id", "md")


_DEFINITION = r"(?m)^([\x20\x09]*(?:def|function|func|fn|public|private|protected|class|module|interface)[\x20\x09]+)"
_CODE_LINES = f"""SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS i FROM (SELECT doc_id, a, unnest(ls) AS x, generate_subscripts(ls, 1) AS b FROM (
    SELECT doc_id, a, CASE WHEN length(x) > 986 THEN string_split(regexp_replace(x, '(\n)', '\\1' || chr(1), 'g'), chr(1)) ELSE [x] END AS ls FROM (
        SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS a FROM (SELECT doc_id, string_split(regexp_replace(text, '{_DEFINITION}', chr(1) || '\\1', 'g'), chr(1)) AS ls FROM documents WHERE length(text) > 986)))) WHERE x <> ''"""


@query(f"""WITH RECURSIVE {greedy_sql('c', _CODE_LINES, 'doc_id', 986, 0)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS BIGINT) AS chunk_index, '```python' || chr(10) || text || chr(10) || '```' AS text FROM (
    SELECT doc_id, g, regexp_replace(array_to_string(xs, ''), '\n+$', '') AS text FROM c WHERE {STRIP % "array_to_string(xs, '')"} <> '' UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 986)""")
def chunk_code(t: Tables) -> DataFrame:
    fenced = t.documents.select("doc_id", F.concat(F.lit("```python\n"), "text", F.lit("\n```")).alias("block"))
    return B.apply(fenced, "doc_id", ["block"], B.code_pieces, CHUNKS).select("doc_id", F.posexplode("value").alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(_fold_sql("SELECT doc_id, '- ' || x || CASE WHEN i < n THEN chr(10) ELSE '' END AS x, i FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))", 1000, "", 0, 0))
def chunk_list(t: Tables) -> DataFrame:
    items = t.documents.select("doc_id", F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- "))).alias("items"))
    return B.apply(items, "doc_id", ["items"], B.list_pieces, CHUNKS).select("doc_id", F.posexplode("value").alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


_MARKED = r"regexp_matches(p.x, '^(#{1,6}|\*\*|__|[0-9]+\.)[\x20\x09-\x0D]+.+$')"
_MD_PARTS = f"""md_p AS MATERIALIZED ({_pieces('string_split(md, chr(10))', 'page_id', 'pages_md')}), md_k AS (SELECT page_id, i, x, CAST(length(x) + 1 AS BIGINT) AS size, CAST(0 AS BIGINT) AS g FROM md_p WHERE i = 1
    UNION ALL SELECT p.page_id, p.i, p.x, CASE WHEN {_MARKED} OR k.size >= 1024 THEN 0 ELSE k.size END + length(p.x) + 1, k.g + CASE WHEN {_MARKED} OR k.size >= 1024 THEN 1 ELSE 0 END FROM md_k k JOIN md_p p ON p.page_id = k.page_id AND p.i = k.i + 1),
    md_s AS (SELECT page_id, g, regexp_replace(regexp_replace(array_to_string(list(x ORDER BY i), chr(10)), '^\n+', ''), '\n+$', '') AS x FROM md_k GROUP BY page_id, g)"""


@query(f"""WITH RECURSIVE {PAGES_MD}, {_MD_PARTS}, {greedy_sql('m', "SELECT page_id, x, row_number() OVER (PARTITION BY page_id ORDER BY g) AS i FROM md_s WHERE x <> ''", 'page_id', 1024, 2)}
    SELECT page_id, CAST(g AS BIGINT) AS chunk_index, array_to_string(xs, chr(10) || chr(10)) AS text FROM m""")
def chunk_semantic_md(t: Tables) -> DataFrame:
    return B.apply(pages_md(t), "page_id", ["md"], B.semantic_sections, CHUNKS).select("page_id", F.posexplode("value").alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(_fold_sql(_pieces(r"list_filter(list_transform(string_split(text, chr(10)), lambda x: " + STRIP % "x" + "), lambda x: x <> '')"), 1024, "' || chr(10) || chr(10) || '", 2, 2))
def chunk_semantic_text(t: Tables) -> DataFrame:
    paragraphs = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    return C.exploded(t.documents, "doc_id", C.packed(paragraphs, 1024, "\n\n", 2))


def _continued_sql(source: str, keys: str, columns: str, size: int) -> str:
    """Query: ``columns``, part, text, is_continuation of the sections ``source`` (keys, columns, x); long ones are packed sentences."""
    sentences = rf"list_filter(list_transform(string_split(regexp_replace(x, '([.!?。！？])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)), lambda y: {STRIP % 'y'}), lambda y: y <> '')"
    pieces = f"SELECT {keys}, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT {keys}, {sentences} AS ls FROM {source} WHERE length(x) > {size})"
    return f"""{greedy_sql('cont', pieces, keys, size, 1)} SELECT {columns}, part, text, part > 0 AS is_continuation FROM {source} JOIN (
        SELECT {keys}, g AS part, array_to_string(xs, ' ') AS text FROM cont UNION ALL SELECT {keys}, 0, x FROM {source} WHERE length(x) <= {size} AND x <> '') USING ({keys})"""


#: The size of a section in the two queries; sections of the pages are short.
SECTION = 200


@query(f"""WITH RECURSIVE {LINES}, own AS (SELECT page_id, heading_no, title, level, {STRIP % "line_text"} AS x FROM (SELECT h.page_id, h.heading_no, h.title, h.level, (SELECT string_agg(l.line, chr(10) ORDER BY l.line_no) FROM lines l WHERE l.page_id = h.page_id AND l.heading_no = h.heading_no) AS line_text FROM headings h)),
    {_continued_sql('own', 'page_id, heading_no', 'page_id, heading_no, title, level', SECTION)}""")
def chunk_hier_md(t: Tables) -> DataFrame:
    rows = M.lines(pages_md(t), "page_id", "md").filter("heading_no > 0")
    own = rows.groupBy("page_id", "heading_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("own"), F.max("title").alias("title"), F.max("level").alias("level"))
    parts = C.long_section(T.strip(F.array_join(F.transform("own", lambda x: x["line"]), "\n")), SECTION)
    return own.select("page_id", "heading_no", "title", "level", F.posexplode(parts).alias("part", "x")).select("page_id", "heading_no", "title", "level", F.col("part").cast("long").alias("part"), "x.*")


@query(f"""WITH RECURSIVE marked AS (SELECT page_id, string_split(regexp_replace(html, '(?i)(<h[1-6][^>]*>)', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM pages), each AS (SELECT page_id, unnest(list_slice(parts, 2, len(parts))) AS part, generate_subscripts(list_slice(parts, 2, len(parts)), 1) - 1 AS i FROM marked),
    own AS (SELECT page_id, CAST(i AS BIGINT) AS chunk_index, trim(regexp_replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS x FROM each),
    {_continued_sql('own', 'page_id, chunk_index', 'page_id, chunk_index', SECTION)}""")
def chunk_hier_html(t: Tables) -> DataFrame:
    parts = F.split(F.regexp_replace("html", r"(?i)(<h[1-6][^>]*>)", "\x01$1"), "\x01")
    sections = F.slice(parts, F.lit(2), F.size(parts))
    own = C.exploded(t.pages.withColumn("s", sections), "page_id", F.transform(F.col("s"), T.html_to_text))
    made = own.select("page_id", "chunk_index", F.posexplode(C.long_section(F.col("text"), SECTION)).alias("part", "x"))
    return made.select("page_id", "chunk_index", F.col("part").cast("long").alias("part"), "x.*")


_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"
#: A short line that ends with a colon, or is in upper or in title case.
_HEADS = rf"""length(x) < 100 AND (ends_with(x, ':') OR regexp_matches(x, '[\p{{Lu}}\p{{Lt}}]') AND (NOT regexp_matches(x, '[\p{{Ll}}\p{{Lt}}]')
    OR NOT regexp_matches(x, '{_CASED}[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches(x, '(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}')))"""
_GENERIC = rf"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, x, {_HEADS} AS head, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
        SELECT doc_id, {STRIP % 'x'} AS x, i FROM ({_pieces('string_split(text, chr(10))')})) WHERE x <> ''),
    k AS (SELECT doc_id, i, x, head, CASE WHEN head THEN x END AS heading, CAST(CASE WHEN head THEN 0 ELSE length(x) + 2 END AS BIGINT) AS n, CAST(0 AS BIGINT) AS g FROM p WHERE i = 1
        UNION ALL SELECT p.doc_id, p.i, p.x, p.head, CASE WHEN p.head THEN p.x ELSE k.heading END, CASE WHEN p.head THEN 0 WHEN k.n > 0 AND k.n + length(p.x) > 1024 THEN length(p.x) + 2 ELSE k.n + length(p.x) + 2 END,
            k.g + CASE WHEN p.head OR k.n > 0 AND k.n + length(p.x) > 1024 THEN 1 ELSE 0 END FROM k JOIN p ON p.doc_id = k.doc_id AND p.i = k.i + 1)"""


@query(f"""{_GENERIC} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS chunk_index, heading, text FROM (
    SELECT doc_id, g, max(heading) AS heading, array_to_string(list(x ORDER BY i), chr(10) || chr(10)) AS text FROM k WHERE NOT head GROUP BY doc_id, g)""")
def chunk_hier_generic(t: Tables) -> DataFrame:
    found = B.apply(t.documents, "doc_id", ["text"], B.generic_sections, "array<struct<heading:string,text:string>>")
    return found.select("doc_id", F.posexplode("value").alias("chunk_index", "v")).select("doc_id", "chunk_index", "v.heading", "v.text")


@query(f"WITH {LINES}, {CRUMBS} SELECT page_id, heading_no, breadcrumb FROM crumbs")
def heading_breadcrumbs(t: Tables) -> DataFrame:
    return M.breadcrumbs(M.headings(pages_md(t), "page_id", "md"), "page_id").select("page_id", "heading_no", "breadcrumb")


@query()
def semantic_boundaries(t: Tables) -> DataFrame:
    found = B.apply(t.pages, "page_id", ["html"], lambda x: B.boundaries(x, html=True), "array<struct<type:string,start:int,end:int,level:int,title:string,importance:double>>")
    return found.select("page_id", F.inline("value"))


@query("""WITH cut AS (SELECT doc_id, i // 500 AS chunk_index, substr(text, i + 1, 500) AS own FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS i FROM documents))
    SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, own || coalesce(left(lead(own) OVER (PARTITION BY doc_id ORDER BY chunk_index), 50), '') AS text FROM cut""")
def chunk_forward_overlap(t: Tables) -> DataFrame:
    chunks = C.exploded(t.documents.filter("text <> ''"), "doc_id", C.windows(F.col("text"), 500))
    following = F.lead("text").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks.select("doc_id", "chunk_index", F.concat("text", F.coalesce(F.left(following, F.lit(50)), F.lit(""))).alias("text"))


def _of_spans(rows: DataFrame, key: str, f) -> DataFrame:
    made = B.apply(rows, key, [rows.columns[1]], lambda x: [{"start": a, "end": b} for a, b in f(x)], "array<struct<start:long,end:long>>")
    return made.select(key, F.posexplode("value").alias("chunk_index", "s")).select(key, F.col("chunk_index").cast("long").alias("chunk_index"), "s.start", "s.end")


@query()
def chunk_enhanced(t: Tables) -> DataFrame:
    return _of_spans(t.documents.select("doc_id", "text"), "doc_id", B.enhanced_spans)


@query("SELECT doc_id, i AS start, least(i + 1000, length(text)) AS end FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS i FROM documents)")
def split_fixed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(C.spans(F.col("text"), 1000)).alias("s")).select("doc_id", "s.start", "s.end")


def _spans_sql(pattern: str) -> str:
    """Spans of greedily packed pieces that end at matches of ``pattern``."""
    folded = _fold_sql(_pieces(f"string_split(regexp_replace(text, '({pattern})', '\\1' || chr(1), 'g'), chr(1))"), 1000, "", 0, 0)
    return f"SELECT doc_id, CAST(row_number() OVER own - 1 AS BIGINT) AS chunk_index, CAST(sum(length(text)) OVER own AS BIGINT) - length(text) AS start, CAST(sum(length(text)) OVER own AS BIGINT) AS end FROM ({folded}) WHERE text <> '' WINDOW own AS (PARTITION BY doc_id ORDER BY chunk_index)"


_UNICODE_WS = r"\x09-\x0D\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(_spans_sql(f"[.!?。！？][{_UNICODE_WS}]+"))
def split_sentence_spans(t: Tables) -> DataFrame:
    return _of_spans(t.documents.select("doc_id", "text"), "doc_id", lambda x: B.spans_by(B.SENTENCE, x, 1000))


@query(f"SELECT * EXCLUDE (chunk_index) FROM ({_spans_sql(r'\n[\x20\x09-\x0D]*\n|\n')})")
def split_paragraph_spans(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(C.spans_at(F.col("text"), r"\n[\x20\x09-\x0D]*\n|\n", 1000)).alias("s")).select("doc_id", "s.start", "s.end")


@query()
def chunk_recursive_md(t: Tables) -> DataFrame:
    return B.apply(pages_md(t), "page_id", ["md"], lambda x: B.recursive_pieces(x, overlap=200), CHUNKS).select("page_id", F.posexplode("value").alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("""SELECT doc_id, doc_id || '_segment_' || (i // 300) AS segment_id, CAST(i // 300 AS BIGINT) AS segment_index, CAST(ceil(length(text) / 300) AS BIGINT) AS total_segments, substr(text, i + 1, 300) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 300)) AS i FROM documents)""")
def segment_documents(t: Tables) -> DataFrame:
    return C.segments(t.documents.filter("text <> ''"), "doc_id", C.windows(F.col("text"), 300))


@query("""SELECT doc_id, doc_id || '_segment_' || k AS segment_id, CAST(k AS BIGINT) AS segment_index, CAST(least(4, ceil(length(text) / 300)) AS BIGINT) AS total_segments, substr(text, k * 300 + 1, 300) AS text
    FROM (SELECT doc_id, text, unnest(range(0, CAST(least(4, ceil(length(text) / 300)) AS BIGINT))) AS k FROM documents)""")
def segment_documents_capped(t: Tables) -> DataFrame:
    """At most four segments a document: the cap is the caller's."""
    return C.segments(t.documents.filter("text <> ''"), "doc_id", C.windows(F.col("text"), 300), 4)


@query(f"WITH {LINES} SELECT page_id, heading_no, line_no, level, title, heading_id FROM headings")
def md_structure(t: Tables) -> DataFrame:
    return M.headings(pages_md(t), "page_id", "md")


@query(f"WITH {LINES} SELECT page_id, heading_no, heading_id FROM headings")
def heading_slug(t: Tables) -> DataFrame:
    return M.headings(pages_md(t), "page_id", "md").select("page_id", "heading_no", "heading_id")


@query(f"WITH {LINES}, {SECTIONS} SELECT page_id, heading_no, level, title, breadcrumb, content FROM sections")
def md_sections(t: Tables) -> DataFrame:
    return M.sections(pages_md(t), "page_id", "md").drop("heading_id")


_TABLES = "(SELECT doc_id, string_agg(CASE WHEN contains(line, '|') THEN '| ' || line || ' |' ELSE line END, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id)"


def _tabular(t: Tables) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.contains(x, F.lit("|")), F.concat(F.lit("| "), x, F.lit(" |"))).otherwise(x))
    return t.documents.select("doc_id", F.array_join(lines, "\n").alias("text"))


@query(rf"""WITH rows AS (SELECT doc_id, line, i - 1 AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {_TABLES})),
    piped AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM rows WHERE regexp_matches(trim(line), '^\|.*\|$'))
    SELECT doc_id, CAST(min(line_no) AS BIGINT) AS start_line, CAST(max(line_no) AS BIGINT) AS end_line, count(*) AS n_rows FROM piped GROUP BY doc_id, run HAVING count(*) >= 2""")
def md_table_blocks(t: Tables) -> DataFrame:
    return M.table_blocks(_tabular(t), "doc_id", "text")


def _referring(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pages' markdown, each with a reference to its first heading's id, to its last heading's title, and to nothing."""
    md = pages_md(t)
    found = M.headings(md, "page_id", "md")
    ends = found.groupBy("page_id").agg(F.min_by("heading_id", "heading_no").alias("a"), F.max_by("title", "heading_no").alias("b"))
    made = md.join(ends, "page_id").select("page_id", F.concat("md", F.lit("\nsee [this](#"), "a", F.lit(") and [["), "b", F.lit("]] and [ref:nowhere]")).alias("md"))
    return made, found


_REFS = f"""WITH {LINES}, ends AS (SELECT page_id, arg_min(heading_id, heading_no) AS a, arg_max(title, heading_no) AS b FROM headings GROUP BY page_id),
    refs AS (SELECT page_id, unnest([CASE WHEN regexp_matches(a, '^[^)\\n]+$') THEN a END, CASE WHEN regexp_matches(b, '^[^\\]\\n]+$') THEN b END, 'nowhere']) AS target FROM ends),
    names AS (SELECT page_id, heading_no, heading_id, unnest(list_distinct([heading_id, title, lower(title)])) AS name FROM headings), last AS (SELECT page_id, name, arg_max(heading_id, heading_no) AS named FROM names GROUP BY ALL),
    resolved AS (SELECT r.page_id, r.target, coalesce(x.named, y.named) AS heading_id FROM refs r LEFT JOIN last x ON x.page_id = r.page_id AND x.name = r.target LEFT JOIN last y ON y.page_id = r.page_id AND y.name = lower(r.target) WHERE r.target IS NOT NULL)"""


@query(f"{_REFS} SELECT page_id, target, heading_id FROM resolved")
def resolve_references(t: Tables) -> DataFrame:
    made, found = _referring(t)
    return M.resolved_references(made, found, "page_id", "md")


@query(f"{_REFS} SELECT page_id, heading_id, count(*) AS n_in FROM resolved WHERE heading_id IS NOT NULL GROUP BY ALL")
def reference_counts(t: Tables) -> DataFrame:
    made, found = _referring(t)
    return M.resolved_references(made, found, "page_id", "md").filter("heading_id is not null").groupBy("page_id", "heading_id").agg(F.count("*").alias("n_in"))


@query(f"WITH {LINES}, {SECTIONS} SELECT page_id, count(*) AS n_chunks, CAST(sum(length(breadcrumb) + 2 + length(content)) AS BIGINT) AS chars FROM sections WHERE content <> '' GROUP BY page_id")
def pipeline_metadata(t: Tables) -> DataFrame:
    from docloom.plans.pipelines import Pipeline

    def to_markdown(df: DataFrame) -> DataFrame:
        return df.select("page_id", M.from_html(F.col("html")).alias("md"))

    def to_chunks(df: DataFrame) -> DataFrame:
        return M.section_chunks(df, "page_id", "md")

    return Pipeline([to_markdown, to_chunks])(t.pages).groupBy("page_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chars"))
