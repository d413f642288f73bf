"""Splits by structure and contexts of references, over pages as markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import markdown as M, structure as S, text as T
from docloom.operators import boundaries as B
from docloom.plans.chunk_queries import LINES, PAGES_MD, SECTIONS, STRIP, greedy_sql, overlap_sql, pages_md
from docloom.plans.registry import query
from docloom.tables import Tables

#: The size of a piece in these queries; pages are short.
SIZE = 300


def _mixed(t: Tables) -> DataFrame:
    """Each page's markdown, of whose lines six in turn stay, are code, items of a list, and rows of a table."""

    def line(x: Column, i: Column) -> Column:
        k = i % 24
        code = F.concat(F.when(k == 6, F.lit("```python\ndef a(x):\n    ")).when(k == 9, F.lit("class B:\n    ")).otherwise(F.lit("    ")), x, F.when(k == 11, F.lit("\n```")).otherwise(F.lit("")))
        item, row = F.concat(F.lit("- "), x, F.when(k == 14, F.lit("\n  and more\n")).otherwise(F.lit(""))), F.concat(F.lit("| "), F.replace(x, F.lit(". "), F.lit(" | ")), F.lit(" |"))
        return F.when(k < 6, x).when(k < 12, code).when(k < 18, item).otherwise(row)

    return pages_md(t).select("page_id", F.array_join(F.transform(F.split("md", "\n"), line), "\n").alias("md"))


_LINE = """CASE WHEN k < 6 THEN x WHEN k < 12 THEN CASE k WHEN 6 THEN '```python' || chr(10) || 'def a(x):' || chr(10) WHEN 9 THEN 'class B:' || chr(10) ELSE '' END || '    ' || x || CASE WHEN k = 11 THEN chr(10) || '```' ELSE '' END
    WHEN k < 18 THEN '- ' || x || CASE WHEN k = 14 THEN chr(10) || '  and more' || chr(10) ELSE '' END ELSE '| ' || replace(x, '. ', ' | ') || ' |' END"""
_MIXED = f"""{PAGES_MD}, mixed AS (SELECT page_id, string_agg({_LINE}, chr(10) ORDER BY i) AS md FROM (
    SELECT page_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i, (generate_subscripts(ls, 1) - 1) % 24 AS k FROM (SELECT page_id, string_split(md, chr(10)) AS ls FROM pages_md)) GROUP BY page_id)"""


def blocks_sql(source: str, key: str, text: str) -> str:
    """CTEs whose last, ``blk``, has key, block, kind, text."""
    own = f"OVER (PARTITION BY {key} ORDER BY line_no)"
    return rf"""ln AS (SELECT {key}, i - 1 AS line_no, CASE WHEN i < n THEN line || chr(10) ELSE line END AS line, line AS bare FROM (
            SELECT {key}, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM (SELECT {key}, string_split({text}, chr(10)) AS ls FROM {source})) WHERE i < n OR line <> ''),
        fe AS (SELECT *, CAST(starts_with(trim(bare), '```') AS INT) AS fence FROM ln),
        op AS (SELECT *, sum(fence) {own} AS opened, sum(fence) OVER (PARTITION BY {key}) AS fences FROM fe),
        co AS (SELECT *, CASE WHEN opened % 2 = 1 AND opened < fences THEN opened WHEN fence = 1 AND opened % 2 = 0 THEN opened - 1 END AS code FROM op),
        ow AS (SELECT *, CASE WHEN code IS NOT NULL THEN 'code' WHEN regexp_matches(bare, '^[\x20\x09]*(?:[*+-]|[0-9]+\.)[\x20\x09]+') THEN 'list' WHEN regexp_matches(bare, '^[\x20\x09]*\|.*\|[\x20\x09]*$') THEN 'table'
            WHEN regexp_matches(bare, '^[\x20\x09-\x0D]*$') THEN NULL WHEN regexp_matches(bare, '^[\x20\x09]+[^\x20\x09]') THEN 'in' ELSE 'text' END AS own FROM co),
        so AS (SELECT *, last_value(CASE WHEN own <> 'in' THEN own END IGNORE NULLS) {own} AS solid FROM ow),
        ki AS (SELECT *, coalesce(last_value(CASE WHEN own = 'in' THEN CASE WHEN solid = 'list' THEN 'list' ELSE 'text' END ELSE own END IGNORE NULLS) {own}, 'text') AS kind FROM so),
        fi AS (SELECT * REPLACE (CASE WHEN kind = 'code' THEN last_code END AS code) FROM (SELECT *, last_value(code IGNORE NULLS) {own} AS last_code FROM ki)),
        ne AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) {own} AND code IS NOT DISTINCT FROM lag(code) {own} THEN 0 ELSE 1 END AS new FROM fi),
        nu AS (SELECT *, CAST(sum(new) {own} - 1 AS BIGINT) AS block FROM ne),
        blk AS MATERIALIZED (SELECT {key}, block, kind, string_agg(line, '' ORDER BY line_no) AS text FROM nu GROUP BY {key}, block, kind)"""


def pieces_sql(key: str, size: int) -> str:
    """CTEs after ``blocks_sql`` whose last, ``pie``, has key, block, kind, head, part, text."""
    cut = lambda x, pattern, new: f"string_split(regexp_replace({x}, '{pattern}', {new}, 'g'), chr(1))"
    lines = cut("%s", r"(\n)", r"'\1' || chr(1)")
    definition = r"(?m)^([\x20\x09]*(?:def|function|func|fn|public|private|protected|class|module|interface)[\x20\x09]+)"
    item = r"(?m)(^[\x20\x09]*(?:[*+-]|[0-9]+\.)[\x20\x09]+)"
    step = lambda name, source, n, parts: f"{name} AS (SELECT * EXCLUDE (ls), unnest(ls) AS x, generate_subscripts(ls, 1) AS {n} FROM (SELECT * EXCLUDE (x), {parts} AS ls FROM {source})), {name}x AS (SELECT * FROM {name} WHERE x <> '')"
    first = f"CASE kind WHEN 'code' THEN {cut('x', definition, 'chr(1) || ' + chr(39) + chr(92) + '1' + chr(39))} WHEN 'list' THEN {cut('x', item, 'chr(1) || ' + chr(39) + chr(92) + '1' + chr(39))} WHEN 'table' THEN {lines % 'x'} ELSE {cut('x', r'(\n[\x20\x09-\x0D]*\n)', chr(39) + chr(92) + '1' + chr(39) + ' || chr(1)')} END"
    second = rf"CASE WHEN length(x) <= {size} OR kind = 'table' THEN [x] WHEN kind IN ('code', 'list') THEN {lines % 'x'} ELSE string_split(regexp_replace(x, '([.!?。！？；;][\x20\x09-\x0D]*|\n)', '\1' || chr(1), 'g'), chr(1)) END"
    third = f"CASE WHEN length(x) <= {size} OR kind IN ('code', 'table') THEN [x] ELSE list_transform(range(0, length(x), {size}), lambda j: substr(x, j + 1, {size})) END"
    return f"""big AS (SELECT {key}, block, kind, text AS x FROM blk WHERE length(text) > {size}), {step('p1', 'big', 'a', first)}, {step('p2', 'p1x', 'b', second)}, {step('p3', 'p2x', 'c', third)},
        {greedy_sql('pk', f'SELECT {key}, block, x, row_number() OVER (PARTITION BY {key}, block ORDER BY a, b, c) AS i FROM p3x', f'{key}, block', size, 0)},
        pie AS (SELECT b.{key}, b.block, b.kind, regexp_extract(b.text, '^([^\\n]*\\n)', 1) AS head, coalesce(k.g, 0) AS part, coalesce(array_to_string(k.xs, ''), b.text) AS text FROM blk b LEFT JOIN pk k ON k.{key} = b.{key} AND k.block = b.block)"""


@query(f"""WITH RECURSIVE {_MIXED}, {blocks_sql('mixed', 'page_id', 'md')}, {pieces_sql('page_id', SIZE)}
    SELECT page_id, row_number() OVER own - 1 AS piece, kind, block, CAST(sum(length(text)) OVER own AS BIGINT) - length(text) AS start, CAST(sum(length(text)) OVER own AS BIGINT) AS end, text,
        CASE WHEN part > 0 AND kind = 'code' THEN head ELSE '' END AS lead FROM pie WINDOW own AS (PARTITION BY page_id ORDER BY block, part)""")
def chunk_structure_split(t: Tables) -> DataFrame:
    return S.structure_split(_mixed(t), "page_id", "md", SIZE)


def _citing(t: Tables) -> DataFrame:
    """Pages' markdown with a reference to the first heading's id and the last heading's title in every section."""
    titles = F.transform(F.regexp_extract_all("md", F.lit(r"(?m)^#{1,6}[\x20\x09]+([^\n]+)$"), 1), T.strip)  # pages have no fences
    md = pages_md(t).withColumn("titles", titles).filter(F.size("titles") > 0)
    named = F.concat(F.lit("see [this](#"), M.slug(F.get("titles", F.lit(0))), F.lit(") and [["), F.element_at("titles", -1), F.lit("]]."))
    return md.select("page_id", F.replace(F.regexp_replace("md", r"(?m)^(#{1,6}[\x20\x09]+[^\n]+)$", "$1\n\x02"), F.lit("\x02"), named).alias("md"))


_REFS = r"""ends AS (SELECT page_id, arg_min(heading_id, heading_no) AS a, arg_max(title, heading_no) AS b FROM headings GROUP BY page_id),
    refs AS (SELECT page_id, unnest([CASE WHEN regexp_matches(a, '^[^)\n]+$') THEN a END, CASE WHEN regexp_matches(b, '^[^\]\n]+$') THEN b END]) AS target FROM ends),
    names AS (SELECT page_id, heading_no, unnest(list_distinct([heading_id, title, lower(title)])) AS name FROM headings), last AS (SELECT page_id, name, max(heading_no) AS named FROM names GROUP BY ALL),
    cites AS (SELECT h.page_id, h.heading_no AS citing, coalesce(x.named, y.named) AS cited FROM headings h JOIN refs r ON r.page_id = h.page_id
        LEFT JOIN last x ON x.page_id = r.page_id AND x.name = r.target LEFT JOIN last y ON y.page_id = r.page_id AND y.name = lower(r.target) WHERE r.target IS NOT NULL),
    edges AS (SELECT * FROM cites WHERE cited IS NOT NULL), important AS (SELECT page_id, cited FROM edges GROUP BY ALL HAVING count(*) >= 2),
    contexts AS (SELECT e.page_id, citing AS heading_no, string_agg(chr(10) || chr(10) || '引用上下文: ' || h.title || ' (级别: ' || h.level || ')', '' ORDER BY cited) AS context
        FROM (SELECT DISTINCT page_id, citing, cited FROM edges JOIN important USING (page_id, cited)) e JOIN headings h ON h.page_id = e.page_id AND h.heading_no = e.cited GROUP BY ALL)"""


@query(f"WITH {LINES}, {_REFS} SELECT * FROM contexts")
def reference_context(t: Tables) -> DataFrame:
    return S.reference_contexts(S.reference_edges(_citing(t), "page_id", "md"), "page_id")


_TITLES = r"list_transform(regexp_extract_all(md, '(?m)^#{1,6}[\x20\x09]+([^\n]+)$', 1), lambda x: " + STRIP % "x" + ")"
_SLUG_OF = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(titles[1], '<[^>]*>', '', 'g')), '[^a-z0-9一-龥]+', '-', 'g'), '^-+', ''), '-+$', '')"
_CITING = rf"""pages_md AS (SELECT page_id, replace(regexp_replace(md, '(?m)^(#{{1,6}}[\x20\x09]+[^\n]+)$', '\1' || chr(10) || chr(2), 'g'), chr(2), 'see [this](#' || {_SLUG_OF} || ') and [[' || titles[-1] || ']].') AS md
    FROM (SELECT page_id, md, {_TITLES} AS titles FROM plain_md) WHERE len(titles) > 0)"""
_SECTION_ROWS = f"""sums AS (SELECT s.page_id, s.heading_no, s.page_id * 100000 + s.heading_no AS sec, breadcrumb || chr(10) || chr(10) AS head, content, coalesce(context, '') AS context,
        coalesce((SELECT count(*) FROM edges e WHERE e.page_id = s.page_id AND e.cited = s.heading_no), 0) AS n_in, coalesce((SELECT count(*) FROM edges e WHERE e.page_id = s.page_id AND e.citing = s.heading_no), 0) AS n_out,
        EXISTS (SELECT 1 FROM headings a JOIN edges e ON e.page_id = a.page_id AND e.cited = a.heading_no WHERE a.page_id = s.page_id AND (a.heading_no = s.heading_no OR a.heading_no < s.heading_no AND a.level < s.level
            AND NOT EXISTS (SELECT 1 FROM headings b WHERE b.page_id = a.page_id AND b.heading_no > a.heading_no AND b.heading_no < s.heading_no AND b.level <= a.level))) AS under
        FROM sections s LEFT JOIN contexts c ON c.page_id = s.page_id AND c.heading_no = s.heading_no WHERE content <> ''),
    marked AS MATERIALIZED (SELECT *, CASE WHEN under OR n_out > 0 THEN array_to_string(list_filter([CASE WHEN under THEN '[被引用次数: ' || n_in || ']' END, CASE WHEN n_out > 0 THEN '[外部引用数: ' || n_out || ']' END], lambda x: x IS NOT NULL), ' ') || chr(10) ELSE '' END AS meta FROM sums),
    long AS (SELECT * FROM marked WHERE length(head) + length(meta) + length(content) > {SIZE})"""


def _full_sql() -> str:
    lines = LINES.replace("pages_md AS (", "plain_md AS (", 1).replace("FROM pages), raw AS", f"FROM pages), {_CITING}, raw AS", 1)
    return f"""WITH RECURSIVE {lines}, {SECTIONS}, {_REFS}, {_SECTION_ROWS}, {blocks_sql('long', 'sec', 'content')}, {pieces_sql('sec', SIZE)},
        befores AS (SELECT *, CASE WHEN part > 0 AND kind = 'text' THEN lag(text) OVER (PARTITION BY sec ORDER BY block, part) ELSE '' END AS before FROM pie),
        every AS (SELECT page_id, heading_no, 0 AS block, 0 AS part, 'section' AS kind, head || meta || content || context AS text FROM marked WHERE sec NOT IN (SELECT sec FROM long)
            UNION ALL SELECT l.page_id, l.heading_no, p.block, p.part, p.kind, l.head || CASE WHEN p.block = 0 AND p.part = 0 THEN l.meta ELSE '' END
                || CASE WHEN p.before <> '' THEN {overlap_sql('p.before', 50)} || chr(10) || chr(10) ELSE '' END || p.text || l.context FROM befores p JOIN long l USING (sec))
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY heading_no, block, part) - 1 AS chunk_index, heading_no, kind, text FROM every"""


@query(_full_sql())
def chunk_markdown_full(t: Tables) -> DataFrame:
    return S.markdown_chunks(_citing(t), "page_id", "md", SIZE, 50)


def _ends_sql() -> str:
    """CTEs whose last, ``ends``, has page_id, e: where matches of the patterns end, and the text does."""
    parts = []
    for n, pattern in enumerate(B.SPLITS):
        cut = f"string_split(regexp_replace(md, '({pattern})', '\\1' || chr(1), 'g'), chr(1))"
        parts.append(f"SELECT page_id, CAST(sum(length(x)) OVER (PARTITION BY page_id ORDER BY i) AS BIGINT) AS e, i < n AS inner_end FROM (SELECT page_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM (SELECT page_id, {cut} AS ls FROM mixed))")
    return f"ends AS (SELECT DISTINCT page_id, e FROM ({' UNION ALL '.join(parts)}) WHERE inner_end AND e > 0 UNION SELECT page_id, length(md) FROM mixed WHERE md <> '')"


@query(f"""WITH RECURSIVE {_MIXED}, {_ends_sql()}, cuts AS (SELECT page_id, e, coalesce(lag(e) OVER (PARTITION BY page_id ORDER BY e), 0) AS s, row_number() OVER (PARTITION BY page_id ORDER BY e) AS i FROM ends),
    {greedy_sql('g', 'SELECT c.page_id, substr(md, s + 1, e - s) AS x, i FROM cuts c JOIN mixed USING (page_id)', 'page_id', 1000, 0)}
    SELECT page_id, CAST(g AS BIGINT) AS chunk_index, CAST(sum(n) OVER own - n AS BIGINT) AS start, CAST(sum(n) OVER own AS BIGINT) AS end FROM (SELECT page_id, g, length(array_to_string(xs, '')) AS n FROM g) WINDOW own AS (PARTITION BY page_id ORDER BY g)""")
def split_semantic_spans(t: Tables) -> DataFrame:
    made = B.apply(_mixed(t), "page_id", ["md"], lambda x: [{"start": a, "end": b} for a, b in B.semantic_spans(x)], "array<struct<start:long,end:long>>")
    return made.select("page_id", F.posexplode("value").alias("chunk_index", "s")).select("page_id", F.col("chunk_index").cast("long").alias("chunk_index"), "s.start", "s.end")


@query()
def chunk_enhanced_context(t: Tables) -> DataFrame:
    """Enhanced chunks with the heading that they stand under, the boundaries that they have passed, and the first characters of the next chunk."""
    return B.enhanced(_mixed(t), "page_id", "md", 50, size=400, least=100, most=800)


@query(f"""WITH {_MIXED}, {blocks_sql('mixed', 'page_id', 'md')} SELECT page_id, block, kind, CASE WHEN kind = 'code' THEN regexp_extract(text, '^ *```([0-9A-Za-z_]*)', 1) END AS language,
    CAST(sum(length(text)) OVER own - length(text) AS BIGINT) AS start, CAST(sum(length(text)) OVER own AS BIGINT) AS end, CAST(sum(n) OVER own - n AS BIGINT) AS start_line, CAST(n AS BIGINT) AS n_lines
    FROM (SELECT *, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS n FROM blk) WINDOW own AS (PARTITION BY page_id ORDER BY block)""")
def md_blocks(t: Tables) -> DataFrame:
    """Code (with its language), lists and tables of a text, and what lies between, by their places and lines."""
    return S.blocks(_mixed(t), "page_id", "md")


_IMAGES = "regexp_replace(html, '(?is)<img[^>]*>|<h1[^>]*>(.*?)</h1>', '![\\1](/' || page_id || '.png) ', 'g')"


@query(f"""SELECT page_id, CAST(unnest(range(len(alts))) AS BIGINT) AS image_no, unnest(alts) AS alt, unnest(paths) AS path FROM (
    SELECT page_id, regexp_extract_all(md, '!\\[([^\\]\\n]*)\\]\\(([^)\\n]*)\\)', 1) AS alts, regexp_extract_all(md, '!\\[([^\\]\\n]*)\\]\\(([^)\\n]*)\\)', 2) AS paths FROM (SELECT page_id, {_IMAGES} AS md FROM pages))""")
def md_images(t: Tables) -> DataFrame:
    """Images of a markdown text, here put in for the pages' first headings."""
    md = F.regexp_replace("html", F.lit("(?is)<img[^>]*>|<h1[^>]*>(.*?)</h1>"), F.concat(F.lit("![$1](/"), F.col("page_id").cast("string"), F.lit(".png) ")))
    return t.pages.select("page_id", F.posexplode(M.images(md)).alias("image_no", "x")).select("page_id", F.col("image_no").cast("long").alias("image_no"), "x.*")
