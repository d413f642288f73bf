"""Markdown structure: headings, sections, blocks and references, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import slug, strip

HEADING = r"^(#{1,6})[\x20\x09]+(.+)$"


def from_html(html: Column) -> Column:
    """Markdown of simple HTML: headings become # lines, paragraph and line ends new lines, other tags go."""
    out = html
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + r" $1" + "\n")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)</p>|<br[^>]*>", "\n"), "<[^>]*>", "")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line, in_code (between fences, the fences with it), level and title of headings, heading_no (0 before the first)."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.startswith(F.trim("line"), F.lit("```"))
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(order)).withColumn("in_code", fence | (F.col("fences") % 2 == 1))
    heading = ~F.col("in_code") & F.col("line").rlike(HEADING)
    rows = rows.withColumns(
        {
            "level": F.when(heading, F.length(F.regexp_extract("line", HEADING, 1)).cast("long")),
            "title": F.when(heading, strip(F.regexp_extract("line", HEADING, 2))),
        }
    )
    return rows.drop("fences").withColumn("heading_no", F.sum(F.col("level").isNotNull().cast("int")).over(order).cast("long"))


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, heading_no (from 1), line_no, level, title, heading_id."""
    return lines(docs, key, text).filter("level is not null").select(key, "heading_no", F.col("line_no").cast("long").alias("line_no"), "level", "title", slug(F.col("title")).alias("heading_id"))


def breadcrumbs(found: DataFrame, key: str) -> DataFrame:
    """``found`` with breadcrumb: titles of the enclosing headings and its own, outermost first.

    Walking back from a heading, each heading of a lower level than all seen so far encloses it.
    """
    before = Window.partitionBy(key).orderBy("heading_no").rowsBetween(Window.unboundedPreceding, -1)
    out = found
    for level in range(1, 6):
        # the last heading of this level, unless one of a lower level came after it
        last = F.max(F.when(F.col("level") == level, F.struct("heading_no", "title"))).over(before)
        lower = F.max(F.when(F.col("level") < level, F.col("heading_no"))).over(before)
        out = out.withColumn(f"_at{level}", F.when((F.col("level") > level) & (last["heading_no"] > F.coalesce(lower, F.lit(-1))), last["title"]))
    crumb = F.concat_ws(" > ", *(f"_at{level}" for level in range(1, 6)), "title")
    return out.withColumn("breadcrumb", crumb).drop(*(f"_at{level}" for level in range(1, 6)))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sections: key, heading_no, level, title, breadcrumb, content (lines outside fences after the heading, from the first non-blank one)."""
    rows = lines(docs, key, text)
    body = rows.filter("level is null and not in_code and heading_no > 0").groupBy(key, "heading_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("own"))
    content = F.array_join(F.transform("own", lambda x: x["line"]), "\n")
    found = breadcrumbs(headings(docs, key, text), key).join(body, [key, "heading_no"], "left")
    return found.select(key, "heading_no", "level", "title", "heading_id", "breadcrumb", strip(F.coalesce(content, F.lit(""))).alias("content"))


def section_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_index, text: each section with content, its breadcrumb before it."""
    kept = sections(docs, key, text).filter("content <> ''")
    order = Window.partitionBy(key).orderBy("heading_no")
    return kept.select(key, (F.row_number().over(order) - 1).cast("long").alias("chunk_index"), F.concat("breadcrumb", F.lit("\n\n"), "content").alias("text"))


def table_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_line, end_line, n_rows: runs of two or more lines that begin and end with a pipe."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.filter(F.trim("line").rlike(r"^\|.*\|$"))
    run = F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    grouped = rows.withColumn("run", run).groupBy(key, "run").agg(F.min("line_no").cast("long").alias("start_line"), F.max("line_no").cast("long").alias("end_line"), F.count("*").alias("n_rows"))
    return grouped.filter("n_rows >= 2").drop("run")


def reference_targets(text: Column) -> Column:
    """Targets of [text](#id), [ref:x], [[x]] and 「参见：x」."""
    patterns = (r"\[[^\]\n]+\]\(#([^)\n]+)\)", r"\[ref:([^\]\n]+)\]", r"\[\[([^\]\n]+)\]\]", r"「参见：([^」\n]+)」")
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in patterns))


def resolved_references(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """key, target, heading_id: each reference with the heading it names, by id, title, lower-case title or slug; null where none does.

    Of headings with one name the last wins.
    """
    refs = docs.select(key, F.explode(reference_targets(F.col(text))).alias("target"))
    names = found.select(key, "heading_no", "heading_id", F.explode(F.array_distinct(F.array("heading_id", "title", F.lower("title")))).alias("name"))
    last = names.groupBy(key, "name").agg(F.max_by("heading_id", "heading_no").alias("named"))
    exact = refs.join(last.withColumnRenamed("name", "target"), [key, "target"], "left").withColumnRenamed("named", "by_name")
    lowered = exact.withColumn("low", F.lower("target")).join(last.select(key, F.col("name").alias("low"), F.col("named").alias("by_low")), [key, "low"], "left")
    return lowered.select(key, "target", F.coalesce("by_name", "by_low").alias("heading_id"))


def images(text: Column) -> Column:
    """Images as structs of alt and path, in their order."""
    pattern = F.lit(r"!\[([^\]\n]*)\]\(([^)\n]*)\)")
    return F.zip_with(F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2), lambda a, b: F.struct(a.alias("alt"), b.alias("path")))
