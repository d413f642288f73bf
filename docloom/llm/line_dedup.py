"""Removal of lines that are spread over many sites, with DataFrame functions only.

For each line hash an HyperLogLog sketch of its sites is aggregated (each task
sends one sketch a line).  An estimate clearly under or over the threshold
decides; lines near it get an exact count of distinct sites, from the occurrences
of candidates that are looked up once.  Spread lines are then taken out of every
document.  The occurrences of very common lines are dealt out by a salt.

Lines are compared without white space at their ends; blank lines are never removed.
Short lines, under ``SHORT`` characters, may well be written at several sites
independently, so they are boilerplate at twice as many sites.  Null text has no
lines and stays null; a null site counts as one site of its own; rows that repeat are
treated alike, each.  An empty table gives no rows, further columns are kept, whatever
their names (but ``n_lines`` and ``n_removed`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, hot_keys, salted_join

#: Share of the threshold on either side within which the exact count decides: over ten times the sketch's error.
BAND = 0.25
LG_K = 12
#: Characters under which a line is short, and how many times as many sites it must be on.
SHORT, SHORT_SITES = 20, 2
BLANK = " \t\n\v\f\r"


def _hash(line: Column) -> list[Column]:
    """128 bits, so that lines of one hash are one line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), F.reverse(line)).alias("h2")]


def line_hashes(docs: DataFrame, text: str, site: str, *keep: str) -> DataFrame:
    """``keep``, site, line_no, h1, h2, short of every line that isn't blank."""
    lines = docs.select(*keep, F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANK))).filter("line <> ''")
    return lines.select(*keep, "site", "line_no", *_hash(F.col("line")), (F.length("line") < SHORT).alias("short"))


def _candidates(lines: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2, need (sites that make it boilerplate), sure, n (occurrences) of the lines whose estimate isn't clearly under what they need; ``sure``: it is clearly over it."""
    sketched = lines.groupBy("h1", "h2", "short").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count("*").alias("n"))
    need = sketched.withColumn("need", F.when(F.col("short"), SHORT_SITES * min_sites).otherwise(min_sites).cast("long"))
    return need.filter(F.col("sites") > F.col("need") * (1 - BAND)).select("h1", "h2", "need", (F.col("sites") >= F.col("need") * (1 + BAND)).alias("sure"), "n")


def _hits(lines: DataFrame, min_sites: int, *row: str) -> DataFrame:
    """Occurrences (the columns ``row``, line_no, h1, h2) of the lines spread over ``min_sites`` sites or more, short ones over more."""
    found = cut(_candidates(lines, min_sites))
    near = cut(salted_join(lines.drop("short"), found.select("h1", "h2", "need", "sure"), hot_keys(found, "h1", "h2"), ["h1", "h2"], [*row, "line_no"]))
    counted = near.filter("not sure").select("h1", "h2", "need", "site").distinct().groupBy("h1", "h2", "need").agg(F.count("*").alias("sites")).filter(F.col("sites") >= F.col("need"))
    unsure = found.filter("not sure").select("h1", "h2", "n")
    exact = salted_join(near.filter("not sure"), counted.select("h1", "h2"), hot_keys(unsure, "h1", "h2"), ["h1", "h2"], [*row, "line_no"], "left_semi")
    return near.filter("sure").unionByName(exact).select(*row, "line_no", "h1", "h2")


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names that ``docs`` hasn't."""
    taken = {c.lower() for c in docs.columns}
    return [next(c for c in (f"{name}{'_' * k}" for k in range(len(taken) + 1)) if c not in taken) for name in names]


def spread_lines(docs: DataFrame, min_sites: int, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """h1, h2 of the lines that occur at ``min_sites`` distinct sites or more, short ones at ``SHORT_SITES`` times as many."""
    lines = line_hashes(docs.select(docs[key].alias("_key"), docs[text], docs[site]), text, site, "_key")
    return _hits(lines, min_sites, "_key").select("h1", "h2").distinct()


def remove_spread_lines(docs: DataFrame, min_sites: int, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with spread lines removed from ``text``, and n_lines, n_removed (names that are taken are replaced)."""
    given = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # rows that share a key are told apart by 128 bits of key, text and site
    row1, row2, gone = _free(docs, "_row1", "_row2", "_gone")
    hashes = {row1: F.xxhash64(key, text, site), row2: F.xxhash64(F.lit(11), site, text, key)}
    lines = line_hashes(docs.select(*(c.alias(n) for n, c in hashes.items()), F.col(text), F.col(site)), text, site, row1, row2)
    hits = _hits(lines, min_sites, row1, row2).groupBy(row1, row2).agg(F.collect_set("line_no").alias(gone))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")
    removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    out = docs.select(*given).withColumns(hashes).join(hits, [row1, row2], "left")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    return out.select(*[F.when(F.col(gone).isNull(), F.col(text)).otherwise(left).alias(text) if c == text else c for c in given], n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
