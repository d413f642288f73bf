"""URL filter: allow and block rules, then segmented host words and path tokens under naive Bayes.

A rule is a host, a slash and the beginning of a path; it fits its host and all
subdomains, where the url's path starts with the rule's.  The longest rule wins.

Where no rule fits, host labels are cut into words by the most probable
segmentation (Viterbi under unigram counts of the corpus' own words), and a
multinomial naive Bayes model, trained on all urls that a rule decides, scores
the host's words and the path's tokens.  Counts stay in DataFrames: a label is
joined with the counts of its own substrings, so no dictionary is broadcast.

A null url, or one without ``://``, has empty host and path; no rule fits it and
it has no tokens, so the classes' shares decide; a tie is ``allow``.  Repeated
rows get the same verdict each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut as checkpointed
from docloom.llm.common import hot_keys, salted_join

#: Letters of a label up to which its substrings are made at once: no name is longer, under the rules for host names; longer labels go place by place.
NAME = 255
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, rule) that fits, and its verdict; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, begin = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + begin))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def visible(html: str) -> Column:
    """The text of a whole page, title included: without scripts, styles, comments, tags and entities."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """word, n over all rows: runs of a-z in the lower-cased text."""
    words = texts.select(F.explode(F.split(F.lower(column), "[^a-z]+")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def best_words(label: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The segmentation of least cost; a piece of k letters that isn't known costs ``unknown`` and ln 10 for each letter. Ties: the longest last word."""
    per, sizes = math.log(10), sorted({len(w) for w in cost}, reverse=True)
    best = [(0.0, 0)]
    low, low_at = 0.0, 0  # of the places so far: the least cost without what its letters would cost, and where
    for end in range(1, len(label) + 1):
        found, at = low + unknown + per * end, low_at
        for size in sizes:
            if size <= end and (own := cost.get(label[end - size : end])) is not None:
                known = best[end - size][0] + own
                if known < found - 1e-9 or known < found + 1e-9 and end - size < at:
                    found, at = known, end - size
        best.append((found, at))
        if found - per * end < low - 1e-9:
            low, low_at = found - per * end, end
    words, end = [], len(label)
    while end:
        start = best[end][1]
        words.append(label[start:end])
        end = start
    return words[::-1]


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words: the distinct ``labels.label`` (a-z) segmented under ``counts`` (word, n)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    labels = labels.filter("label <> ''").withColumn("size", F.length("label"))
    longest = labels.agg(F.max("size").alias("size")).first().size or 0
    # as many numbers as the longest label has letters, at most
    lengths = sorted(r.k for r in counts.select(F.length("word").alias("k")).filter(F.col("k") <= longest).distinct().collect())
    some = F.array(*map(F.lit, lengths)).cast("array<int>")
    fitting = lambda start: F.filter(some, lambda k: k <= F.col("size") - start + 1)
    at = lambda start: F.transform(fitting(start), lambda k: F.substring(F.col("label"), start, k))
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size")), at)))
    whole = labels.filter(F.col("size") <= NAME).select("label", F.explode(pieces).alias("word"))
    places = labels.filter(F.col("size") > NAME).select("label", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("start"))
    placed = places.select("label", F.explode(at(F.col("start"))).alias("word")).distinct()
    # a label without any piece of a word's length still has a row
    cut = whole.unionByName(placed).unionByName(labels.select("label", F.lit("").alias("word")))
    # some words are in very many labels
    hot = hot_keys(cut.groupBy("word").agg(F.count("*").alias("n")), "word")
    known = salted_join(cut, counts, hot, ["word"], ["label"], "left").groupBy("label").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))
    known = known.crossJoin(F.broadcast(total))  # one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, own, n in zip(*(batch.column(c).to_pylist() for c in ("label", "known", "total"))):
                log_n = math.log(max(n, 1))
                out.append(best_words(label, {k["word"]: log_n - math.log(k["n"]) for k in own}, log_n))
            yield pa.record_batch([batch.column("label"), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    return known.mapInArrow(run, "label string, words array<string>")


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """part, token: each ``hosts.part`` with the words of its runs of a-z, and its runs of other letters and digits; numbers are one token."""
    labels = hosts.select("part", F.explode(F.filter(F.split("part", "[^a-z]+"), lambda x: x != "")).alias("label"))
    words = segmented(labels.select("label").distinct(), counts)
    hot = hot_keys(labels.groupBy("label").agg(F.count("*").alias("n")), "label")
    named = salted_join(labels, words, hot, ["label"], ["part"]).select("part", F.explode("words").alias("word"))
    others = hosts.select("part", F.explode(F.filter(F.split("part", r"[^\p{L}\p{N}&&[^a-z]]+"), lambda x: x != "")).alias("word"))
    others = others.select("part", F.when(F.col("word").rlike("^[0-9]+$"), F.lit("#")).otherwise(F.col("word")).alias("word"))
    return named.unionByName(others).select("part", F.concat(F.lit("h:"), "word").alias("token"))


def path_tokens(paths: DataFrame) -> DataFrame:
    """part, token: each ``paths.part`` with its runs of letters and digits; numbers are one token."""
    split = F.filter(F.split(F.lower("part"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    tokens = F.transform(split, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x))
    return paths.select("part", F.explode(tokens).alias("word")).select("part", F.concat(F.lit("p:"), "word").alias("token"))


def naive_bayes(tokens: DataFrame) -> DataFrame:
    """kind, part, odds: the sum over a part's tokens of their log odds of block against allow.

    ``tokens``: kind, part, token, and block and allow, how many decided urls have the part.
    """
    every = tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("n"))
    model = every.filter("block + allow > 0")
    sizes = model.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("all_block"), F.coalesce(F.sum("allow"), F.lit(0)).alias("all_allow"), F.count("*").alias("kinds"))
    odds = lambda b, a: F.log((b + 1) / (F.col("all_block") + F.col("kinds") + 1)) - F.log((a + 1) / (F.col("all_allow") + F.col("kinds") + 1))
    weights = model.crossJoin(F.broadcast(sizes)).select("token", odds(F.col("block"), F.col("allow")).alias("weight"))  # sizes: one row
    unseen = sizes.select(odds(F.lit(0), F.lit(0)).alias("unseen"))
    both = salted_join(tokens, weights, hot_keys(every, "token"), ["token"], ["kind", "part"], "left").crossJoin(F.broadcast(unseen))  # one row
    return both.groupBy("kind", "part").agg(F.sum(F.coalesce("weight", "unseen")).alias("odds"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], texts: DataFrame, text: str, key: str = "page_id", url: str = "url") -> DataFrame:
    """For each row of ``pages``: page_id, host, path, rule, verdict, score (log odds of block; null where a rule decides).

    ``texts.text`` gives the words for the segmentation.
    """
    host, path = parts(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decided = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decided": decided})
    # rows of equal host or path are one part, with the numbers of its decided rows
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("part")) for c in ("host", "path")))).alias("p")
    every = checkpointed(rows.select(named, "decided").groupBy("p.kind", "p.part").agg(F.count_if(F.col("decided") == "block").alias("block"), F.count_if(F.col("decided") == "allow").alias("allow"), F.count("*").alias("n")))
    hosts, paths = every.filter("kind = 'host'"), every.filter("kind = 'path'")
    found = host_tokens(hosts, checkpointed(word_counts(texts, text))).withColumn("kind", F.lit("host")).unionByName(path_tokens(paths).withColumn("kind", F.lit("path")))
    scores = naive_bayes(checkpointed(found.join(every.drop("n"), ["kind", "part"])))
    prior = rows.agg(F.log((F.count_if(F.col("decided") == "block") + 1) / (F.count_if(F.col("decided") == "allow") + 1)).alias("prior"))
    scored = rows
    for c in ("host", "path"):
        hot = hot_keys(every.filter(F.col("kind") == c).select(F.col("part").alias(c), "n"), c)  # a host or path of very many pages
        scored = salted_join(scored, scores.filter(F.col("kind") == c).select(F.col("part").alias(c), F.col("odds").alias(f"{c}_odds")), hot, [c], ["page_id", "host", "path"], "left")
    zero = F.lit(0.0)
    score = F.round(F.col("prior") + F.coalesce("host_odds", zero) + F.coalesce("path_odds", zero), 9)
    out = scored.crossJoin(F.broadcast(prior)).withColumn("score", F.when(F.col("rule").isNull(), score))
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
