"""Quality rules with a ledger of bits: every rule is evaluated once, policies and ablations read the bits.

``ledger`` measures each text and stores, beside the measurements, one whole
number with a bit for each rule that the text fails.  A policy is a versioned list
of rules; its verdict is one AND of two numbers, so that a new version needs no
text again.  ``ablations`` sums the documents of each distinct number first (there
are no more of them than combinations of failures that occur) and then tells by
bitwise aggregation what every rule of a policy rejects, and what it alone
rejects, which comes back when the rule is dropped.

Measurements are Column functions, apart from repeated windows: those are found
in Arrow batches of about ``BATCH`` bytes.  Words get numbers there, numbers of
pairs, of fours and of eights follow by doubling, and equal eights are equal
windows, without hashes.  A very long text is split into words by slices, so that
it takes some 60 bytes a word and no list of its words.

Null text has no words; it and the empty text fail the first rule.  Every row is
judged by itself, also rows that repeat and rows without a doc_id.  An empty table
gives no rows.  ``key`` goes along; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from docloom.llm.common import bounded, utf8

#: Characters that part words, characters that count as symbols, words in a window.
BLANK, SYMBOLS, WINDOW = " \t\n\v\f\r", "#*$%&|<>", 8
#: Bytes of text that are looked at together, and of one slice of a long text.
BATCH, SLICE = 4 << 20, 1 << 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    """``fails`` is an SQL condition on the measurements.  A rule's place in its list is its bit, so lists only grow."""

    name: str
    fails: str


class Policy(NamedTuple):
    version: int
    rules: tuple[str, ...]


#: The first two rules.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("odd_word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
)
POLICIES = {
    p.version: p
    for p in (Policy(1, ("few_words", "repeated_words")), Policy(2, ("few_words", "repeated_words", "odd_word_length", "many_symbols")), Policy(3, tuple(r.name for r in RULES)))
}


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + SLICE, n)
        if end < n:  # a slice ends at a blank
            found = re.compile(rb"[\x20\x09-\x0D]").search(text, end)
            end = found.end() if found else n
        yield text[start:end].split()  # of bytes, this parts at the characters of BLANK and no others
        start = end


def repeated_words(texts: Sequence[bytes], window: int = WINDOW) -> np.ndarray:
    """For each text the number of its words that lie in windows found twice or more in it; ``window`` is a power of two."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, sizes = [np.empty(0, np.int64)], []
    for text in texts:
        size = 0
        for words in words_of(text):
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            size += len(words)
        sizes.append(size)
    ids, ends = np.concatenate(parts), np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if len(ids) < window:
        return np.zeros(len(sizes), np.int64)
    step = 1
    while step < window:  # windows over the end of a text get numbers too, and are left out below
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    starts = np.flatnonzero(np.arange(len(ids)) + window <= ends[owner[: len(ids)]])
    at, which = np.unique(ids[starts] * len(sizes) + owner[starts], return_inverse=True, return_counts=True)[1:]
    again = starts[which[at] > 1]
    change = np.zeros(len(owner) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    return np.bincount(owner[np.cumsum(change[:-1]) > 0], minlength=len(sizes)).astype(np.int64)


def _batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for x in texts:
        if part and size + len(x) > BATCH:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


@F.arrow_udf(LongType())
def _repeat_words(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        found = [repeated_words(part) for part in _batches(utf8(column))]
        yield pa.array(np.concatenate(found) if found else np.empty(0, np.int64))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the columns ``MEASURES``, all long."""
    rows = bounded(docs).select(docs[key], F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"))
    body, bare = F.col("_text"), F.translate("_text", BLANK, "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, BLANK, "") != "")
    return rows.select(
        key,
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(body).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the measurements and ``failed``: bit i is set where rule i fails."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules at most")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, key, text).withColumn("failed", bits)


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits of the rules of these names; an unknown name is an error."""
    places = {rule.name: i for i, rule in enumerate(rules)}
    if unknown := [n for n in names if n not in places]:
        raise ValueError(f"there are no rules {unknown}")
    return sum(1 << places[n] for n in set(names))


def verdict(held: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES, name: str = "kept") -> DataFrame:
    """``held`` (a ledger) with ``name``: true where no rule of the policy fails."""
    return held.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask(policy.rules, rules)).cast("long")) == 0)


def ablations(held: DataFrame, policies: Mapping[int, Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """version, rule, n_docs, n_kept, n_failed, n_alone (documents that come back without the rule), n_kept_without."""
    masks = held.groupBy("failed").agg(F.count("*").alias("n"))  # one row for each combination that occurs
    each = [(v, rule, mask(p.rules, rules), mask([rule], rules)) for v, p in policies.items() for rule in p.rules]
    listed = held.sparkSession.createDataFrame(each, "version int, rule string, policy_bits long, rule_bit long")
    found = masks.select("n", "failed", F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("policy_bits"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("rule_bit")) for v, r, m, b in each))).alias("x")).select("n", "failed", "x.*")
    hit = F.col("failed").bitwiseAND(F.col("policy_bits"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    sums = found.groupBy("version", "rule").agg(
        total(F.lit(True)).alias("n_docs"),
        total(hit == 0).alias("n_kept"),
        total(F.col("failed").bitwiseAND(F.col("rule_bit")) != 0).alias("n_failed"),
        total(hit == F.col("rule_bit")).alias("n_alone"),
    )
    names = ("n_docs", "n_kept", "n_failed", "n_alone")
    out = listed.select("version", "rule").join(sums, ["version", "rule"], "left").fillna(0, list(names))
    return out.withColumn("n_kept_without", F.col("n_kept") + F.col("n_alone"))
