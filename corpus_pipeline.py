"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes the rows that its predecessor kept and returns them with the
columns of documents, except the last, which returns packed pieces:

1. toxicity: rows whose predicted P(grade >= 1) is 0.5 or more go; the model is
   fitted on the labelled rows among the stage's input.
2. line dedup: lines spread over ``MIN_SITES`` sources or more, short ones over twice
   as many, go from the texts.
3. SimHash near-dedup: texts link whose 5-word shingles have a Jaccard similarity
   of 0.8 or more; of each component one row stays, that with the smallest doc_id,
   and among rows of one doc_id that of the smallest hash.
4. suffix-array dedup: repeated strings go from the texts; a character that is
   cut in two goes as a whole.
5. packing: sequences of 2048 tokens.

Null texts stay null up to the last stage, where they are empty.  Rows that share
a doc_id, or have none, are told apart by all that they hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import line_dedup, packing, simhash, suffix_dedup, toxicity
from docloom.llm.common import cut, table
from docloom.llm.queries import END_OF_DOCUMENT, MIN_SITES, severity_labels, vocabulary

#: Words of a shingle, and differing bits of fingerprints of candidates, in the near-dedup stage.
WORDS, RADIUS = 5, 24
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, severity_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, keep=COLUMNS).filter(~F.col("toxic")).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_spread_lines(docs, MIN_SITES)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row is known by its doc_id and 128 bits of all it holds, so rows that share a doc_id, or have none, are points of their own
    held = [*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)]
    rows = docs.select(*COLUMNS).withColumns({"_row1": F.xxhash64(*held), "_row2": F.xxhash64(F.lit(11), *reversed(held))})
    point = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row1", "_row2")
    found = simhash.near_duplicates(rows.select(point.alias("doc_id"), "text"), words=WORDS, radius=RADIUS, similar=True).filter("doc_id <=> component_id")
    stay = found.select("doc_id._row1", "doc_id._row2").distinct()
    return rows.join(stay, ["_row1", "_row2"], "left_semi").dropDuplicates(["_row1", "_row2"]).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(docs, keep=("lang", "source"))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return found.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(), END_OF_DOCUMENT)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack),
]

#: Ordinal regression, fingerprints and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(lambda docs, stage: stage[1](spark, cut(docs, free=True) if stage[0] != STAGES[0][0] else docs, sf_dir), STAGES, table(spark, sf_dir, "documents"))
