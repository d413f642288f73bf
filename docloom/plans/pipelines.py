"""Processors and pipelines: a processor takes a DataFrame to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunkers
from docloom.operators.incremental import State

#: Fixed value: characters of the longest text that is taken.
LONGEST = 10485760

Processor = Callable[[DataFrame], DataFrame]
_REGISTERED: dict[str, tuple[Processor, frozenset[str]]] = {}


def register(name: str, types: Iterable[str] = ()) -> Callable[[Processor], Processor]:
    """Registers a processor for the file types it supports; none: all."""

    def add(f: Processor) -> Processor:
        _REGISTERED[name] = (f, frozenset(types))
        return f

    return add


class Pipeline:
    """Processors applied in their order."""

    def __init__(self, steps: Iterable[Processor]):
        self.steps = list(steps)

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df

    @classmethod
    def named(cls, names: Iterable[str], file_type: str | None = None) -> Pipeline:
        """The processors of these names; one that doesn't support the type, or isn't known, is an error."""
        steps = []
        for name in names:
            f, types = _REGISTERED[name]
            if file_type and types and file_type not in types:
                raise ValueError(f"{name} doesn't support {file_type}")
            steps.append(f)
        return cls(steps)


def validated(df: DataFrame) -> DataFrame:
    """Rows with a text, of at most ``LONGEST`` characters."""
    return df.filter((F.col("text") != "") & (F.length("text") <= LONGEST))


def chunked(key: str, chunker: str) -> Processor:
    """One row a chunk, by the chunker of that name: key, chunk_index, text."""
    return lambda df: chunkers.chunker(chunker)(df, key, "text")


def described(key: str) -> Processor:
    """Chunks with their keywords and topics, and those of their document's other chunks: key, chunk_index, text, keywords, topics."""

    def run(chunks: DataFrame) -> DataFrame:
        own = chunks.withColumn("keywords", T.words(F.col("text"))).withColumn("topics", T.topic_areas(F.col("keywords")))
        topics = own.select(key, F.explode("topics").alias("topic")).distinct().groupBy(key).agg(F.sort_array(F.collect_list("topic")).alias("topics"))  # four at most
        return own.select(key, "chunk_index", "text", F.size("keywords").cast("long").alias("n_keywords")).join(topics, key, "left")

    return run


def embedded(key: str, embed: Callable[[DataFrame, str], DataFrame]) -> Processor:
    """Chunks with the embedding of their text, null where they have no word: key, chunk_index, text, embedding."""

    def run(chunks: DataFrame) -> DataFrame:
        rows = chunks.withColumn("_id", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_index").cast("string")))
        return rows.join(embed(rows.select("_id", "text"), "_id"), "_id", "left").drop("_id")

    return run


def due(state: State, columns: dict[str, Column]) -> Processor:
    """Rows that have changed since the last run, by ``columns``; ``state.done`` notes them once they are processed."""
    return lambda df: state.due(df.withColumns(columns))


def standard(key: str, embed: Callable[[DataFrame, str], DataFrame], chunker: str = "paragraph") -> Pipeline:
    return Pipeline([validated, chunked(key, chunker), embedded(key, embed)])


def metadata_aware(key: str, chunker: str = "paragraph") -> Pipeline:
    return Pipeline([validated, chunked(key, chunker), described(key)])


def incremental(key: str, state: State, columns: dict[str, Column], embed: Callable[[DataFrame, str], DataFrame], chunker: str = "paragraph") -> Pipeline:
    return Pipeline([validated, due(state, columns), chunked(key, chunker), embedded(key, embed)])
