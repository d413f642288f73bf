"""Chunkers of one's own as a table function that SQL can call.

``register`` gives a session a function that takes a text and a chunker's name and
returns its rows, for use with LATERAL.  Each chunker says what columns its rows have,
and the function's result has the columns of the chunker that the call names.

    register(spark, "chunk", {**CHUNKERS, "words": Plugin(my_words, "text string, n int")})
    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk(d.text, 'words') c

For the library's own chunkers the DataFrame operators (``chunkers``, ``chunking``) stay
in the JVM and are faster; this is the way in for code that Spark doesn't have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StructField, StructType

from docloom.operators import boundaries as B


class Plugin(NamedTuple):
    """``pieces`` of a text: tuples of the columns in ``schema``."""

    pieces: Callable[[str], Iterable[tuple]]
    schema: str


def _texts(f: Callable[[str], list[str]]) -> Plugin:
    return Plugin(lambda text: ((x,) for x in f(text)), "text string")


def _paragraphs(separator: str) -> Callable[[str], list[str]]:
    return lambda text: B.paragraph_pieces(text, separator)


CHUNKERS: dict[str, Plugin] = {
    "paragraph": _texts(_paragraphs("\n\n")),
    "line": _texts(_paragraphs("\n")),
    "code": _texts(B.code_pieces),
    "list": _texts(B.list_pieces),
    "semantic": _texts(B.semantic_sections),
    "recursive_markdown": _texts(B.recursive_pieces),
    "generic": Plugin(lambda text: ((x["heading"], x["text"]) for x in B.generic_sections(text)), "heading string, text string"),
    "boundaries": Plugin(lambda text: ((b["type"], b["start"], b["end"], b["level"], b["importance"]) for b in B.boundaries(text)), "type string, start int, end int, level int, importance double"),
}


def register(spark: SparkSession, name: str, plugins: Mapping[str, Plugin] = CHUNKERS) -> None:
    """The table function ``name``(text, chunker): chunk_index and the chunker's columns; null and empty texts have no rows.

    The chunker's name must be a constant; one that isn't known is an error when the query is analysed.
    """
    known = {k: (p.pieces, StructType([StructField("chunk_index", LongType()), *StructType.fromDDL(p.schema).fields])) for k, p in plugins.items()}

    class Chunk:
        @staticmethod
        def analyze(text: AnalyzeArgument, chunker: AnalyzeArgument) -> AnalyzeResult:
            if not chunker.isConstantExpression:
                raise ValueError("the name of a chunker is a constant")
            if chunker.value not in known:
                raise ValueError(f"unknown chunker {chunker.value!r}; known: {sorted(known)}")
            return AnalyzeResult(schema=known[chunker.value][1])

        def eval(self, text: str, chunker: str):
            if text:
                for i, row in enumerate(known[chunker][0](text)):
                    yield (i, *row)

    spark.udtf.register(name, udtf(Chunk))
