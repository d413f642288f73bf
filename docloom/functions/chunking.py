"""Chunkers: text to an ordered array of pieces, Column to Column.

The greedy packers are folds over the pieces of a text, one pass in the JVM.
Sizes are in characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.text import let, sentences_keeping_ends, strip

#: Fixed value: the largest chunk.
MAX_CHUNK = 1000

_STATE = "struct<done:array<string>,now:string,size:int>"


def _fold(pieces: Column, step: Callable[[Column, Column], Column]) -> Column:
    start = F.from_json(F.lit('{"done":[],"now":"","size":0}'), _STATE)
    return F.aggregate(pieces, start, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def _state(done: Column, now: Column, size: Column) -> Column:
    return F.struct(done.alias("done"), now.alias("now"), size.cast("int").alias("size"))


def _flushed(s: Column) -> Column:
    return F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])


def windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentence_chunks(paragraph: Column, size: int = MAX_CHUNK) -> Column:
    """Sentences (ended by a full stop and a space, or a line end) packed with spaces; longer ones are cut into slices.

    A sentence counts one more than its length, but not where it opens a chunk after one that was full.
    """

    def step(s: Column, x: Column) -> Column:
        n = F.length(x)
        return (
            F.when(n > size, _state(F.concat(_flushed(s), windows(x, size)), F.lit(""), F.lit(0)))
            .when(s["size"] + n > size, _state(_flushed(s), x, n))
            .otherwise(_state(s["done"], F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(" "), x)), s["size"] + n + 1))
        )

    return _fold(F.split(F.regexp_replace(paragraph, r"\. ", ".\n"), "\n"), step)


def paragraph_chunks(text: Column, size: int = MAX_CHUNK, separator: str = "\n\n") -> Column:
    """Paragraphs packed up to ``size``, separators not counted; longer ones become sentence chunks."""

    def step(s: Column, x: Column) -> Column:
        n = F.length(x)
        return (
            F.when(n > size, _state(F.concat(_flushed(s), sentence_chunks(x, size)), F.lit(""), F.lit(0)))
            .when(s["size"] + n > size, _state(_flushed(s), x, n))
            .otherwise(_state(s["done"], F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(separator), x)), s["size"] + n))
        )

    return _fold(F.split(text, separator), step)


def heading_chunks(text: Column, marker: str, size: int = MAX_CHUNK) -> Column:
    """Lines packed; a line that begins with ``marker`` opens a chunk, and a chunk longer than ``size`` is closed."""

    def step(s: Column, x: Column) -> Column:
        cut = F.startswith(x, F.lit(marker)) & (s["now"] != "")
        done, now, n = F.when(cut, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]), F.when(cut, F.lit("")).otherwise(s["now"]), F.when(cut, F.lit(0)).otherwise(s["size"])
        now, n = F.concat(now, x, F.lit("\n")), n + F.length(x) + 1
        return F.when(n > size, _state(F.concat(done, F.array(now)), F.lit(""), F.lit(0))).otherwise(_state(done, now, n))

    return _fold(F.split(text, "\n"), step)


def packed(pieces: Column, size: int, joiner: str, counted: int) -> Column:
    """Pieces joined while the sum of lengths, each plus ``counted``, stays within ``size``."""

    def step(s: Column, x: Column) -> Column:
        n = F.length(x)
        over = (s["size"] + n > size) & (s["now"] != "")
        return F.when(over, _state(F.concat(s["done"], F.array(s["now"])), x, n + counted)).otherwise(
            _state(s["done"], F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(joiner), x)), s["size"] + n + counted)
        )

    return _fold(pieces, step)


def overlapping_sentences(text: Column, size: int = MAX_CHUNK, back: int = 3) -> Column:
    """Sentences packed with spaces; a new chunk begins with up to ``back`` - 1 sentences of the one before."""
    return let(F.transform(sentences_keeping_ends(text), strip), lambda pieces: _overlapping(pieces, size, back))


def _overlapping(pieces: Column, size: int, back: int) -> Column:
    start = F.from_json(F.lit('{"done":[],"from":0,"to":0,"size":0}'), "struct<done:array<string>,from:int,to:int,size:int>")
    joined = lambda a, b: F.array_join(F.slice(pieces, a + 1, b - a), " ")

    def step(s: Column, x: Column) -> Column:
        over = (s["size"] + F.length(x) > size) & (s["to"] > s["from"])
        begin = F.greatest(s["to"] - (back - 1), s["from"] + 1)
        carried = F.aggregate(F.slice(pieces, begin + 1, s["to"] - begin), F.lit(0), lambda a, y: a + F.length(y) + 1)
        state = lambda d, a, n: F.struct(d.alias("done"), a.cast("int").alias("from"), (s["to"] + 1).alias("to"), n.cast("int").alias("size"))
        return F.when(over, state(F.concat(s["done"], F.array(joined(s["from"], s["to"]))), begin, carried + F.length(x) + 1)).otherwise(state(s["done"], s["from"], s["size"] + F.length(x) + 1))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["to"] > s["from"], F.concat(s["done"], F.array(joined(s["from"], s["to"])))).otherwise(s["done"]))


def _trailing(pieces: Column, joiner: str, room: Column) -> Column:
    """How many of the last pieces fit into ``room`` when joined; one alone needs room for a joiner too."""
    fits = lambda j: F.length(F.array_join(F.slice(pieces, -j, j), joiner)) + F.when(j == 1, len(joiner)).otherwise(0) <= room
    return F.when(F.size(pieces) > 0, F.size(F.filter(F.sequence(F.lit(1), F.size(pieces)), fits))).otherwise(0)


def _last(pieces: Column, n: Column, joiner: str) -> Column:
    return F.when(n > 0, F.array_join(F.slice(pieces, -n, n), joiner)).otherwise(F.lit(""))


def semantic_overlap(text: Column, size: int) -> Column:
    """What the next chunk repeats of ``text``: its last whole paragraphs within ``size``, and of the paragraph before them its last whole sentences.

    Where that is less than half of ``size``, the last ``size`` characters.
    """

    def of_paragraphs(parts: Column) -> Column:
        return let(_trailing(parts, "\n\n", F.lit(size)), lambda n: let(F.struct(_last(parts, n, "\n\n").alias("tail"), T.sentences_keeping_ends(F.coalesce(F.get(parts, F.size(parts) - n - 1), F.lit(""))).alias("before")), with_sentences))

    def with_sentences(x: Column) -> Column:
        room = F.lit(size) - F.length(x["tail"])
        lead = let(F.when(room > 0, _trailing(x["before"], " ", room)).otherwise(0), lambda n: _last(x["before"], n, " "))
        return let(lead, lambda a: F.concat(a, F.when((a != "") & (x["tail"] != ""), F.lit("\n\n")).otherwise(F.lit("")), x["tail"]))

    # empty paragraphs at the end don't count
    to_last = lambda parts: F.slice(parts, F.lit(1), F.coalesce(F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1))), F.lit(0)))
    whole = let(let(let(F.split(text, "\n\n"), to_last), of_paragraphs), lambda x: F.when(F.length(x) * 2 < size, F.right(text, F.lit(size))).otherwise(x))
    return F.when(F.length(text) <= size, text).otherwise(whole)


def recursive_chunks(text: Column, size: int = MAX_CHUNK, overlap: int = 100) -> Column:
    """Paragraphs packed up to ``size``; a chunk that follows a full one begins with the overlap of that one.

    A paragraph over ``size`` becomes sentence chunks, one over twice ``size`` overlapping sentences.
    """

    def step(s: Column, x: Column) -> Column:
        n, now = F.length(x), s["now"]
        again = F.when(F.length(now) > overlap, F.concat(semantic_overlap(now, overlap), F.lit("\n\n"), x)).otherwise(x)
        return (
            F.when(n > 2 * size, _state(F.concat(_flushed(s), overlapping_sentences(x, size)), F.lit(""), F.lit(0)))
            .when(n > size, _state(F.concat(_flushed(s), sentence_chunks(x, size)), F.lit(""), F.lit(0)))
            .when((now != "") & (F.length(now) + n + 2 > size), _state(_flushed(s), again, F.lit(0)))
            .otherwise(_state(s["done"], F.when(now == "", x).otherwise(F.concat(now, F.lit("\n\n"), x)), F.lit(0)))
        )

    paragraphs = F.filter(F.transform(F.split(text, r"\n[\x20\x09-\x0D]*\n"), strip), lambda x: x != "")
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(_fold(paragraphs, step))


def long_section(text: Column, size: int) -> Column:
    """Sentences of a section packed with spaces up to ``size``, as structs of text and is_continuation; a section within ``size`` stays as it is."""
    parts = packed(F.filter(F.transform(T.sentences(text), strip), lambda x: x != ""), size, " ", 1)
    whole = F.when(F.length(text) > size, parts).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.transform(whole, lambda x, i: F.struct(x.alias("text"), (i > 0).alias("is_continuation")))


def spans(text: Column, size: int) -> Column:
    """(start, end) of slices of ``size`` characters that tile the text."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))
    span = lambda i: F.struct(i.cast("long").alias("start"), F.least(i + size, F.length(text)).cast("long").alias("end"))
    return F.when(F.length(text) > 0, F.transform(starts, span)).otherwise(F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>"))


def spans_at(text: Column, pattern: str, size: int) -> Column:
    """(start, end) of slices that end at matches of ``pattern`` where possible: pieces are packed up to ``size``."""
    pieces = F.split(F.regexp_replace(text, f"({pattern})", "$1\x01"), "\x01")
    chunks = packed(pieces, size, "", 0)
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>")

    def step(done: Column, x: Column) -> Column:
        start = F.when(F.size(done) == 0, F.lit(0).cast("long")).otherwise(F.element_at(done, -1)["end"])
        return F.concat(done, F.array(F.struct(start.alias("start"), (start + F.length(x)).alias("end"))))

    return F.aggregate(F.filter(chunks, lambda x: x != ""), none, step)


def exploded(rows: DataFrame, key: str, chunks: Column, text: str = "text") -> DataFrame:
    """One row a chunk: key, chunk_index, text."""
    return rows.select(key, F.posexplode(chunks).alias("chunk_index", text)).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def segments(rows: DataFrame, key: str, chunks: Column, most: int | None = None) -> DataFrame:
    """One row a segment: key, segment_id, segment_index, total_segments, text; ``most`` is the feature's own cap."""
    pieces = F.slice(chunks, 1, most) if most else chunks
    made = rows.select(key, pieces.alias("pieces")).select(key, F.size("pieces").cast("long").alias("total_segments"), F.posexplode("pieces").alias("i", "text"))
    return made.select(key, F.concat_ws("_", F.col(key).cast("string"), F.lit("segment"), F.col("i").cast("string")).alias("segment_id"), F.col("i").cast("long").alias("segment_index"), "total_segments", "text")
