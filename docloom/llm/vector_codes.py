"""Product codes of vectors: codebooks by Lloyd rounds that skip distances with Yinyang's bounds, in whole numbers.

A component x counts as floor(scale * x); a vector is cut into equal consecutive
parts, and each part has a codebook of its own.  The entries of a codebook are
clustered into a few groups once.  Every row keeps, for each part, its entry, an
upper bound of the distance to it and one lower bound for each group.  A round
moves the bounds by how far entries have drifted; where the upper bound stays
under all lower bounds nothing is computed, otherwise the distance to the row's own
entry is, and then only groups whose bound doesn't clear it are scanned.  Bounds are
floats rounded outwards, a group is passed over only if it lies strictly farther,
and distances are compared as whole numbers, so ties go to the lower index exactly
as in an exhaustive search.

The rows with their bounds are a table in the shared folder, rewritten each round;
the table of the round before is removed then.  Each task adds one row with its own
sums to the table, so a round is one job over the rows and one over these sums,
which Spark adds up; the driver gets as many numbers as the codebooks hold.

Rows whose vector is null, empty, or holds null or non-finite components are
dropped.  Vectors of different lengths, a length that the parts don't divide, and
components so large that 64 bits don't hold the sums are errors.  The first entries
come from the smallest keys, null keys last, rows of one key in the order of their
vectors; fewer rows than entries make fewer entries.  Rows that repeat are coded
each.  An empty table gives no rows.  Columns in ``keep`` go along, others are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from docloom.llm.common import cut, hot_keys, salted_join, work_dir
from docloom.storage import remove

#: Bounds are moved outwards by this share; floats of 32 bits are off by less than a tenth of it.
MARGIN = 1e-6
#: Components that are worked on together.
BLOCK = 1 << 20
FAR = np.iinfo(np.int64).max


class Trained(NamedTuple):
    """``coded``: key, kept columns, code (hex digits), error.  ``compared``: for each assignment, distances computed and distances of an exhaustive search."""

    coded: DataFrame
    codebooks: list[np.ndarray]
    compared: list[tuple[int, int]]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, in decimal, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def _up(x: np.ndarray) -> np.ndarray:
    return (x * np.where(x > 0, 1 + MARGIN, 1 - MARGIN)).astype(np.float32)


def _down(x: np.ndarray) -> np.ndarray:
    return (x * np.where(x > 0, 1 - MARGIN, 1 + MARGIN)).astype(np.float32)


def groups_of(book: np.ndarray, n: int) -> np.ndarray:
    """A group for each entry: seeds far from each other, then five rounds of means."""
    points = book.astype(np.float64)
    seeds = [0]
    while len(seeds) < min(n, len(points)):
        seeds.append(int(np.argmax(((points[:, None] - points[seeds]) ** 2).sum(-1).min(1))))
    centres = points[seeds]
    for _ in range(5):
        own = ((points[:, None] - centres) ** 2).sum(-1).argmin(1)
        centres = np.stack([points[own == g].mean(0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return np.unique(own, return_inverse=True)[1]


class Part(NamedTuple):
    """A part's codebook, its groups, and how far entries and groups have drifted since the bounds were set."""

    book: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    @classmethod
    def moved(cls, book: np.ndarray, groups: np.ndarray, before: np.ndarray | None) -> Part:
        return cls(book, groups, np.zeros(len(book)) if before is None else np.sqrt(((book - before) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN))

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Sets ``code`` of the rows ``x`` and their bounds; the number of distances that it took."""
        n_groups = self.groups.max() + 1
        upper[:] = _up(upper.astype(np.float64) + self.drift[code])
        lower[:] = _down(lower.astype(np.float64) - np.array([self.drift[self.groups == g].max() for g in range(n_groups)]))
        at = np.flatnonzero(upper >= lower.min(1))
        own = ((x[at] - self.book[code[at]]) ** 2).sum(1)
        computed = len(at)
        upper[at] = _up(np.sqrt(own.astype(np.float64)))
        left = upper[at] >= lower[at].min(1)
        at, own = at[left], own[left]
        scan = lower[at] <= upper[at][:, None]
        found = np.full((len(at), len(self.book)), FAR)
        rows = np.arange(len(at))
        found[rows, code[at]] = own
        for g in range(n_groups):
            here, members = np.flatnonzero(scan[:, g]), np.flatnonzero(self.groups == g)
            found[np.ix_(here, members)] = ((x[at[here]][:, None] - self.book[members]) ** 2).sum(-1)
            computed += len(here) * len(members)
        best = found.argmin(1)  # the first of equal ones
        code[at], upper[at] = best, _up(np.sqrt(found[rows, best].astype(np.float64)))
        found[rows, best] = FAR
        for g in range(n_groups):
            nearest = found[:, self.groups == g].min(1)
            bound = np.where(nearest == FAR, np.inf, _down(np.sqrt(nearest.astype(np.float64))))
            # in a group that wasn't scanned, only the entry that the row has just left is new
            lower[at, g] = np.where(scan[:, g], bound, np.minimum(lower[at, g], bound))
        return computed


def _matrix(column: pa.Array, dtype: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), n).copy()


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _assigned(batches: Iterator[pa.RecordBatch], parts: list[Part], keep: list[str], kind: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], int]]:
    """Of each block of rows of the table: itself, whole components, codes, upper and lower bounds by part, distances computed."""
    size = parts[0].book.shape[1]
    for batch in batches:
        for start in range(0, batch.num_rows, step := max(1, BLOCK // (size * len(parts)))):
            block = batch.slice(start, step)
            if "_sums" in block.schema.names:
                block = block.filter(block.column("_sums").is_null())
            if not (n := block.num_rows):
                continue
            x = _matrix(block.column("_x"), kind, size * len(parts)).astype(np.int64)
            n_groups = [p.groups.max() + 1 for p in parts]
            if "_code" in block.schema.names:
                codes = _matrix(block.column("_code"), "u1", len(parts)).astype(np.int64)
                upper = _matrix(block.column("_upper"), "<f4", len(parts))
                lower = np.split(_matrix(block.column("_lower"), "<f4", sum(n_groups)), np.cumsum(n_groups)[:-1], axis=1)
            else:  # nothing is known: every group is scanned
                codes, upper = np.zeros((n, len(parts)), np.int64), np.full((n, len(parts)), np.inf, np.float32)
                lower = [np.full((n, g), -np.inf, np.float32) for g in n_groups]
            computed = 0
            for i, part in enumerate(parts):
                code, bound, low = codes[:, i].copy(), upper[:, i].copy(), lower[i].copy()
                computed += part.assign(x[:, i * size : (i + 1) * size], code, bound, low)
                codes[:, i], upper[:, i], lower[i] = code, bound, low
            yield block, x, codes, upper, lower, computed


def _round(parts: list[Part], keep: list[str], kind: str):
    size, entries = parts[0].book.shape[1], len(parts[0].book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(parts), entries, 1 + size), np.int64)
        computed = n_rows = 0
        names, fields = None, None
        for block, x, codes, upper, lower, n in _assigned(batches, parts, keep, kind):
            computed, n_rows = computed + n, n_rows + len(x)
            for i in range(len(parts)):
                for e in np.unique(codes[:, i]):
                    mine = x[codes[:, i] == e, i * size : (i + 1) * size]
                    sums[i, e, 0] += len(mine)
                    sums[i, e, 1:] += mine.sum(0)
            own = [block.column(c) for c in keep]
            names, fields = [*keep, "_x", "_code", "_upper", "_lower", "_sums"], [c.type for c in own]
            made = [block.column("_x"), _binary(codes.astype("u1")), _binary(upper), _binary(np.concatenate(lower, axis=1))]
            yield pa.RecordBatch.from_arrays([*own, *made, pa.nulls(len(x), pa.list_(pa.int64()))], names=names)
        if names:
            total = pa.array([[*sums.ravel().tolist(), computed, n_rows * len(parts) * entries]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in fields), *[pa.nulls(1, pa.binary())] * 4, total], names=names)

    return run


def _last(parts: list[Part], keep: list[str], kind: str):
    size = parts[0].book.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x, codes, *_ in _assigned(batches, parts, keep, kind):
            error = sum(((x[:, i * size : (i + 1) * size] - p.book[codes[:, i]]) ** 2).sum(1) for i, p in enumerate(parts))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array([r.tobytes().hex() for r in codes.astype("u1")], pa.string()), pa.array(error, pa.int64())], names=[*keep, "code", "error"])

    return run


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def _stored(kind: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _binary(x.astype(kind))], names=[*keep, "_x"])

    return run


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = ("label",), parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, n_groups: int = 4) -> Trained:
    """Codebooks of ``entries`` (256 at most) for each of ``parts``, after ``rounds`` rounds, and all rows coded with them."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 256 entries at most")
    spark, keep = vectors.sparkSession, list(dict.fromkeys([key, *keep]))
    whole = F.transform(F.col("_v"), lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.select(*keep, vectors[vector].alias("_v")).filter(usable(F.col("_v")))
    kept_fields = rows.select(*keep).schema.fields
    facts = rows.agg(F.count("*").alias("n"), F.min(F.size("_v")).alias("low"), F.max(F.size("_v")).alias("high"), F.max(F.array_max(F.transform("_v", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    result = StructType([*kept_fields, *StructType.fromDDL("code string, error bigint").fields])
    if not facts.n:
        return Trained(spark.createDataFrame([], result), [np.empty((0, 0), np.int64)] * parts, [])
    if facts.low != facts.high or facts.low % parts:
        raise ValueError(f"vectors of {facts.low} to {facts.high} components can't be cut into {parts} parts alike")
    most = int(facts.most * scale) + 1
    if facts.low * (2 * most) ** 2 >= 1 << 62 or facts.n * most >= 1 << 62:
        raise ValueError("components are too large for sums in 64 bits")
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"

    rows = rows.withColumn("_v", whole)
    # the first entries: as many rows as a codebook has entries
    first = np.array([r._v for r in rows.orderBy(F.asc_nulls_last(key), "_v").limit(entries).collect()], np.int64)
    books = np.split(first, parts, axis=1)
    groups = [groups_of(b, n_groups) for b in books]
    before: list[np.ndarray | None] = [None] * parts

    folder, compared, old = work_dir(spark, "codes"), [], None
    table = rows.mapInArrow(_stored(kind, keep), StructType([*kept_fields, StructField("_x", BinaryType())]))
    state = StructType([*kept_fields, *(StructField(c, BinaryType()) for c in ("_x", "_code", "_upper", "_lower")), StructField("_sums", ArrayType(LongType()))])
    try:
        for i in range(rounds):
            now = [Part.moved(*x) for x in zip(books, groups, before)]
            table.mapInArrow(_round(now, keep, kind), state).write.parquet(path := f"{folder}/round-{i}")
            if old:
                remove(spark, old)
            old, table = path, spark.read.schema(state).parquet(path)
            listed = table.filter("_sums is not null").select(F.posexplode("_sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
            flat = np.zeros(parts * len(first) * (1 + books[0].shape[1]) + 2, np.int64)
            for r in listed.collect():  # one number for each component of the codebooks
                flat[r.i] = r.x
            compared.append((int(flat[-2]), int(flat[-1])))
            sums, before = flat[:-2].reshape(parts, len(first), -1), books
            books = [np.where(s[:, :1] > 0, s[:, 1:] // np.maximum(s[:, :1], 1), b) for s, b in zip(sums, books)]  # // floors
        now = [Part.moved(*x) for x in zip(books, groups, before)]
        coded = cut(table.mapInArrow(_last(now, keep, kind), result))
    finally:
        remove(spark, folder)
    return Trained(coded, books, compared)


def with_group_error(coded: DataFrame, group: str = "label", key: str = "vec_id", name: str = "label_error") -> DataFrame:
    """``coded`` with ``name``: the sum of error over rows of one ``group``, nulls together.  Rows of a common group are dealt out by a salt."""
    keyed = coded.withColumns({"_null": F.col(group).isNull(), "_group": F.coalesce(F.col(group).cast("string"), F.lit(""))})
    sums = keyed.groupBy("_null", "_group").agg(F.sum("error").alias(name), F.count("*").alias("n"))
    hot = hot_keys(sums, "_null", "_group")
    return salted_join(keyed, sums.drop("n"), hot, ["_null", "_group"], [key, "code"]).drop("_null", "_group")
