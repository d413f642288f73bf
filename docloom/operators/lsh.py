"""Approximate vector search by random hyperplanes.

A table of signs of ``bits`` projections gives each vector a bucket in each of
``tables`` tables; a query looks into its own buckets and those one bit away,
and what it finds is ranked exactly.  All rows are indexed.

Bits grow with the number of rows, so that an even bucket keeps ``PER_BUCKET``
rows, and tables with the bits, so that a row at ``ANGLE`` degrees from the query
is found with probability ``FOUND``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import vector as V
from docloom.operators.bm25 import top

PER_BUCKET, ANGLE, FOUND = 64, 60, 0.995


def sizes(n_rows: int) -> tuple[int, int]:
    """Bits and tables for so many rows."""
    bits = max(8, math.ceil(math.log2(max(n_rows, 1) / PER_BUCKET)))
    same = 1 - ANGLE / 180
    hit = same**bits + bits * same ** (bits - 1) * (1 - same)  # own bucket, or one bit away
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - hit))


def signs(x: np.ndarray, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    """The bucket of each vector in each table: a row of ``tables`` numbers."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, x.shape[1]))
    out = np.empty((len(x), tables), np.int64)
    for t in range(tables):
        out[:, t] = (x @ planes[t].T > 0) @ (1 << np.arange(bits))
    return out


def meet(own: np.ndarray, others: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``others`` lie in a bucket of a row of ``own`` (both by ``signs``) or one bit away, as a boolean matrix."""
    met = np.zeros((len(own), len(others)), bool)
    flips = np.array([0, *(1 << i for i in range(bits))])
    for t in range(own.shape[1]):
        order = np.argsort(others[:, t], kind="stable")
        held = others[order, t]
        probes = (own[:, t, None] ^ flips).ravel()
        low, high = np.searchsorted(held, probes), np.searchsorted(held, probes, "right")
        n = high - low
        places = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        met[np.repeat(np.arange(len(probes)) // len(flips), n), order[places]] = True
    return met


def candidates(queries: DataFrame, rows: DataFrame, k: int, block: int = V.BLOCK) -> DataFrame:
    """query_id, vec_id, score, n_found (rows the query met), rank: the best of what the buckets hold.

    Blocks of queries and rows meet in the cells of ``vector.grid``; a cell keeps its own
    buckets in memory and sends on ``k`` hits of a query and the number of rows that it
    met, so no pair of a query and a row is shuffled.
    """
    bits, tables = sizes(rows.select("vec_id").count())
    q, x = V.grid(queries, rows, block=block)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], []]
        if a.num_rows and b.num_rows:
            left, own, right, ids = V.matrix(a["v"]), a["id"].to_numpy(), V.matrix(b["v"]), b["id"].to_numpy()
            there = signs(right, bits, tables)
            for low in range(0, len(own), V.AT_ONCE):
                part = left[low : low + V.AT_ONCE]
                met = meet(signs(part, bits, tables), there, bits)
                s = np.round(V.cosine(part, right), 6) + 0.0
                s[~met] = -np.inf
                i, j = V.best(s, ids, k)
                for into, values in zip(found, (own[low + i], ids[j], s[i, j], np.zeros(len(i), np.int64))):
                    into.append(values)
                # and how many were met, once a query
                mine = own[low : low + V.AT_ONCE]
                for into, values in zip(found, (mine, np.full(len(mine), -1), np.full(len(mine), np.nan), met.sum(1))):
                    into.append(values)
        each = [np.concatenate(c) if c else np.array([]) for c in found]
        of = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(each, of)], ["query_id", "vec_id", "score", "n_found"])

    to_long = lambda df: df.withColumn("id", F.col("id").cast("long"))
    found = to_long(q).groupBy("qb", "xb").cogroup(to_long(x).groupBy("qb", "xb")).applyInArrow(cell, "query_id long, vec_id long, score double, n_found long")
    found = found.withColumn("n_found", F.sum("n_found").over(Window.partitionBy("query_id")))
    return top(found.filter(~F.isnan("score")), k, "query_id", F.desc("score"), "vec_id")
