"""Packing into windows by the sum-of-squares rule, online.

Each task packs the documents of its partition as they come: whole windows are
cut from the front of a long document, and the rest goes to the fill level that
makes the sum of the squared counts of partially filled windows least; the
counts are kept in a level array.  At the end of a task the windows that are still
open stay as the rule has left them, the fullest first, and are filled up with
pieces of the emptiest ones, which are cut freely for that; the last remainder goes
into windows whose sizes are powers of two, which need no padding.  Nothing is
shuffled, and a task holds its open windows only.

Null texts are empty; a document always has its end id, so every row has at
least one piece.  Repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docloom.llm.bpe import encoded
from docloom.llm.common import bounded

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Piece = tuple[object, int, np.ndarray, int]  # doc_id, start, ids, tokens of the document


class SumOfSquares:
    """Windows of ``size`` tokens; ``place`` and ``finish`` return the closed ones, each a list of pieces."""

    def __init__(self, size: int):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)  # partially filled windows at each fill
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def choose(self, n: int) -> int:
        """The fill level, 0 for a new window, at which a piece of ``n`` tokens costs least; the fullest of equal ones."""
        top = self.size - n
        here, there = self.level[1 : top + 1], self.level[1 + n : self.size + 1]
        change = 2 * (there - here) + 2
        if top:
            change[-1] = 1 - 2 * here[-1]  # the window would be full and no longer counts
        at = np.flatnonzero(here)
        best, cost = 0, 2 * self.level[n] + 1
        if len(at):
            least = change[at].min()
            if least <= cost:
                best = int(at[change[at] == least][-1]) + 1
        return best

    def place(self, piece: Piece) -> list[list[Piece]]:
        n = len(piece[2])
        if n == self.size:
            return [[piece]]
        at = self.choose(n)
        window = self.open[at].pop() if at else []
        self.level[at] -= bool(at)
        window.append(piece)
        if at + n == self.size:
            return [window]
        self.level[at + n] += 1
        self.open[at + n].append(window)
        return []

    def finish(self) -> list[list[Piece]]:
        """Closes the open windows: the fullest are filled up with pieces of the emptiest, what is left is cut into powers of two."""
        windows = [(at, window) for at in sorted(self.open, reverse=True) for window in self.open[at]]
        out, spare, first, last = [], [], 0, len(windows)
        while first < last:
            at, window = windows[first]
            first, room = first + 1, self.size - at
            while room and (spare or first < last):
                if not spare:
                    last -= 1
                    spare = windows[last][1][::-1]
                room -= self._take(window, spare, room)
            if room:  # nothing is left to fill it up with
                spare = window[::-1]
                break
            out.append(window)
        left = sum(len(p[2]) for p in spare)  # less than a window
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                room -= self._take(window, spare, room)
            out.append(window)
        self.open.clear()
        self.level[:] = 0
        return out

    @staticmethod
    def _take(window: list[Piece], pieces: list[Piece], room: int) -> int:
        """Moves the last of ``pieces``, or its beginning, into the window; how many tokens that were."""
        doc, start, ids, total = pieces.pop()
        if len(ids) > room:
            pieces.append((doc, start + room, ids[room:], total))
            ids = ids[:room]
        window.append((doc, start, ids, total))
        return len(ids)


def pack(docs: DataFrame, path: str, end: int, size: int = 2048) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text), packed into sequences of at most ``size`` tokens.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``end`` is the id put after each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task, done = SumOfSquares(size), TaskContext.get().partitionId() << 36, 0
        tail = np.array([end], "<u4")

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal done
            out = []
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, task + done, offset))
                    offset += len(ids)
                done += 1
            return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 7, NAMES)

        for batch, ids in encoded(batches, path):
            closed: list[list[Piece]] = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), ids):
                own = np.concatenate([own, tail]).astype("<u4")
                for start in range(0, len(own), size):
                    closed += packer.place((doc, start, own[start : start + size], len(own)))
            yield rows(closed)
        yield rows(packer.finish())

    return bounded(docs).select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
