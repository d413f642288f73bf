"""Removal of byte strings that repeat across documents, by per-shard suffix arrays.

A byte goes when it lies in a string of ``width`` bytes (a window) that also
starts earlier: in a document of smaller doc_id, or earlier in the same one.

1. Every task cuts its documents into shards of about 256 KB (documents over twice that in
   parts that overlap by a window less a byte), builds the suffix
   array of each by Larsson-Sadakane refinement, and takes Kasai common
   prefixes; that gives all repeats inside a shard.
2. Across shards, windows are gathered by content.  The least hash of the
   37-byte strings in a window is its anchor; equal windows have equal anchors.
   Neighbouring windows with one anchor are a run, sent as two hashes of different
   kinds: of the anchor and of the run's whole bytes.  Of equal runs, all but the earliest
   are repeats, first among the runs of a task, so that a passage of every shard
   is few rows of its anchor; runs that share an anchor but differ are merged further.
3. For these the bytes are fetched, and the runs of an anchor meet in one merge
   shard, whose own suffix array puts equal windows side by side; a window's group is
   looked up among the sorted groups for its first place.  Anchors with more than
   ``many`` different runs don't meet in one shard: their windows are dealt out one by
   one, by 128-bit hashes, and counted with partial aggregation.

Matches never cross documents.  Null text is empty; texts shorter than a window
stay whole.  doc_id and text identify a document, inside as ``doc`` and ``sub``, a
64-bit hash of the text: rows that repeat both are one document, rows of one
doc_id with different texts are several, in the order of ``sub``; null doc_ids come
first.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, cut, small_batches, utf8

# a shard's arrays, some ten times its size, fit into a core's share of the cache
WIDTH, HOT, SHARD = 100, 2000, 1 << 18
#: Runs of a task among which equal ones are looked for before they are dealt out.
COMBINE = 1 << 19
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
RUN = "h long, c long, doc long, sub long, start int, n int"
NONE = -(2**63)


def refined(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (uint8) sorted by their first ``depth`` bytes or more, by Larsson-Sadakane refinement.

    A suffix's rank is the first place of its group; a round sorts the members
    of unfinished groups by the rank of the suffix h further on, which doubles h.
    Also returned: the places that were in one group with the place before them
    when the last round began; all others differ from it within ``depth`` bytes.
    """
    n = len(text)
    used = np.zeros(256, bool)
    used[text] = True
    code = np.cumsum(used).astype(np.uint64)
    symbol = np.zeros(n + 64, np.uint64)
    symbol[:n] = code[text]
    bits = int(code[-1]).bit_length() if n else 1
    h = max(1, 63 // bits)
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key = key << np.uint64(bits) | symbol[i : i + n]
    sa = np.argsort(key).astype(np.int32)
    group, slot = key[sa], np.arange(n, dtype=np.int32)
    place = max(1, n.bit_length())
    mask = np.uint64((1 << place) - 1)
    rank = np.zeros(n + 2 * depth + 64, np.int32)
    close = slot[:0]
    while n:
        new = np.ones(len(slot) + 1, bool)
        np.not_equal(group[1:], group[:-1], out=new[1:-1])
        starts = np.flatnonzero(new[:-1])
        rank[sa[slot]] = np.repeat(slot[starts] + 1, np.diff(np.append(starts, len(slot))))
        if h >= depth:
            break
        close = slot[~new[:-1]]
        slot = slot[~(new[:-1] & new[1:])]  # a group of one is finished
        if not len(slot):
            break
        at = sa[slot]
        if 3 * place <= 64:
            order = np.sort(rank[at].astype(np.uint64) << np.uint64(2 * place) | rank[at + h].astype(np.uint64) << np.uint64(place) | at.astype(np.uint64))
            sa[slot], group = (order & mask).astype(np.int32), order >> np.uint64(place)
        else:
            by = np.lexsort((rank[at + h], rank[at]))
            sa[slot] = at[by]
            group = rank[at][by].astype(np.int64) << 32 | rank[(at + h)][by]
        h *= 2
    return sa, close


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` sorted by their first ``depth`` bytes or more."""
    return refined(text, depth)[0]


def common_prefixes(text: np.ndarray, sa: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Common prefix of suffix sa[r] with sa[r - 1], for the places r in ``candidates``.

    Kasai's observation in the form for whole arrays: where suffix i - 1 has the
    predecessor of suffix i, less one, the prefix is one shorter, so only the
    first place of such a stretch is compared.
    """
    by = np.argsort(sa[candidates], kind="stable")
    i, j = sa[candidates][by], sa[candidates - 1][by]
    fresh = np.ones(len(i), bool)
    fresh[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    x, y, n = i[fresh], j[fresh], len(text)
    words = np.zeros(n + 8, np.uint64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    for k in range(8):
        words |= padded[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    length, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(live):
        a, b = x[live] + length[live], y[live] + length[live]
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        room = n - np.maximum(a, b)
        length[live] += np.minimum(same, np.maximum(room, 0))
        live = live[(same == 8) & (room > 8)]
    stretch = np.cumsum(fresh) - 1
    value = np.maximum(length[stretch] - (np.arange(len(i)) - np.flatnonzero(fresh)[stretch]), 0)
    out = np.empty(len(i), np.int64)
    out[by] = value
    return out


def groups_of_windows(text: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows with an equal one, and the number of their group; ``ends``: of each byte, the end of its document."""
    sa, close = refined(text, width)
    long = close[common_prefixes(text, sa, close) >= width]
    member = np.zeros(len(sa), bool)
    member[long] = member[long - 1] = True
    joined = np.zeros(len(sa), bool)
    joined[long] = True
    at = np.flatnonzero(member)
    group = np.cumsum(~joined[at]) - 1
    whole = sa[at] + width <= ends[sa[at]]  # inside its document
    return sa[at][whole], group[whole]


def repeats(text: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each place of ``text``, whether the window there also starts at an earlier place."""
    out = np.zeros(len(text), bool)
    if len(text):
        place, group = groups_of_windows(text, ends, width)
        if len(place):
            first = np.full(group.max() + 1, len(text))
            np.minimum.at(first, group, place)
            out[place[place != first[group]]] = True
    return out


def first_places(text: np.ndarray, ends: np.ndarray, order: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Like ``repeats``, with places ordered by ``order``: each window's group is looked up among the sorted groups for its first place."""
    out = np.zeros(len(text), bool)
    if len(text):
        place, group = groups_of_windows(text, ends, width)
        if len(place):
            by = np.lexsort((order[place], group))
            place, group = place[by], group[by]
            sorted_groups, at = np.unique(group, return_index=True)
            first = at[np.searchsorted(sorted_groups, group)]
            out[place[order[place] != order[place[first]]]] = True
    return out


def _prefix_hash(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
    inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)]))
    value = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
    value ^= value >> np.uint64(31)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value * power[:n], out=total[1:])
    return total, inverse


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


def runs(text: np.ndarray, ends: np.ndarray, width: int = WIDTH, spread: int = 64) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor: start, number of windows, hash of the anchor."""
    gram, n = width - spread + 1, len(text)
    starts = n - width + 1
    if starts <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
    total, inverse = _prefix_hash(text)
    exact = _mixed((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    place = max(21, n.bit_length())
    least = exact >> np.uint64(place) << np.uint64(place) | np.arange(len(exact), dtype=np.uint64)
    step = 1
    while step < spread:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    anchor = (least & np.uint64((1 << place) - 1)).astype(np.int64)
    inside = np.arange(starts) + width <= ends[:starts]
    begins = np.ones(starts, bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (ends[1:starts] != ends[: starts - 1])
    at = np.flatnonzero(begins)
    count = np.diff(np.append(at, starts))
    # windows over a document's end are no windows
    count = np.minimum(count, np.maximum(ends[at] - width + 1 - at, 0))
    at, count = at[count > 0], count[count > 0]
    return at, count, exact[anchor[at]]


def run_hashes(raw: bytes, at: np.ndarray, count: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """XXH3 of each run's bytes: of another kind than the hash of its anchor, so that bytes made to collide in one don't in the other."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip(at.tolist(), (at + count - 1 + width).tolist())), np.uint64, len(at))


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One text of all documents; of each byte the document's number and end; each document's start."""
    sizes = np.array(list(map(len, docs)), np.int64)
    stop = np.cumsum(sizes)
    return np.frombuffer(b"".join(docs), np.uint8), np.repeat(np.arange(len(docs)), sizes), np.repeat(stop, sizes), stop - sizes


def _batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(np.asarray(c).view(np.int64) if getattr(c, "dtype", None) == np.uint64 else c, kinds[t]) for c, (_, t) in zip(columns, fields)], [name for name, _ in fields])


def _shards(batch: pa.RecordBatch, width: int, shard: int) -> Iterator[list[tuple[int, int, bytes, int]]]:
    """The batch's documents as doc, sub, bytes, first byte; a long one in parts whose windows are all its windows, each once."""
    rows = sorted({*zip(batch.column("doc").to_pylist(), batch.column("sub").to_pylist(), utf8(batch.column("text")))})
    if len(rows) > 1 or len(rows[0][2]) <= 2 * shard:
        yield [(*r, 0) for r in rows]
        return
    doc, sub, text = rows[0]
    for at in range(0, len(text) - width + 1, shard):
        yield [(doc, sub, text[at : at + shard + width - 1], at)]


def _repeated(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of ``RUN`` for windows that repeat; h only deals them out."""
    spread = _mixed(start.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(_BASE)).view(np.int64)
    return pa.record_batch([pa.array(spread), pa.nulls(len(doc), pa.int64()), pa.array(doc), pa.array(sub), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["h", "c", "doc", "sub", "start", "n"])


def shard_runs(docs: DataFrame, width: int = WIDTH, shard: int = SHARD, combine: int = COMBINE) -> DataFrame:
    """Rows of ``RUN`` from each shard: runs with windows that no earlier place of the shard has; with c null, stretches of windows that have.

    Of equal runs of about ``combine`` rows of one task only the earliest goes on.
    """

    def earliest(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(held, axis=1)
        by = np.lexsort((x[4], x[3], x[2], x[1], x[0]))
        differs = np.ones(len(by), bool)
        differs[1:] = (x[0, by[1:]] != x[0, by[:-1]]) | (x[1, by[1:]] != x[1, by[:-1]])
        lead = by[np.flatnonzero(differs)[np.cumsum(differs) - 1]]
        again = by[~differs & (x[2:5, by] != x[2:5, lead]).any(axis=0)]  # not the same document once more
        first = x[:, np.sort(by[differs])]  # in the order of documents, which packs well
        yield _batch([*first[:4], *first[4:].astype(np.int32)], RUN)
        yield _repeated(*x[2:, np.sort(again)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in small_batches(batches, "text", shard):
            for rows in _shards(batch, width, shard):
                ids, subs, offsets = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 3))
                text, owner, ends, begin = joined([r[2] for r in rows])
                if not len(text):
                    continue
                begin = begin - offsets
                again = repeats(text, ends, width)
                at, count, h = runs(text, ends, width)
                seen = np.concatenate([[0], np.cumsum(again)])
                new = seen[at + count] - seen[at] < count
                at, count, h = at[new], count[new], h[new]
                c = run_hashes(text.tobytes(), at, count, width)
                own = owner[at]
                held.append(np.stack([h.view(np.int64), c.view(np.int64), ids[own], subs[own], at - begin[own], count]))
                size += len(at)
                low, high = spans(again)  # a window ends inside its document, so no stretch goes on in the next one
                if len(low):
                    yield _repeated(ids[owner[low]], subs[owner[low]], low - begin[owner[low]], high - low)
                if size > combine:
                    yield from earliest(held)
                    held, size = [], 0
        if held:
            yield from earliest(held)

    return docs.mapInArrow(run, RUN)


def sort_out(rows: DataFrame, many: int = HOT) -> DataFrame:
    """doc, sub, start, n, h, kind of the runs: 0 repeats; 1 and 2 first of several different ones with one anchor, 2 of over ``many``."""
    schema = "doc long, sub long, start int, n int, h long, kind int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted; of the anchor at the end of a batch the first rows of each different run are kept for the next batch
        held: np.ndarray = np.zeros((6, 0), np.int64)
        hot = None

        def out(x: np.ndarray, kind: int) -> pa.RecordBatch:
            return _batch([x[2], x[3], x[4].astype(np.int32), x[5].astype(np.int32), x[0], np.full(x.shape[1], kind, np.int32)], schema)

        for batch in batches:
            known = pc.is_valid(batch.column("c")).to_numpy(zero_copy_only=False)
            x = np.stack([(batch.column(k).fill_null(0)).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)])
            yield out(x[:, ~known], 0)
            fresh = np.concatenate([np.zeros(held.shape[1], bool), np.ones(int(known.sum()), bool)])
            x = np.concatenate([held, x[:, known]], axis=1)
            if not x.shape[1]:
                continue
            differs = np.ones(x.shape[1], bool)
            differs[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
            lead = np.flatnonzero(differs)[np.cumsum(differs) - 1]
            same = ~differs & (x[2:5] != x[2:5, lead]).any(axis=0)
            yield out(x[:, same], 0)
            x, fresh = x[:, differs], fresh[differs]
            group = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
            size = np.repeat(np.diff(np.append(group, x.shape[1])), np.diff(np.append(group, x.shape[1])))
            last = np.arange(x.shape[1]) >= group[-1]
            was_hot = x[0] == hot if hot is not None else np.zeros(x.shape[1], bool)
            ended = ~last & ~was_hot
            yield out(x[:, ended & (size > 1) & (size <= many)], 1)
            yield out(x[:, ended & (size > many)], 2)
            yield out(x[:, was_hot & fresh], 2)
            tail = x[:, last]
            if hot is not None and tail[0, 0] == hot:
                held = tail[:, -1:]
            elif tail.shape[1] > many:
                yield out(tail, 2)
                hot, held = tail[0, 0], tail[:, -1:]
            else:
                hot, held = None, tail
        if held.shape[1] > 1 and hot is None:
            yield out(held, 1)

    return rows.repartition("h").sortWithinPartitions("h", "c", "doc", "sub", "start").mapInArrow(run, schema)


def merge_shards(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, sub, start, n: windows of the runs' bytes (h, doc, sub, start, bytes) that also start earlier, for runs that share h."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        # places then are in the order of documents and starts; rows that repeat a document bring each piece again, once is enough
        rows = sorted({r[:4]: r for r in rows}.values(), key=lambda r: r[1:4])
        doc, sub, start = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        text, owner, ends, begin = joined([r[4] for r in rows])
        again = first_places(text, ends, np.arange(len(text)), width)
        low, high = spans(again)
        if len(low):
            own = owner[low]
            yield _batch([doc[own], sub[own], (start[own] + low - begin[own]).astype(np.int32), (high - low).astype(np.int32)], "doc long, sub long, start int, n int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if size > SHARD and row[0] != rows[-1][0]:
                    yield from solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield from solve(rows)

    return pieces.select("h", "doc", "sub", "start", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc long, sub long, start int, n int")


def merge_windows(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """The same for runs of very common anchors: window by window, first places by partial aggregation."""
    schema = "h1 long, h2 long, doc long, sub long, start int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "bytes", 1 << 18):
            doc, sub, start = (batch.column(c).to_numpy() for c in ("doc", "sub", "start"))
            text, owner, ends, begin = joined(utf8(batch.column("bytes")))
            at = np.flatnonzero(np.arange(len(text)) + width <= ends)
            hashes = []
            for bytes_ in (text, text[::-1]):
                total, inverse = _prefix_hash(bytes_)
                low = at if bytes_ is text else len(text) - width - at
                hashes.append(_mixed((total[low + width] - total[low]) * inverse[low]))
            yield _batch([*hashes, doc[owner[at]], sub[owner[at]], (start[owner[at]] + at - begin[owner[at]]).astype(np.int32)], schema)

    windows = pieces.select("doc", "sub", "start", "bytes").mapInArrow(run, schema)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "sub", "start")).alias("f")).select("f.doc", "f.sub", "f.start", F.lit(1).alias("first"))
    # all places less the first ones
    places = windows.select("doc", "sub", "start", F.lit(0).alias("first")).unionByName(first).groupBy("doc", "sub", "start").agg(F.max("first").alias("first"))
    return places.filter("first = 0").select("doc", "sub", "start", F.lit(1).alias("n"))


def repeated_windows(docs: DataFrame, width: int = WIDTH, shard: int = SHARD, many: int = HOT) -> DataFrame:
    """doc, sub, start, n: stretches of n windows from byte ``start`` on that also start earlier; ``docs`` has doc, sub, text."""
    sorted_out = cut(sort_out(shard_runs(docs, width, shard), many), free=True)
    wanted = sorted_out.filter("kind > 0").groupBy("doc", "sub").agg(F.collect_list(F.struct("h", "start", "n", "kind")).alias("runs"))
    found = docs.join(wanted, ["doc", "sub"]).select("doc", "sub", F.col("text").cast("binary").alias("raw"), F.explode("runs").alias("r"))
    pieces = cut(found.select("r.h", "doc", "sub", "r.start", "r.kind", F.expr(f"substring(raw, r.start + 1, r.n + {width - 1})").alias("bytes")), free=True)
    merged = merge_shards(pieces.filter("kind = 1"), width).unionByName(merge_windows(pieces.filter("kind = 2"), width))
    return sorted_out.filter("kind = 0").select("doc", "sub", "start", "n").unionByName(merged)


def covered(size: int, start: list[int], n: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the stretches of windows cover."""
    if not start:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.array(start, np.int64)
    by = np.argsort(low, kind="stable")
    low, high = low[by], np.minimum((low + np.array(n, np.int64) + width - 1)[by], size)
    reach = np.maximum.accumulate(high)
    head = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
    return low[head], reach[np.append(head[1:], len(low)) - 1]


def remove_repeats(docs: DataFrame, width: int = WIDTH, shard: int = SHARD, many: int = HOT, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256.

    With ``keep``, also these columns, the text itself, and kept_text: the whole characters among the remaining bytes.
    """
    keyed = bounded(docs).withColumns({"doc": F.coalesce(docs["doc_id"].cast("long"), F.lit(NONE)), "sub": F.xxhash64(F.coalesce("text", F.lit("")))})
    texts = keyed.select("doc", "sub", F.coalesce("text", F.lit("")).alias("text"))
    found = repeated_windows(texts, width, shard, many).groupBy("doc", "sub").agg(F.collect_list(F.struct("start", "n")).alias("w"))
    given = ["doc_id", "text", *keep]
    both = keyed.select("doc", "sub", *given).join(found, ["doc", "sub"], "left").select(*given, F.col("w.start").alias("_start"), F.col("w.n").alias("_n"))
    new = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}
    if keep:
        new["kept_text"] = pa.string()
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    shown = given if keep else ["doc_id"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in shown] + [f"{c} {kinds[k]}" for c, k in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out: list[list] = []
            for raw, start, n in zip(utf8(batch.column("text")), batch.column("_start").to_pylist(), batch.column("_n").to_pylist()):
                low, high = covered(len(raw), start or [], n or [], width)
                kept = b"".join(raw[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(raw)])) if len(low) else raw
                out.append([len(raw), len(raw) - len(kept), len(low), kept, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")])
            yield pa.record_batch([*(batch.column(c) for c in shown), *(pa.array([r[i] for r in out], k) for i, k in enumerate(new.values()))], [*shown, *new])

    return both.mapInArrow(run, schema)
