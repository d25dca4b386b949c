"""Removal of byte strings that repeat across documents (operator 5).

Maximal repeat groups come from enhanced suffix arrays.  Sorting every
suffix of a corpus in one place does not scale, so windows of ``span`` bytes
are dealt by content first: a window's anchor is the gram of ``GRAM`` bytes
in it with the least hash, and equal windows have equal anchors.  Consecutive
windows of one anchor form a piece (``span`` to 2 * ``span`` - ``GRAM`` bytes).

1. Groups of documents send shards their distinct anchors; a shard answers
   which occur in two documents or more.  (A few equal 40-bit prefixes of
   different anchors only send more along.)
2. Groups send the distinct pieces of those anchors with the least doc_id
   that holds each; copies inside a group are merged, so a passage that a
   third of all documents hold reaches its shard once per group.
3. A shard sorts the suffixes of its pieces (those at least ``span`` long)
   into a suffix array with common-prefix lengths, drops runs of equal
   windows that all continue to the left with one byte (a longer repeat
   holds them), scans the rest with a stack into the tree of common-prefix
   intervals, and keeps the nodes whose occurrences differ in the byte to
   the left: maximal repeat groups, each with all its occurrences.  A piece
   gets back every group it is part of, as (from, to, least doc_id).
4. A group cuts what its documents share with a smaller doc_id.

Since equal windows meet in one shard and every repeated window lies in a
maximal group with all its holders, the bytes removed are exactly those
covered by a ``span``-byte string that also starts in a document with a
smaller doc_id.

Defined results: a null text is empty; a text shorter than ``span`` loses
nothing; rows with a null doc_id come after every id, and lose nothing to
each other, nor do repeated rows of one doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import ship_package
from .groups import binary, dealt, fixed_order, joined, runs

SPAN = 50
GRAM = 20
LAST = np.iinfo(np.int64).max       # stands for a null doc_id
_PLACE = np.uint64((1 << 24) - 1)
_SEGMENT = 500_000                  # windows whose anchors are searched at once
CHARS = 4_000_000                   # of a group of documents


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _words(buffer: np.ndarray, dtype: str) -> np.ndarray:
    """A little-endian integer at every byte."""
    size = np.dtype(dtype).itemsize
    return np.ndarray((max(0, len(buffer) - size + 1),), dtype=dtype, buffer=buffer, strides=(1,))


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` = 8 + 8 + 4 bytes at every place."""
    n = max(0, len(buffer) - GRAM + 1)
    a, b = _words(buffer, "<u8")[:n], _words(buffer, "<u8")[8:8 + n]
    c = _words(buffer, "<u4")[16:16 + n].astype(np.uint64)
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)) ^ b
    return _mix(h + c * np.uint64(0x165667B19E3779F9))


def pieces(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(first byte, end byte, anchor hash, document number) of each piece of
    the documents buffer[starts[i]:ends[i]]."""
    out: list[tuple[np.ndarray, ...]] = []
    width = span - GRAM + 1
    for lo in range(0, len(buffer) - span + 1, _SEGMENT):
        hi = min(lo + _SEGMENT, len(buffer) - span + 1)       # windows lo..hi - 1
        h = gram_hashes(buffer[lo:hi + span - 1])
        least = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < width:                                    # least of every `width` grams
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        at = (least & _PLACE).astype(np.int64)
        doc = int(np.searchsorted(starts, lo, side="right")) - 1
        # windows that stay inside one document, as runs [a, b)
        last = np.searchsorted(starts, hi, side="left")
        d = np.arange(max(doc, 0), last)
        a, b = np.maximum(starts[d], lo) - lo, np.minimum(ends[d] - span + 1, hi) - lo
        d, a, b = d[b > a], a[b > a], b[b > a]
        if not len(d):
            continue
        change = np.zeros(hi - lo + 1, bool)
        change[1:-1] = at[1:] != at[:-1]
        change[a] = True
        change[b] = True
        cut = np.flatnonzero(change)
        cut = np.concatenate([[0], cut]) if not len(cut) or cut[0] else cut
        cut = np.concatenate([cut, [hi - lo]]) if cut[-1] != hi - lo else cut
        first, end = cut[:-1], cut[1:]
        k = np.searchsorted(a, first, side="right") - 1
        inside = (k >= 0) & (first < b[np.maximum(k, 0)])
        first, end, k = first[inside], end[inside], k[inside]
        out.append((first + lo, end + lo + span - 1, h[at[first]], d[k]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(buffer: np.ndarray, first: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Pieces as rows, zero beyond their ends."""
    padded = np.concatenate([buffer, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[first]
    rows[np.arange(width) >= length[:, None]] = 0
    return rows


def _width(span: int) -> int:
    return -(-(2 * span - GRAM) // 8) * 8


def distinct_rows(rows: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each content, its least doc, content number of each row)."""
    words = rows.view("<u8")
    h = length.astype(np.uint64)
    for k in range(words.shape[1]):
        h = _mix(h + words[:, k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k))
    _, number = np.unique(h, return_inverse=True)
    order = np.lexsort((doc, number))
    first = order[np.concatenate([[True], np.diff(number[order]) > 0])] if len(order) else order
    if not ((words == words[first[number]]).all() and (length == length[first[number]]).all()):
        raise RuntimeError("two pieces share a 64-bit hash")
    return first, doc[first], number


# --- the enhanced suffix array of a shard --------------------------------

def suffix_array(rows: np.ndarray, length: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``span`` bytes, sorted by those bytes: (piece,
    offset, starts a new run of equal ``span``-byte prefixes).  Refined word
    by word; a suffix that stands alone is in place."""
    n = length - span + 1
    piece = np.repeat(np.arange(len(length)), n)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    flat = rows.reshape(-1)
    at = piece * rows.shape[1] + offset
    big = _words(flat, ">u8")
    order = np.argsort(big[at].astype(np.uint64), kind="stable")
    keys = big[at[order]].astype(np.uint64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    depth = 8
    while depth < span:
        depth = min(depth + 8, span)
        run = np.cumsum(new)
        alone = new & np.concatenate([new[1:], [True]]) if len(new) else new
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        keys = big[at[order[open_]] + depth - 8].astype(np.uint64)
        sub = np.lexsort((keys, run[open_]))
        order[open_] = order[open_[sub]]
        keys, run_ = keys[sub], run[open_]
        again = np.concatenate([[True], (keys[1:] != keys[:-1]) | (run_[1:] != run_[:-1])])
        new[open_] = again
    return piece[order], offset[order], new


def common_prefix(rows: np.ndarray, length: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], span: int) -> np.ndarray:
    """Common-prefix lengths of suffix pairs that agree in ``span`` bytes."""
    width = rows.shape[1]
    most = np.minimum(length[a[0]] - a[1], length[b[0]] - b[1])
    out = np.minimum(span, most)
    live = np.flatnonzero(out < most)
    while len(live):
        same = rows[a[0][live], np.minimum(a[1][live] + out[live], width - 1)] == rows[b[0][live], np.minimum(b[1][live] + out[live], width - 1)]
        live = live[same]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


def interval_tree(lcp: list[int], left: list[int], new_run: list[bool]) -> Iterator[tuple[int, int, int]]:
    """Stack scan over suffixes of runs that agree in ``span`` bytes:
    (depth, first, end) of every common-prefix interval whose members differ
    in the byte to the left (-1: nothing to the left, differs from all).
    ``lcp[i]`` is that of suffix i and the one before, 0 at a new run."""
    stack: list[list] = []          # [depth, first, left byte or None if they differ]
    n = len(left)
    for i in range(1, n + 1):
        depth = 0 if i == n or new_run[i] else lcp[i]
        byte = left[i - 1] if left[i - 1] >= 0 else None
        first = i - 1
        if stack:
            top = stack[-1]
            top[2] = top[2] if top[2] == byte else None
        while stack and depth < stack[-1][0]:
            d, first, seen = stack.pop()
            if seen is None:
                yield d, first, i
            if stack and stack[-1][0] >= depth:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else None
            byte = seen
        if depth and (not stack or stack[-1][0] < depth):
            stack.append([depth, first, byte])


def maximal_repeats(rows: np.ndarray, length: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeat groups of distinct pieces: (length of the common
    string, pieces, offsets), all occurrences of each."""
    piece, offset, new = suffix_array(rows, length, span)
    if not len(piece):
        return
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    before = np.where(offset > 0, rows[piece, np.maximum(offset - 1, 0)].astype(np.int16), -1)
    starts = np.flatnonzero(new)
    low, high = np.minimum.reduceat(before, starts), np.maximum.reduceat(before, starts)
    keep = ((size > 1) & ((low < 0) | (low != high)))[run]
    piece, offset, new, before = piece[keep], offset[keep], new[keep], before[keep]
    if not len(piece):
        return
    # inside a run the rest of each suffix decides the order
    at = np.minimum(offset + span, rows.shape[1])
    tail_width = rows.shape[1] - span
    padded = np.concatenate([rows, np.zeros((len(rows), tail_width), np.uint8)], axis=1)
    tails = np.lib.stride_tricks.sliding_window_view(padded, tail_width, axis=1)[piece, at]
    words = np.concatenate([tails, np.zeros((len(tails), -tail_width % 8), np.uint8)], axis=1).view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], np.cumsum(new)))
    piece, offset, before = piece[order], offset[order], before[order]
    lcp = np.zeros(len(piece), np.int64)
    lcp[1:] = common_prefix(rows, length, (piece[1:], offset[1:]), (piece[:-1], offset[:-1]), span)
    for depth, a, b in interval_tree(lcp.tolist(), before.tolist(), new.tolist()):
        yield depth, piece[a:b], offset[a:b]


def coverage(rows: np.ndarray, length: np.ndarray, doc: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(piece, from, to, least doc) of every maximal repeat group that
    reaches a smaller doc than the piece itself has."""
    out: list[tuple[np.ndarray, ...]] = []
    for depth, p, o in maximal_repeats(rows, length, span):
        least = doc[p].min()
        lose = doc[p] > least
        if lose.any():
            p, o = p[lose], o[lose]
            out.append((p, o, o + depth, np.full(len(p), least)))
    z = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (z, z, z, z)


# --- the distributed operator --------------------------------------------

class Group:
    """Bytes and pieces of a group of documents."""

    def __init__(self, table: pa.Table, span: int, shards: int):
        tokens.encoder.cache_clear()        # a reused worker may still hold words of a packing task
        self.table = fixed_order(table)
        self.ids = self.table.column("doc_id").to_pylist()
        self.raw = [t.encode("utf-8", "surrogatepass") for t in self.table.column("text").to_pylist()]
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.buffer = np.frombuffer(b"".join(self.raw), np.uint8)
        self.doc = np.array([LAST if d is None else d for d in self.ids], np.int64)
        self.first, self.last, self.anchor, self.owner = pieces(self.buffer, self.start, self.end, span)
        self.shard = ((self.anchor >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (shard, 40 bits of the anchor) in shard order, whether
        two documents of the group have it, its number for each piece."""
        key = self.anchor & np.uint64(0xFFFFFFFFFF)
        order = np.lexsort((self.doc[self.owner], key, self.shard))
        k, s, d = key[order], self.shard[order], self.doc[self.owner[order]]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        several = np.maximum.reduceat(d, starts) != np.minimum.reduceat(d, starts) if len(starts) else np.zeros(0, bool)
        number = np.empty(len(k), np.int64)
        number[order] = np.cumsum(new) - 1
        return k[new], s[new], several, number

    def repeated(self, masks: dict[int, bytes]) -> np.ndarray:
        """Numbers of the pieces whose anchor the shards called repeated."""
        key, shard, _, number = self.anchors()
        if not len(key):
            return np.zeros(0, np.int64)
        flags = [np.unpackbits(np.frombuffer(masks[s], np.uint8), count=at.stop - at.start) for s, at in zip(*_listed(shard))]
        return np.flatnonzero(np.concatenate(flags).astype(bool)[number])

    def distinct(self, chosen: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
        """Distinct contents of chosen pieces, in shard order: (rows,
        lengths, least doc, shard, number of each chosen piece)."""
        length = self.last[chosen] - self.first[chosen]
        rows = _matrix(self.buffer, self.first[chosen], length, _width(span)) if len(chosen) else np.zeros((0, _width(span)), np.uint8)
        first, doc, number = distinct_rows(rows, length, self.doc[self.owner[chosen]])
        shard = self.shard[chosen[first]]
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return rows[first][order], length[first][order], doc[order], shard[order], place[number]


def _listed(shard: np.ndarray) -> tuple[list[int], list[slice]]:
    values, places = runs(shard)
    return values.tolist(), places


def _packed(rows: np.ndarray, length: np.ndarray) -> bytes:
    return rows[np.arange(rows.shape[1]) < length[:, None]].tobytes()


def shared_spans(docs: DataFrame, span: int = SPAN, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``text`` (bytes), ``spans`` (packed
    int64 pairs from, to: the maximal runs to remove), and the columns
    ``carry`` as ``c0``, ``c1``..."""
    def finish(ids: list[int | None], raw: list[bytes], spans: list[bytes], carried: dict[str, pa.ChunkedArray]) -> pa.Table:
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": binary(raw), "spans": binary(spans), **carried})

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("spans", T.BinaryType())])
    return _cut(docs, span, text, key, carry, finish, schema)


def _cut(docs: DataFrame, span: int, text: str, key: str, carry: list[str] | None, finish: Callable[..., pa.Table], schema: T.StructType) -> DataFrame:
    """What ``finish`` makes of the ids, bytes, packed spans and carried
    columns of a group of documents: rows of ``schema`` and these columns."""
    if span < GRAM + 1 or 2 * span - GRAM > 255:
        raise ValueError(f"span must be {GRAM + 1} to {(255 + GRAM) // 2}")
    ship_package(docs.sparkSession)
    rows, n = dealt(docs, text, key, carry, CHARS)
    carried = [c for c in rows.columns if c not in ("grp", "doc_id", "text")]

    def say_anchors(table: pa.Table) -> pa.Table:
        g = Group(table, span, n)
        keys, shard, several, _ = g.anchors()
        shards, places = _listed(shard)
        parts = [(keys[at], several[at]) for at in places]
        return pa.table({"grp": pa.array([table.column("grp")[0].as_py()] * len(parts), pa.int64()), "shard": pa.array(shards, pa.int64()),
                         "low": binary([k.astype("<u4").tobytes() for k, _ in parts]),
                         "high": binary([(k >> np.uint64(32)).astype("u1").tobytes() for k, _ in parts]),
                         "several": binary([np.packbits(m).tobytes() for _, m in parts])})

    def find_repeated(table: pa.Table) -> pa.Table:
        low, cut = joined(table.column("low"), "<u4")
        high, _ = joined(table.column("high"), "u1")
        keys = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
        twice = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=c) for m, c in zip(table.column("several").to_pylist(), cut)])
        uniq, number = np.unique(keys, return_inverse=True)
        found = (np.bincount(number, weights=1 + twice, minlength=len(uniq)) > 1)[number]
        return pa.table({"grp": table.column("grp"), "kind": pa.array([0] * len(cut), pa.int32()), "shard": table.column("shard"),
                         "a": binary([np.packbits(f).tobytes() for f in np.split(found, np.cumsum(cut)[:-1])]),
                         "b": binary([b""] * len(cut)), "c": binary([b""] * len(cut))})

    def masks_of(replies: pa.Table) -> dict[int, bytes]:
        return dict(zip(replies.column("shard").to_pylist(), replies.column("a").to_pylist()))

    def say_pieces(docs_of: pa.Table, replies: pa.Table) -> pa.Table:
        g = Group(docs_of, span, n)
        chosen = g.repeated(masks_of(replies))
        content, length, doc, shard, _ = g.distinct(chosen, span)
        shards, cut = _listed(shard)
        return pa.table({"grp": pa.array([docs_of.column("grp")[0].as_py()] * len(cut), pa.int64()), "shard": pa.array(shards, pa.int64()),
                         "content": binary([_packed(content[c], length[c]) for c in cut]),
                         "length": binary([length[c].astype("u1").tobytes() for c in cut]),
                         "doc": binary([doc[c].astype("<i8").tobytes() for c in cut])})

    def find_groups(table: pa.Table) -> pa.Table:
        length, cut = joined(table.column("length"), "u1")
        length = length.astype(np.int64)
        doc, _ = joined(table.column("doc"), "<i8")
        buffer, _ = joined(table.column("content"), "u1")
        content = _matrix(buffer, np.cumsum(length) - length, length, _width(span)) if len(length) else np.zeros((0, _width(span)), np.uint8)
        first, least, number = distinct_rows(content, length, doc)
        content, length = content[first], length[first]
        p, a, b, m = coverage(content, length, least, span)
        order = np.argsort(p, kind="stable")
        p, spans = p[order], np.stack([a, b, m], axis=1)[order].astype("<i8")
        count = np.bincount(p, minlength=len(first))
        starts = np.cumsum(count) - count
        out_a, out_b, out_c = [], [], []
        for of in np.split(number, np.cumsum(cut)[:-1]):        # the pieces of one group of documents
            reps = count[of]
            where = np.repeat(starts[of] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            out_a.append(least[of].astype("<i8").tobytes())
            out_b.append(reps.astype("<u4").tobytes())
            out_c.append(spans[where].tobytes())
        return pa.table({"grp": table.column("grp"), "kind": pa.array([1] * len(cut), pa.int32()), "shard": table.column("shard"),
                         "a": binary(out_a), "b": binary(out_b), "c": binary(out_c)})

    def cut_documents(docs_of: pa.Table, replies: pa.Table) -> pa.Table:
        g = Group(docs_of, span, n)
        kinds = np.array(replies.column("kind").to_pylist(), dtype=np.int64)
        chosen = g.repeated(masks_of(replies.filter(pa.array(kinds == 0, pa.bool_()))))
        _, _, _, _, number = g.distinct(chosen, span)
        found = replies.filter(pa.array(kinds == 1, pa.bool_())).sort_by("shard")
        least, _ = joined(found.column("a"), "<i8")
        reps, _ = joined(found.column("b"), "<u4")
        spans = joined(found.column("c"), "<i8")[0].reshape(-1, 3)
        change = np.zeros(len(g.buffer) + 1, np.int32)
        mine = g.doc[g.owner[chosen]]
        whole = least[number] < mine
        np.add.at(change, g.first[chosen[whole]], 1)
        np.add.at(change, g.last[chosen[whole]], -1)
        # groups of unequal pieces
        rest = np.flatnonzero(~whole)
        starts = np.cumsum(reps.astype(np.int64)) - reps
        k = reps[number[rest]].astype(np.int64)
        occurrence = np.repeat(rest, k)
        which = np.repeat(starts[number[rest]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        hit = spans[which, 2] < mine[occurrence]
        occurrence, which = occurrence[hit], which[hit]
        np.add.at(change, g.first[chosen[occurrence]] + spans[which, 0], 1)
        np.add.at(change, g.first[chosen[occurrence]] + spans[which, 1], -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for s, e in zip(g.start.tolist(), g.end.tolist()):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[s:e], [False]]).astype(np.int8)))
            out.append(edge.astype("<i8").tobytes())
        return finish(g.ids, g.raw, out, {c: g.table.column(c) for c in carried})

    masks = (rows.groupBy("grp").applyInArrow(say_anchors, "grp bigint, shard bigint, low binary, high binary, several binary")
             .groupBy("shard").applyInArrow(find_repeated, _REPLY))
    found = (rows.groupBy("grp").cogroup(masks.groupBy("grp")).applyInArrow(say_pieces, "grp bigint, shard bigint, content binary, length binary, doc binary")
             .groupBy("shard").applyInArrow(find_groups, _REPLY))
    return rows.groupBy("grp").cogroup(masks.unionByName(found).groupBy("grp")).applyInArrow(
        cut_documents, T.StructType([*schema, *[rows.schema[c] for c in carried]]))


_REPLY = "grp bigint, kind int, shard bigint, a binary, b binary, c binary"


def kept_bytes(raw: bytes, spans: bytes) -> bytes:
    edges = np.frombuffer(spans, "<i8").tolist()
    return b"".join(raw[a:b] for a, b in zip([0, *edges[1::2]], [*edges[0::2], len(raw)]))


def whole_characters(raw: bytes, spans: bytes) -> str:
    """What is left as text: a run that starts or ends inside a character
    leaves that character in place."""
    edges = np.frombuffer(spans, "<i8").tolist()
    out, at = [], 0
    for a, b in zip(edges[0::2], edges[1::2]):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, span: int = SPAN, text: str = "text", key: str = "doc_id", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeats cut out of the text (whole characters only) and
    the length column, if there is one, counted anew; all rows and columns
    stay, a null text stays null."""
    columns = docs.columns
    others = [c for c in columns if c != text]
    place = {c: f"c{i}" for i, c in enumerate(others)}
    unset, flag = f"c{len(others)}", "__unset"
    while flag in columns:
        flag += "_"

    # the text travels once, and is cut in the task that found its spans
    def finish(ids: list[int | None], raw: list[bytes], spans: list[bytes], carried: dict[str, pa.ChunkedArray]) -> pa.Table:
        new = [None if gone else whole_characters(r, s) for gone, r, s in zip(carried[unset].to_pylist(), raw, spans)]
        return pa.table({"__text": pa.array(new, pa.string()), **carried})

    flagged = docs.withColumn(flag, F.col(text).isNull())
    out = _cut(flagged, span, text, key, [*others, flag], finish, T.StructType([T.StructField("__text", T.StringType())]))
    kind = {c: docs.schema[c].dataType for c in columns}
    return out.select(*[F.col("__text").cast(kind[c]).alias(c) if c == text
                        else F.length("__text").cast(kind[c]).alias(c) if c == n_chars else F.col(place[c]).alias(c) for c in columns])


def digest(spans: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, raw, cut in zip(*(b.column(i).to_pylist() for i in range(3))):
                edges = np.frombuffer(cut, "<i8")
                out.append((doc, len(raw), int((edges[1::2] - edges[0::2]).sum()), len(edges) // 2, hashlib.sha256(kept_bytes(raw, cut)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.string(),))],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
