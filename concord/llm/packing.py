"""Packing token ids into fixed-length training sequences (operator 10).

Bounded-space online packing: each partition reads its documents once and
keeps at most ``open_windows`` partly filled windows.  A document's pieces
of a full window leave at once; its rest goes to the open window it fits
best; when none fits and no further window may be opened, the fullest window
is filled up with a cut of the rest and emitted.  What is still open at the
end of a partition is merged into full windows, less than one window per
partition remains, and these remainders are merged across groups of
``merge_fanin`` partitions; a group's last remainder is cut into power-of-two
sequences, which need no padding.

Defined results: a null or empty text is the end token alone; repeated rows
are packed each; a null id stays null; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, ship_package, texts
from .tokens import chunks, encoder

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("ids_crc32", T.LongType(), False),
    T.StructField("doc_tokens", T.LongType(), False),
    T.StructField("sequence_id", T.LongType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("ids", T.BinaryType()),
    T.StructField("part", T.LongType()),
])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()),
])
# a piece: (doc_id, start, ids as bytes, tokens of its document)
Piece = tuple


class Packer:
    """Windows of one partition; ``rows`` collects finished sequences."""

    def __init__(self, size: int, open_windows: int, first_sequence: int, keep_ids: bool):
        self.size, self.limit, self.next_id, self.keep_ids = size, open_windows, first_sequence, keep_ids
        self.free: list[tuple[int, int]] = []      # (free tokens, window number), sorted
        self.windows: dict[int, list[Piece]] = {}
        self.opened = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, ids if self.keep_ids else None, None))
            offset += n
        self.next_id += 1

    def add(self, doc, ids: bytes, start: int = 0, total: int | None = None) -> None:
        size, at, end = self.size, 0, len(ids) // 4
        total = end if total is None else total
        while end - at >= size:
            self.emit([(doc, start + at, ids[4 * at:4 * (at + size)], total)])
            at += size
        while at < end:
            need = end - at
            i = bisect_left(self.free, (need, -1))
            if i < len(self.free):
                room, w = self.free.pop(i)            # best fit
            elif len(self.free) < self.limit:
                room, w = size, self.opened
                self.opened += 1
                self.windows[w] = []
            else:
                room, w = self.free.pop(0)            # none fits: the fullest leaves, filled up
            take = min(need, room)
            self.windows[w].append((doc, start + at, ids[4 * at:4 * (at + take)], total))
            at += take
            if take == room:
                self.emit(self.windows.pop(w))
            else:
                insort(self.free, (room - take, w))

    def merge_open(self) -> list[Piece]:
        """Join the open windows, fullest first, into full ones; returns the
        pieces of the remainder (fewer than ``size`` tokens)."""
        rest = [p for _, w in self.free for p in self.windows[w]]
        self.free, self.windows = [], {}
        return self.fill(rest, self.size)

    def fill(self, pieces: list[Piece], size: int) -> list[Piece]:
        """Emit windows of exactly ``size`` from the pieces in order."""
        now: list[Piece] = []
        have = 0
        for doc, start, ids, total in pieces:
            at, end = 0, len(ids) // 4
            while at < end:
                take = min(end - at, size - have)
                now.append((doc, start + at, ids[4 * at:4 * (at + take)], total))
                at, have = at + take, have + take
                if have == size:
                    self.emit(now)
                    now, have = [], 0
        return now


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = 2048, open_windows: int = 32,
         blanks_matter: bool = True, merge_fanin: int = 256, keep_ids: bool = True, text: str = "text", key: str = "doc_id", added_tokens: bool = True) -> DataFrame:
    """One row per piece: which ids of which document stand where in which
    sequence (``sequence_id``, ``offset``), with the ids themselves as
    little-endian unsigned 32-bit ``ids`` unless ``keep_ids`` is false.
    With ids, every sequence is written, and ``length`` and ``ids_crc32`` are
    those of the ids read back."""
    spark = docs.sparkSession
    ship_package(spark)
    end = end_id.to_bytes(4, "little")

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path, blanks_matter, added_tokens)
        packer = Packer(size, open_windows, pid << 32, keep_ids)
        for b in batches:
            ids, all_texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in chunks(all_texts):
                for doc, code in zip(ids[lo:hi], enc.encode_many(all_texts[lo:hi])):
                    packer.add(doc, code + end)
                yield from _batches(packer.rows)
                packer.rows = []
        enc.trim()
        tail = packer.merge_open()
        packer.rows += [(doc, start, len(i) // 4, zlib.crc32(i), total, -1, 0, i, pid) for doc, start, i, total in tail]
        yield from _batches(packer.rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task holds whole groups, sorted; one group is open at a time."""
        group, pieces = None, []

        def close() -> Iterator[pa.RecordBatch]:
            packer = Packer(size, 1, (1 << 62) + (group << 32), keep_ids)
            rest = packer.fill(pieces, size)
            left = sum(len(p[2]) // 4 for p in rest)
            while left:
                power = 1 << (left.bit_length() - 1)
                before = packer.next_id
                tail = packer.fill(_head(rest, power), power)
                assert not tail and packer.next_id == before + 1
                rest, left = _drop(rest, power), left - power
            yield from _batches(packer.rows)

        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("doc_id", "start", "ids", "doc_tokens", "part")}
            for doc, start, ids, total, part in zip(*cols.values()):
                if group is not None and part // merge_fanin != group:
                    yield from close()
                    pieces = []
                group = part // merge_fanin
                pieces.append((doc, start, ids, total))
        if group is not None:
            yield from close()

    packed = saved(texts(docs, text, key).mapInArrow(partition, PIECES), "pack")
    tails = packed.where("sequence_id = -1")
    group = F.floor(F.col("part") / merge_fanin)
    merged = (tails.repartition(group)
              .sortWithinPartitions(group, "part", F.col("doc_id").asc_nulls_first(), "start", "doc_tokens", "ids_crc32")
              .mapInArrow(merge, PIECES))
    if not keep_ids:
        return packed.where("sequence_id <> -1").unionByName(merged).drop("part", "ids")
    out = packed.where("sequence_id <> -1").unionByName(saved(merged, "pack-merged")).drop("part")
    return out.withColumn("length", F.floor(F.length("ids") / 4)).withColumn("ids_crc32", F.crc32("ids"))


def _head(pieces: list[Piece], n: int) -> list[Piece]:
    out = []
    for doc, start, ids, total in pieces:
        if n <= 0:
            break
        take = min(n, len(ids) // 4)
        out.append((doc, start, ids[:4 * take], total))
        n -= take
    return out


def _drop(pieces: list[Piece], n: int) -> list[Piece]:
    out = []
    for doc, start, ids, total in pieces:
        take = min(n, len(ids) // 4)
        n -= take
        if take < len(ids) // 4:
            out.append((doc, start + take, ids[4 * take:], total))
    return out
