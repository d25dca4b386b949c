"""Token-id files with directly addressable codes (operator 9).

An id is cut into chunks of fixed bit widths.  Level k stores, for every
value that reaches it, one chunk, and a bitmap says whether the value goes
on to level k + 1; a rank directory over each bitmap gives a value's place
in the next level.  Any id can thus be read by itself, without decoding
what stands before it.

File format: a Parquet table in the given folder, one row per segment of
about ``segment_ids`` ids in ascending document order: ``part`` (range
partition), ``seq`` (segment within it), ``n_ids``, ``local_start`` (ids
before it in its part), ``doc_ids``, ``doc_lengths`` (packed integers) and
``payload``, the self-contained code image of ``encode``.

Defined results: a null or empty text has the end token alone; documents
are ordered by doc_id (null first), equal ids by a hash of the text and the
text, so repeated rows stand side by side; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, shuffle_partitions, texts
from .tokens import chunks, encoder

WIDTHS = (8, 8, 16)
BLOCK = 64                       # bitmap bytes per entry of the rank directory
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)

SEGMENTS = T.StructType([
    T.StructField("part", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("n_ids", T.LongType(), False),
    T.StructField("local_start", T.LongType(), False),
    T.StructField("doc_ids", T.BinaryType(), False),
    T.StructField("doc_known", T.BinaryType(), False),
    T.StructField("doc_lengths", T.BinaryType(), False),
    T.StructField("payload", T.BinaryType(), False),
])
_SEGMENTS_ARROW = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("local_start", pa.int64()),
                             ("doc_ids", pa.binary()), ("doc_known", pa.binary()), ("doc_lengths", pa.binary()), ("payload", pa.binary())])
READ = T.StructType([
    T.StructField("part", T.LongType(), False),
    T.StructField("doc_id", T.LongType()),
    T.StructField("local_start", T.LongType(), False),
    T.StructField("n_tokens", T.LongType(), False),
    T.StructField("ids_crc32", T.LongType(), False),
])
_READ_ARROW = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def encode(values: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The code image of unsigned 32-bit values."""
    head, body = [struct.pack("<4sQB", b"DAC1", len(values), len(widths))], []
    rest = values.astype(np.uint32)
    for k, width in enumerate(widths):
        chunk = rest & np.uint32((1 << width) - 1)
        rest = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        last = k == len(widths) - 1
        if last and rest.any():
            raise ValueError("a value is wider than all chunks")
        more = rest != 0
        bitmap = b"" if last else np.packbits(more, bitorder="little").tobytes()
        ranks = b"" if last else _ranks(np.frombuffer(bitmap, np.uint8)).tobytes()
        kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32
        data = chunk.astype(kind).tobytes()
        head.append(struct.pack("<BQQQQ", width, len(chunk), len(data), len(bitmap), len(ranks)))
        body += [data, bitmap, ranks]
        rest = rest[more]
    return b"".join(head + body)


def _ranks(bitmap: np.ndarray) -> np.ndarray:
    """Ones before each block of the bitmap."""
    ones = np.concatenate([_ONES[bitmap], np.zeros(-len(bitmap) % BLOCK, np.uint8)]).reshape(-1, BLOCK).sum(1, dtype=np.uint64)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u8")


class Codes:
    """Read access to a code image; nothing is decoded ahead of a request."""

    def __init__(self, image: bytes):
        magic, self.n, levels = struct.unpack_from("<4sQB", image)
        if magic != b"DAC1":
            raise ValueError("not a code image")
        at = struct.calcsize("<4sQB")
        sizes = [struct.unpack_from("<BQQQQ", image, at + i * struct.calcsize("<BQQQQ")) for i in range(levels)]
        at += levels * struct.calcsize("<BQQQQ")
        self.levels = []
        for width, count, data, bitmap, ranks in sizes:
            kind = "<u1" if width <= 8 else "<u2" if width <= 16 else "<u4"
            self.levels.append((width, np.frombuffer(image, kind, count, at), np.frombuffer(image, "u1", bitmap, at + data),
                                np.frombuffer(image, "<u8", ranks // 8, at + data + bitmap)))
            at += data + bitmap + ranks

    def __getitem__(self, i: int) -> int:
        return int(self.take(np.array([i]))[0])

    def take(self, where: np.ndarray) -> np.ndarray:
        """Values at any places, in the order asked for."""
        out = np.zeros(len(where), dtype=np.uint32)
        open_, at, shift = np.arange(len(where)), np.asarray(where, dtype=np.int64), 0
        for k, (width, data, bitmap, ranks) in enumerate(self.levels):
            out[open_] |= data[at].astype(np.uint32) << np.uint32(shift)
            if k == len(self.levels) - 1 or not len(open_):
                break
            more = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            open_, at = open_[more], _rank(bitmap, ranks, at[more])
            shift += width
        return out

    def all(self) -> np.ndarray:
        """Every value, level by level, without rank queries."""
        out = None
        open_, shift = None, 0
        for k, (width, data, bitmap, _) in enumerate(self.levels):
            if out is None:
                out, open_ = data.astype(np.uint32), np.arange(self.n)
            else:
                out[open_] |= data.astype(np.uint32) << np.uint32(shift)
            if k < len(self.levels) - 1:
                open_ = open_[np.unpackbits(bitmap, bitorder="little", count=len(data)).astype(bool)]
                shift += width
        return out


def _rank(bitmap: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ones before each place: the directory, whole bytes of its block, bits."""
    if not len(at):
        return at
    byte = at >> 3
    block = byte // BLOCK
    out = ranks[block].astype(np.int64)
    for step in range(BLOCK):
        inside = block * BLOCK + step < byte
        if not inside.any():
            break
        out[inside] += _ONES[bitmap[(block * BLOCK + step)[inside]]]
    return out + _ONES[bitmap[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, blanks_matter: bool = False,
          segment_ids: int = 2_000_000, text: str = "text", key: str = "doc_id", added_tokens: bool = True) -> None:
    """Encode every document and write the token files to ``path``, in
    ascending document order across and within files."""
    spark = docs.sparkSession
    ship_package(spark)
    end = end_id.to_bytes(4, "little")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer_path, blanks_matter, added_tokens)
        names, codes, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, before, names, codes, held
            ids = np.frombuffer(b"".join(codes), "<u4")
            row = (part, seq, len(ids), before, np.array([n or 0 for n in names], "<i8").tobytes(),
                   np.packbits(np.array([n is not None for n in names])).tobytes(),
                   np.array([len(c) // 4 for c in codes], "<i8").tobytes(), encode(ids))
            seq, before, names, codes, held = seq + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SEGMENTS_ARROW.types)], schema=_SEGMENTS_ARROW)

        for b in batches:
            ids, all_texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in chunks(all_texts):
                for doc, code in zip(ids[lo:hi], enc.encode_many(all_texts[lo:hi])):
                    names.append(doc)
                    codes.append(code + end)
                    held += len(code) // 4 + 1
                    if held >= segment_ids:
                        yield close()
        enc.trim()
        if names:
            yield close()

    tie = F.xxhash64("text")
    ordered = (texts(docs, text, key)
               .repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), tie)
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text"))
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start`` (ids before
    it in the whole output), ``n_tokens``, ``ids_crc32``."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    # one total per range partition: as many numbers as write tasks
    starts, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_ids")).collect()):
        starts[part], total = total, total + n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = Codes(r["payload"]).all().astype("<u4")
                n = np.frombuffer(r["doc_lengths"], "<i8")
                ends = np.cumsum(n)
                firsts = ends - n
                raw = memoryview(ids).cast("B")
                known = np.unpackbits(np.frombuffer(r["doc_known"], np.uint8), count=len(n)).astype(bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), r["part"])), pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=~known),
                    pa.array(firsts + r["local_start"] + starts[r["part"]]), pa.array(n),
                    pa.array([zlib.crc32(raw[4 * a:4 * e]) for a, e in zip(firsts.tolist(), ends.tolist())], pa.int64())], schema=_READ_ARROW)

    return files.mapInArrow(documents, READ).select("doc_id", F.col("local_start").alias("start"), "n_tokens", "ids_crc32")
