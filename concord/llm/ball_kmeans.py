"""Product codes of vectors by ball k-means (operator 13).

Vectors are cut into equal parts; each part position has a codebook that
k-means refines.  An entry and the parts assigned to it are a ball.  After the
entries moved, a task treats each ball of its packet of vectors like this:

* the ball's radius is the greatest distance of its parts to the entry;
  only entries within twice the radius are *neighbour entries*, the others
  cannot be nearest to any of its parts;
* the *stable core*: a part nearer to its entry than half the way to the
  closest neighbour keeps its code without a further distance;
* *annular rings*: beyond the core, a part between half the distances to the
  i-th and the next neighbour is compared with the first i only.

Everything is integer arithmetic on squared distances, so ties are ties, and
the result is that of comparing every part with every entry.

Packets (the vectors of an Arrow batch as one binary, with their codes) are
written once a round together with their partial sums, from which Spark adds
up the new entries; a lost executor costs its running tasks.  The driver sees
the entries only (parts x entries x width numbers).  Superseded rounds are
deleted, so at most two copies of the packets exist.

Defined results: rows with a null vector, or a null or non-finite component,
are left out; vectors of unequal length count as filled up with zeros to the
longest, and that to a multiple of the number of parts; a component counts as
at most ``limit`` (2**27 for 64 components) in size, so that no sum of squares
leaves 64 bits; repeated rows stay, each with its code; a null id stays, and
comes last when the first entries are chosen; with fewer rows than entries
the codebooks have as many entries as rows; equal entries: the lower index
wins; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, saved, ship_package

MAX_LABELS = 100_000            # label totals are broadcast up to this count
SALTS = 32
_KINDS = (np.int16, np.int32, np.int64)


@dataclass
class Codebooks:
    """``entries[part, entry, position]``."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, scale: int, vector: str = "embedding") -> DataFrame:
    """``vectors`` with integer components ``v`` in place of ``vector``;
    rows whose vector has none or holds null or non-finite ones are left out."""
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(x.isNotNull() & ~bad).withColumn("v", F.transform(x, lambda e: F.floor(e.cast("double") * scale))).drop(vector)


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return np.einsum("...i,...i->...", d, d)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every row (ties: lower index) and its squared
    distance, by comparison with all entries."""
    best = squared(x, entries[0])
    code = np.zeros(len(x), np.int64)
    for j in range(1, len(entries)):
        d = squared(x, entries[j])
        closer = d < best
        best[closer], code[closer] = d[closer], j
    return code, best


def reassign(x: np.ndarray, code: np.ndarray, entries: np.ndarray, work: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``nearest``, from codes of an earlier codebook: balls,
    neighbour entries, stable cores and rings.  ``work`` counts the distances
    that were taken beyond a part's own entry."""
    code = code.copy()
    own = squared(x, entries[code])
    best = own.copy()
    between = squared(entries[:, None, :], entries[None, :, :])
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        ball = order[edges[i]:edges[i + 1]]
        if not len(ball):
            continue
        radius = own[ball].max()
        near = np.flatnonzero(between[i] <= 4 * radius)             # neighbour entries
        near = near[near != i]
        near = near[np.argsort(between[i, near], kind="stable")]
        for j in near.tolist():
            ball = ball[4 * own[ball] >= between[i, j]]             # leaves the core and the rings within
            if not len(ball):
                break
            d = squared(x[ball], entries[j])
            if work is not None:
                work["distances"] = work.get("distances", 0) + len(ball)
            closer = (d < best[ball]) | (d == best[ball]) & (j < code[ball])
            best[ball[closer]], code[ball[closer]] = d[closer], j
    return code, best


def partial_sums(x: np.ndarray, code: np.ndarray, n_entries: int) -> np.ndarray:
    """(entry, width + 1): sums of the parts of each entry, and their number."""
    out = np.zeros((n_entries, x.shape[1] + 1), np.int64)
    order = np.argsort(code, kind="stable")
    used, starts = np.unique(code[order], return_index=True)
    if len(used):
        out[used, :-1] = np.add.reduceat(x[order], starts, axis=0)
        out[used, -1] = np.diff([*starts, len(code)])
    return out


def _matrix(column: pa.Array, width: int, limit: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros, held within ``limit``."""
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < length[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return np.clip(out, -limit, limit)


def _small(v: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integer type that holds them."""
    top = int(np.abs(v).max(initial=0))
    return v.astype(next(k for k in _KINDS if top <= np.iinfo(k).max))


class BallKMeans:
    """Codebooks fitted on all rows, and the rows' codes."""

    def __init__(self, parts: int = 8, n_entries: int = 16, rounds: int = 6):
        if not 1 <= n_entries <= 256:
            raise ValueError("a code has two hex digits: 1 to 256 entries")
        self.parts, self.n_entries, self.rounds = parts, n_entries, rounds

    def encode(self, rows: DataFrame, key: str = "vec_id", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
        """(``key``, ``label``, ``code``, ``error``) of every row of (key,
        label, v), and the final codebooks (none for an empty table)."""
        spark = rows.sparkSession
        ship_package(spark)
        kind = rows.schema[label].dataType
        rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), "v")
        longest = rows.agg(F.max(F.size("v"))).first()[0]
        out = T.StructType([T.StructField(key, T.LongType()), T.StructField(label, kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        if longest is None:
            return spark.createDataFrame([], out), None
        width = max(1, -(-longest // self.parts)) * self.parts
        limit = isqrt((1 << 62) // width) // 2
        first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(self.n_entries).select("v").collect()
        seeds = np.clip(np.array([r.v + [0] * (width - len(r.v)) for r in first], dtype=object), -limit, limit).astype(np.int64)
        books = Codebooks(np.ascontiguousarray(seeds.reshape(len(seeds), self.parts, -1).transpose(1, 0, 2)))
        packets = None
        for _ in range(self.rounds):
            step = saved(self._assign(rows, books, width, limit, kind, first=True) if packets is None else self._assign(packets, books, width, limit, kind), "ball-round")
            if packets is not None:
                release(packets)
            packets = step
            books = self._moved(packets, books)
        final = books
        return packets.mapInArrow(self._final(final, kind), out), final

    def _assign(self, source: DataFrame, books: Codebooks, width: int, limit: int, kind: T.DataType, first: bool = False) -> DataFrame:
        entries, parts = books.entries, self.parts

        def read(b: pa.RecordBatch):
            if first:
                v = _matrix(b.column("v"), width, limit)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), b.column(n)) for n in ("id", "label")]
                yield [*lists, _small(v)], v, None
            else:
                for i in range(b.num_rows):
                    packed, codes, size = b.column("vectors")[i].as_py(), b.column("codes")[i].as_py(), b.column("size")[i].as_py()
                    v = np.frombuffer(packed, _KINDS[size])
                    yield [b.column("ids").slice(i, 1), b.column("labels").slice(i, 1), v], v.reshape(-1, width).astype(np.int64), np.frombuffer(codes, np.uint8).reshape(-1, parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for (ids, labels, v), whole, before in read(b):
                    codes, sums = np.zeros((len(whole), parts), np.uint8), []
                    for p, x in enumerate(np.split(whole, parts, axis=1)):
                        code, _ = nearest(x, entries[p]) if before is None else reassign(x, before[:, p].astype(np.int64), entries[p])
                        codes[:, p] = code
                        sums.append(partial_sums(x, code, entries.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [ids, labels, pa.array([v.tobytes()], pa.binary()), pa.array([_KINDS.index(v.dtype.type)], pa.int32()),
                         pa.array([codes.tobytes()], pa.binary()), pa.array([np.stack(sums).astype("<i8").tobytes()], pa.binary())],
                        names=["ids", "labels", "vectors", "size", "codes", "sums"])

        return source.mapInArrow(run, T.StructType([
            T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kind)), T.StructField("vectors", T.BinaryType()),
            T.StructField("size", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("sums", T.BinaryType())]))

    def _moved(self, packets: DataFrame, books: Codebooks) -> Codebooks:
        """Entries at the floor of their parts' mean; unused ones stay.  A
        task sends one number per place of the codebooks."""
        shape = (*books.entries.shape[:2], books.entries.shape[2] + 1)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(int(np.prod(shape)), np.int64)
            for b in batches:
                for s in b.column(0).to_pylist():
                    total += np.frombuffer(s, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "total"])

        sums = packets.select("sums").mapInArrow(add, "place bigint, total bigint").groupBy("place").agg(F.sum("total").alias("total"))
        total = np.zeros(int(np.prod(shape)), np.int64)
        for place, value in sums.collect():                          # parts x entries x (width + 1) numbers
            total[place] = value
        total = total.reshape(shape)
        count = total[..., -1:]
        return Codebooks(np.where(count > 0, total[..., :-1] // np.maximum(count, 1), books.entries))

    def _final(self, books: Codebooks, kind: T.DataType):
        entries, parts = books.entries, self.parts
        width = parts * entries.shape[2]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    v = np.frombuffer(b.column("vectors")[i].as_py(), _KINDS[b.column("size")[i].as_py()]).reshape(-1, width).astype(np.int64)
                    before = np.frombuffer(b.column("codes")[i].as_py(), np.uint8).reshape(-1, parts)
                    codes, error = np.zeros((len(v), parts), np.uint8), np.zeros(len(v), np.int64)
                    for p, x in enumerate(np.split(v, parts, axis=1)):
                        code, d = reassign(x, before[:, p].astype(np.int64), entries[p])
                        codes[:, p] = code
                        error += d
                    text = codes.tobytes().hex()
                    step = 2 * parts
                    yield pa.RecordBatch.from_arrays(
                        [b.column("ids").slice(i, 1).flatten(), b.column("labels").slice(i, 1).flatten(),
                         pa.array([text[k:k + step] for k in range(0, len(text), step)], pa.string()), pa.array(error)],
                        names=["id", "label", "code", "error"])

        return run


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", max_labels: int = MAX_LABELS) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels
    (nulls together).  Totals are few and broadcast up to ``max_labels``;
    beyond, a label's rows are dealt over ``SALTS`` tasks."""
    totals = saved(coded.groupBy(F.col(label).alias("_l")).agg(F.sum(error).alias("label_error")), "label-errors")
    same: Column = coded[label].eqNullSafe(F.col("_l"))
    if totals.count() <= max_labels:
        return coded.join(F.broadcast(totals), same, "left").drop("_l")
    salt = F.pmod(F.xxhash64(*coded.columns), F.lit(SALTS)).cast("int")
    spread = totals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return coded.join(spread, same & (salt == F.col("_s")), "left").drop("_l", "_s")
