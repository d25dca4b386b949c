"""Hard-negative mining by slot-decomposed selection (operator 11).

Anchors are a stated query set; every anchor is scored against all rows, in
blocks.  Two passes:

1. *Positives*: the first ``n_positives`` other rows of the anchor's label.
2. *Negatives*: the positives' scores are the upper limits of windows that
   overlap.  They split the scores into disjoint slots, from the highest:
   slot j holds what lies above limit j + 1 and not above limit j.  A task
   keeps the first ``k`` rows of each slot of its block (the combiner); these
   are merged per (anchor, slot); and since all of slot j comes before all of
   slot j + 1, the first k of slots j, j + 1, ... is the answer to every
   window whose upper limit is j: its lower limit then cuts the tail.

Blocks hold at most about ``block_rows`` rows and ``block_anchors`` anchors,
dealt by a hash, so no label, vector or id makes a task larger than others.
A row goes to one task per block of anchors.  A pass returns k rows a slot
and block, whatever the ties.

Scores are integer inner products of floor(scale * x), exact: products whose
bound stays below 2**53 are computed in doubles, others in 64-bit or Python
integers; a score beyond 64 bits counts as the nearest 64-bit value.

Defined results: rows with a null label, a null vector, or a null or
non-finite component take no part; a component whose scaled floor leaves 64
bits counts as the nearest 64-bit value; a shorter vector counts as filled
up with zeros; repeated equal rows (id, label, vector) count once, rows that
share only the id are rows of their own; a null id comes last among ties and
is never an anchor; an anchor without positives, an empty window and an empty
table give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship_package

BLOCK_ROWS = 8192
BLOCK_ANCHORS = 2048
NO_ID = np.iinfo(np.int64).max
_SLICE = 2_000_000              # scores held at once
_FOUND = "anchor bigint, tag bigint, slot int, id bigint, score bigint"
_FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("tag", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def integer_rows(vectors: DataFrame, scale: int, label: Column, anchor: Column, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, label, v, is_anchor) of the rows that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(label.isNotNull() & x.isNotNull() & ~bad).select(
        F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
        F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))


class Block:
    """Distinct rows of a block by ascending id, vectors as one matrix."""

    def __init__(self, table: pa.Table, width: int, tags: bool = False):
        ids = table.column("id").to_numpy(zero_copy_only=False) if not table.column("id").null_count else table.column("id").fill_null(NO_ID).to_numpy()
        label = table.column("label").to_numpy()
        flat = table.column("v").combine_chunks()
        length = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        self.v = np.zeros((len(ids), width), np.int64)
        self.v[np.arange(width) < length[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((*self.v.T[::-1], label, ids)) if len(ids) and len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
        ids, label, v = ids[order], label[order], self.v[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (label[1:] != label[:-1]) | (v[1:] != v[:-1]).any(axis=1)
        keep = np.flatnonzero(new)
        self.ids, self.label, self.v, self.place = ids[keep], label[keep], v[keep], order[keep]
        if tags:
            self.tag = table.column("tag").to_numpy()[self.place]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b."""
    top = [int(np.abs(m.astype(np.float64)).max(initial=0)) for m in (a, b)]
    bound = top[0] * top[1] * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    held = a.astype(object) @ b.T.astype(object)
    limit = np.iinfo(np.int64)
    return np.clip(held, limit.min, limit.max).astype(np.int64)


def first_of(query: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which candidates are among the first k of their query: higher scores
    first, ties by place."""
    order = np.lexsort((place, ~score, query))          # ~ turns the order round without leaving 64 bits
    q = query[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(q)]])))
    return order[rank < k]


def _found(anchors: Block, a: np.ndarray, slot: np.ndarray, rows: Block, r: np.ndarray, score: np.ndarray) -> pa.Table:
    ids = rows.ids[r]
    return pa.table([pa.array(anchors.ids[a]), pa.array(anchors.tag[a]), pa.array(slot.astype(np.int32)),
                     pa.array(ids, mask=ids == NO_ID), pa.array(score)], schema=_FOUND_ARROW)


def _slices(anchors: Block, of: np.ndarray, n_rows: int):
    step = max(1, _SLICE // max(1, n_rows))
    for at in range(0, len(of), step):
        yield of[at:at + step]


def block_positives(anchors: Block, rows: Block, k: int) -> pa.Table:
    """First k rows of each anchor's label in a block, but the anchor."""
    out = [np.zeros((0, 3), np.int64)]
    for label in np.unique(anchors.label):
        same = np.flatnonzero(rows.label == label)
        for a in _slices(anchors, np.flatnonzero(anchors.label == label), len(same)):
            score = products(anchors.v[a], rows.v[same])
            at, r = np.nonzero(score >= _kth(score, k + 1)[:, None])
            itself = rows.ids[same[r]] == anchors.ids[a[at]]
            itself[itself] = (rows.v[same[r[itself]]] == anchors.v[a[at[itself]]]).all(axis=1)
            at, r = at[~itself], r[~itself]
            s = score[at, r]
            keep = first_of(at, r, s, k)
            out.append(np.stack([a[at[keep]], same[r[keep]], s[keep]], axis=1))
    found = np.concatenate(out)
    return _found(anchors, found[:, 0], np.zeros(len(found)), rows, found[:, 1], found[:, 2])


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest score of each row, the least where there are fewer."""
    n = score.shape[1]
    if n <= k:
        return score.min(axis=1) if n else np.zeros(len(score), np.int64)
    return np.partition(score, n - k, axis=1)[:, n - k]


def block_slots(anchors: Block, limits: list[list[int]], lowest: np.ndarray, rows: Block, k: int) -> pa.Table:
    """First k rows of other labels in each slot of each anchor.  Slot j of an
    anchor holds scores up to ``limits[j]``, above ``limits[j + 1]``, and
    nothing below ``lowest``."""
    width = max(map(len, limits), default=0)
    least = np.iinfo(np.int64).min
    upper = np.array([x + [least] * (width - len(x)) for x in limits], np.int64).reshape(len(limits), width)
    out = [np.zeros((0, 4), np.int64)]
    for label in np.unique(anchors.label):
        other = np.flatnonzero(rows.label != label)
        for a in _slices(anchors, np.flatnonzero(anchors.label == label), len(other)):
            score = products(anchors.v[a], rows.v[other])
            at, r = np.nonzero((score >= lowest[a][:, None]) & (score <= upper[a, 0][:, None]))
            s = score[at, r]
            slot = (upper[a[at], 1:] >= s[:, None]).sum(axis=1) if width > 1 else np.zeros(len(at), np.int64)
            keep = first_of(at * width + slot, r, s, k)
            out.append(np.stack([a[at[keep]], slot[keep], other[r[keep]], s[keep]], axis=1))
    found = np.concatenate(out)
    return _found(anchors, found[:, 0], found[:, 1], rows, found[:, 2], found[:, 3])


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k candidates of a group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, n_positives: int = 5, k: int = 5, share: tuple[int, int] = (80, 100), block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """One row per anchor, positive and rank: ``anchor_id``, ``positive_id``,
    ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` are (id, label, v, is_anchor) with integer labels, as
    ``integer_rows`` makes them.  A negative of a positive p has another label and a score n with
    share[0] * p <= share[1] * n <= share[1] * p.
    """
    num, den = share
    if not 0 < num <= den:
        raise ValueError("share must be a fraction above 0, at most 1")
    spark = rows.sparkSession
    ship_package(spark)
    rows = saved(rows.withColumn("tag", F.xxhash64("label", "v")), "negatives-rows")
    is_anchor = F.col("is_anchor") & F.col("id").isNotNull()
    n, n_anchors, width = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max(F.size("v"))).first()
    width = width or 0
    n_rb, n_ab = -(-n // block_rows) or 1, -(-n_anchors // block_anchors) or 1
    deal = lambda n, salt: F.pmod(F.xxhash64("id", "tag", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # names of their own: a cogroup of two frames over the same columns confuses them
    rows_in = rows.select(*[F.col(c).alias(c) for c in ("id", "label", "v")], deal(n_rb, 1).alias("rb"), every(n_ab).alias("ab"))
    asked = rows.where(is_anchor).dropDuplicates(["id", "tag"]).select("id", "label", "v", "tag", deal(n_ab, 2).alias("ab"))
    cell = ["ab", "rb"]

    def positives(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return block_positives(Block(left, width, tags=True), Block(right, width), n_positives)

    found = (asked.withColumn("rb", every(n_rb)).groupBy(*cell).cogroup(rows_in.groupBy(*cell)).applyInArrow(positives, _FOUND))
    positive = saved(_first(found, ["anchor", "tag"], n_positives).select(
        "anchor", "tag", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        (F.dense_rank().over(Window.partitionBy("anchor", "tag").orderBy(F.col("score").desc())) - 1).alias("slot")), "negatives-positives")

    # an anchor's distinct positive scores, descending: upper limits of its slots
    limits = positive.groupBy("anchor", "tag").agg(F.sort_array(F.collect_set("positive_score"), asc=False).alias("limits"))
    with_limits = asked.join(limits, (asked.id == limits.anchor) & (asked.tag == limits.tag)).select("id", "label", "v", asked.tag, "ab", "limits")

    def slots(key, left: pa.Table, right: pa.Table) -> pa.Table:
        anchors = Block(left, width, tags=True)
        all_limits = left.column("limits").to_pylist()
        upper = [all_limits[i] for i in anchors.place.tolist()]
        lowest = np.array([min((-(-num * p // den) for p in u if p >= 0), default=NO_ID) for u in upper], np.int64)
        return block_slots(anchors, upper, lowest, Block(right, width), k)

    found = (with_limits.withColumn("rb", every(n_rb)).groupBy(*cell).cogroup(rows_in.groupBy(*cell)).applyInArrow(slots, _FOUND))
    best = saved(_first(found, ["anchor", "tag", "slot"], k).drop("rank"), "negatives-slots")

    # descending suffix merge: a window's answer is the first k of its own slot and those below
    p, b = positive.alias("p"), best.alias("b")
    exact = lambda c, by: F.col(c).cast("decimal(38,0)") * by
    window = p.join(b, (F.col("p.anchor") == F.col("b.anchor")) & (F.col("p.tag") == F.col("b.tag")) & (F.col("b.slot") >= F.col("p.slot"))
                    & (exact("p.positive_score", num) <= exact("b.score", den)))
    order = Window.partitionBy("p.anchor", "p.tag", "p.rank").orderBy("b.slot", F.col("b.score").desc(), F.col("b.id").asc_nulls_last())
    return (window.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
            .select(F.col("p.anchor").alias("anchor_id"), "p.positive_id", F.col("place").cast("int").alias("rank"), F.col("b.id").alias("negative_id"),
                    "p.positive_score", F.col("b.score").alias("negative_score")))
