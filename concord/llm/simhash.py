"""SimHash near-duplicate groups with vantage-point trees (operator 8).

Every document gets a 64-bit fingerprint of its word shingles.  Fingerprints
within ``radius`` bits are linked, and a document's group is named by the
smallest doc_id that links reach.

Equal fingerprints are merged first, so copies cost one row.  Distinct
fingerprints are dealt to shards by a small vantage-point tree (built on a
bounded sample of about ``SAMPLE`` fingerprints; the tree only decides where rows
go, never which pairs count): a fingerprint's home is one leaf, and it also
visits every leaf that its ball of ``radius`` overlaps, by the triangle
bounds |d(v, x) - mu|.  In a leaf a vantage-point tree over the residents
answers all residents and visitors; subtrees whose distance bounds exclude
the ball are pruned.  A leaf returns the links of a spanning forest of what
it found - as many as it has fingerprints at most, and the same
connectivity as all pairs.  Leaves' forests are joined by
``components.connected``.

Defined results: a null or empty text has fingerprint zero and is linked
like any other; repeated rows share their group; rows with a null doc_id
keep their fingerprint, can link others, never name a group if another
member has an id (their own group of null ids is null); an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, saved, ship_package, texts
from .components import connected
from .tokens import encoder

SAMPLE = 4096          # fingerprints, about, that shape the routing tree; twice as many at most
LEAF_ROOT = 10         # a leaf aims at this many times the root of the count:
                       # more leaves mean more visits, larger ones more work each

FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_no", T.LongType(), False), T.StructField("fp", T.LongType(), False)])


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash: bit set where more than half of the shingles' XXH64
    (seed 42) have it; zero without words."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, 42)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[words - 1:].tolist()
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends)], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray, step: int = 65536) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), step):
        ones += np.unpackbits(hashes[i:i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def distance(a: np.ndarray, b) -> np.ndarray:
    """Hamming distances of unsigned 64-bit fingerprints."""
    return np.bitwise_count(np.bitwise_xor(a, b))


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text_no, fp bigint)`` of every row of ``docs``; text_no is
    a hash of the whole text as it stands."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()        # a reused worker may still hold words of a packing task
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "text_no", "fp"])

    return texts(docs, text, key).select("doc_id", F.xxhash64("text").alias("text_no"), "text").mapInArrow(run, FINGERPRINTS)


# --- vantage-point trees -------------------------------------------------

def routing_tree(sample: np.ndarray, depth: int, seed: int = 8) -> list:
    """A binary vantage-point tree as nested [vantage, mu, near, far]
    (leaves: numbers from 0).  The vantage of a node is the sampled point,
    of a few tried, whose distances spread most."""
    rng = np.random.default_rng(seed)
    leaves = 0

    def grow(points: np.ndarray, level: int):
        nonlocal leaves
        if level == depth or len(points) < 2:
            leaves += 1
            return leaves - 1
        tried = [points[i] for i in rng.integers(0, len(points), 8)]
        v = max(tried, key=lambda p: distance(points, p).astype(np.float64).std())
        d = distance(points, v).astype(np.int64)
        mu = int(np.median(d))
        near = d <= mu
        if near.all():
            mu -= 1
            near = d <= mu
        return [int(v), mu, grow(points[near], level + 1), grow(points[~near], level + 1)]

    return grow(sample, 0)


def route(tree, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, leaf, is home) of every leaf a fingerprint's ball
    of ``radius`` may reach."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    stack = [(tree, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, list):
            out.append((at, node, home))
            continue
        v, mu, near, far = node
        d = distance(fps[at], np.uint64(v)).astype(np.int64)
        go = d <= mu + radius
        stack.append((near, at[go], (home & (d <= mu))[go]))
        go = d > mu - radius
        stack.append((far, at[go], (home & (d > mu))[go]))
    if not out:
        return np.array([], np.int64), np.array([], np.int64), np.array([], bool)
    return (np.concatenate([a for a, _, _ in out]), np.concatenate([np.full(len(a), leaf) for a, leaf, _ in out]),
            np.concatenate([h for _, _, h in out]))


class Forest:
    """Union-find over the fingerprints of one leaf; ``links`` are the joins
    that mattered."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join pairs; only pairs whose trees differ, one per pair of trees,
        are looked at one by one."""
        if not len(a):
            return
        up = self.up
        while True:
            flat = up[up]
            if (flat == up).all():
                break
            up = flat
        self.up = up
        ra, rb = up[a], up[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        _, first = np.unique(lo * len(up) + hi, return_index=True)
        for i in first[lo[first] != hi[first]].tolist():
            s, t = self.find(a[i]), self.find(b[i])
            if s != t:
                self.up[max(s, t)] = min(s, t)
                self.links.append((int(a[i]), int(b[i])))


def leaf_links(homes: np.ndarray, visitors: np.ndarray, radius: int, small: int = 96, seed: int = 9) -> list[tuple[int, int]]:
    """Links (pairs of places in homes + visitors) that connect whatever
    lies within ``radius`` of a resident: a vantage-point tree over the
    residents is descended by all queries at once, a branch only by those
    whose ball reaches its shell of distances."""
    allp = np.concatenate([homes, visitors])
    forest = Forest(len(allp))
    rng = np.random.default_rng(seed)
    stack = [(np.arange(len(homes)), np.arange(len(allp)))]
    while stack:
        points, queries = stack.pop()
        if not len(points) or not len(queries):
            continue
        if len(points) <= small:
            p = allp[points]
            for i in range(0, len(queries), 8192):
                q = queries[i:i + 8192]
                x, y = np.nonzero(distance(allp[q][:, None], p[None, :]) <= radius)
                forest.join_all(q[x], points[y])
            continue
        v = allp[points[rng.integers(0, len(points))]]
        d = distance(allp[points], v).astype(np.int64)
        mu = int(np.median(d))
        near = d <= mu
        if near.all():
            mu = int(d.min())
            near = d <= mu
            if near.all():                     # one shell: no split by this vantage
                half = len(points) // 2
                stack += [(points[:half], queries), (points[half:], queries)]
                continue
        dq = distance(allp[queries], v).astype(np.int64)
        for part, dist in ((points[near], d[near]), (points[~near], d[~near])):
            lo, hi = int(dist.min()), int(dist.max())
            stack.append((part, queries[(dq >= lo - radius) & (dq <= hi + radius)]))
    return forest.links


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``,
    distinct rows) that give the same connectivity as all pairs within
    ``radius`` bits."""
    spark = fps.sparkSession
    ship_package(spark)
    n = fps.count()
    sample = np.array(sorted(r[0] for r in hash_sample(fps.select("fp"), ["fp"], SAMPLE, n).collect()), dtype=np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) ** 0.5 / LEAF_ROOT))))
    tree = routing_tree(sample, depth) if len(sample) else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, leaf, home = route(tree, f, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(f[at].view(np.int64)), pa.array(home)], names=["leaf", "fp", "home"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task holds whole leaves in order; one is open at a time."""
        leaf, held = None, []

        def close() -> pa.RecordBatch:
            f = np.concatenate([h[0] for h in held])
            home = np.concatenate([h[1] for h in held])
            points = np.concatenate([f[home], f[~home]])
            found = np.array(leaf_links(f[home], f[~home], radius), dtype=np.int64).reshape(-1, 2)
            ends = points[found].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for b in batches:
            ls = b.column(0).to_numpy()
            f = b.column(1).to_numpy().view(np.uint64)
            home = b.column(2).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ls)) + 1, [len(ls)]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if s == e:
                    continue
                if leaf is not None and ls[s] != leaf:
                    yield close()
                    held = []
                leaf = ls[s]
                held.append((f[s:e].copy(), home[s:e].copy()))
        if held:
            yield close()

    dealt = fps.select("fp").mapInArrow(deal, "leaf bigint, fp bigint, home boolean")
    return dealt.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, text_no, fp, component_id, root)`` of every row of
    ``docs``; ``root`` names the group by one of its fingerprints."""
    fps = saved(fingerprints(docs, words, text, key), "fingerprints")
    # smallest id per fingerprint: copies are merged on the map side
    names = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "names")
    found = saved(links(names, radius), "links")
    groups = connected(found)                                    # (node, component) of linked fingerprints
    named = names.join(groups, names["fp"] == groups["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "doc_id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    roots = saved(named.join(least, "root").select("fp", "root", "component_id"), "roots")
    # one row per fingerprint on this side, so a hot fingerprint's documents
    # can be split by the adaptive skew join
    return fps.join(roots, "fp").select("doc_id", "text_no", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id
    (null last), of several texts of that id the one of the least text_no,
    of equal rows any one; every column stays."""
    groups = near_duplicates(docs, words, radius, text, key)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_no")).alias("r"))
    chosen = first.select(F.col("r.doc_id").alias("__id"), F.col("r.text_no").alias("__no")).distinct()
    repeated = groups.groupBy("doc_id", "text_no").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_no").alias("__no"))
    same = F.col(key).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("__no"))
    stay = docs.join(chosen, same, "left_semi")
    # rows that are repeated are few or one group's; only they are compared
    return stay.join(repeated, same, "left_anti").unionByName(stay.join(repeated, same, "left_semi").dropDuplicates([key, text]))
