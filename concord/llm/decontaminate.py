"""Benchmark decontamination (operator 1), DataFrame expressions only.

A document is contaminated by a benchmark item if some window of the item's
number of words has a weighted shingle similarity of ``similarity`` or more
with it (multiset Jaccard over ``words``-word shingles: sum of least counts
over sum of greatest counts).  Texts are lower-cased; words are maximal runs
of letters and digits.  A text with fewer words than an item is one window.

1. Items get their shingle hashes and a 64-bit SimHash, weighted by count.
2. The documents' shingles are looked up among the items'.  Of m shingles a
   window needs at least 2 m s / (1 + s) that an item of that length has, in
   any order, to reach similarity s (8 of 9 for 0.8); every window with that
   many is a candidate, wherever in the item its shingles stand.
3. Each window gets its SimHash.  Two fingerprints within ``radius`` bits
   agree, in one of ``blocks`` blocks, up to radius // blocks bits; items
   are indexed under every such variant of every block, windows look up
   their blocks as they are: all pairs within the radius are found.
4. Pairs within the radius are verified by the exact similarity.

Defined results: null or empty texts and items match nothing; items of
fewer than ``words`` words are one shingle of all their words and match
windows equal to them; repeated rows of a document, and windows that tie,
report the best similarity and then the first start; a null doc_id or
item_id is reported as null; other columns are ignored; an empty benchmark
or table gives no rows.

The benchmark decides the joins' small side.  It is broadcast only while its
shingles are at most ``BROADCAST_SHINGLES`` (counted first); beyond that the
same joins shuffle both sides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, texts

BROADCAST_SHINGLES = 2_000_000       # about 80 MB as a hash relation
RADIUS = 17
BLOCKS = 6


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """Hashes of all runs of exactly k words, in order."""
    n = F.size(words)
    return F.when(n < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))),
                    lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def shingles(words: Column, k: int) -> Column:
    """Hashes of all k-word shingles (all words, if fewer; none of none)."""
    n = F.size(words)
    out = F.when(n >= k, grams(words, k))
    for m in range(1, k):
        out = out.when(n == m, F.array(F.xxhash64(*[F.get(words, F.lit(j)) for j in range(m)])))
    return out.otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bits that more than half of the hashes (repeats included) have."""
    def ones(b: int) -> Column:
        return F.aggregate(hashes, F.lit(0), lambda s, h: s + F.shiftrightunsigned(h, b).bitwiseAND(1).cast("int"))

    bits = [F.when(2 * ones(b) > F.size(hashes), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")) for b in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def block_ranges(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def block_keys(fp: Column, blocks: int, flips: int) -> Column:
    """(block, value) of every block of a fingerprint, in every variant of
    at most ``flips`` changed bits."""
    out = []
    for n, (first, width) in enumerate(block_ranges(blocks)):
        value = F.shiftrightunsigned(fp, first).bitwiseAND((1 << width) - 1)
        masks = [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(width), k)]
        out.append(_variants(n, value, masks))
    return F.concat(*out)


def _variants(block: int, value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]),
                       lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value")))


def similarity_of(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two arrays of hashes as ``numbered`` gives them:
    least counts are an intersection."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def numbered(hashes: Column) -> Column:
    """Of a sorted array, hashes of (hash, how many equal ones stood before
    it), all distinct."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, i - F.array_position(hashes, h).cast("int")))


def starts_of(places: Column, shingles_: Column, need: Column, last: Column) -> Column:
    """Starts 0..last of the windows of ``shingles_`` places that hold at
    least ``need`` of the sorted ``places``: between one place and the next
    a window's first hit is the same, so its starts are one run."""
    run = F.transform(places, lambda p, i: F.struct(
        F.greatest(F.coalesce(F.get(places, i - 1) + 1, F.lit(0)), F.get(places, i + need - 1) - shingles_ + 1, F.lit(0)).alias("a"),
        F.least(p, last).alias("b"), (i + need <= F.size(places)).alias("enough")))
    return F.flatten(F.transform(F.filter(run, lambda r: r["enough"] & (r["a"] <= r["b"])), lambda r: F.sequence(r["a"], r["b"])))


def similar_windows(docs: DataFrame, benchmark: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, blocks: int = BLOCKS,
               text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The windows (of the text ``text_no``) that contaminate, by item."""
    items = (benchmark.select(F.col(item_key).alias("item_id"), words_of(F.coalesce(F.col(item_text), F.lit(""))).alias("w"))
             .withColumn("n_words", F.size("w")).where("n_words > 0")
             .withColumn("item_hashes", F.array_sort(shingles(F.col("w"), words)))
             .withColumn("item_no", F.xxhash64("item_id", F.col("w"))))
    items = saved(items.select("item_id", "item_no", "n_words", "item_hashes", simhash(F.col("item_hashes")).alias("item_fp")).dropDuplicates(["item_id", "item_no"]), "items")
    hits = items.select("n_words", F.explode("item_hashes").alias("h")).distinct()
    small = (items.agg(F.sum(F.size("item_hashes"))).first()[0] or 0) <= BROADCAST_SHINGLES
    near = F.broadcast if small else (lambda df: df)

    rows = texts(docs, text, key).withColumn("text_no", F.xxhash64("text"))
    tokens = rows.select("doc_id", "text_no", words_of(F.col("text")).alias("w"))
    # step 2: (document, start, length) of windows with enough shared shingles;
    # items shorter than a shingle (the benchmark's lengths decide which of
    # the few sizes occur) are looked up among runs of their own length
    short = [r[0] for r in items.where(F.col("n_words") < words).select("n_words").distinct().collect()]
    runs = tokens.select("doc_id", "text_no", F.size("w").alias("n"), F.posexplode(grams(F.col("w"), words)).alias("p", "h"))
    for m in sorted(short):
        runs = runs.unionByName(tokens.select("doc_id", "text_no", F.size("w").alias("n"), F.posexplode(grams(F.col("w"), m)).alias("p", "h")))
    found = (runs.join(near(hits), "h").groupBy("doc_id", "text_no", "n", "n_words").agg(F.array_sort(F.collect_set("p")).alias("places"))
             .withColumn("size", F.least("n", "n_words"))
             .withColumn("m", F.greatest(F.col("size") - (words - 1), F.lit(1)))
             .withColumn("of", F.greatest(F.col("n_words") - (words - 1), F.lit(1)))
             .withColumn("need", F.ceil(similarity * (F.col("m") + F.col("of")) / (1 + similarity) - 1e-9).cast("int"))
             .where(F.size("places") >= F.col("need"))
             .withColumn("starts", starts_of(F.col("places"), F.col("m"), F.greatest("need", F.lit(1)), F.col("n") - F.col("size")))
             .where(F.size("starts") > 0))
    windows = found.groupBy("doc_id", "text_no").agg(F.flatten(F.collect_list(F.transform(
        "starts", lambda p: F.struct(p.alias("start"), F.col("n_words"), F.col("size"))))).alias("windows"))
    # step 3: their fingerprints; documents are read again, for the few that have windows
    again = rows.alias("r").join(windows.alias("v"), F.col("r.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("r.text_no") == F.col("v.text_no")))
    placed = (again.select("r.doc_id", "r.text_no", words_of(F.col("r.text")).alias("w"), "windows").dropDuplicates(["doc_id", "text_no"])
              .select("doc_id", "text_no", F.explode(F.transform("windows", lambda s: F.struct(
                  s["start"].alias("start"), s["n_words"].alias("n_words"), s["size"].alias("size"),
                  F.array_sort(shingles(F.slice(F.col("w"), s["start"] + 1, s["size"]), words)).alias("hashes")))).alias("s"))
              .select("doc_id", "text_no", "s.*").withColumn("fp", simhash(F.col("hashes"))).withColumn("hashes", numbered(F.col("hashes"))))
    index = items.select("item_id", "item_no", "n_words", numbered(F.col("item_hashes")).alias("item_hashes"), "item_fp",
                         F.explode(block_keys(F.col("item_fp"), blocks, radius // blocks)).alias("k")).select("*", "k.*").drop("k")
    asked = placed.withColumn("k", F.explode(block_keys(F.col("fp"), blocks, 0))).select("*", "k.*").drop("k")
    pairs = (asked.join(near(index.select("block", "value", "n_words", "item_id", "item_no", "item_hashes", "item_fp")), ["block", "value", "n_words"])
             .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
             .where(F.col("distance") <= radius)
             .withColumn("similarity", similarity_of(F.col("hashes"), F.col("item_hashes")))
             .where(F.col("similarity") >= similarity))
    return pairs


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document and item: ``doc_id``, ``item_id``,
    ``start`` and ``n_words`` of its best window, ``distance`` of the
    fingerprints, ``similarity``."""
    pairs = similar_windows(docs, benchmark, **options)
    best = pairs.groupBy("doc_id", "item_id").agg(F.min(F.struct(
        (-F.col("similarity")).alias("s"), "start", F.col("size").alias("n_words"), "distance")).alias("b"))
    return best.select("doc_id", "item_id", "b.start", "b.n_words", "b.distance", (-F.col("b.s")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that any item contaminates; every
    column stays.  Rows without a doc_id are each a document of their own,
    told apart by their texts."""
    key, text = F.col(options.get("key", "doc_id")).cast("bigint"), F.col(options.get("text", "text")).cast("string")
    marked = similar_windows(docs, benchmark, **options).select(
        F.col("doc_id").alias("__leak"), F.when(F.col("doc_id").isNull(), F.col("text_no")).alias("__no")).distinct()
    own = F.when(key.isNull(), F.xxhash64(F.coalesce(text, F.lit(""))))
    return docs.join(marked, key.eqNullSafe(F.col("__leak")) & own.eqNullSafe(F.col("__no")), "left_anti")
