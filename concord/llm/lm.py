"""Language-model scoring with an Elias-Fano n-gram trie (operator 7).

The model is a bigram model over words (lower-cased A-Z) and one end token
per document, which is also the context of a document's first word:

    P(w | u) = (c(u w) + k(u) P1(w)) / (c(u) + k(u)),   k(u) = K0 c(u)^GAMMA
    P1(w)    = (1 - p0) c(w) / N,  unknown words: p0 = (n1 + 1) / (N + 2)

with n1 the words seen once; P1 sums to one over the training words and one
unknown word, so every P(. | u) does as well.

The trie is cut into shards: words (level 1, exact counts) by their hash,
successors (level 2, quantised log counts) by the hash of their context and
one of ``SPLITS`` classes of the successor, so that the successors of a very
frequent word are spread.  Both levels are monotone sequences in Elias-Fano
form in one anonymous memory map: level 2 holds context rank and successor
hash as one key, and a query finds its successor among those of its context
through the high bits' bucket and a binary search of the low bits.
Smoothing happens at the query, because c(u) and N are the whole corpus's.

A group of documents asks each shard for its distinct words and pairs and
gets exact counts and quantised log counts back (see ``groups``).  Words are
compared by 64-bit hashes, successors within a context by 32 bits of them.

Defined results: a null or empty text is the end token alone; rows with a
null doc_id teach; repeated rows teach and are scored each; with no training
tokens N and V are 0 and every word is unknown; an empty table gives no rows.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship_package
from .groups import binary, dealt, joined, sorted_documents

K0, GAMMA = 2.0, 0.9
SPLITS = 16
STEP = 1 / 4096            # of log10 counts; 16 bits reach 10**16
END = b""                  # no word is empty


# --- Elias-Fano ----------------------------------------------------------

class EliasFano:
    """A sorted sequence of unsigned keys below 2**63 in memory-mapped
    levels: low bits packed, high bits in unary with a select directory."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n = n
        top = int(keys[-1]) + 1 if n else 1
        self.low_bits = low = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        high = (keys >> np.uint64(low)).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if n else 1
        bits = np.zeros(n + self.buckets + 1, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        lows = ((keys[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
        packed = [np.packbits(lows.reshape(-1), bitorder="little"), np.packbits(bits, bitorder="little")]
        self.map = mmap.mmap(-1, len(packed[0]) + len(packed[1]) + 8)
        self.map.write(packed[0].tobytes() + b"\0" * 8 + packed[1].tobytes())
        at = len(packed[0]) + 8
        self.words = np.ndarray((max(1, at - 7),), dtype="<u8", buffer=self.map, strides=(1,))
        unary = np.unpackbits(np.frombuffer(self.map, np.uint8, len(packed[1]), at), bitorder="little", count=len(bits))
        zeros = np.flatnonzero(unary == 0)                       # select0: bucket ends
        self.first = np.concatenate([[0], zeros[:self.buckets] - np.arange(self.buckets)]).astype(np.int64)

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        return (self.words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def successor(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first key that is not smaller, for each key."""
        high = np.minimum((keys >> np.uint64(self.low_bits)).astype(np.int64), self.buckets)
        beyond = high >= self.buckets
        high[beyond] = self.buckets - 1
        target = keys & np.uint64((1 << self.low_bits) - 1)
        lo, hi = self.first[high], self.first[high + 1]
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self.low(mid) < target[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
            active = active[lo[active] < hi[active]]
        lo[beyond] = self.n
        return lo

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is absent."""
        if not self.n:
            return np.full(len(keys), -1)
        at = self.successor(keys)
        inside = np.minimum(at, self.n - 1)
        high = np.searchsorted(self.first, inside, side="right") - 1
        same = (at < self.n) & (high == (keys >> np.uint64(self.low_bits)).astype(np.int64)) & (
            self.low(inside) == keys & np.uint64((1 << self.low_bits) - 1))
        return np.where(same, at, -1)


class Trie:
    """One shard: words with exact counts, contexts with successors."""

    def __init__(self, words: np.ndarray, word_n: np.ndarray, contexts: np.ndarray, successors: np.ndarray, pair_n: np.ndarray):
        uniq, place = np.unique(words, return_inverse=True)
        n = np.bincount(place, weights=word_n, minlength=len(uniq)).astype(np.int64)
        self.words, self.counts = EliasFano(uniq[n > 0] >> np.uint64(1)), n[n > 0]
        uniq, place = np.unique(contexts, return_inverse=True)
        self.contexts = EliasFano(uniq)
        keys, inv = np.unique(place.astype(np.uint64) << np.uint64(32) | successors, return_inverse=True)
        n = np.bincount(inv, weights=pair_n, minlength=len(keys)).astype(np.int64)
        self.pairs, self.weights = EliasFano(keys[n > 0]), quantise(n[n > 0])

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        at = self.words.find(words >> np.uint64(1))
        return np.where(at >= 0, self.counts[at] if len(self.counts) else 0, 0)

    def pair_weights(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        rank = self.contexts.find(contexts)
        at = self.pairs.find(np.maximum(rank, 0).astype(np.uint64) << np.uint64(32) | successors)
        seen = (rank >= 0) & (at >= 0)
        return np.where(seen, self.weights[at] if len(self.weights) else 0, 0).astype(np.uint16)


def quantise(n: np.ndarray) -> np.ndarray:
    return (1 + np.round(np.log10(n) / STEP)).astype(np.uint16)


def counts_of(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 10.0 ** ((q.astype(np.float64) - 1) * STEP), 0.0)


# --- groups and shards ---------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Group:
    """Distinct words and pairs of a group of documents, in shard order."""

    def __init__(self, ids: list, texts: list[str], shards: int):
        import xxhash

        number: dict[bytes, int] = {END: 0}
        codes, self.lengths = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            words = t.encode("utf-8", "surrogatepass").lower().split()
            self.lengths[i] = len(words) + 1
            codes += [number.setdefault(w, len(number)) for w in words]
            codes.append(0)
        self.codes = np.array(codes, dtype=np.int64)
        del codes
        self.hash = np.array([xxhash.xxh64_intdigest(w) for w in number], dtype=np.uint64)
        # the context of a document's first word is the end before it
        self.before = np.concatenate([[0], self.codes[:-1]]) if len(self.codes) else self.codes
        pair, self.pair_of = np.unique(self.before * len(number) + self.codes, return_inverse=True)
        self.u, self.w = pair // len(number), pair % len(number)
        # successors are known by 32 bits; the other bits choose the class
        short = self.hash[self.w]
        self.successor = short & np.uint64(0xFFFFFFFF)
        self.context = _mix(self.hash[self.u] + (short >> np.uint64(32)) % np.uint64(SPLITS) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(1)
        word_shard = (_mix(self.hash) % np.uint64(shards)).astype(np.int64)
        pair_shard = (self.context % np.uint64(shards)).astype(np.int64)
        self.word_order = np.argsort(word_shard, kind="stable")
        self.pair_order = np.lexsort((self.successor, self.context, pair_shard))
        self.word_shard, self.pair_shard = word_shard[self.word_order], pair_shard[self.pair_order]

    def training_counts(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taught = np.repeat(learn, self.lengths)
        return (np.bincount(self.codes[taught], minlength=len(self.hash)), np.bincount(self.pair_of[taught], minlength=len(self.u)))


def held_out_fold(ids: list, folds: int, held: int) -> np.ndarray:
    import zlib

    return np.array([d is not None and zlib.crc32(str(d).encode()) % folds == held for d in ids], dtype=bool)


def score(docs: DataFrame, folds: int = 7, held: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores of all rows, learned from those whose fold is not ``held``."""
    spark = docs.sparkSession
    ship_package(spark)
    rows, n = dealt(docs, text, key)

    def ask(table: pa.Table) -> pa.Table:
        ids, all_texts = sorted_documents(table)
        g = Group(ids, all_texts, n)
        word_n, pair_n = g.training_counts(~held_out_fold(ids, folds, held))
        out = {k: [] for k in ("words", "word_n", "contexts", "context_n", "successors", "pair_n")}
        shards = np.union1d(g.word_shard, g.pair_shard)      # only those with keys
        for s in shards.tolist():
            w = g.word_order[np.searchsorted(g.word_shard, s):np.searchsorted(g.word_shard, s + 1)]
            p = g.pair_order[np.searchsorted(g.pair_shard, s):np.searchsorted(g.pair_shard, s + 1)]
            contexts, repeats = np.unique(g.context[p], return_counts=True)
            out["words"].append(g.hash[w].tobytes())
            out["word_n"].append(word_n[w].astype(np.uint32).tobytes())
            out["contexts"].append(contexts.tobytes())
            out["context_n"].append(repeats.astype(np.uint32).tobytes())
            out["successors"].append(g.successor[p].astype(np.uint32).tobytes())
            out["pair_n"].append(pair_n[p].astype(np.uint32).tobytes())
        return pa.table({"grp": pa.array([table.column("grp")[0].as_py()] * len(shards), pa.int64()), "shard": pa.array(shards),
                         **{k: binary(v) for k, v in out.items()}})

    def answer(table: pa.Table) -> pa.Table:
        words, word_cut = joined(table.column("words"), "<u8")
        word_n, _ = joined(table.column("word_n"), "<u4")
        heads, _ = joined(table.column("contexts"), "<u8")
        repeats, _ = joined(table.column("context_n"), "<u4")
        successors, pair_cut = joined(table.column("successors"), "<u4")
        pair_n, _ = joined(table.column("pair_n"), "<u4")
        contexts, successors = np.repeat(heads, repeats), successors.astype(np.uint64)
        trie = Trie(words, word_n, contexts, successors, pair_n)
        counts, weights = trie.word_counts(words).astype("<u8"), trie.pair_weights(contexts, successors).astype("<u2")
        seen = trie.counts
        total = pa.table({"grp": pa.array([-1], pa.int64()), "shard": pa.array([0], pa.int64()), "counts": binary([b""]), "weights": binary([b""]),
                          "n": pa.array([int(seen.sum())]), "v": pa.array([len(seen)]), "once": pa.array([int((seen == 1).sum())])})
        zero = pa.array(np.zeros(len(word_cut), np.int64))
        replies = pa.table({"grp": table.column("grp"), "shard": table.column("shard"),
                            "counts": binary([a.tobytes() for a in np.split(counts, np.cumsum(word_cut)[:-1])]),
                            "weights": binary([a.tobytes() for a in np.split(weights, np.cumsum(pair_cut)[:-1])]), "n": zero, "v": zero, "once": zero})
        return pa.concat_tables([total, replies])

    asked = rows.groupBy("grp").applyInArrow(
        ask, "grp bigint, shard bigint, words binary, word_n binary, contexts binary, context_n binary, successors binary, pair_n binary")
    replies = saved(asked.groupBy("shard").applyInArrow(answer, "grp bigint, shard bigint, counts binary, weights binary, n bigint, v bigint, once bigint"), "lm-replies")
    big_n, v, once = (x or 0 for x in replies.where("grp = -1").agg(F.sum("n"), F.sum("v"), F.sum("once")).first())

    def finish(docs_of: pa.Table, replies_of: pa.Table) -> pa.Table:
        ids, all_texts = sorted_documents(docs_of)
        g = Group(ids, all_texts, n)
        replies_of = replies_of.sort_by("shard")
        counts, weights = np.empty(len(g.hash)), np.empty(len(g.u))
        counts[g.word_order] = joined(replies_of.column("counts"), "<u8")[0]
        weights[g.pair_order] = counts_of(joined(replies_of.column("weights"), "<u2")[0])
        p0 = (once + 1) / (big_n + 2)
        one = np.where(counts > 0, (1 - p0) * counts / max(big_n, 1), p0)
        c_u = counts[g.u]
        k = K0 * np.maximum(c_u, 1) ** GAMMA
        pair_score = np.log10((weights + k * one[g.w]) / (np.maximum(c_u, weights) + k))
        base = np.log10((counts + 1) / (big_n + 1 * (v + 1)))
        owner = np.repeat(np.arange(len(ids)), g.lengths)
        known = np.bincount(owner, weights=counts[g.codes] > 0, minlength=len(ids))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held_out_fold(ids, folds, held)), "n_tokens": pa.array(g.lengths),
            "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), big_n, np.int64)),
            "base_score": pa.array(np.bincount(owner, weights=base[g.codes], minlength=len(ids))),
            "score": pa.array(np.bincount(owner, weights=pair_score[g.pair_of], minlength=len(ids)))})

    return rows.groupBy("grp").cogroup(replies.where("grp >= 0").groupBy("grp")).applyInArrow(
        finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
