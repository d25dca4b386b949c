"""Removal of repeated word windows with sharded FM-indexes (operator 12).

A window is ``span`` consecutive words of one document.  Words covered by a
window that also starts earlier (smaller doc_id, or the same document and an
earlier start) go; windows are judged on the input.

*Dealing.*  Equal windows have to meet in one shard without any document
being sent to all of them.  Each window names the gram of ``GRAM`` words in it
with the least hash, its anchor; consecutive windows with the same anchor are
one piece of at most ``2 * span - GRAM`` words, dealt by the anchor.  First
only the distinct anchors of a group of documents travel; pieces follow for
anchors that occur twice.  A group sends a distinct piece once, with its
earliest place, so copies inside a group are added up before the shuffle;
later copies of a whole text are found first and send nothing.  An anchor with
more than ``HOT_PIECES`` pieces (a phrase in a third of all documents, with
other words around it) is split: its windows are dealt one by one, by their
own hash, and again only those that occur twice follow.  No key brings a
shard more than ``HOT_PIECES`` pieces, or one piece a group.

*Index.*  A shard builds a compressed FM-index of its distinct pieces: the
Burrows-Wheeler transform in a wavelet tree of packed bit planes with rank
directories, and bits that mark where neighbouring suffixes share fewer than
``span`` words.  Pieces stream through it from their last word: backward
search extends the match by one word, and once it has ``span`` words the
interval is widened to all suffixes that share them, which gives matching
statistics capped at ``span`` for one step a word.  An interval at the
threshold is a repeated window; its least place tells whether a piece's own
place is the earliest.

Words are compared by 64-bit hashes, pieces of a group and whole texts by 128
bits.  A text is held in one task, as one cell of a row is: about ten bytes
of memory for a byte of text.

Defined results: a null text has no words; a text with fewer words than
``span`` stays; rows with a null doc_id come after every id; rows that share a
doc_id (or have none) lose to each other by the earlier start only, so equal
rows stay together; an empty table gives no rows; other columns are ignored
unless carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import ship_package
from .groups import MIN_GROUPS, binary, joined, runs

SPAN = 20
GRAM = 8
LAST = np.iinfo(np.int64).max       # stands for a null doc_id
HOT_PIECES = 4096
CHARS = 4_000_000                   # of a group of documents
_BLOCK = 4_000_000                  # bytes hashed at once
_U = np.uint64
_PLACE = _U((1 << 24) - 1)
_SEGMENT = 1 << 20                  # windows whose anchors are searched at once
_REPLY = "grp bigint, kind int, shard bigint, a binary, b binary"
ANCHORS, FLAGS, FIRSTS, WINDOWS = range(4)


# --- hashes --------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, _U), np.cumprod(np.full(self.n - 1, b, _U))]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _OTHER = _Powers(0x9E3779B97F4A7C15), _Powers(0xC2B2AE3D27D4EB4F), _Powers(0x165667B19E3779F9)


def ranges_hash(values: np.ndarray, first: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of values[first[i]:end[i]] for each i, whatever their place."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum((values + _U(1)) * up[:-1], out=total[1:])
    return _mix((total[end] - total[first]) * down[first] + (end - first).astype(_U) * _U(0xFF51AFD7ED558CCD))


def word_places(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word of a buffer that ends with a blank."""
    blank = np.concatenate([[True], (buffer == 32) | ((buffer >= 9) & (buffer <= 13))])
    return np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])


def word_hashes(buffer: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), _U)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(end, first[at] + _BLOCK)))
        lo, hi = int(first[at]), int(end[to - 1])
        out[at:to] = ranges_hash(buffer[lo:hi].astype(_U), first[at:to] - lo, end[at:to] - lo, _BYTES)
        at = to
    return out


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    n = max(0, len(words) - gram + 1)
    h = np.zeros(n, _U)
    for j in range(gram):
        h = h * _U(0x9E3779B97F4A7C15) + words[j:j + n]
    return _mix(h)


def pieces(words: np.ndarray, doc_first: np.ndarray, doc_end: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first word, number of windows, anchor hash, document number) of each
    run of windows with one anchor; a run stays in its document."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))]
    width = span - gram + 1
    n_windows = len(words) - span + 1
    for lo in range(0, n_windows, _SEGMENT):
        hi = min(lo + _SEGMENT, n_windows)
        h = gram_hashes(words[lo:hi + span - 1], gram)
        least = h & ~_PLACE | np.arange(len(h), dtype=_U)
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        at = (least & _PLACE).astype(np.int64)
        # windows that lie inside one document, as intervals of this segment
        d = np.arange(np.searchsorted(doc_end, lo, side="right"), np.searchsorted(doc_first, hi, side="left"))
        a, b = np.maximum(doc_first[d], lo) - lo, np.minimum(doc_end[d] - span + 1, hi) - lo
        d, a, b = d[b > a], a[b > a], b[b > a]
        if not len(d):
            continue
        edge = np.zeros(hi - lo + 1, np.int64)
        edge[a] += 1
        edge[b] -= 1
        inside = np.cumsum(edge[:-1]) > 0
        new = inside.copy()
        new[1:] &= at[1:] != at[:-1]
        new[a] = True
        first = np.flatnonzero(new)
        count = np.add.reduceat(inside.astype(np.int64), first)
        out.append((first + lo, count, h[at[first]], d[np.searchsorted(a, first, side="right") - 1]))
    return tuple(np.concatenate(c) for c in zip(*out))


# --- the index -----------------------------------------------------------

class BitPlane:
    """Packed bits with the number of ones before every 64 of them."""

    def __init__(self, bits: np.ndarray):
        self.bits = np.packbits(np.concatenate([bits, np.zeros(64 + -len(bits) % 64, bool)]), bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits[:-1]), dtype=np.int64)]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.bits[block] & ((_U(1) << (at & 63).astype(_U)) - _U(1)))


class WaveletTree:
    """A sequence of numbers below 2**levels as bit planes, highest bit
    first, each plane stably sorted by the bits above."""

    def __init__(self, values: np.ndarray, n_values: int):
        self.planes, self.levels = [], max(1, int(n_values - 1).bit_length())
        for k in range(self.levels - 1, -1, -1):
            bits = (values >> k & 1).astype(bool)
            self.planes.append(BitPlane(bits))
            values = np.concatenate([values[~bits], values[bits]])
        self.base = self._down(np.arange(n_values), np.zeros(n_values, np.int64))

    def _down(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, plane in zip(range(self.levels - 1, -1, -1), self.planes):
            ones = plane.rank(at)
            at = np.where(value >> k & 1, plane.zeros + ones, at - ones)
        return at

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each value before each place."""
        return self._down(value, at) - self.base[value]


class FmIndex:
    """Index of pieces (word hashes one after another, and lengths)."""

    def __init__(self, words: np.ndarray, length: np.ndarray, span: int):
        self.span = span
        self.known, number = np.unique(words, return_inverse=True)
        self.n = len(words) + len(length)
        end = np.cumsum(length + 1) - 1                 # where the separators stand
        text = np.zeros(self.n, np.int64)
        is_word = np.ones(self.n, bool)
        is_word[end] = False
        text[is_word] = number.reshape(-1) + 1
        self.first = end - length
        suffixes = self._sorted(text, np.repeat(end, length + 1), int(length.max(initial=0)))
        self.shared = self._shared(text, suffixes)      # words in common with the suffix before, at most span
        self.shared[:1] = 0
        self.suffixes = suffixes
        self.runs = np.concatenate([np.flatnonzero(self.shared < span), [self.n]])
        self.tree = WaveletTree(text[suffixes - 1], len(self.known) + 1)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.known) + 1))])
        self._levels: dict[int, np.ndarray] = {}

    @staticmethod
    def _sorted(text: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
        """Suffixes in order, by doubling the words that count; equal ones
        by place."""
        rank, k, place = text, 1, np.arange(len(text))
        while k <= longest:
            after = np.where(place + k <= end, rank[np.minimum(place + k, len(text) - 1)], 0)
            rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].reshape(-1)
            k *= 2
        return np.argsort(rank, kind="stable")

    def _shared(self, text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(suffixes), np.int64)
        j = np.arange(1, len(suffixes))
        for d in range(self.span):
            a, b = text[np.minimum(suffixes[j] + d, len(text) - 1)], text[np.minimum(suffixes[j - 1] + d, len(text) - 1)]
            j = j[(a == b) & (a > 0)]
            out[j] += 1
        return out

    def step(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more word before them."""
        base = self.smaller[value]
        return base + self.tree.rank(value, lo), base + self.tree.rank(value, hi)

    def _edges(self, depth: int) -> np.ndarray:
        if depth not in self._levels:
            self._levels[depth] = np.concatenate([np.flatnonzero(self.shared < depth), [self.n]])
        return self._levels[depth]

    def _wider(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger interval whose suffixes share fewer words."""
        ends = np.concatenate([self.shared, [0]])
        depth = np.maximum(ends[lo], ends[hi])
        out_lo, out_hi = np.zeros_like(lo), np.full_like(hi, self.n)
        for d in np.unique(depth[depth > 0]).tolist():
            at, edges = depth == d, self._edges(d)
            out_lo[at] = edges[np.searchsorted(edges, lo[at], side="right") - 1]
            out_hi[at] = edges[np.searchsorted(edges, hi[at])]
        return out_lo, out_hi, depth

    def matching_statistics(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every word of the streamed pieces: how many words from there
        on (at most ``span``, within the piece) occur in the index, and for
        ``span`` words the number of their interval in ``runs`` (else -1)."""
        value = np.searchsorted(self.known, words)
        value[value == len(self.known)] = 0
        value = np.where(self.known[value] == words, value + 1, 0) if len(self.known) else np.zeros(len(words), np.int64)
        matched, interval = np.zeros(len(words), np.int64), np.full(len(words), -1)
        end = np.cumsum(length)
        lo, hi, have = np.zeros(len(length), np.int64), np.full(len(length), self.n), np.zeros(len(length), np.int64)
        for t in range(1, int(length.max(initial=0)) + 1):
            active = np.flatnonzero(length >= t)
            c = value[end[active] - t]
            gone = active[c == 0]
            lo[gone], hi[gone], have[gone] = 0, self.n, 0
            todo, c = active[c > 0], c[c > 0]
            while len(todo):
                a, b = self.step(c, lo[todo], hi[todo])
                hit = b > a
                found, miss = todo[hit], todo[~hit]
                lo[found], hi[found] = a[hit], b[hit]
                have[found] += 1
                lo[miss], hi[miss], have[miss] = self._wider(lo[miss], hi[miss])
                todo, c = miss, c[~hit]
            full = active[have[active] >= self.span]
            run = np.searchsorted(self.runs, lo[full], side="right") - 1
            lo[full], hi[full], have[full] = self.runs[run], self.runs[run + 1], self.span
            matched[end[active] - t] = have[active]
            interval[end[full] - t] = run
        return matched, interval

    def earliest(self, place: np.ndarray) -> np.ndarray:
        """Least ``place`` (one for each indexed word) of every interval."""
        of = np.full(self.n, np.iinfo(np.int64).max)
        is_word = np.ones(self.n, bool)
        is_word[np.concatenate([self.first[1:], [self.n]]) - 1] = False
        of[is_word] = place
        return np.minimum.reduceat(of[self.suffixes], self.runs[:-1])


def repeated_windows(words: np.ndarray, length: np.ndarray, doc: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every word of the pieces: the (doc, start) at which the window
    that begins there occurs first in any of them; -1, -1 for none."""
    index = FmIndex(words, length, span)
    _, interval = index.matching_statistics(words, length)
    inside = np.arange(len(words)) - np.repeat(np.cumsum(length) - length, length)
    docs, starts = np.repeat(doc, length), np.repeat(start, length) + inside
    order = np.lexsort((starts, docs))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = index.earliest(place)
    hit = interval >= 0
    out_doc, out_start = np.full(len(words), -1), np.full(len(words), -1)
    at = order[first[interval[hit]]]
    out_doc[hit], out_start[hit] = docs[at], starts[at]
    return out_doc, out_start


# --- the distributed operator --------------------------------------------


class Group:
    """Words and pieces of a group of documents."""

    def __init__(self, table: pa.Table, replies: pa.Table, span: int, gram: int, shards: int):
        tokens.encoder.cache_clear()        # a reused worker may still hold words of a packing task
        self.span, self.shards = span, shards
        ids, all_texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, all_texts[i]))
        self.ids = [ids[i] for i in self.order]
        raw = [all_texts[i].encode("utf-8", "surrogatepass") for i in self.order]
        self.buffer = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        edge = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.doc = np.array([LAST if d is None else d for d in self.ids], np.int64)
        self.first, self.end = word_places(self.buffer)
        self.words = word_hashes(self.buffer, self.first, self.end)
        self.doc_first, self.doc_end = np.searchsorted(self.first, edge[:-1]), np.searchsorted(self.first, edge[1:])
        # later copies of a whole text take no part: all their windows are repeats
        replies = replies if replies.num_rows else _nothing(_REPLY)
        self.replies = {k: replies.filter(pa.array(np.array(replies.column("kind").to_pylist(), np.int64) == k, pa.bool_())) for k in range(4)}
        firsts = set(zip(self.replies[FIRSTS].column("shard").to_pylist(), self.replies[FIRSTS].column("a").to_pylist()))
        digests = table.column("digest").to_pylist()
        self.copy = np.array([(d, digests[i]) not in firsts for d, i in zip(self.doc.tolist(), self.order)], bool)
        self.piece, self.windows, self.anchor, self.owner = pieces(self.words, self.doc_first, np.where(self.copy, self.doc_first, self.doc_end), span, gram)
        self.shard = self._shard(self.anchor)

    def _shard(self, key: np.ndarray) -> np.ndarray:
        return ((key >> _U(32)) % _U(self.shards)).astype(np.int64)

    def content(self, first: np.ndarray, windows: np.ndarray, powers: _Powers = _WORDS) -> np.ndarray:
        return ranges_hash(self.words, first, first + windows + self.span - 1, powers)

    def keys(self, key: np.ndarray, shard: np.ndarray, content: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Distinct (32 bits of the key, shard) in shard order, how often
        each occurs, with how many contents, its number for each input."""
        low = key & _U(0xFFFFFFFF)
        order = np.lexsort((low, shard) if content is None else (content, low, shard))
        k, s = low[order], shard[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        starts = np.flatnonzero(new)
        number = np.empty(len(k), np.int64)
        number[order] = np.cumsum(new) - 1
        count = np.diff(np.concatenate([starts, [len(k)]]))
        if content is None or not len(k):
            return k[new], s[new], count, count, number
        c = content[order]
        other = new.copy()
        other[1:] |= c[1:] != c[:-1]
        return k[new], s[new], count, np.add.reduceat(other.astype(np.int64), starts), number

    def anchors(self) -> tuple[np.ndarray, ...]:
        return self.keys(self.anchor, self.shard, self.content(self.piece, self.windows))

    def _bits(self, kind: int, shard: np.ndarray, column: str) -> np.ndarray:
        """The shards' bits, in the order in which the keys were sent."""
        table = self.replies[kind]
        bits = dict(zip(table.column("shard").to_pylist(), table.column(column).to_pylist()))
        values, cut = runs(shard)
        parts = [np.unpackbits(np.frombuffer(bits[s], np.uint8), count=at.stop - at.start) for s, at in zip(values.tolist(), cut)]
        return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with repeated anchors: numbers of those that stay whole;
        first words of the windows of those with a hot anchor."""
        _, shard, _, _, number = self.anchors()
        repeated, hot = (self._bits(ANCHORS, shard, c)[number] for c in ("a", "b"))
        far = np.flatnonzero(repeated & hot)
        count = self.windows[far]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.flatnonzero(repeated & ~hot), np.repeat(self.piece[far], count) + inside

    def hot_windows(self, first: np.ndarray) -> tuple[np.ndarray, ...]:
        key = self.content(first, np.ones(len(first), np.int64))
        return (key, *self.keys(key, self._shard(key)))

    def chosen(self) -> tuple[np.ndarray, ...]:
        """Distinct pieces to send, in shard order, each at its earliest
        place: (first, windows, shard), and for every piece that they stand
        for: (first, windows, number of the distinct one)."""
        whole, window = self.split()
        if len(window):
            key, _, shard, _, _, number = self.hot_windows(window)
            again = self._bits(WINDOWS, shard, "a")[number]
            window, key = window[again], key[again]
        else:
            key = np.zeros(0, _U)
        first = np.concatenate([self.piece[whole], window])
        windows = np.concatenate([self.windows[whole], np.ones(len(window), np.int64)])
        shard = np.concatenate([self.shard[whole], self._shard(key)])
        one, two = self.content(first, windows), self.content(first, windows, _OTHER)
        order = np.lexsort((first, two, one, shard))     # words stand in (doc, start) order
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (shard[order][1:] != shard[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        lead = order[new]
        return first[lead], windows[lead], shard[lead], first, windows, number

    def places(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc, start within it) of words."""
        d = np.searchsorted(self.doc_end, first, side="right")
        return self.doc[d], first - self.doc_first[d]

    def removed(self) -> np.ndarray:
        """Which words of the group go."""
        lead, _, shard, first, windows, number = self.chosen()
        table = self.replies[FLAGS].sort_by("shard")
        flags = joined(table.column("a"), "<u8")[0]
        count = windows
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        which = np.repeat(np.arange(len(first)), count)
        # a window stays only where its piece's earliest place is the earliest of all
        doc, start = self.places(first)
        lead_doc, lead_start = self.places(lead)
        own = (doc == lead_doc[number]) & (start == lead_start[number])
        stays = own[which] & (flags[number[which]] >> inside.astype(_U) & _U(1)).astype(bool)
        gone = (first[which] + inside)[~stays]
        change = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + self.span, -1)
        out = np.cumsum(change[:-1]) > 0
        for d in np.flatnonzero(self.copy).tolist():
            if self.doc_end[d] - self.doc_first[d] >= self.span:
                out[self.doc_first[d]:self.doc_end[d]] = True
        return out

    def kept(self, removed: np.ndarray) -> list[str]:
        """Each document's other words with a blank between them."""
        edge = np.zeros(len(self.buffer) + 1, np.int8)
        edge[self.first[~removed]] += 1
        edge[self.end[~removed] + 1] -= 1                # the word and the sign after it
        keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
        text = self.buffer.copy()
        text[self.end] = 32
        text = text[keep].tobytes()
        size = np.concatenate([[0], np.cumsum(np.where(removed, 0, self.end + 1 - self.first))])
        return [text[size[a]:max(size[a], size[b] - 1)].decode("utf-8", "surrogatepass") for a, b in zip(self.doc_first.tolist(), self.doc_end.tolist())]


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, text: str = "text", key: str = "doc_id", carry: list[str] | None = None,
                    chars: int = CHARS, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``spans`` (packed int64
    pairs from, to in words: the maximal runs that go), ``kept`` (the other
    words with a blank between them) and the columns ``carry`` as ``c0``..."""
    if not 1 <= gram <= span or span - gram + 1 > 64:
        raise ValueError("a window holds at least one gram and at most 64")
    ship_package(docs.sparkSession)
    more = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry or [])]
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *more)
    size = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n = max(MIN_GROUPS, -(-size // chars))
    place = F.coalesce("doc_id", F.lit(int(LAST)))
    group_of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    rows = rows.select(group_of(place, "digest").alias("grp"), *rows.columns)
    carried = [f.name for f in rows.schema if f.name not in ("grp", "doc_id", "text", "digest")]
    firsts = (rows.groupBy("digest").agg(F.min(place).alias("shard"))
              .select(group_of("shard", "digest").alias("grp"), F.lit(FIRSTS).alias("kind"), "shard", F.col("digest").alias("a"), F.lit(b"").alias("b")))

    def group(table: pa.Table, replies: pa.Table) -> Group:
        return Group(table, replies, span, gram, n)

    def say(table: pa.Table, values: tuple, weights: bool) -> pa.Table:
        k, shard, count, contents, _ = values
        of, cut = runs(shard)
        return pa.table({"grp": pa.array([table.column("grp")[0].as_py()] * len(cut), pa.int64()), "shard": pa.array(of.tolist(), pa.int64()),
                         "low": binary([k[c].astype("<u4").tobytes() for c in cut]), "several": binary([np.packbits(count[c] > 1).tobytes() for c in cut]),
                         "weight": binary([np.minimum(contents[c], 65535).astype("<u2").tobytes() if weights else b"" for c in cut])})

    said = "grp bigint, shard bigint, low binary, several binary, weight binary"

    def say_anchors(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _nothing(said)
        return say(table, group(table, replies).anchors(), True)

    def say_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _nothing(said)
        g = group(table, replies)
        return say(table, g.hot_windows(g.split()[1])[1:], False)

    def repeated(kind: int):
        def run(table: pa.Table) -> pa.Table:
            low, cut = joined(table.column("low"), "<u4")
            several = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=c) for m, c in zip(table.column("several").to_pylist(), cut)])
            uniq, number = np.unique(low, return_inverse=True)
            edges = np.cumsum(cut)[:-1]
            twice = (np.bincount(number, weights=1 + several, minlength=len(uniq)) > 1)[number]
            hot = np.zeros(len(low), bool)
            if kind == ANCHORS:
                hot = (np.bincount(number, weights=joined(table.column("weight"), "<u2")[0], minlength=len(uniq)) > hot_pieces)[number]
            return pa.table({"grp": table.column("grp"), "kind": pa.array([kind] * len(cut), pa.int32()), "shard": table.column("shard"),
                             "a": binary([np.packbits(f).tobytes() for f in np.split(twice, edges)]), "b": binary([np.packbits(f).tobytes() for f in np.split(hot, edges)])})
        return run

    def say_pieces(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _nothing(pieces_said)
        g = group(table, replies)
        first, windows, shard, *_ = g.chosen()
        doc, start = g.places(first)
        length = windows + span - 1
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        words = g.words[np.repeat(first, length) + inside].astype("<u8")
        edge = np.concatenate([[0], np.cumsum(length)])
        of, cut = runs(shard)
        return pa.table({"grp": pa.array([table.column("grp")[0].as_py()] * len(cut), pa.int64()), "shard": pa.array(of.tolist(), pa.int64()),
                         "words": binary([words[edge[c.start]:edge[c.stop]].tobytes() for c in cut]), "windows": binary([windows[c].astype("u1").tobytes() for c in cut]),
                         "doc": binary([doc[c].astype("<i8").tobytes() for c in cut]), "start": binary([start[c].astype("<i8").tobytes() for c in cut])})

    pieces_said = "grp bigint, shard bigint, words binary, windows binary, doc binary, start binary"

    def search(table: pa.Table) -> pa.Table:
        windows, cut = joined(table.column("windows"), "u1")
        windows = windows.astype(np.int64)
        words, doc, start = (joined(table.column(c), t)[0] for c, t in (("words", "<u8"), ("doc", "<i8"), ("start", "<i8")))
        length = windows + span - 1
        edge = np.concatenate([[0], np.cumsum(length)])
        # equal pieces of several groups are indexed once, at their earliest place
        one, two = (ranges_hash(words, edge[:-1], edge[1:], p) for p in (_WORDS, _OTHER))
        order = np.lexsort((start, doc, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        lead = order[new]
        each = length[lead]
        inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        out_doc, out_start = repeated_windows(words[np.repeat(edge[:-1][lead], each) + inside], each, doc[lead], start[lead], span)
        # a bit for each window of each sent piece: is its own place the earliest?
        begin = np.cumsum(each) - each
        at = np.repeat(np.arange(len(windows)), windows)
        k = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
        w = begin[number[at]] + k
        mine = (out_doc[w] == doc[at]) & (out_start[w] == start[at] + k)
        flags = np.zeros(len(windows), _U)
        np.bitwise_or.at(flags, at, mine.astype(_U) << k.astype(_U))
        return pa.table({"grp": table.column("grp"), "kind": pa.array([FLAGS] * len(cut), pa.int32()), "shard": table.column("shard"),
                         "a": binary([f.astype("<u8").tobytes() for f in np.split(flags, np.cumsum(cut)[:-1])]), "b": binary([b""] * len(cut))})

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.binary()), ("kept", pa.string())])})
        g = group(table, replies)
        gone = g.removed()
        spans = []
        for a, b in zip(g.doc_first.tolist(), g.doc_end.tolist()):
            spans.append(np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).astype("<i8").tobytes())
        return pa.table({"doc_id": pa.array(g.ids, pa.int64()), "n_words": pa.array(g.doc_end - g.doc_first, pa.int64()), "spans": binary(spans),
                         "kept": pa.array(g.kept(gone), pa.string()), **{c: table.column(c).take(g.order) for c in carried}})

    def ask(replies: DataFrame, fn, schema) -> DataFrame:
        return rows.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(fn, schema)

    anchors = ask(firsts, say_anchors, said).groupBy("shard").applyInArrow(repeated(ANCHORS), _REPLY).unionByName(firsts)
    hot = ask(anchors, say_windows, said).groupBy("shard").applyInArrow(repeated(WINDOWS), _REPLY)
    known = anchors.unionByName(hot)
    flags = ask(known, say_pieces, pieces_said).groupBy("shard").applyInArrow(search, _REPLY)
    return ask(known.unionByName(flags), remove, T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.BinaryType()),
        T.StructField("kept", T.StringType()), *[rows.schema[c] for c in carried]]))


def _nothing(schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array([], kinds[t]) for n, t in (f.split(" ") for f in schema.split(", "))})


def digest(removed: DataFrame) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256."""
    n = F.when(F.col("kept") == "", 0).otherwise(F.length("kept") - F.length(F.translate("kept", " ", "")) + 1)
    return removed.select("doc_id", "n_words", (F.col("n_words") - n).cast("bigint").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
