"""Token ids of whole texts with a public tokenizer file.

Both tokenizers here cut a text at white space before any merge, so a text
is the concatenation of its blank-separated words' ids, and a word's ids do
not depend on its neighbours.  ``WordEncoder`` therefore encodes a word
once per Python worker and looks it up from then on; anything outside the
plain patterns below goes to the tokenizer whole.  The caches take the first
``word_limit`` words and ``piece_limit`` pieces they meet, which are mostly
the frequent ones: they only save time, never change ids.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np

# letters and signs for which every boundary between the two classes (and
# around a single line feed) is also a boundary of both pre-tokenizers
_PIECE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?|#$%&*()]+|\n")
# white space next to a blank (or no word between two blanks), or twice in a row
_LOOSE = re.compile(r"^\s|\s$|\s\s|^$")
_TWO = re.compile(r"\s\s")


class _LooseSpace(Exception):
    pass


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


class _Codes(dict):
    """text -> code; a text that is not there is encoded, and kept while
    there is room."""

    def __init__(self, tok, limit: int):
        self.tok, self.limit = tok, limit

    def __missing__(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        code = _packed(ids)
        if len(self) < self.limit:
            self[text] = code
        return code


class _Words(dict):
    """word -> code after ``lead``.  A word of several pieces is put together
    from its first piece, which is a word too, and the other pieces.  A piece
    of letters is one pre-token, so the library's model takes it without the
    steps before; everything else takes the library's plain call."""

    def __init__(self, tok, lead: str, fold: bool, word_limit: int, piece_limit: int):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.model, self.lead, self.fold, self.limit = tok, tok.model, lead, fold, word_limit
        self.pieces, self.plain = _Codes(tok, piece_limit), _Codes(tok, 0)
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = str.maketrans({c: shown(c)[0][0] for c in map(chr, range(0xC0, 0x100))})
        self.shown_lead = shown(lead)[0][0] if lead else ""

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            code = _packed([t.id for t in self.model.tokenize(self.shown_lead + (word.lower() if self.fold else word))])
        elif self.lead and _LOOSE.search(word):
            raise _LooseSpace                                    # not a word of a text that is cut at blanks
        else:
            parts = cut(word, self.fold)
            if len(parts) > 1:
                pieces = self.pieces
                code = self[parts[0]] + b"".join([pieces[p] for p in parts[1:]])
            elif parts and word[0].isalpha():
                code = _packed([t.id for t in self.model.tokenize(self.shown_lead + parts[0].translate(self.letters))])
            else:
                code = self.plain[self.lead + word]
        if len(self) < self.limit:
            self[word] = code
        return code


def cut(word: str, fold: bool = False) -> list[str]:
    """Pieces of a word whose codes together are the word's; none for a word
    with other signs than the plain ones.  One pass over the word, whatever
    it holds.  ``fold``: the tokenizer lower-cases, so plain letters may be
    before."""
    if word.isascii() and word.isalpha():
        return [word.lower() if fold else word]
    parts = _PIECE.findall(word)
    if "".join(parts) != word or "\n" in word and (word[-1] == "\n" or "\n\n" in word):
        return []
    return [p.lower() for p in parts] if fold else parts


class WordEncoder:
    """ids as little-endian unsigned 32-bit bytes.

    ``blanks_matter``: a word keeps the blank before it (byte-level files);
    otherwise the tokenizer drops white space and lower-cases.
    ``added_tokens``: a text that spells an added token (<|endoftext|>) gets
    that token's id, as by the tokenizer's plain call; if false, it is text.
    """

    def __init__(self, path: str, blanks_matter: bool, added_tokens: bool = True, word_limit: int = 600_000, piece_limit: int = 100_000):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True         # words put together after lower-casing must not become one
        self.added = [t.content for t in tok.get_added_tokens_decoder().values()] if added_tokens else []
        self.blanks_matter = blanks_matter
        self.plain = _Codes(tok, 0)
        self.words = _Words(tok, " " if blanks_matter else "", not blanks_matter, word_limit, piece_limit)

    def encode(self, text: str) -> bytes:
        """ids of a whole text, without any end token."""
        if any(t in text for t in self.added):
            tok = self.plain.tok
            tok.encode_special_tokens = False
            try:
                return np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            finally:
                tok.encode_special_tokens = True
        if not self.blanks_matter:
            words = (text.lower() if text.isascii() else text).split(" ")
            return b"".join(map(self.words.__getitem__, words))
        words = text.split(" ")
        # nothing stands before the first word; white space next to a blank belongs to no word
        if len(words) > 1 and _LOOSE.search(words[0]) and words[0] or _TWO.search(words[0]):
            return self.plain[text]
        try:
            rest = b"".join(map(self.words.__getitem__, words[1:]))
        except _LooseSpace:
            return self.plain[text]
        pieces = self.words.pieces
        return b"".join([pieces[p] for p in cut(words[0]) or words[:1]]) + rest

    def trim(self, keep: int = 200_000) -> None:
        """Called at the end of a task: a worker that is reused holds the
        first ``keep`` words, which are mostly frequent, and the file's tables."""
        for held in (self.words, self.words.pieces):
            if len(held) > keep:
                first = list(islice(held.items(), keep))
                held.clear()
                held.update(first)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str, blanks_matter: bool, added_tokens: bool = True) -> WordEncoder:
    """One encoder per Python worker and file; a task that is done with it
    calls ``trim``."""
    return WordEncoder(path, blanks_matter, added_tokens)


def chunks(items: list[str], chars: int = 1_500_000):
    """Slices of a list of texts of about ``chars`` characters each (a
    longer text stands alone), as (first, last + 1)."""
    start = size = 0
    for i, t in enumerate(items):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(items):
        yield start, len(items)
