"""Operator 12 against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest

from concord.llm import substring_dedup as sd
from concord.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_force(rows, span=20):
    """{(doc, text): (n_words, n_removed, sha256)}"""
    last = lambda d: (d is None, d or 0)
    first = {}
    split = [(d, WORDS.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - span + 1):
            k = tuple(w[i:i + span])
            first[k] = min(first.get(k, ((True, 2**70), 0)), (last(d), i))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            if first[tuple(w[i:i + span])] < (last(d), i):
                gone[i:i + span] = [True] * span
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def prose(rnd, n, vocabulary=4000):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def shared_texts(seed, n=60):
    rnd = random.Random(seed)
    passage, phrase, base = prose(rnd, 55), prose(rnd, 9), prose(rnd, 200)
    rows = []
    for i in range(n):
        kind = i % 6
        near = base.split()
        near[rnd.randrange(200)] = "changed"
        text = [f"{prose(rnd, 40)}\n{passage}\t{prose(rnd, 30)}", f"{prose(rnd, 25)} {phrase} {prose(rnd, 25)}", base, "  " + " \r\n ".join(near) + " ",
                " ".join(["again and"] * 30), f"{prose(rnd, 30)} {passage} {prose(rnd, 3)} {passage} ünï　cödé {phrase}"][kind]
        rows.append((rnd.randrange(-20, 80) * 2 + i % 2, text))
    return rows


def result(df):
    return sorted(map(tuple, sd.digest(df).collect()), key=str)


@pytest.mark.parametrize("chars,hot", [(4_000_000, 4096), (2_000, 3)])
def test_odd_and_shared_rows(docs_of, odd_rows, chars, hot):
    rnd = random.Random(4)
    tail = prose(rnd, 30)
    rows = odd_rows + shared_texts(1) + [(None, tail), (None, tail), (70, tail), (70, "x " + tail), (71, tail + " y"), (72, "word " * 25)]
    assert result(sd.without_repeats(docs_of(rows), chars=chars, hot_pieces=hot)) == by_force(rows)


def test_other_windows_and_carried_columns(docs_of):
    rows = shared_texts(7, 30)
    got = sd.without_repeats(docs_of(rows), span=6, gram=3, carry=["start", "text"])
    assert result(got) == by_force(rows, 6)
    assert {(r.doc_id, r.c0, r.c1) for r in got.collect()} == {(d, 7, t) for d, t in rows}
    for r in got.collect():                              # spans say what kept leaves out
        w, edge = WORDS.findall(r.c1), np.frombuffer(r.spans, "<i8").tolist()
        for a, b in zip(edge[0::2], edge[1::2]):
            w[a:b] = [None] * (b - a)
        assert " ".join(x for x in w if x is not None) == r.kept and r.n_words == len(w)


def test_no_rows_and_only_nulls(docs_of):
    assert sd.without_repeats(docs_of([])).count() == 0
    assert result(sd.without_repeats(docs_of([(1, None), (None, None)]))) == by_force([(1, None), (None, None)])


def test_a_very_long_text(docs_of):
    rnd = random.Random(8)
    text = prose(rnd, 400_000, 10**6)
    rows = [(5, text), (6, text[1_000_000:1_200_000]), (4, text[2_000_000:2_000_900])]
    assert result(sd.without_repeats(docs_of(rows))) == by_force(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_substring_dedup"](spark, SF).collect()), key=str) == by_force(rows)


def test_hashes_do_not_depend_on_place_or_blocks(monkeypatch):
    text = b"one two  three\tone \xc3\xa9one two one\n"
    buffer = np.frombuffer(text, np.uint8)
    first, end = sd.word_places(buffer)
    assert [text[a:b] for a, b in zip(first, end)] == text.split()
    whole = sd.word_hashes(buffer, first, end)
    monkeypatch.setattr(sd, "_BLOCK", 4)
    assert (sd.word_hashes(buffer, first, end) == whole).all()
    assert whole[0] == whole[3] == whole[6] and len(set(whole.tolist())) == 4


def test_wavelet_tree_counts():
    rng = np.random.default_rng(2)
    for n, kinds in ((1, 1), (64, 2), (1000, 37), (130, 128)):
        values = rng.integers(0, kinds, n)
        tree = sd.WaveletTree(values, kinds)
        at, c = rng.integers(0, n + 1, 300), rng.integers(0, kinds, 300)
        assert tree.rank(c, at).tolist() == [int((values[:a] == x).sum()) for a, x in zip(at, c)]


def test_matching_statistics_of_other_texts():
    rng = np.random.default_rng(3)
    for span in (3, 5):
        length = rng.integers(1, 12, 40)
        words = rng.integers(0, 5, length.sum()).astype(np.uint64)
        index = sd.FmIndex(words, length, span)
        parts = np.split(words, np.cumsum(length)[:-1])
        known = {tuple(p[i:i + k].tolist()) for p in parts for k in range(1, span + 1) for i in range(len(p) - k + 1)}
        q_length = rng.integers(1, 15, 30)
        query = rng.integers(0, 7, q_length.sum()).astype(np.uint64)         # 5 and 6 are not in the index
        got, interval = index.matching_statistics(query, q_length)
        at = 0
        for p in np.split(query, np.cumsum(q_length)[:-1]):
            for i in range(len(p)):
                want = max([k for k in range(1, min(span, len(p) - i) + 1) if tuple(p[i:i + k].tolist()) in known], default=0)
                assert got[at] == want and (interval[at] >= 0) == (want == span)
                at += 1
