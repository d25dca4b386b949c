"""Operator 5 against brute force."""
import hashlib

import numpy as np
import pytest

from concord.llm import suffix_dedup as sd
from concord.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, span):
    """doc -> (bytes, removed, runs, hash of the rest), list of rows."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in raw:
        rank = (d is None, d or 0)
        for p in range(len(b) - span + 1):
            s = b[p:p + span]
            if s not in least or rank < least[s]:
                least[s] = rank
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if least[b[p:p + span]] < (d is None, d or 0):
                gone[p:p + span] = b"\1" * span
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d is None, d or 0, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def low_entropy(rng, n):
    """Texts over a tiny alphabet made of shared and changed blocks, so
    that repeats nest, overlap and meet at every offset."""
    blocks = ["".join(rng.choice(list("abé\n"), rng.integers(20, 200))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 6)):
            b = blocks[rng.integers(0, len(blocks))]
            a, e = sorted(rng.integers(0, len(b) + 1, 2))
            b = list(b[a:e] if rng.random() < 0.6 else b)
            if b and rng.random() < 0.4:
                b[rng.integers(0, len(b))] = "X"
            parts.append("".join(b))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("span", [24, 50])
def test_nested_repeats(docs_of, span):
    rng = np.random.default_rng(span)
    rows = list(enumerate(low_entropy(rng, 120)))
    rows += [(200, "a" * 500), (201, "a" * 300 + "b" + "a" * 49), (202, "ab" * 200), (203, "ab" * 150 + "c")]
    assert result(sd.digest(sd.shared_spans(docs_of(rows), span))) == brute(rows, span)


def test_odd_rows(docs_of, odd_rows):
    rows = odd_rows + [(None, "null id text " * 9), (None, "null id text " * 9), (50, "null id text " * 9), (50, "q" * 60), (50, "q" * 60), (51, "q" * 60)]
    assert result(sd.digest(sd.shared_spans(docs_of(rows)))) == brute(rows, 50)


def test_no_rows(docs_of):
    assert sd.digest(sd.shared_spans(docs_of([]))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op5_suffix_dedup"](spark, SF)) == brute(rows, 50)


def test_maximal_groups_against_brute_force():
    rng = np.random.default_rng(3)
    span, width = 24, sd._width(24)
    base = rng.choice(np.frombuffer(b"ab", np.uint8), 400)
    texts = set()
    for _ in range(60):
        a = rng.integers(0, 360)
        piece = bytes(base[a:a + rng.integers(span, 29)])
        if rng.random() < 0.5:
            piece = piece[:10] + b"c" + piece[11:]
        texts.add(piece)
    texts = sorted(t for t in texts if len(t) >= span)
    length = np.array([len(t) for t in texts])
    rows = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        rows[i, :len(t)] = np.frombuffer(t, np.uint8)
    got = {(tuple(sorted(zip(p.tolist(), o.tolist()))), int(d)) for d, p, o in sd.maximal_repeats(rows, length, span)}
    places = {}
    for i, t in enumerate(texts):
        for o in range(len(t)):
            for n in range(span, len(t) - o + 1):
                places.setdefault(t[o:o + n], []).append((i, o))
    want = set()
    for s, at in places.items():
        if len(at) < 2:
            continue
        right = {texts[i][o + len(s)] if o + len(s) < len(texts[i]) else (i, o) for i, o in at}
        left = {texts[i][o - 1] if o else (i, o) for i, o in at}
        if len(right) > 1 and len(left) > 1:
            want.add((tuple(sorted(at)), len(s)))
    assert got == want


def test_cut_text_keeps_whole_characters_and_all_columns(docs_of):
    shared = "é" * 40
    rows = [(1, "a" + shared), (2, "b" + shared + "ç"), (3, None), (4, "x")]
    df = docs_of(rows)
    got = {r.doc_id: r for r in sd.without_repeats(df).collect()}
    assert sd.without_repeats(df).columns == df.columns
    assert got[2].text == "bç" and got[2].n_chars == 2 and got[1].text == "a" + shared
    assert got[3].text is None and got[3].n_chars is None and got[2].start == 7 and got[2].ids == "x" and got[4].text == "x"


@pytest.mark.parametrize("segment", [1, 7, 97, 10_000])
def test_segments_do_not_matter(monkeypatch, segment):
    import pyarrow as pa

    monkeypatch.setattr(sd, "_SEGMENT", segment)
    span, rng = 24, np.random.default_rng(segment)
    rows = list(enumerate(["", *low_entropy(rng, 25), "", "a" * 90, "a" * 70]))
    g = sd.Group(pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}), span, 5)
    windows = sum(max(0, len(t.encode()) - span + 1) for _, t in rows)
    assert (g.last - g.first - span + 1).sum() == windows          # every window lies in one piece
    chosen = np.arange(len(g.first))
    content, length, doc, _, number = g.distinct(chosen, span)
    gone = np.zeros(len(g.buffer), bool)
    mine = g.doc[g.owner]
    spans = list(zip(*sd.coverage(content, length, doc, span)))
    for i in chosen.tolist():
        cuts = [(0, length[number[i]], doc[number[i]])] + [s[1:] for s in spans if s[0] == number[i]]
        for a, b, least in cuts:
            if least < mine[i]:
                gone[g.first[i] + a:g.first[i] + b] = True
    got = [(d, len(t.encode()), int(gone[s:e].sum())) for (d, t), s, e in zip(rows, g.start, g.end)]
    assert got == [(d, n, removed) for _, d, n, removed, _, _ in brute(rows, span)]


def test_cut_texts_pass_one_python_task_and_travel_once(docs_of):
    """A second Python step over whole texts doubled the workers of a task slot."""
    docs = docs_of([(1, "a" * 90), (2, "b" + "a" * 90), (3, None)])
    plan = sd.without_repeats(docs)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 0 and plan.count("FlatMapCoGroupsInArrow") >= 2
    seen = []
    dealt = sd.dealt
    try:
        sd.dealt = lambda rows, text, key, carry, chars: seen.append(carry) or dealt(rows, text, key, carry, chars)
        out = sd.without_repeats(docs.withColumnRenamed("ids", "__unset"))
    finally:
        sd.dealt = dealt
    assert "text" not in seen[0]
    assert {(r.doc_id, r.text, r["__unset"]) for r in out.collect()} == {(1, "a" * 90, "x"), (2, "b", "x"), (3, None, "x")}
