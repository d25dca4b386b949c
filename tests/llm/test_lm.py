"""Operator 7: counts against brute force, the model's own checks."""
import math
import re
import zlib
from collections import Counter

import numpy as np

from concord.llm import lm
from concord.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def check(rows, got):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts, pairs = Counter(), Counter()
    for d, t in rows:
        if not held(d):
            ws = tokens(t)
            counts.update(ws)
            pairs.update(zip([None, *ws], ws))
    n, v = sum(counts.values()), len(counts)
    p0 = (sum(c == 1 for c in counts.values()) + 1) / (n + 2)
    want = []
    for d, t in rows:
        ws = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        score = 0
        for u, w in zip([None, *ws], ws):
            one = (1 - p0) * counts[w] / max(n, 1) if counts[w] else p0
            k = lm.K0 * max(counts[u], 1) ** lm.GAMMA
            score += math.log10((pairs[u, w] + k * one) / (max(counts[u], pairs[u, w]) + k))
        want.append((str(d), held(d), len(ws), sum(counts[w] > 0 for w in ws), n, base, score))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    for g, w in zip(got, sorted(want)):
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        assert math.isclose(g[6], w[6], rel_tol=2e-3, abs_tol=2e-3)      # counts are quantised


def test_odd_rows(docs_of, odd_rows):
    check(odd_rows, lm.score(docs_of(odd_rows)).collect())


def test_no_rows(docs_of):
    assert lm.score(docs_of([])).count() == 0


def test_query_and_held_out_text(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op7_lm_scoring"](spark, SF).collect()
    check(rows, got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_elias_fano_finds_every_key():
    rng = np.random.default_rng(4)
    for keys in (np.array([], np.uint64), np.array([0], np.uint64), np.array([5, 6, 7], np.uint64),
                 np.unique(rng.integers(0, 2**62, 3000, dtype=np.uint64)), np.unique(rng.integers(0, 5000, 3000, dtype=np.uint64))):
        level = lm.EliasFano(keys)
        probe = np.concatenate([keys, rng.integers(0, 2**62, 500, dtype=np.uint64), rng.integers(0, 6000, 500, dtype=np.uint64)])
        want = np.searchsorted(keys, probe)
        found = np.array([int(w) if w < len(keys) and keys[w] == p else -1 for w, p in zip(want, probe)])
        assert (level.find(probe) == found).all()
        if len(keys):
            assert (level.successor(probe) == want).all()
