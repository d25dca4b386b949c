"""Operator 8 against brute force."""
import re

import numpy as np
import xxhash

from concord.llm import simhash
from concord.llm.components import connected
from concord.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(fps, radius=3):
    """component of each index: smallest index reachable."""
    comp = list(range(len(fps)))
    changed = True
    near = [[j for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= radius] for i in range(len(fps))]
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(comp[j] for j in js)
            if m < comp[i]:
                comp[i], changed = m, True
    return comp


def check(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = slow_groups(fps)
    want = sorted(((d is None, d or 0, f, rows[c][0]) for (d, _), f, c in zip(rows, fps, comp)), key=str)
    assert sorted(((r.doc_id is None, r.doc_id or 0, int(r.fingerprint, 16), r.component_id) for r in got), key=str) == want


def hexed(df):
    from pyspark.sql import functions as F
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id").collect()


def test_odd_rows(docs_of, odd_rows):
    check(odd_rows, hexed(simhash.near_duplicates(docs_of(odd_rows))))


def test_no_rows(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, QUERIES["op8_simhash_groups"](spark, SF).collect())


def test_tree_links_equal_brute_force():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    points = {int(c) for c in rng.integers(0, 2**63, 900, dtype=np.uint64)}
    for c in centres.tolist():                   # chains and balls around centres
        p = c
        for _ in range(25):
            points.add(p)
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                p ^= 1 << b
    fps = np.array(sorted(points), dtype=np.uint64)
    want = slow_groups(fps.tolist())
    tree = simhash.routing_tree(fps[::3], 4)
    at, leaf, home = simhash.route(tree, fps, 3)
    assert np.bincount(at[home], minlength=len(fps)).tolist() == [1] * len(fps)
    comp = list(range(len(fps)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for k in range(leaf.max() + 1):
        mine = leaf == k
        places = np.concatenate([at[mine & home], at[mine & ~home]])
        found = simhash.leaf_links(fps[at[mine & home]], fps[at[mine & ~home]], 3, small=8)
        assert len(found) < max(1, len(places))
        for a, b in found:
            x, y = find(places[a]), find(places[b])
            comp[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == want


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(int(a), int(b)) for a, b in rng.integers(200, 300, (60, 2))] + [(7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i
    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: find(i) for i in linked}
