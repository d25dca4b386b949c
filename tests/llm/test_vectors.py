"""Operators 11 and 13 against brute force."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import ball_kmeans, hard_negatives, queries
from concord.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, id bigint, v string, tag int, slot int, rb int, error string, code string"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "e", "c") for r in rows], SCHEMA).repartition(partitions)


def odd_vectors(seed=3, n=260, width=16):
    rnd = random.Random(seed)
    common = [rnd.choice([-1, 0, 1]) * 0.25 for _ in range(width)]
    rows = []
    for i in range(n):
        v = list(common) if i % 3 == 0 else [rnd.randint(-4, 4) / 16 + 0.01 for _ in range(width)]
        rows.append((i, v, rnd.choice([0, 0, 1, 2, None]) if i % 100 else 0))
    rows += [(300, None, 1), (301, [], 1), (302, [math.nan] * width, 1), (303, [None] * width, 0), (304, [math.inf] + [0.0] * (width - 1), 0),
             (None, list(common), 1), (None, list(common), 1), (500, [0.5] * 3, 2), (500, [0.5] * 3, 2), (100, [1.0] * width, 0), (600, [-1.0] * width, 1),
             (-100, [0.25] * width, 0), (7, list(common), None)]
    return rows


def integers(v, scale):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(float(np.float32(x)) * scale) for x in v]


def mined_by_force(rows, n_positives=5, k=5):
    kept = set()
    for i, v, label in rows:
        q = integers(v, 256)
        if i is not None and i % 7 == 0 and label is not None:
            label = (label + 1) % 10
        if q is not None and label is not None:
            kept.add((i, label, tuple(q)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a in kept:
        if a[0] is None or a[0] % 100:
            continue
        scored = [(dot(a[2], b[2]), b[0], b[1]) for b in kept if b != a]
        for p in sorted((s for s in scored if s[2] == a[1]), key=order)[:n_positives]:
            found = sorted((s for s in scored if s[2] != a[1] and 80 * p[0] <= 100 * s[0] <= 100 * p[0]), key=order)[:k]
            out += [(a[0], p[1], rank + 1, s[1], p[0], s[0]) for rank, s in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [(8192, 2048), (40, 2)])
def test_mining_of_odd_rows(spark, monkeypatch, blocks):
    rows = odd_vectors()
    monkeypatch.setattr(queries, "read_table", lambda *_: frame(spark, rows))
    monkeypatch.setattr(hard_negatives, "_SLICE", 100)
    mine = hard_negatives.mine
    monkeypatch.setattr(hard_negatives, "mine", lambda r: mine(r, block_rows=blocks[0], block_anchors=blocks[1]))
    got = QUERIES["op11_hard_negatives"](spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined_by_force(rows)
    assert len(want) > 30 and sorted(map(tuple, got.collect()), key=str) == want


def test_mining_of_no_rows_and_of_one_label(spark):
    for rows in ([], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        df = frame(spark, rows)
        assert hard_negatives.mine(hard_negatives.integer_rows(df, 256, F.col("label"), F.col("vec_id") == 0)).count() == 0


def test_products_are_exact_at_any_size():
    a, b = np.array([[2**40, 3], [2**62, -1], [1, 1]]), np.array([[2**20, 5], [2**62, 2**62], [-2**62, 7]])
    want = [[max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(r.tolist(), c.tolist())))) for c in b] for r in a]
    assert hard_negatives.products(a, b).tolist() == want
    score = np.array([5, 9, 9, -2**63, 5])
    assert sorted(hard_negatives.first_of(np.zeros(5, np.int64), np.arange(5), score, 3).tolist()) == [0, 1, 2]


def codes_by_force(rows, parts=8, n=16, rounds=6, scale=4096):
    kept = [(i, label, integers(v, scale)) for i, v, label in rows if integers(v, scale) is not None]
    width = max(1, -(-max(len(v) for _, _, v in kept) // parts)) * parts
    kept = sorted(((i, label, v + [0] * (width - len(v))) for i, label, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = width // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for p in range(parts)] for _, _, v in kept]
    books = [[cut[e][p] for e in range(min(n, len(cut)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, now) if a[p][1] == j]
                if mine:
                    books[p][j] = tuple(sum(x) // len(mine) for x in zip(*mine))
    now = assign()
    error = [sum(d for d, _ in a) for a in now]
    by = {}
    for (_, label, _), e in zip(kept, error):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in a), e, by[label], digest) for (i, label, _), a, e in zip(kept, now, error)), key=str)


@pytest.mark.parametrize("rows", [odd_vectors(), odd_vectors(9, 40, 10), [(1, [0.5] * 8, None), (None, [0.25] * 8, None), (1, [0.5] * 8, 3)]])
def test_codes_of_odd_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(queries, "read_table", lambda *_: frame(spark, rows))
    got = QUERIES["op13_vector_codes"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == codes_by_force(rows)


def test_codes_of_no_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "read_table", lambda *_: frame(spark, [(1, None, 2)]))
    assert QUERIES["op13_vector_codes"](spark, SF).count() == 0


def test_label_errors_without_a_broadcast(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 4 else None, i) for i in range(50)], "vec_id bigint, label int, error bigint")
    few, many = (sorted(map(tuple, ball_kmeans.with_label_error(df, max_labels=n).collect())) for n in (100, 0))
    assert few == many and len(few) == 50


def test_balls_give_what_full_comparison_gives_with_less_work():
    rng = np.random.default_rng(5)
    for scale in (4, 1000):                      # coarse numbers give ties and equal entries
        x = rng.integers(-scale, scale, (600, 4)) + 3 * scale * rng.integers(0, 4, (600, 1))
        entries = x[:16].copy()
        entries[3] = entries[7]
        code, _ = ball_kmeans.nearest(x, entries)
        work = {}
        for _ in range(5):
            sums = ball_kmeans.partial_sums(x, code, 16)
            entries = np.where(sums[:, -1:] > 0, sums[:, :-1] // np.maximum(sums[:, -1:], 1), entries)
            code, d = ball_kmeans.reassign(x, code, entries, work)
            full, best = ball_kmeans.nearest(x, entries)
            assert (code == full).all() and (d == best).all()
        assert work["distances"] < 5 * 600 * 15 / 2


def test_large_components_are_held_within_the_limit(spark):
    df = frame(spark, [(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0), (3, [1.0] * 8, 0)])
    coded, books = ball_kmeans.BallKMeans(n_entries=2).encode(ball_kmeans.integer_vectors(df.select("vec_id", "label", "embedding"), 4096))
    assert coded.count() == 3 and abs(books.entries).max() <= 2**29
