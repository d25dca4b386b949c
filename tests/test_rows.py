"""D3/D6/D7/D8/D9/D10/D11/D13 row comparison."""

import pytest
from pyspark.sql import functions as F

from concord.operators.compare import compare_rows
from concord.operators.compare.report import row_check


def _df(spark, rows, schema="customer_id string, amount double, status string"):
    return spark.createDataFrame(rows, schema)


def _summary(rc):
    return rc.summary.collect()[0].asDict()


def test_reordered_duplicates_pass(spark):
    s = _df(spark, [("C1", 100.0, "ACTIVE"), ("C1", 200.0, "PENDING")])
    t = _df(spark, [("C1", 200.0, "PENDING"), ("C1", 100.0, "ACTIVE")])
    rc = compare_rows(s, t, ["customer_id"])
    out = _summary(rc)
    assert out["mismatch_count"] == 0 and out["score"] == 1.0
    assert out["duplicate_key_warnings"] == 1
    ev = rc.evidence().collect()
    assert [e.category for e in ev] == ["NON_UNIQUE_KEY_WARNING"]


def test_different_multiset_one_cell(spark):
    s = _df(spark, [("C1", 100.0, "ACTIVE"), ("C1", 500.0, "NORMAL")])
    t = _df(spark, [("C1", 100.0, "ACTIVE"), ("C1", 500.0, "HIGH_RISK")])
    rc = compare_rows(s, t, ["customer_id"])
    assert _summary(rc)["mismatch_count"] == 1
    cells = rc.cells.collect()
    assert len(cells) == 1 and cells[0].column == "status"
    assert (cells[0].source_value, cells[0].target_value) == ("NORMAL", "HIGH_RISK")


def test_surplus_target_row(spark):
    s = spark.createDataFrame([("C1", 100.0)], "customer_id string, amount double")
    t = spark.createDataFrame([("C1", 100.0), ("C1", 200.0)], "customer_id string, amount double")
    rc = compare_rows(s, t, ["customer_id"])
    out = _summary(rc)
    assert out["mismatch_count"] == 1 and out["unpaired_rows"] == 1
    assert [r.category for r in rc.unpaired.collect()] == ["EXTRA_IN_TARGET"]


def test_missing_extra_and_value(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id int, name string, v double")
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.5), (4, "d", 4.0)], "id int, name string, v double")
    rc = compare_rows(s, t)  # default key: first column
    out = _summary(rc)
    assert (out["missing_keys"], out["extra_keys"], out["differing_cells"]) == (1, 1, 1)
    assert out["mismatch_count"] == 3 and out["status"] == "FAIL"
    assert out["rows_compared"] == 2 and out["rows_matched"] == 1
    assert abs(out["score"] - round(1 / 3, 4)) < 1e-9
    ev = rc.evidence().collect()
    assert [e.category for e in ev] == ["MISSING_FROM_TARGET", "EXTRA_IN_TARGET", "VALUE_MISMATCH"]
    assert ev[0].key == {"id": "3"}


def test_fast_path_score(spark):
    s = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, v double")
    t = spark.createDataFrame([(i, float(i) + (1 if i < 2 else 0)) for i in range(10)], "id int, v double")
    out = _summary(compare_rows(s, t))
    assert out["one_to_one"] and out["mismatch_count"] == 2 and out["score"] == 0.8


def test_composite_key_and_null_keys(spark):
    s = spark.createDataFrame([(1, None, 5.0), (1, "x", 6.0)], "a int, b string, v double")
    t = spark.createDataFrame([(1, None, 5.0), (1, "x", 6.0)], "a int, b string, v double")
    out = _summary(compare_rows(s, t, ["a", "b"]))
    assert out["mismatch_count"] == 0 and out["missing_keys"] == 0


def test_key_error_row(spark):
    s = spark.createDataFrame([(1, 2.0)], "id int, v double")
    t = spark.createDataFrame([(1, 2.0)], "other int, v double")
    r = row_check(s, t, ["id"]).collect()[0]
    assert r.status == "ERROR" and r.score == 0.0


def test_self_compare_and_partitioning_invariance(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    out = _summary(compare_rows(o, o.repartition(7)))
    assert out["mismatch_count"] == 0 and out["score"] == 1.0
    shuffled = o.select(*reversed(o.columns)).repartition(3)
    assert _summary(compare_rows(o, shuffled, ["o_orderkey"]))["mismatch_count"] == 0


def test_hot_key_unpaired_counts(spark):
    s = spark.range(0, 300).select(F.lit("K").alias("k"), F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    t = spark.range(0, 260).select(F.lit("K").alias("k"), (F.col("id") + 1000).alias("a"), (F.col("id") % 7).alias("b"))
    out = _summary(compare_rows(s, t, ["k"]))
    assert out["unpaired_rows"] == 40            # |300 - 260|
    assert out["differing_cells"] == 260         # every pair agrees in b and differs in a
    assert out["mismatch_count"] == 300


@pytest.mark.parametrize("n", [300, 1500, 6000])
def test_hot_key_tolerance_is_the_same_at_every_size(spark, n):
    s = spark.range(n).select(F.lit("K").alias("k"), (F.col("id") * 1.37).alias("v"))
    t = spark.range(n).select(F.lit("K").alias("k"), (F.col("id") * 1.37 + 1e-9).alias("v"))
    out = _summary(compare_rows(s, t, ["k"]))
    assert (out["mismatch_count"], out["rows_matched"], out["score"], out["status"]) == (0, n, 1.0, "PASS")


def test_copies_are_counted_not_written_out(spark):
    s = spark.createDataFrame([("K", "x")], "k string, v string").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("i")
    t = s.limit(4990).unionByName(spark.createDataFrame([("K", "y")] * 7, "k string, v string"))
    out = _summary(compare_rows(s, t, ["k"]))
    assert (out["rows_matched"], out["differing_cells"], out["unpaired_rows"]) == (4990, 7, 3)


@pytest.mark.parametrize("a,b,diff", [
    (("abc", "string"), (5, "int"), 1), (("7.0", "string"), (7, "int"), 0), ((7, "int"), (7.0, "double"), 0), (("1.50", "decimal(10,2)"), (1.5, "double"), 0),
    ((True, "boolean"), (1, "int"), 0), ((None, "string"), (3, "int"), 1), (("2026-01-01", "string"), ("2026-01-01", "date"), 0), (("x", "string"), (True, "boolean"), 1)])
def test_type_drift_is_compared(spark, a, b, diff):
    side = lambda v, t: spark.createDataFrame([(1,)], "id int").withColumn("v", F.lit(v).cast(t))
    out = _summary(compare_rows(side(*a), side(*b), ["id"]))
    assert out["differing_cells"] == diff and out["rows_compared"] == 1
    assert _summary(compare_rows(side(*b), side(*a), ["v"]))["missing_keys"] in (0, 1)


def test_tolerance_pairs_in_residual(spark):
    s = spark.createDataFrame([("K", 1.0, "x"), ("K", 2.0, "y")], "k string, v double, w string")
    t = spark.createDataFrame([("K", 2.0000001, "y"), ("K", 1.0000001, "x")], "k string, v double, w string")
    out = _summary(compare_rows(s, t, ["k"]))
    assert out["mismatch_count"] == 0 and out["rows_matched"] == 2


def test_injected_faults_found_exactly(spark, sf):
    from concord.operators import inject
    o = spark.read.parquet(f"{sf}/orders.parquet")
    t = inject.null_head(o, "o_orderpriority", "o_orderkey", 11)          # 11 cells
    t = inject.orphan_fk(t, "o_custkey", "o_orderkey", (-99999, -99998))  # +2 cells (rows 1, 2 overlap the 11)
    t = inject.duplicate_rows(t, "o_orderkey", 1)                         # +1 surplus target row
    out = _summary(compare_rows(o, t, ["o_orderkey"]))
    assert out["differing_cells"] == 13 and out["unpaired_rows"] == 1
    assert out["missing_keys"] == 0 and out["extra_keys"] == 0
    assert out["mismatch_count"] == 14 and out["duplicate_key_warnings"] == 1


def _greedy_cells(src, tgt):
    """Differing cells of one key's rows by the rule, on Python values."""
    order = lambda row: [(x is not None, x) for x in row]
    s, t, cells = sorted(src, key=order), sorted(tgt, key=order), 0
    while s and t:
        n, i, j = max(((sum(a == b for a, b in zip(x, y)), -i, -j) for i, x in enumerate(s) for j, y in enumerate(t)))
        cells += len(s[-i]) - n
        del s[-i], t[-j]
    return cells, len(s) + len(t)


def _pairs_of(spark, src, tgt, max_pairs):
    from concord.operators.compare.rows import CompareConfig
    schema = "k int, a int, b string, c int, d string"
    return compare_rows(spark.createDataFrame(src, schema), spark.createDataFrame(tgt, schema), ["k"], CompareConfig(max_pairs=max_pairs))


@pytest.mark.parametrize("max_pairs", [4096, 1])
def test_most_equal_columns_pair_first(spark, max_pairs):
    rc = _pairs_of(spark, [(1, 1, "m", 7, "u"), (1, 5, "n", 8, "v")], [(1, 0, "n", 8, "w"), (1, 6, "m", 7, "z")], max_pairs)
    assert rc.cells.count() == 4 and rc.unpaired.count() == 0


def test_pairing_by_the_rule_on_many_keys(spark):
    import random
    rnd = random.Random(6)
    row = lambda k: (k, rnd.choice([None, 1, 2, 3]), rnd.choice("xyz"), rnd.choice([4, 5]), rnd.choice(["p", "q", None]))
    src, tgt = ([row(k) for k in range(30) for _ in range(rnd.randrange(1, 9))] for _ in range(2))
    out = _summary(_pairs_of(spark, src, tgt, 4096))
    want = [0, 0]
    for k in {r[0] for r in src} & {r[0] for r in tgt}:
        for i, n in enumerate(_greedy_cells([r[1:] for r in src if r[0] == k], [r[1:] for r in tgt if r[0] == k])):
            want[i] += n
    assert [out["differing_cells"], out["unpaired_rows"]] == want


def test_pairing_of_a_hot_key_leaves_no_better_pair(spark, monkeypatch):
    import random

    from concord.operators.compare import pairing
    rnd = random.Random(7)
    monkeypatch.setattr(pairing.Pairing, "block", 16)
    row = lambda: (1, rnd.randrange(30), rnd.choice("uvwxyz"), rnd.randrange(12), rnd.choice("pqrst"))
    src, tgt = [row() for _ in range(150)], [row() for _ in range(130)]
    rc = _pairs_of(spark, src, tgt, 10)
    pairs = rc.pairs.collect()
    cols = "abcd"
    both = [(tuple(r["s_" + c] for c in cols), tuple(r["t_" + c] for c in cols)) for r in pairs if r._has_s and r._has_t for _ in range(r._n)]
    same = sum(n for n in (min(src.count(r), tgt.count(r)) for r in set(src)))
    assert len(both) + same == 130 and sum(r._n for r in pairs if not r._has_t) == 20
    equal = lambda x, y: sum(a == b for a, b in zip(x, y))
    for s1, t1 in both:                                  # no two rows agree in more columns than both do with their partners
        for s2, t2 in both:
            assert equal(s1, t2) <= max(equal(s1, t1), equal(s2, t2))
    assert rc.cells.count() == sum(4 - equal(s, t) for s, t in both)


def test_many_copies_without_long_arrays(spark):
    from concord.operators.compare.rows import each_copy
    assert each_copy(spark.createDataFrame([("a", 200_001), ("b", 1), ("c", 65_536)], "k string, _n bigint")).groupBy("k").count().orderBy("k").collect() \
        == [("a", 200_001), ("b", 1), ("c", 65_536)]
