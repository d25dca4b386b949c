"""I assurance, E quality, C injection and F structure on small inputs."""

from pyspark.sql import functions as F

from concord.operators import assurance as A
from concord.operators import inject, quality
from concord.operators import structure as S

CHK = "migration_id long, check_name string, status string, score double"


def test_scores_and_band(spark):
    c = spark.createDataFrame([
        (1, "SchemaValidator", "PASS", 1.0), (1, "RowValidator", "FAIL", 0.5), (1, "AggregateValidator", "PASS", 1.0),
        (1, "BusinessRuleValidator", "SKIPPED", 1.0), (1, "EdgeCaseValidator", "ERROR", 0.0)], CHK)
    r = A.assurance_score(c).collect()[0]
    # applicable weight .75: (10*100 + 30*50 + 20*100 + 15*0) / 75
    assert r.evidence_coverage == 75.0 and r.evidence_score == round(4500 / 75, 2)
    assert r.band == "POOR_ASSURANCE"


def test_gates_and_decision(spark):
    f = spark.createDataFrame([(1, True, True, True, True, False, 0, False, None, None, None, None, True),
                               (2, True, False, True, True, False, 0, False, None, None, None, None, True),
                               (3, True, True, True, True, False, 2, True, 1, "PARTIALLY_RESOLVED", True, True, True)],
                              "migration_id long, source_ok boolean, translation_ok boolean, target_ok boolean, "
                              "schema_ok boolean, has_critical boolean, remaining long, repair_attempted boolean, "
                              "new_after_repair long, verification_status string, dataset_unchanged boolean, "
                              "config_unchanged boolean, lineage_complete boolean")
    g = A.gates(f)
    s = {r.migration_id: r for r in A.gate_summary(g).collect()}
    assert s[1].final_status == "VERIFIED" and s[1].not_applicable_count == 4 and s[1].total_gates == 11
    assert s[2].final_status == "FAILED"
    assert s[3].final_status == "BLOCKED" and s[3].not_applicable_count == 0


def test_lineage_and_transitions(spark):
    lin = spark.createDataFrame([(1, "DIRECT_PASS", "t", "s", "x", "v", "", "", "", ""),
                                 (2, "REPAIRED_PASS", "t", "s", "x", "v", "d", "", "r", "w"),
                                 (3, "REPAIR_FAILED", "t", "s", "x", "v", "d", "a", "r", "")],
                                "migration_id long, verification_path string, translation_id string, "
                                "source_execution_id string, target_execution_id string, validation_id string, "
                                "diagnosis_id string, ai_diagnosis_id string, repair_id string, verification_id string")
    got = {r.migration_id: (r.is_complete, r.missing_fields) for r in A.lineage_check(lin).collect()}
    assert got == {1: (True, ""), 2: (False, "ai_diagnosis_id"), 3: (False, "")}
    ev = spark.createDataFrame([(1, 1, 1, None, "CREATED"), (1, 2, 2, "CREATED", "ANALYZING"),
                                (1, 3, 3, "ANALYZING", "VERIFIED"), (1, 4, 4, "VERIFIED", "ERROR"),
                                (1, 5, 5, "CREATED", "ANALYZING")],
                               "migration_id long, event_id long, ts long, from_state string, to_state string")
    v = {r.event_id: r.violation for r in A.audit_transitions(ev).collect()}
    assert v == {3: "ILLEGAL_EDGE", 4: "FROM_TERMINAL", 5: "CHAIN_BREAK"}


def test_quality_checks(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 99)], "id long, parent long")
    parent = spark.createDataFrame([(10,), (11,)], "pid long")
    assert quality.fk_orphan_keys(child, parent, "parent", "pid").count() == 1
    assert quality.fk_orphan_keys(child, parent, "parent", "pid", strict=True).count() == 2
    dup = spark.createDataFrame([(1,), (1,), (None,), (None,)], "k long")
    assert quality.pk_duplicates(dup, "k").count() == 2
    prof = {r.column_name: r for r in quality.profile_basic(child, "c").collect()}
    assert prof["parent"].null_rate == 0.25 and prof["parent"].distinct_count == 3
    assert prof["parent"].max_val == 99.0


def test_injection_counts(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    n = inject.null_head(o, "o_orderpriority", "o_orderkey", 11).filter(F.col("o_orderpriority").isNull()).count()
    assert n == 11
    t = inject.inject_boundary_triple(o, "o_totalprice", "o_orderkey", 500.0, 0.01, F.col("o_orderstatus") == "F")
    vals = sorted(r[0] for r in t.filter(F.col("o_totalprice").isin(499.99, 500.0, 500.01)).select("o_totalprice").collect())
    assert vals == [499.99, 500.0, 500.01]
    assert inject.duplicate_rows(o, "o_orderkey", 1).count() == o.count() + 1


def test_structure_and_transformations(spark):
    c = spark.createDataFrame([
        (1, "SRC", "filter", 1, "w", "x > 5", False), (1, "TGT", "filter", 1, "w", "x >= 5", False),
        (1, "SRC", "table", 1, "orders", None, False), (1, "TGT", "table", 1, "orders2", None, False),
        (1, "SRC", "aggregation", 1, "COUNT", "id", True), (1, "TGT", "aggregation", 1, "COUNT", "id", False)],
        "migration_id long, side string, kind string, ordinal int, name string, expr string, is_distinct boolean")
    d = {(r.category, r.source_value, r.target_value): r.occurrences for r in S.structural_diff(c).collect()}
    assert ("TABLE_REMOVED", "orders", None) in d and ("TABLE_ADDED", None, "orders2") in d
    assert ("FILTER_REMOVED", "x > 5", None) in d and ("AGGREGATION_CHANGED", "distinct=true", "distinct=false") in d
    assert ("OPERATOR_CHANGED", "x > 5", None) not in d  # '>' is contained in '>='
    tr = spark.createDataFrame([(1, 1, "TRANSLATED_RULE", "NVL", "COALESCE"), (1, 2, "STRUCTURAL_DIFFERENCE", " NVL", "COALESCE "),
                                (1, 3, "TRANSLATED_RULE", "NVL", "COALESCE"), (1, 4, "ASSUMPTION", "ASSUMPTION", "x")],
                               "migration_id long, seq long, type string, source string, target string")
    dd = {r.type: r.occurrences for r in S.dedupe_transformations(tr).collect()}
    assert dd == {"TRANSLATED_RULE": 2, "ASSUMPTION": 1}
    cnt = S.transformation_counts(tr).collect()[0]
    assert (cnt.transformation_count, cnt.assumption_count) == (1, 1)


def test_profiles_share_one_scan_and_bitmaps_are_exact(spark):
    rows = [(i - 70, i % 2 == 0, f"t{i % 3}", None if i % 5 else i * 1e10) for i in range(200)] + [(None, None, None, float("nan")), (2**62, True, "t0", -0.0)]
    df = spark.createDataFrame(rows, "k long, b boolean, t string, d double").withColumn("day", F.date_add(F.lit("1969-11-01"), F.coalesce(F.col("k") % 97, F.lit(0)).cast("int")))
    got = {r.column_name: r for r in quality.profile_basic(df, "x").collect()}
    want = df.agg(*[F.countDistinct(F.when(~F.isnan("d"), F.col("d")) if c == "d" else c).alias(c) for c in df.columns]).first()
    assert {c: got[c].distinct_count for c in df.columns} == want.asDict()
    assert (got["k"].min_val, got["k"].max_val, got["k"].null_count, got["b"].distinct_count) == (-70.0, float(2**62), 1, 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = quality.dataset_profile({"x": spark.read.parquet("/root/testdata/sf0.001/orders.parquet")})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1


def test_sketched_columns_are_marked(spark, sf):
    df = spark.range(20_000).select("id", F.concat(F.lit("name"), "id").alias("name"), (F.col("id") % 4).cast("string").alias("few"), (F.col("id") / 7).alias("x"))
    exact, guess = ({(r.column_name, r.metric, r.label): r.value for r in quality.dataset_profile({"x": df}, sketch_near_unique=s).collect()} for s in (False, True))
    marked = {k[0] for k in guess if k[1] == "distinct_is_estimate"}
    assert marked == {"name", "x"} and not any(k[1] == "distinct_is_estimate" for k in exact)
    for k, v in exact.items():
        near = k[0] in marked and k[1] in ("distinct_count", "shares_omitted")
        assert abs(guess[k] - v) <= 0.05 * v if near else guess[k] == v
