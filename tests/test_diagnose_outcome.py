"""G diagnosis and H before/after outcomes on hand-made rows."""

from pyspark.sql import functions as F

from concord.operators import diagnose as G
from concord.operators import outcome as H

SIG = ("validation_id long, signal_id long, source_validator string, signal_type string, "
       "source_expression string, target_expression string, analysis_path string, mismatch_count long, column string")


def test_rule_and_row_signal_merge(spark):
    s = spark.createDataFrame([
        (1, 1, "BusinessRuleValidator", "OPERATOR_CHANGED", "t.amount > 500", "t.amount >= 500",
         "columns[risk_class]", 0, "risk_class"),
        (1, 2, "RowValidator", "VALUE_MISMATCH", "t.amount > 500", "t.amount >= 500",
         "columns[risk_class]", 229, "risk_class")], SIG)
    d = G.consolidate(s, total_rows=10000).collect()
    assert len(d) == 1
    r = d[0]
    assert r.category == "BOUNDARY_CONDITION" and r.affected_row_count == 229
    assert r.affected_percentage == 2.29 and r.classification_confidence == 0.95
    assert r.affected_output_columns == ["risk_class"] and r.discrepancy_id == "D-001"
    assert r.severity == "HIGH"


def test_row_signal_on_other_column_stays_separate(spark):
    s = spark.createDataFrame([
        (1, 1, "BusinessRuleValidator", "OPERATOR_CHANGED", "t.amount > 500", "t.amount >= 500",
         "columns[risk_class]", 0, "risk_class"),
        (1, 2, "RowValidator", "VALUE_MISMATCH", None, None, "columns[total_amount]", 40, "total_amount")], SIG)
    d = {r.analysis_path: r for r in G.consolidate(s, total_rows=10000).collect()}
    assert len(d) == 2
    assert d["columns[risk_class]"].affected_row_count is None
    assert d["columns[total_amount]"].affected_row_count == 40


def test_order_does_not_matter(spark):
    rows = [(1, i, v, "", f"x{i % 3} > 1", f"x{i % 3} >= 1", f"columns[c{i % 2}]", i, None)
            for i, v in enumerate(["RowValidator", "BusinessRuleValidator", "EdgeCaseValidator"] * 4)]
    a = G.consolidate(spark.createDataFrame(rows, SIG), total_rows=100)
    b = G.consolidate(spark.createDataFrame(list(reversed(rows)), SIG).repartition(5), total_rows=100)
    key = lambda r: (r.signature, r.discrepancy_id, r.severity, r.affected_row_count)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_classifier_priorities(spark):
    rows = [(1, 1, "RowValidator", "", "COALESCE(a, 0) > 5", "a > 5", "", 1, None),
            (1, 2, "RowValidator", "", "a > 5", "a >= 5", "", 1, None),
            (1, 3, "RowValidator", "", "LEFT JOIN b", "INNER JOIN b", "", 1, None),
            (1, 4, "RowValidator", "", "x UNION y", "x", "", 1, None),
            (1, 5, "RowValidator", "", "foo", "bar", "", 1, None),
            (1, 6, "RowValidator", "", "UPDATED_AT", "x", "", 1, None)]
    got = {r.signal_id: r.category for r in G.classify(G.normalize_signals(spark.createDataFrame(rows, SIG))).collect()}
    assert got == {1: "NULL_SEMANTICS", 2: "BOUNDARY_CONDITION", 3: "JOIN_SEMANTICS", 4: "SET_SEMANTICS",
                   5: "UNKNOWN", 6: "DATE_SEMANTICS"}


def test_normalize_expression(spark):
    df = spark.createDataFrame([("  sum( x )   where  a = 1.00 and b is null ",)], "e string")
    assert df.select(G.normalize_expression(F.col("e"))).first()[0] == "SUM( x ) WHERE a = 1 AND b IS NULL"


def test_grounding(spark):
    ev = spark.createDataFrame([(1, "E-001"), (1, "E-003"), (2, "E-001")], "pack_id long, evidence_id string")
    cl = spark.createDataFrame([(1, 1, "E-001"), (1, 2, "E-003"), (2, 1, "E-009"), (3, 1, None)],
                               "pack_id long, claim_id long, evidence_ref string")
    got = {r.pack_id: r.is_valid for r in G.grounding_check(cl, ev).collect()}
    assert got == {1: True, 2: False, 3: False}


D = ("pair_id long, discrepancy_id string, ordinal long, category string, analysis_path string, "
     "affected_row_count long")


def test_region_match_reduction(spark):
    b = spark.createDataFrame([(1, "D-001", 1, "BOUNDARY_CONDITION", "columns[risk_class]", 10512)], D)
    a = spark.createDataFrame([(1, "D-002", 1, "BOUNDARY_CONDITION", "columns[risk_class]", 5000)], D)
    b2 = b.withColumn("source_expression", F.lit("a > 1"))
    r = H.target_outcome(b2, a).collect()[0]
    assert r.status == "PERSISTS" and r.affected_rows_after == 5000
    assert r.reduction_count == 5512 and r.reduction_percentage == 52.44


def test_region_other_category_changed_and_resolved(spark):
    b = spark.createDataFrame([(1, "D-001", 1, "BOUNDARY_CONDITION", "columns[r]", 10), (2, "D-001", 1, "NULL_SEMANTICS", "x", 5)], D)
    a = spark.createDataFrame([(1, "D-002", 1, "FILTER_LOGIC", "columns[r]", 10)], D)
    got = {r.pair_id: r.status for r in H.target_outcome(b, a).collect()}
    assert got == {1: "CHANGED", 2: "RESOLVED"}


def test_new_discrepancy_and_zero_rows(spark):
    b = spark.createDataFrame([(1, "D-001", 1, "BOUNDARY_CONDITION", "columns[r]", 10)], D)
    a = spark.createDataFrame([(1, "D-002", 1, "CASE_LOGIC", "columns[other]", 3)], D)
    out = {(r.outcome, r.discrepancy_id) for r in H.classify_before_after(b, a).collect()}
    assert out == {("RESOLVED", "D-001"), ("NEW", "D-002")}
    f = spark.createDataFrame([(1, 1, 0, "RESOLVED", 0.0), (2, 0, 0, "RESOLVED", 0.0), (3, 0, 0, "RESOLVED", None)],
                              "k int, new int, rows_before long, ts string, pct double")
    st = f.select("k", H.verification_status(F.lit(True), F.lit(True), F.lit(True), F.lit(True), F.lit(True),
                                             F.col("new"), F.col("ts"), F.col("rows_before"), F.col("pct")).alias("s"))
    got = {r.k: r.s for r in st.collect()}
    assert got[1] == "NEW_DISCREPANCIES" and got[2] == "FAILED_VERIFICATION"


def test_all_classes_occur_in_the_classified_signals(spark, sf):
    from concord.operators.diagnose import CATEGORIES
    from concord.plans import registry
    registry.load_all()
    got = {r.category for r in registry.QUERIES["g04_classify"](spark, sf).select("category").distinct().collect()}
    assert got == set(CATEGORIES)


def test_evidence_carries_values_and_totals(spark):
    from concord.operators.diagnose import typed_evidence
    rows = [(1, i, "RowValidator", "VALUE_MISMATCH", "columns[a]", "a", f"k{i}", "1", "2") for i in range(5)] + [(1, 9, "BusinessRuleValidator", "X", "rules[0]", None, None, None, None)]
    df = spark.createDataFrame(rows, "validation_id long, signal_id long, source_validator string, signal_type string, analysis_path string, column string, "
                                     "row_key string, source_value string, target_value string")
    got = typed_evidence(df, cap=3, link=False).collect()
    diffs = sorted((r.ordinal, r.row_key, r.source_result, r.target_result, r.detail, r.total_count, r.truncated) for r in got if r.type == "ROW_DIFF")
    assert diffs == [(i + 1, f"k{i}", "1", "2", "rows differ in a", 5, True) for i in range(3)]
    rule = [r for r in got if r.type == "RULE_DIFF"]
    assert len(rule) == 1 and rule[0].total_count == 1 and not rule[0].truncated and rule[0].detail


def test_containment_keys_find_what_contains_finds(spark):
    from concord.functions.text import grams, leading_gram, prefixes
    texts = ["", "a", "columns[a]", "columns[a].x", "lumns[a]", "filters[0].expression", "filters[0]", "ers[0].expr", "xx" * 12]
    a = spark.createDataFrame([(t,) for t in texts], "a string")
    b = a.withColumnRenamed("a", "b")
    met = a.withColumn("g", leading_gram(F.col("a"))).join(b.withColumn("g", F.explode(grams(F.col("b")))), "g").filter(F.col("b").contains(F.col("a")))
    assert {tuple(r) for r in met.select("a", "b").collect()} == {(x, y) for x in texts for y in texts if x and x in y}
    pre = a.withColumn("p", F.explode(prefixes(F.col("a")))).join(b, F.col("p") == F.col("b"))
    assert {(r.a, r.b) for r in pre.collect()} == {(x, y) for x in texts for y in texts if y and x.startswith(y)}


def test_only_longer_regions_are_cut_and_only_into_lengths_asked_for(spark):
    """Every after region used to give all its substrings of up to 8 characters."""
    from concord.functions.text import gram_length, grams
    b = spark.createDataFrame([(1, "D-1", 1, "A", "columns[c1]", 1), (2, "D-1", 1, "A", "columns[c1]", 1), (2, "D-2", 2, "A", "c1]", 1)], D)
    a = spark.createDataFrame([(1, "D-3", 1, "A", "columns[c2]", 1), (1, "D-4", 2, "A", "columns[c1]", 1), (2, "D-3", 1, "B", "columns[c1]", 1)], D)
    t, after = H._prep(b), H._prep(a).select("pair_id", "category", "_reg", F.struct("ordinal").alias("_at"))
    assert [(r.pair_id, r._reg, r.category) for r in H._held_regions(t, after).collect()] == [(2, "c1]", "B")]
    texts = spark.createDataFrame([("columns[c1]", "columns[",), ("abc", "ab")], "held string, of string")
    got = {r.held: sorted(r.g) for r in texts.select("held", grams(F.col("held"), gram_length(F.col("of"))).alias("g")).collect()}
    assert got == {"columns[c1]": sorted(["columns[", "olumns[c", "lumns[c1", "umns[c1]"]), "abc": ["ab", "bc"]}


def test_target_outcome_follows_its_rule(spark):
    import random
    rnd = random.Random(5)
    paths = ["", "columns[a]", "columns[ab]", "columns[a].x", "a]", "s", "filters[0]", "filters[0].expression", "expression", "global"]
    row = lambda: (rnd.choice([1, 2, 3, None]), rnd.choice(["d1", "d2", "d3", None]), rnd.choice([1, 2, 3, None]),
                   rnd.choice(["A", "B", None]), rnd.choice(paths), rnd.choice([0, 4, 9, None]))
    before, after = [row() for _ in range(60)], [row() for _ in range(25)]
    sig = lambda r: f"{r[3] or ''}|{r[4]}||"
    region = lambda r: r[4] or "global"
    order = lambda r: tuple((v is not None, v if v is not None else 0) for v in (r[2],)) + tuple((v is not None, v or "") for v in (r[1],)) + ((r[5] is not None, r[5] or 0),)
    best = {}
    for t in before:
        for a in after:
            if t[0] is None or t[1] is None or t[0] != a[0]:
                continue
            near = region(t) == region(a) or region(t) != "global" and region(t) in region(a)
            cls = 0 if sig(t) == sig(a) else 1 if near and t[3] is not None and t[3] == a[3] else 2 if near else None
            if cls is not None:
                best[t[:2]] = min(best.get(t[:2], (9,)), (cls, order(a), a[1], a[5]), key=lambda m: m[:2])
    want = []
    for t in before:
        m = best.get(t[:2])
        want.append((t[0], t[1], t[3], region(t), "RESOLVED" if m is None else "CHANGED" if m[0] == 2 else "PERSISTS", t[5], 0 if m is None else m[3], m and m[2]))
    got = [(r.pair_id, r.discrepancy_id_before, r.category, r.affected_region, r.status, r.affected_rows_before, r.affected_rows_after, r.matching_after_id)
           for r in H.target_outcome(spark.createDataFrame(before, D), spark.createDataFrame(after, D)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_packs_sign_their_signals_once(spark, sf, monkeypatch):
    """Linking, classifying and signing ran anew for discrepancies and for their evidence."""
    from concord.plans import derived, registry
    registry.load_all()
    signed, calls = G.signed_signals, []
    monkeypatch.setattr(G, "signed_signals", lambda *a: calls.append(a) or signed(*a))
    got = registry.QUERIES["g13_evidence_pack"](spark, sf)
    assert len(calls) == 1
    s = derived.load(spark, sf, "signals")
    d = G.consolidate(s, total_rows=400)
    want = G.evidence_pack(d, *G.pack_inputs(d, G.typed_evidence(s, 100)))
    rows = lambda df: sorted((r.validation_id, r.discrepancy_id, r.evidence_id, r.evidence_type, sorted(r.details.items())) for r in df.collect())
    assert rows(got) == rows(want)


def test_columns_named_in_expressions_link(spark):
    s = spark.createDataFrame([
        (1, 1, "BusinessRuleValidator", "X", "sum(amt) > 5", "sum(amt) >= 5", "rules[1]", 0, None),
        (1, 2, "BusinessRuleValidator", "X", "x", "max(total_amount)", "rules[2]", 0, None),
        (1, 3, "RowValidator", "Y", "a", "b", "p", 1, "amt"),
        (1, 4, "RowValidator", "Y", "a", "b", "p", 1, "total_amount"),
        (1, 5, "RowValidator", "Y", "a", "b", "p", 1, "other"),
        (2, 6, "RowValidator", "Y", "a", "b", "p", 1, "amt"),
        (1, 7, "RowValidator", "Y", "a", "b", "p", 1, "")], SIG)
    got = {r.signal_id: r.target_expression for r in G.link_execution_to_structure(s).collect()}
    assert got == {1: "sum(amt) >= 5", 2: "max(total_amount)", 3: "sum(amt) >= 5", 4: "max(total_amount)", 5: "b", 6: "b", 7: "b"}
