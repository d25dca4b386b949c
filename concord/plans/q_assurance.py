"""Driver queries for I — assurance over the checks / facts / lineage /
artifacts / state_events recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assurance as A
from ..operators.compare.report import report_rollup
from . import derived
from .registry import query

_W = "(VALUES " + ", ".join(f"('{n}', {w}, '{c}', {i}, {round(w * 100)})" for i, (n, w, c) in enumerate(A.COMPONENT_WEIGHTS)) + ") AS w(name, weight, check_name, position, points)"

_COMP = derived.cte("checks") + f""", m AS (SELECT DISTINCT migration_id FROM checks),
comp AS (SELECT m.migration_id, w.position, w.name, CAST(w.weight AS DOUBLE) AS weight, w.points, w.check_name,
  CASE WHEN c.status IS NULL OR c.status = 'SKIPPED' THEN 'NOT_APPLICABLE' WHEN c.status = 'ERROR' THEN 'ERROR' ELSE 'SCORED' END AS status,
  CASE WHEN c.status IS NOT NULL AND c.status NOT IN ('SKIPPED', 'ERROR') THEN round(c.score * 100.0, 6) ELSE 0.0 END AS raw_score
  FROM m CROSS JOIN {_W} LEFT JOIN checks c ON c.migration_id = m.migration_id AND c.check_name = w.check_name)
"""


def _checks(spark, sf):
    return derived.load(spark, sf, "checks")


@query("i01_component_scores", _COMP + "SELECT * FROM comp")
def i01(spark, sf):
    return A.component_scores(_checks(spark, sf))


_SCORE = _COMP + """, g AS (SELECT migration_id, sum(CASE WHEN status IN ('SCORED', 'ERROR') THEN points ELSE 0 END) AS w,
  sum(CASE WHEN status IN ('SCORED', 'ERROR') THEN raw_score * points ELSE 0 END) AS s FROM comp GROUP BY migration_id),
sc AS (SELECT migration_id, CASE WHEN w > 0 THEN round(s / w, 2) ELSE 0.0 END AS evidence_score, round(CAST(w AS DOUBLE), 1) AS evidence_coverage FROM g)
"""


@query("i02_assurance_score", _SCORE + """SELECT migration_id, evidence_score, evidence_coverage,
 CASE WHEN evidence_score >= 95 THEN 'STRONG_EVIDENCE' WHEN evidence_score >= 85 THEN 'MINOR_CONCERNS'
  WHEN evidence_score >= 70 THEN 'SIGNIFICANT_CONCERNS' ELSE 'POOR_ASSURANCE' END AS band FROM sc""")
def i02(spark, sf):
    return A.assurance_score(_checks(spark, sf))


_LIN_REQ = {f: [p for p, req in A.LINEAGE_REQUIRED.items() if f in req] for f in
            ("translation_id", "source_execution_id", "target_execution_id", "validation_id", "diagnosis_id",
             "ai_diagnosis_id", "repair_id", "verification_id")}
_LINEAGE_SQL = derived.cte("lineage") + """, lc AS (SELECT migration_id, verification_path, list_filter([""" + ", ".join(
    f"CASE WHEN verification_path IN ({', '.join(repr(p) for p in ps)}) AND coalesce({f}, '') = '' THEN '{f}' END"
    for f, ps in _LIN_REQ.items()) + """], lambda x: x IS NOT NULL) AS miss FROM lineage),
lin AS (SELECT migration_id, verification_path, array_to_string(miss, ',') AS missing_fields,
  len(miss) = 0 AND verification_path IN ('DIRECT_PASS', 'REPAIRED_PASS') AS is_complete FROM lc)
"""


@query("i11_lineage_check", _LINEAGE_SQL + "SELECT * FROM lin")
def i11(spark, sf):
    return A.lineage_check(derived.load(spark, sf, "lineage"))


def _facts_full(spark, sf):
    f = derived.load(spark, sf, "facts")
    lc = A.lineage_check(derived.load(spark, sf, "lineage")).select("migration_id", F.col("is_complete").alias("lineage_complete"))
    return f.join(lc, "migration_id", "left")


_GATES_SQL = _LINEAGE_SQL.replace("WITH ", derived.cte("facts").rstrip() + ",\n", 1) + """,
ff AS (SELECT f.*, lin.is_complete AS lineage_complete FROM facts f LEFT JOIN lin USING (migration_id)),
gates AS (SELECT migration_id, g.gate_id, g.outcome FROM (SELECT migration_id, unnest([
 {'gate_id': 'GATE-001', 'outcome': CASE WHEN coalesce(source_ok, FALSE) THEN 'PASS' ELSE 'FAIL' END},
 {'gate_id': 'GATE-002', 'outcome': CASE WHEN coalesce(translation_ok, FALSE) THEN 'PASS' ELSE 'FAIL' END},
 {'gate_id': 'GATE-003', 'outcome': CASE WHEN coalesce(target_ok, FALSE) THEN 'PASS' ELSE 'FAIL' END},
 {'gate_id': 'GATE-004', 'outcome': CASE WHEN coalesce(schema_ok, FALSE) THEN 'PASS' ELSE 'FAIL' END},
 {'gate_id': 'GATE-005', 'outcome': CASE WHEN NOT coalesce(has_critical, FALSE) THEN 'PASS' ELSE 'FAIL' END},
 {'gate_id': 'GATE-006', 'outcome': CASE WHEN NOT coalesce(repair_attempted, FALSE) THEN 'NOT_APPLICABLE' WHEN coalesce(new_after_repair, 0) = 0 THEN 'PASS' ELSE 'FAIL' END},
 {'gate_id': 'GATE-007', 'outcome': CASE WHEN NOT coalesce(repair_attempted, FALSE) THEN 'NOT_APPLICABLE' WHEN coalesce(verification_status = 'VERIFIED', FALSE) THEN 'PASS' ELSE 'FAIL' END},
 {'gate_id': 'GATE-008', 'outcome': CASE WHEN NOT coalesce(repair_attempted, FALSE) THEN 'NOT_APPLICABLE' WHEN coalesce(dataset_unchanged, FALSE) THEN 'PASS' ELSE 'FAIL' END},
 {'gate_id': 'GATE-009', 'outcome': CASE WHEN NOT coalesce(repair_attempted, FALSE) THEN 'NOT_APPLICABLE' WHEN coalesce(config_unchanged, FALSE) THEN 'PASS' ELSE 'FAIL' END},
 {'gate_id': 'GATE-010', 'outcome': CASE WHEN coalesce(lineage_complete, FALSE) THEN 'PASS' ELSE 'FAIL' END},
 {'gate_id': 'GATE-011', 'outcome': CASE WHEN coalesce(remaining, 0) = 0 THEN 'PASS' ELSE 'FAIL' END}]) AS g FROM ff))
"""


_GATE_NAME = "CASE gate_id " + " ".join(f"WHEN 'GATE-{i:03d}' THEN '{n}'" for i, n in enumerate(A.GATE_NAMES, 1)) + " END"


@query("i04_gates", _GATES_SQL + f"""SELECT migration_id, gate_id, {_GATE_NAME} AS gate_name, outcome,
 CASE outcome WHEN 'PASS' THEN 'holds' WHEN 'FAIL' THEN 'does not hold' ELSE 'no repair was attempted' END AS reason FROM gates""")
def i04(spark, sf):
    return A.gates(_facts_full(spark, sf))


@query("i05_gate_summary", _GATES_SQL + """SELECT migration_id, count(*) AS total_gates, count(*) FILTER (WHERE outcome = 'PASS') AS passed_count,
 count(*) FILTER (WHERE outcome = 'FAIL') AS failed_count, count(*) FILTER (WHERE outcome = 'NOT_APPLICABLE') AS not_applicable_count,
 count(*) FILTER (WHERE outcome = 'FAIL') = 0 AS all_passed,
 CASE WHEN count(*) FILTER (WHERE outcome = 'FAIL') = 0 THEN 'VERIFIED'
  WHEN count(*) FILTER (WHERE outcome = 'FAIL' AND gate_id IN ('GATE-001', 'GATE-002', 'GATE-003')) > 0 THEN 'FAILED' ELSE 'BLOCKED' END AS final_status
FROM gates GROUP BY migration_id""")
def i05(spark, sf):
    return A.gate_summary(A.gates(_facts_full(spark, sf)))


# provider errors, by the migration's number
_RUNS = """SELECT migration_id, translation_ok, source_ok, target_ok, verification_path,
 CASE migration_id % 4 WHEN 0 THEN 'PROVIDER_TOKEN_EXHAUSTED' WHEN 1 THEN 'PROVIDER_TIMEOUT' WHEN 2 THEN 'INVALID_SQL' END AS translation_error,
 CASE migration_id % 71 WHEN 0 THEN 'PROVIDER_TOKEN_EXHAUSTED' WHEN 1 THEN 'PROVIDER_TIMEOUT' WHEN 2 THEN 'BAD_JSON' END AS diagnosis_error
FROM facts JOIN lineage USING (migration_id)"""


@query("i06_final_status", _GATES_SQL + f""", runs AS ({_RUNS}),
g AS (SELECT migration_id, count(*) FILTER (WHERE outcome = 'PASS') AS passed, count(*) FILTER (WHERE outcome = 'FAIL') AS failed,
  count(*) FILTER (WHERE outcome = 'FAIL' AND gate_id <= 'GATE-003') AS tech,
  string_agg(gate_id || ' ' || {_GATE_NAME}, '; ' ORDER BY gate_id) FILTER (WHERE outcome = 'FAIL') AS names FROM gates GROUP BY migration_id)
SELECT migration_id, CASE
  WHEN NOT coalesce(translation_ok, FALSE) THEN CASE WHEN translation_error = 'PROVIDER_TOKEN_EXHAUSTED' THEN 'BLOCKED_PROVIDER_LIMIT' ELSE 'FAILED' END
  WHEN NOT coalesce(source_ok AND target_ok, FALSE) THEN 'FAILED'
  WHEN diagnosis_error = 'PROVIDER_TOKEN_EXHAUSTED' THEN 'BLOCKED_PROVIDER_LIMIT' WHEN diagnosis_error = 'PROVIDER_TIMEOUT' THEN 'FAILED'
  WHEN failed = 0 THEN 'VERIFIED' WHEN tech > 0 THEN 'FAILED' ELSE 'BLOCKED' END AS final_status,
 CASE WHEN NOT coalesce(translation_ok, FALSE) THEN CASE translation_error WHEN 'PROVIDER_TOKEN_EXHAUSTED' THEN 'provider token budget used up in translation'
   WHEN 'PROVIDER_TIMEOUT' THEN 'provider timed out in translation' ELSE 'translation failed: ' || coalesce(translation_error, 'OTHER') END
  WHEN NOT coalesce(source_ok AND target_ok, FALSE) THEN 'a query did not run'
  WHEN diagnosis_error = 'PROVIDER_TOKEN_EXHAUSTED' THEN 'provider token budget used up in diagnosis'
  WHEN diagnosis_error = 'PROVIDER_TIMEOUT' THEN 'provider timed out in diagnosis'
  WHEN failed = 0 THEN CASE WHEN verification_path = 'DIRECT_PASS' THEN 'validated directly' ELSE 'validated again after repair' END || ', gates passed: ' || passed
  WHEN tech > 0 THEN 'not evaluated: ' || names ELSE 'open issues: ' || names END AS decision_reason
FROM g JOIN runs USING (migration_id)""")
def i06(spark, sf):
    derived.load(spark, sf, "facts").createOrReplaceTempView("facts")
    derived.load(spark, sf, "lineage").createOrReplaceTempView("lineage")
    return A.final_status(A.gates(_facts_full(spark, sf)), spark.sql(_RUNS))


@query("i07_is_verified", _GATES_SQL + """SELECT migration_id, coalesce(translation_ok, FALSE) AND coalesce(source_ok, FALSE) AND coalesce(target_ok, FALSE)
 AND coalesce(schema_ok, FALSE) AND coalesce(remaining, 0) = 0 AND coalesce(new_after_repair, 0) = 0
 AND coalesce(CASE WHEN repair_attempted THEN verification_status = 'VERIFIED' END, TRUE)
 AND coalesce(dataset_unchanged, TRUE) AND coalesce(config_unchanged, TRUE) AND coalesce(lineage_complete, FALSE) AS is_verified FROM ff""")
def i07(spark, sf):
    f = _facts_full(spark, sf)
    rp = F.when(F.col("repair_attempted"), F.col("verification_status") == "VERIFIED")
    return f.select("migration_id", A.is_verified(
        F.col("translation_ok"), F.col("source_ok"), F.col("target_ok"), F.col("schema_ok"), F.col("remaining"),
        F.col("new_after_repair"), rp, F.col("dataset_unchanged"), F.col("config_unchanged"),
        F.col("lineage_complete")).alias("is_verified"))


_ROLL = derived.cte("checks", "facts") + """, r AS (SELECT migration_id,
 CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status = 'ERROR') > 0 THEN 'ERROR'
  WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS overall,
 sum(CASE WHEN status = 'FAIL' THEN mismatch_count ELSE 0 END) AS fsum FROM checks GROUP BY migration_id)
"""


def _rollup_facts(spark, sf):
    c = _checks(spark, sf)
    r = report_rollup(c.withColumnRenamed("migration_id", "validation_id")).withColumnRenamed("validation_id", "migration_id")
    fs = c.groupBy("migration_id").agg(F.sum(F.when(F.col("status") == "FAIL", F.col("mismatch_count")).otherwise(0)).alias("fsum"))
    return r.join(fs, "migration_id").join(derived.load(spark, sf, "facts"), "migration_id")


@query("i08_verification_path", _ROLL + """SELECT migration_id, CASE WHEN r.overall = 'PASS' THEN 'DIRECT_PASS'
 WHEN NOT coalesce(f.repair_attempted, FALSE) THEN 'REPAIR_NOT_EXECUTED' WHEN f.verification_status = 'VERIFIED' THEN 'REPAIRED_PASS'
 WHEN f.verification_status IN ('FAILED', 'FAILED_VERIFICATION') THEN 'REPAIR_FAILED' ELSE 'REPAIR_NOT_EXECUTED' END AS verification_path
FROM r JOIN facts f USING (migration_id)""")
def i08(spark, sf):
    j = _rollup_facts(spark, sf)
    return j.select("migration_id", A.verification_path(F.col("overall_status") == "PASS", F.col("repair_attempted"),
                                                        F.col("verification_status")).alias("verification_path"))


@query("i09_remaining_discrepancies", _ROLL + """SELECT migration_id, CAST(coalesce(CASE WHEN f.repair_attempted THEN f.remaining END,
 CASE WHEN r.overall <> 'PASS' THEN greatest(coalesce(r.fsum, 0), 1) END, 0) AS BIGINT) AS remaining FROM r JOIN facts f USING (migration_id)""")
def i09(spark, sf):
    j = _rollup_facts(spark, sf)
    return j.select("migration_id", A.remaining_discrepancies(
        F.when(F.col("repair_attempted"), F.col("remaining")), F.lit(None).cast("long"), F.col("fsum"),
        F.col("overall_status") != "PASS").cast("long").alias("remaining"))


@query("i10_schema_valid", derived.cte("checks") + """SELECT migration_id, NOT coalesce(bool_or(check_name = 'SchemaValidator' AND status = 'FAIL'), FALSE) AS schema_valid
FROM checks GROUP BY migration_id""")
def i10(spark, sf):
    return A.schema_valid(_checks(spark, sf))


@query("i13_audit_transitions", derived.cte("state_events") + """,
st(n, name) AS (VALUES """ + ", ".join(f"({i}, '{s}')" for i, s in enumerate(A.STATES)) + """),
ed(from_name, to_name) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, bs in A.TRANSITIONS.items() for b in bs) + """),
e AS (SELECT se.migration_id, se.event_id, se.ts, f.name AS from_name, t.name AS to_name FROM state_events se
  LEFT JOIN st f ON se.from_state = f.n LEFT JOIN st t ON se.to_state = t.n),
e2 AS (SELECT *, lag(to_name) OVER (PARTITION BY migration_id ORDER BY ts, event_id) AS prev_to FROM e),
j AS (SELECT e2.*, CASE WHEN from_name IN ('VERIFIED', 'FAILED', 'BLOCKED', 'ERROR') THEN 'FROM_TERMINAL'
  WHEN from_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.from_name = e2.from_name AND ed.to_name = e2.to_name) THEN 'ILLEGAL_EDGE'
  WHEN from_name IS DISTINCT FROM prev_to THEN 'CHAIN_BREAK' END AS violation FROM e2)
SELECT migration_id, event_id, from_name, to_name, violation FROM j WHERE violation IS NOT NULL""")
def i13(spark, sf):
    return A.audit_transitions(derived.load(spark, sf, "state_events"))


@query("i14_consistency_violations", derived.cte("artifacts") + """SELECT migration_id, v AS violation FROM (SELECT migration_id, unnest(list_filter([
 CASE WHEN upper(coalesce(translation_status, '')) <> 'SUCCESS' AND upper(coalesce(candidate_status, '')) = 'VALID_SYNTAX' THEN 'FAILED_TRANSLATION_VALID_SYNTAX' END,
 CASE WHEN upper(coalesce(translation_status, '')) <> 'SUCCESS' AND coalesce(trim(target_sql), '') <> '' THEN 'FAILED_TRANSLATION_HAS_SQL' END,
 CASE WHEN coalesce(trim(target_sql), '') = '' AND upper(coalesce(target_execution_status, '')) = 'SUCCESS' THEN 'NO_SQL_EXECUTION_SUCCESS' END,
 CASE WHEN upper(coalesce(target_execution_status, '')) <> 'SUCCESS' AND upper(coalesce(validation_status, '')) IN ('PASS', 'FAIL', 'WARN') THEN 'VALIDATION_WITHOUT_EXECUTION' END,
 CASE WHEN coalesce(trim(repair_id), '') = '' AND upper(coalesce(repair_status, '')) IN ('PROPOSED', 'VERIFIED') THEN 'REPAIR_STATUS_WITHOUT_ID' END,
 CASE WHEN coalesce(trim(proposed_sql), '') = '' AND upper(coalesce(repair_status, '')) = 'VERIFIED' THEN 'VERIFIED_REPAIR_WITHOUT_SQL' END,
 CASE WHEN coalesce(trim(verification_id), '') = '' AND upper(coalesce(verification_status, '')) = 'VERIFIED' THEN 'VERIFIED_WITHOUT_VERIFICATION_ID' END,
 CASE WHEN validation_status IS NULL AND evidence_score IS NOT NULL THEN 'SCORE_WITHOUT_VALIDATION' END,
 CASE WHEN validation_status IS NULL AND upper(coalesce(final_status, '')) = 'VERIFIED' THEN 'VERIFIED_WITHOUT_VALIDATION' END,
 CASE WHEN validation_status IS NOT NULL AND upper(coalesce(final_status, '')) = 'VERIFIED' AND evidence_score IS NULL THEN 'VERIFIED_WITHOUT_SCORE' END],
 lambda x: x IS NOT NULL)) AS v FROM artifacts)""")
def i14(spark, sf):
    return A.consistency_violations(derived.load(spark, sf, "artifacts"))


@query("i16_limitations", _COMP.replace("WITH ", derived.cte("facts").rstrip() + ",\n", 1) + """,
g AS (SELECT migration_id, round(CAST(sum(CASE WHEN status IN ('SCORED', 'ERROR') THEN points ELSE 0 END) AS DOUBLE), 1) AS cov,
  list(name ORDER BY position) FILTER (WHERE status = 'NOT_APPLICABLE') AS sk FROM comp GROUP BY migration_id)
SELECT migration_id, 1 AS ordinal, 'evidence covers ' || CAST(cov AS VARCHAR) || '%; not run: ' || array_to_string(sk, ', ') || '.' AS limitation
FROM g WHERE cov < 100.0 AND len(sk) > 0
UNION ALL SELECT migration_id, 2, 'repaired with model help, then validated again' FROM facts WHERE repair_attempted""")
def i16(spark, sf):
    return A.limitations(A.component_scores(_checks(spark, sf)), derived.load(spark, sf, "facts"))


@query("i17_status_to_state", derived.cte("artifacts") + """SELECT migration_id, final_status, coalesce(CASE final_status """ + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in A.STATUS_TO_STATE.items()) + """ END, 'ERROR') AS state FROM artifacts""")
def i17(spark, sf):
    a = derived.load(spark, sf, "artifacts")
    return a.select("migration_id", "final_status", A.status_to_state(F.col("final_status")).alias("state"))


# the seven step summaries and the score: {summary: (frame, columns)}
_SUMMARIES = {
    "translation": ("artifacts", ("translation_status", "candidate_status")), "execution": ("artifacts", ("target_execution_status",)),
    "discrepancy": ("facts", ("has_critical", "remaining")), "diagnosis": ("lineage", ("diagnosis_id", "ai_diagnosis_id")),
    "repair": ("artifacts", ("repair_id", "repair_status")), "verification": ("facts", ("verification_status", "rows_before", "rows_after")),
}


@query("i15_migration_summary", _SCORE.replace("WITH ", derived.cte("facts", "artifacts", "lineage").rstrip() + ",\n", 1) + """,
v AS (SELECT migration_id, count(*) AS checks_run, count(*) FILTER (WHERE status = 'FAIL') AS checks_failed FROM checks GROUP BY migration_id)
SELECT f.migration_id, """ + ", ".join(f"{t}.{c} AS {k}_{c}" for k, (t, cs) in _SUMMARIES.items() for c in cs) + """,
 v.checks_run AS validation_checks_run, v.checks_failed AS validation_checks_failed, sc.evidence_score AS score_evidence_score, sc.evidence_coverage AS score_evidence_coverage
FROM facts f LEFT JOIN facts ON facts.migration_id = f.migration_id LEFT JOIN artifacts ON artifacts.migration_id = f.migration_id
 LEFT JOIN lineage ON lineage.migration_id = f.migration_id LEFT JOIN v ON v.migration_id = f.migration_id LEFT JOIN sc ON sc.migration_id = f.migration_id""")
def i15(spark, sf):
    frames = {t: derived.load(spark, sf, t) for t in ("facts", "artifacts", "lineage")}
    parts = {k: frames[t].select("migration_id", *cs) for k, (t, cs) in _SUMMARIES.items()}
    checks = report_rollup(_checks(spark, sf).withColumnRenamed("migration_id", "validation_id")).withColumnRenamed("validation_id", "migration_id")
    parts["validation"] = checks.select("migration_id", "checks_run", "checks_failed")
    parts["score"] = A.assurance_score(_checks(spark, sf)).select("migration_id", "evidence_score", "evidence_coverage")
    return A.migration_summary(frames["facts"].select("migration_id"), parts)


_ART = """
arts AS (SELECT o_orderkey AS artifact_id, o_custkey AS record_id, CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 1 ELSE o_custkey END AS migration_id,
  md5(o_orderpriority) AS source_hash FROM orders),
recs AS (SELECT c_custkey AS record_id, c_custkey AS migration_id,
  CASE WHEN c_custkey % 3 = 0 THEN md5('1-URGENT') WHEN c_custkey % 3 = 1 THEN '' ELSE md5('2-HIGH') END AS source_hash FROM customer)"""


def _arts(spark, sf):
    from ..session import read_table
    o, c = read_table(spark, sf, "orders"), read_table(spark, sf, "customer")
    arts = o.select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("record_id"),
                    F.when(F.col("o_orderkey") % 50 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
                    .alias("migration_id"), F.md5("o_orderpriority").alias("source_hash"))
    recs = c.select(F.col("c_custkey").alias("record_id"), F.col("c_custkey").alias("migration_id"),
                    F.when(F.col("c_custkey") % 3 == 0, F.md5(F.lit("1-URGENT")))
                    .when(F.col("c_custkey") % 3 == 1, F.lit("")).otherwise(F.md5(F.lit("2-HIGH"))).alias("source_hash"))
    return arts, recs


@query("i12_lineage_mismatch", "WITH" + _ART + """
SELECT a.artifact_id, a.record_id, coalesce(a.migration_id IS NOT NULL AND r.migration_id IS NOT NULL AND a.migration_id <> r.migration_id, FALSE) AS migration_mismatch,
 coalesce(coalesce(a.source_hash, '') <> '' AND coalesce(r.source_hash, '') <> '' AND a.source_hash <> r.source_hash, FALSE) AS hash_mismatch
FROM arts a LEFT JOIN recs r USING (record_id)
WHERE coalesce(a.migration_id IS NOT NULL AND r.migration_id IS NOT NULL AND a.migration_id <> r.migration_id, FALSE)
 OR coalesce(coalesce(a.source_hash, '') <> '' AND coalesce(r.source_hash, '') <> '' AND a.source_hash <> r.source_hash, FALSE)""")
def i12(spark, sf):
    a, r = _arts(spark, sf)
    out = A.lineage_mismatch(a, r)
    return out.select("artifact_id", "record_id", F.coalesce("migration_mismatch", F.lit(False)).alias("migration_mismatch"),
                      F.coalesce("hash_mismatch", F.lit(False)).alias("hash_mismatch"))


_RECS = """SELECT o_orderkey AS migration_id, CASE WHEN o_orderkey % 2 = 0 THEN 'teradata' ELSE 'oracle' END AS source_dialect,
 'spark' AS target_dialect, o_orderpriority AS dataset_id, o_orderdate AS created_at,
 CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'BLOCKED' ELSE 'FAILED' END AS final_status,
 CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'DISCREPANCIES_FOUND' ELSE 'FAILED' END AS state FROM orders"""


@query("i18_list_migrations", f"""SELECT * FROM ({_RECS}) WHERE (contains(lower(CAST(migration_id AS VARCHAR)), 'urgent')
 OR contains(lower(source_dialect), 'urgent') OR contains(lower(target_dialect), 'urgent') OR contains(lower(dataset_id), 'urgent'))
 AND (final_status = 'VERIFIED' OR state = 'VERIFIED') ORDER BY created_at DESC""")
def i18(spark, sf):
    from ..session import read_table
    read_table(spark, sf, "orders").createOrReplaceTempView("orders")
    return A.list_migrations(spark.sql(_RECS), search="URGENT", status="VERIFIED")


def _i19_sql():
    from .q_diagnose import _CONS
    return _CONS.replace("WITH ", derived.cte("lineage").rstrip() + ",\n", 1) + """,
rep AS (SELECT validation_id AS migration_id, count(*) AS n FROM d2 GROUP BY 1)
SELECT l.migration_id, CASE WHEN coalesce(l.diagnosis_id, '') <> '' THEN l.diagnosis_id END AS diagnosis_id,
 CAST(CASE WHEN coalesce(l.diagnosis_id, '') <> '' AND rep.n IS NOT NULL THEN rep.n ELSE 0 END AS BIGINT) AS discrepancy_count,
 CASE WHEN coalesce(l.diagnosis_id, '') = '' THEN 'NO_DISCREPANCIES' WHEN rep.n IS NULL THEN 'DIAGNOSIS_NOT_FOUND'
  WHEN rep.n = 0 THEN 'RESOLVED' ELSE 'DISCREPANCIES_FOUND' END AS status
FROM lineage l LEFT JOIN rep USING (migration_id)"""


@query("i19_get_discrepancies", _i19_sql())
def i19(spark, sf):
    from .q_diagnose import _cons
    rep = _cons(spark, sf).groupBy(F.col("validation_id").alias("migration_id")).agg(
        F.count("*").alias("discrepancy_count"))
    return A.get_discrepancies(derived.load(spark, sf, "lineage"), rep)


def _i10b_sql():
    from .q_diagnose import _CONS
    return _CONS.replace("WITH ", derived.cte("facts").rstrip() + ",\n", 1) + """,
c AS (SELECT validation_id AS migration_id, bool_or(severity = 'CRITICAL') AS c FROM d2 GROUP BY 1)
SELECT c.migration_id, c.c AND NOT coalesce(f.verification_status = 'VERIFIED', FALSE) AS has_unresolved_critical
FROM c LEFT JOIN facts f USING (migration_id)"""


@query("i10_unresolved_critical", _i10b_sql())
def i10b(spark, sf):
    from .q_diagnose import _cons
    d = _cons(spark, sf).withColumnRenamed("validation_id", "migration_id")
    v = derived.load(spark, sf, "facts").select("migration_id", "verification_status")
    return A.unresolved_critical(d, v)
