"""I — assurance: scores, gates, decisions, lineage and audit checks over
tables of many migrations (one row per migration unless stated)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M = "migration_id"

# Score components (name, weight, source check).
COMPONENT_WEIGHTS = (
    ("Schema compatibility", 0.10, "SchemaValidator"),
    ("Row reconciliation", 0.30, "RowValidator"),
    ("Aggregate reconciliation", 0.20, "AggregateValidator"),
    ("Business-rule equivalence", 0.25, "BusinessRuleValidator"),
    ("Edge-case coverage", 0.15, "EdgeCaseValidator"),
)
# weights as whole percentage points, so that weight sums are exact
_POINTS = {c: round(w * 100) for _, w, c in COMPONENT_WEIGHTS}
# Migration states in order (state numbers 0..13) and the
# allowed transition graph; terminal states have no outgoing edge.
STATES = ("CREATED", "ANALYZING", "TRANSLATING", "PREFLIGHTING", "EXECUTING", "VALIDATING",
          "DISCREPANCIES_FOUND", "DIAGNOSING", "REPAIR_PROPOSED", "REPAIR_VERIFYING", "VERIFIED", "FAILED",
          "BLOCKED", "ERROR")
TERMINAL = ("VERIFIED", "FAILED", "BLOCKED", "ERROR")
TRANSITIONS = {
    "CREATED": ("ANALYZING", "ERROR"),
    "ANALYZING": ("TRANSLATING", "ERROR"),
    "TRANSLATING": ("PREFLIGHTING", "FAILED", "ERROR"),
    "PREFLIGHTING": ("EXECUTING", "BLOCKED", "ERROR"),
    "EXECUTING": ("VALIDATING", "FAILED", "ERROR"),
    "VALIDATING": ("VERIFIED", "DISCREPANCIES_FOUND", "ERROR"),
    "DISCREPANCIES_FOUND": ("DIAGNOSING", "BLOCKED", "ERROR"),
    "DIAGNOSING": ("REPAIR_PROPOSED", "BLOCKED", "FAILED", "ERROR"),
    "REPAIR_PROPOSED": ("REPAIR_VERIFYING", "ERROR"),
    "REPAIR_VERIFYING": ("VERIFIED", "BLOCKED", "FAILED", "ERROR"),
}
# Lineage fields required per verification path.
LINEAGE_BASE = ("translation_id", "source_execution_id", "target_execution_id", "validation_id")
LINEAGE_REQUIRED = {
    "DIRECT_PASS": LINEAGE_BASE,
    "REPAIRED_PASS": LINEAGE_BASE + ("diagnosis_id", "ai_diagnosis_id", "repair_id", "verification_id"),
    "REPAIR_FAILED": LINEAGE_BASE + ("diagnosis_id", "ai_diagnosis_id", "repair_id"),
    "REPAIR_NOT_EXECUTED": LINEAGE_BASE,
}
STATUS_TO_STATE = {"VERIFIED": "VERIFIED", "BLOCKED": "BLOCKED", "BLOCKED_PROVIDER_LIMIT": "FAILED",
                   "FAILED": "FAILED", "ERROR": "ERROR", "IN_PROGRESS": "VALIDATING"}


def _components() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(c).alias("check_name"),
                              F.lit(i).alias("position"), F.lit(_POINTS[c]).alias("points"))
                     for i, (n, w, c) in enumerate(COMPONENT_WEIGHTS)])


# ---------------------------------------------------------------- I1-I3
def component_scores(checks: DataFrame, migrations: DataFrame | None = None) -> DataFrame:
    """One row per (migration, component): status SCORED / ERROR /
    NOT_APPLICABLE (SKIPPED or absent) and raw score 0..100 (ERROR -> 0).
    The five components are generated per migration (no join to a
    dimension table)."""
    mig = (migrations if migrations is not None else checks).select(M).distinct()
    grid = mig.select(M, F.explode(_components()).alias("c")).select(M, "c.*")
    c = checks.select(M, "check_name", "status", "score")
    j = grid.join(c, [M, "check_name"], "left")
    status = (F.when(F.col("status").isNull() | (F.col("status") == "SKIPPED"), F.lit("NOT_APPLICABLE"))
              .when(F.col("status") == "ERROR", F.lit("ERROR")).otherwise(F.lit("SCORED")))
    raw = F.when(status == "SCORED", F.round(F.col("score") * 100.0, 6)).otherwise(F.lit(0.0))
    return j.select(M, "position", "name", "weight", "points", "check_name", status.alias("status"),
                    raw.alias("raw_score"))


def assurance_score(checks: DataFrame, migrations: DataFrame | None = None) -> DataFrame:
    """I2 + I3: ``evidence_score`` (2 dp) over applicable components with
    renormalised weights, ``evidence_coverage`` (1 dp), band; NULLs for a
    migration without checks, 0 when nothing applies."""
    comp = component_scores(checks, migrations)
    app = F.col("status").isin("SCORED", "ERROR")
    # sums in whole weight points: exact, so the result does not depend on
    # the order in which partial sums meet
    g = comp.groupBy(M).agg(F.sum(F.when(app, F.col("points")).otherwise(0)).alias("_w"),
                            F.sum(F.when(app, F.col("raw_score") * F.col("points")).otherwise(0.0)).alias("_s"))
    has = checks.select(M).distinct().withColumn("_has", F.lit(True))
    g = g.join(has, M, "left")
    score = F.when(F.col("_w") > 0, F.round(F.col("_s") / F.col("_w"), 2)).otherwise(F.lit(0.0))
    score = F.when(F.col("_has").isNull(), F.lit(None).cast("double")).otherwise(score)
    cov = F.when(F.col("_has").isNull(), F.lit(None).cast("double")).otherwise(F.round(F.col("_w").cast("double"), 1))
    return g.select(M, score.alias("evidence_score"), cov.alias("evidence_coverage"),
                    band(score).alias("band"))


def band(score: Column) -> Column:
    """I3."""
    return (F.when(score.isNull(), F.lit(None).cast("string"))
            .when(score >= 95.0, F.lit("STRONG_EVIDENCE")).when(score >= 85.0, F.lit("MINOR_CONCERNS"))
            .when(score >= 70.0, F.lit("SIGNIFICANT_CONCERNS")).otherwise(F.lit("POOR_ASSURANCE")))


# ---------------------------------------------------------------- I4-I7
FACT_COLUMNS = ("source_ok", "translation_ok", "target_ok", "schema_ok", "has_critical", "remaining",
                "repair_attempted", "new_after_repair", "verification_status", "dataset_unchanged",
                "config_unchanged", "lineage_complete")


# The names of the hard gates, by number.
GATE_NAMES = (
    "Source execution succeeded", "Target translation syntactically valid", "Target execution succeeded",
    "No schema mismatch", "No unresolved CRITICAL discrepancy", "No new discrepancy after repair",
    "Repair verification VERIFIED", "Dataset hash unchanged", "Validation config unchanged",
    "Audit lineage complete", "No unresolved semantic discrepancies",
)
TECHNICAL_GATES = ("GATE-001", "GATE-002", "GATE-003")


def gates(facts: DataFrame) -> DataFrame:
    """I4: the eleven hard gates per migration, ``(migration_id, gate_id,
    gate_name, outcome, reason)`` with PASS / FAIL / NOT_APPLICABLE; gates
    006–009 apply only when a repair was attempted."""
    pf = lambda ok: F.when(F.coalesce(ok, F.lit(False)), F.lit("PASS")).otherwise(F.lit("FAIL"))
    rep = F.coalesce(F.col("repair_attempted"), F.lit(False))
    na = lambda c: F.when(rep, c).otherwise(F.lit("NOT_APPLICABLE"))
    g = [("GATE-001", pf(F.col("source_ok"))), ("GATE-002", pf(F.col("translation_ok"))),
         ("GATE-003", pf(F.col("target_ok"))), ("GATE-004", pf(F.col("schema_ok"))),
         ("GATE-005", pf(~F.coalesce(F.col("has_critical"), F.lit(False)))),
         ("GATE-006", na(pf(F.coalesce(F.col("new_after_repair"), F.lit(0)) == 0))),
         ("GATE-007", na(pf(F.col("verification_status") == "VERIFIED"))),
         ("GATE-008", na(pf(F.col("dataset_unchanged") == True))),  # noqa: E712
         ("GATE-009", na(pf(F.col("config_unchanged") == True))),  # noqa: E712
         ("GATE-010", pf(F.col("lineage_complete"))),
         ("GATE-011", pf(F.coalesce(F.col("remaining"), F.lit(0)) == 0))]
    arr = F.array(*[F.struct(F.lit(i).alias("gate_id"), F.lit(n).alias("gate_name"), o.alias("outcome")) for (i, o), n in zip(g, GATE_NAMES)])
    reason = (F.when(F.col("outcome") == "PASS", F.lit("holds")).when(F.col("outcome") == "FAIL", F.lit("does not hold"))
              .otherwise(F.lit("no repair was attempted")))
    return facts.select(M, F.explode(arr).alias("g")).select(M, "g.*").withColumn("reason", reason)


def gate_summary(gate_rows: DataFrame) -> DataFrame:
    """Counts, ``all_passed`` (no FAIL) and the status by gates alone:
    VERIFIED when all passed, FAILED when a technical gate (001–003)
    failed, else BLOCKED."""
    o = F.col("outcome")
    s = gate_rows.groupBy(M).agg(
        F.count("*").alias("total_gates"), F.count(F.when(o == "PASS", 1)).alias("passed_count"),
        F.count(F.when(o == "FAIL", 1)).alias("failed_count"),
        F.count(F.when(o == "NOT_APPLICABLE", 1)).alias("not_applicable_count"),
        F.count(F.when((o == "FAIL") & F.col("gate_id").isin(*TECHNICAL_GATES), 1))
        .alias("_tech"))
    final = (F.when(F.col("failed_count") == 0, F.lit("VERIFIED")).when(F.col("_tech") > 0, F.lit("FAILED"))
             .otherwise(F.lit("BLOCKED")))
    return s.select(M, "total_gates", "passed_count", "failed_count", "not_applicable_count",
                    (F.col("failed_count") == 0).alias("all_passed"), final.alias("final_status"))


def final_status(gate_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``(migration_id, final_status, decision_reason)``.

    ``runs``: ``migration_id, translation_ok, translation_error, source_ok,
    target_ok, diagnosis_error, verification_path``.  A failed translation
    or execution, and a provider error during diagnosis, decide before the
    gates do; a provider's used-up token budget blocks, it does not fail."""
    by = gate_rows.groupBy(M).agg(
        F.sort_array(F.collect_list(F.when(F.col("outcome") == "FAIL", F.concat("gate_id", F.lit(" "), "gate_name")))).alias("failed"),
        F.count(F.when((F.col("outcome") == "FAIL") & F.col("gate_id").isin(*TECHNICAL_GATES), 1)).alias("tech"),
        F.count(F.when(F.col("outcome") == "PASS", 1)).alias("passed"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    code = F.when(~yes("translation_ok"), F.coalesce("translation_error", F.lit("OTHER"))).when(
        ~(yes("source_ok") & yes("target_ok")), F.lit("EXECUTION")).when(
        F.col("diagnosis_error").isin("PROVIDER_TOKEN_EXHAUSTED", "PROVIDER_TIMEOUT"), F.col("diagnosis_error"))
    step = F.when(yes("translation_ok"), F.lit("diagnosis")).otherwise(F.lit("translation"))
    status = (F.when(code == "PROVIDER_TOKEN_EXHAUSTED", F.lit("BLOCKED_PROVIDER_LIMIT")).when(code.isNotNull(), F.lit("FAILED"))
              .when(F.size("failed") == 0, F.lit("VERIFIED")).when(F.col("tech") > 0, F.lit("FAILED")).otherwise(F.lit("BLOCKED")))
    names = F.array_join("failed", "; ")
    reason = (F.when(code == "PROVIDER_TOKEN_EXHAUSTED", F.concat(F.lit("provider token budget used up in "), step))
              .when(code == "PROVIDER_TIMEOUT", F.concat(F.lit("provider timed out in "), step))
              .when(code == "EXECUTION", F.lit("a query did not run"))
              .when(code.isNotNull(), F.concat(F.lit("translation failed: "), code))
              .when(F.size("failed") == 0, F.concat(
                  F.when(F.col("verification_path") == "DIRECT_PASS", F.lit("validated directly")).otherwise(F.lit("validated again after repair")),
                  F.lit(", gates passed: "), F.col("passed").cast("string")))
              .when(F.col("tech") > 0, F.concat(F.lit("not evaluated: "), names)).otherwise(F.concat(F.lit("open issues: "), names)))
    return by.join(runs, M).select(M, status.alias("final_status"), reason.alias("decision_reason"))


def is_verified(translation_valid: Column, source_ok: Column, target_ok: Column, schema_valid: Column,
                remaining: Column, new_count: Column, repair_passed: Column, dataset_unchanged: Column,
                config_unchanged: Column, lineage_complete: Column) -> Column:
    """Conjunction; the three repair terms are NULL (not applicable)
    when no repair happened."""
    t = lambda c: F.coalesce(c, F.lit(True))
    return (F.coalesce(translation_valid, F.lit(False)) & F.coalesce(source_ok, F.lit(False))
            & F.coalesce(target_ok, F.lit(False)) & F.coalesce(schema_valid, F.lit(False))
            & (F.coalesce(remaining, F.lit(0)) == 0) & (F.coalesce(new_count, F.lit(0)) == 0)
            & t(repair_passed) & t(dataset_unchanged) & t(config_unchanged)
            & F.coalesce(lineage_complete, F.lit(False)))


# ---------------------------------------------------------------- I8-I10
def verification_path(validation_passed: Column, repair_attempted: Column, verification_status: Column,
                      proposal_status: Column | None = None) -> Column:
    """I8."""
    prop = proposal_status if proposal_status is not None else F.lit(None).cast("string")
    return (F.when(F.coalesce(validation_passed, F.lit(False)), F.lit("DIRECT_PASS"))
            .when(~F.coalesce(repair_attempted, F.lit(False)), F.lit("REPAIR_NOT_EXECUTED"))
            .when(verification_status == "VERIFIED", F.lit("REPAIRED_PASS"))
            .when(verification_status.isin("FAILED", "FAILED_VERIFICATION"), F.lit("REPAIR_FAILED"))
            .when(prop == "FAILED", F.lit("REPAIR_FAILED")).otherwise(F.lit("REPAIR_NOT_EXECUTED")))


def remaining_discrepancies(after_repair: Column, diagnosis_count: Column, failed_mismatch_sum: Column,
                            validation_failed: Column) -> Column:
    """After-repair count, else the diagnosis count, else the mismatch
    sum of FAIL checks (at least 1) when validation failed, else 0."""
    return F.coalesce(after_repair, diagnosis_count,
                      F.when(F.coalesce(validation_failed, F.lit(False)),
                             F.greatest(F.coalesce(failed_mismatch_sum, F.lit(0)), F.lit(1))),
                      F.lit(0))


def schema_valid(checks: DataFrame) -> DataFrame:
    """Schema check not FAIL (valid when absent)."""
    sc = checks.filter(F.col("check_name") == "SchemaValidator").groupBy(M).agg(
        F.bool_or(F.col("status") == "FAIL").alias("_f"))
    return checks.select(M).distinct().join(sc, M, "left").select(
        M, (~F.coalesce(F.col("_f"), F.lit(False))).alias("schema_valid"))


def unresolved_critical(discrepancies: DataFrame, verification: DataFrame | None = None) -> DataFrame:
    """Any CRITICAL discrepancy, unless the repair was VERIFIED."""
    d = discrepancies.groupBy(M).agg(F.bool_or(F.col("severity") == "CRITICAL").alias("_c"))
    if verification is not None:
        d = d.join(verification.select(M, "verification_status"), M, "left")
        return d.select(M, (F.col("_c") & ~F.coalesce(F.col("verification_status") == "VERIFIED", F.lit(False)))
                        .alias("has_unresolved_critical"))
    return d.select(M, F.col("_c").alias("has_unresolved_critical"))


# ---------------------------------------------------------------- I11-I12
def lineage_check(lineage: DataFrame) -> DataFrame:
    """Required ids per path present (non-empty); only DIRECT_PASS
    and REPAIRED_PASS can be complete.  ``missing_fields`` in field order."""
    fields = ("translation_id", "source_execution_id", "target_execution_id", "validation_id", "diagnosis_id",
              "ai_diagnosis_id", "repair_id", "verification_id")
    path = F.col("verification_path")
    missing = F.array(*[
        F.when(path.isin(*[p for p, req in LINEAGE_REQUIRED.items() if f in req])
               & (F.coalesce(F.col(f), F.lit("")) == ""), F.lit(f)) for f in fields])
    missing = F.filter(missing, lambda x: x.isNotNull())
    return lineage.select(M, path, F.array_join(missing, ",").alias("missing_fields"),
                          ((F.size(missing) == 0) & path.isin("DIRECT_PASS", "REPAIRED_PASS")).alias("is_complete"))


def lineage_mismatch(artifacts: DataFrame, records: DataFrame) -> DataFrame:
    """Artifact rows whose migration id or source hash differ from the
    migration record (compared only when present)."""
    a = artifacts.select("artifact_id", F.col(M).alias("a_m"), F.col("source_hash").alias("a_h"), "record_id")
    r = records.select(F.col("record_id"), F.col(M).alias("r_m"), F.col("source_hash").alias("r_h"))
    j = a.join(r, "record_id", "left")
    bad_m = F.col("a_m").isNotNull() & F.col("r_m").isNotNull() & (F.col("a_m") != F.col("r_m"))
    bad_h = (F.coalesce(F.col("a_h"), F.lit("")) != "") & (F.coalesce(F.col("r_h"), F.lit("")) != "") \
        & (F.col("a_h") != F.col("r_h"))
    return j.select("artifact_id", "record_id", bad_m.alias("migration_mismatch"), bad_h.alias("hash_mismatch")) \
        .filter(F.col("migration_mismatch") | F.col("hash_mismatch"))


# ---------------------------------------------------------------- I13
def _edges(spark) -> DataFrame:
    from ..session import literal_rows
    rows = [(a, b) for a, bs in TRANSITIONS.items() for b in bs]
    return literal_rows(spark, rows, "from_name string, to_name string")


def state_name(n: Column) -> Column:
    return F.when(n.isNotNull(), F.element_at(F.array(*[F.lit(s) for s in STATES]), n.cast("int") + 1))


def audit_transitions(events: DataFrame) -> DataFrame:
    """Events ``(migration_id, event_id, ts, from_state, to_state)``
    (state numbers or names) that break the state graph: ILLEGAL_EDGE,
    FROM_TERMINAL, or CHAIN_BREAK when ``from_state`` is not the previous
    event's ``to_state`` (first event must start from NULL/CREATED).  The
    edge list is a 31-row constant, broadcast."""
    def nm(c):
        return state_name(F.col(c)) if dict(events.dtypes)[c] in ("int", "bigint", "smallint", "tinyint") \
            else F.col(c)
    e = events.select(M, "event_id", "ts", nm("from_state").alias("from_name"), nm("to_state").alias("to_name"))
    w = Window.partitionBy(M).orderBy("ts", "event_id")
    e = e.withColumn("_prev_to", F.lag("to_name").over(w))
    edges = F.broadcast(_edges(events.sparkSession).withColumn("_ok", F.lit(True)))
    j = e.join(edges, ["from_name", "to_name"], "left")
    reason = (F.when(F.col("from_name").isin(*TERMINAL), F.lit("FROM_TERMINAL"))
              .when(F.col("from_name").isNotNull() & F.col("_ok").isNull(), F.lit("ILLEGAL_EDGE"))
              .when(~F.col("from_name").eqNullSafe(F.col("_prev_to")), F.lit("CHAIN_BREAK")))
    return (j.select(M, "event_id", "from_name", "to_name", reason.alias("violation"))
            .filter(F.col("violation").isNotNull()))


# ---------------------------------------------------------------- I14
def consistency_violations(a: DataFrame) -> DataFrame:
    """Impossible artifact-state combinations, one row per rule hit."""
    up = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    ran = F.col("validation_status").isNotNull()
    rules = [
        ("FAILED_TRANSLATION_VALID_SYNTAX", (up("translation_status") != "SUCCESS") & (up("candidate_status") == "VALID_SYNTAX")),
        ("FAILED_TRANSLATION_HAS_SQL", (up("translation_status") != "SUCCESS") & ~blank("target_sql")),
        ("NO_SQL_EXECUTION_SUCCESS", blank("target_sql") & (up("target_execution_status") == "SUCCESS")),
        ("VALIDATION_WITHOUT_EXECUTION", (up("target_execution_status") != "SUCCESS")
         & up("validation_status").isin("PASS", "FAIL", "WARN")),
        ("REPAIR_STATUS_WITHOUT_ID", blank("repair_id") & up("repair_status").isin("PROPOSED", "VERIFIED")),
        ("VERIFIED_REPAIR_WITHOUT_SQL", blank("proposed_sql") & (up("repair_status") == "VERIFIED")),
        ("VERIFIED_WITHOUT_VERIFICATION_ID", blank("verification_id") & (up("verification_status") == "VERIFIED")),
        ("SCORE_WITHOUT_VALIDATION", ~ran & F.col("evidence_score").isNotNull()),
        ("VERIFIED_WITHOUT_VALIDATION", ~ran & (up("final_status") == "VERIFIED")),
        ("VERIFIED_WITHOUT_SCORE", ran & (up("final_status") == "VERIFIED") & F.col("evidence_score").isNull()),
    ]
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])
    return (a.select(M, F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("violation")))


# ---------------------------------------------------------------- I16-I18
def limitations(scores_components: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """I16: coverage limitation text per migration (skipped component
    names in component order) and the repair note."""
    c = scores_components
    g = c.groupBy(M).agg(
        F.sum(F.when(F.col("status").isin("SCORED", "ERROR"), F.col("points")).otherwise(0)).alias("_w"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "NOT_APPLICABLE",
                                           F.struct("position", "name")))).alias("_sk"))
    cov = F.round(F.col("_w").cast("double"), 1)
    text = F.when((cov < 100.0) & (F.size("_sk") > 0), F.concat(
        F.lit("evidence covers "), cov.cast("string"), F.lit("%; not run: "),
        F.array_join(F.transform("_sk", lambda x: x.getField("name")), ", "), F.lit(".")))
    out = g.select(M, F.lit(1).alias("ordinal"), text.alias("limitation")).filter(F.col("limitation").isNotNull())
    if repairs is not None:
        out = out.unionByName(repairs.filter(F.col("repair_attempted")).select(
            M, F.lit(2).alias("ordinal"),
            F.lit("repaired with model help, then validated again").alias("limitation")))
    return out


def status_to_state(status: Column) -> Column:
    """I17."""
    m = F.create_map(*[F.lit(x) for kv in STATUS_TO_STATE.items() for x in kv])
    return F.coalesce(F.element_at(m, status), F.lit("ERROR"))


def list_migrations(records: DataFrame, search: str | None = None, status: str | None = None) -> DataFrame:
    """Newest first (ties by id); case-insensitive substring over id, dialects and
    dataset; status matches final status or state."""
    r = records
    if search:
        q = search.lower()
        r = r.filter(reduce(lambda a, b: a | b, [F.lower(F.col(c).cast("string")).contains(q)
                                                 for c in ("migration_id", "source_dialect", "target_dialect",
                                                           "dataset_id") if c in records.columns]))
    if status:
        r = r.filter((F.col("final_status") == status) | (F.col("state") == status))
    return r.orderBy(F.desc("created_at"), "migration_id")


def migration_summary(migrations: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per migration, each part (a frame keyed by
    ``migration_id``) left-joined with its columns prefixed by the part
    name."""
    out = migrations.select(M).distinct()
    for name, df in parts.items():
        cols = [F.col(c).alias(f"{name}_{c}") for c in df.columns if c != M]
        out = out.join(df.select(M, *cols), M, "left")
    return out


def get_discrepancies(lineage: DataFrame, reports: DataFrame) -> DataFrame:
    """Per migration, the discrepancy report reached through the
    lineage's diagnosis id.  ``reports``: ``(migration_id,
    discrepancy_count)`` of stored diagnoses.  Status NO_DISCREPANCIES (no
    diagnosis id), DIAGNOSIS_NOT_FOUND, RESOLVED (zero discrepancies) or
    DISCREPANCIES_FOUND."""
    r = reports.select(M, F.col("discrepancy_count").alias("_n"), F.lit(True).alias("_found"))
    j = lineage.select(M, "diagnosis_id").join(r, M, "left")
    has_id = F.coalesce(F.col("diagnosis_id"), F.lit("")) != ""
    status = (F.when(~has_id, F.lit("NO_DISCREPANCIES")).when(F.col("_found").isNull(), F.lit("DIAGNOSIS_NOT_FOUND"))
              .when(F.col("_n") == 0, F.lit("RESOLVED")).otherwise(F.lit("DISCREPANCIES_FOUND")))
    cnt = F.when(has_id & F.col("_found").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    return j.select(M, F.when(has_id, F.col("diagnosis_id")).alias("diagnosis_id"),
                    cnt.cast("long").alias("discrepancy_count"), status.alias("status"))
