"""Driver queries for F — structural comparison over component tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import query_hash
from ..operators import structure as S
from ..session import read_table
from . import derived
from .registry import query

C = derived.cte("components")

_F1 = """SELECT migration_id, 'TABLE_REMOVED' AS category, v AS source_value, CAST(NULL AS VARCHAR) AS target_value, CAST(1 AS BIGINT) AS occurrences
 FROM (SELECT DISTINCT migration_id, name AS v FROM components WHERE kind = 'table' AND side = 'SRC'
       EXCEPT SELECT DISTINCT migration_id, name FROM components WHERE kind = 'table' AND side = 'TGT')
 UNION ALL SELECT migration_id, 'TABLE_ADDED', NULL, v, 1
 FROM (SELECT DISTINCT migration_id, name AS v FROM components WHERE kind = 'table' AND side = 'TGT'
       EXCEPT SELECT DISTINCT migration_id, name FROM components WHERE kind = 'table' AND side = 'SRC')"""

_F2 = """SELECT s.migration_id, 'JOIN_TYPE_CHANGED' AS category, s.name AS source_value, t.name AS target_value, CAST(1 AS BIGINT) AS occurrences
 FROM components s JOIN components t ON s.migration_id = t.migration_id AND s.ordinal = t.ordinal
 WHERE s.kind = 'join' AND t.kind = 'join' AND s.side = 'SRC' AND t.side = 'TGT' AND s.name IS DISTINCT FROM t.name
 UNION ALL SELECT s.migration_id, 'JOIN_CONDITION_CHANGED', s.expr, t.expr, 1
 FROM components s JOIN components t ON s.migration_id = t.migration_id AND s.ordinal = t.ordinal
 WHERE s.kind = 'join' AND t.kind = 'join' AND s.side = 'SRC' AND t.side = 'TGT' AND s.expr IS DISTINCT FROM t.expr"""

_F3 = _F1.replace("'table'", "'filter'").replace("name AS v", "expr AS v").replace(
    "DISTINCT migration_id, name FROM", "DISTINCT migration_id, expr FROM").replace(
    "TABLE_REMOVED", "FILTER_REMOVED").replace("TABLE_ADDED", "FILTER_ADDED")

_OPS = " OR ".join(f"(contains(s.expr, '{o}') AND NOT contains(t.expr, '{o}'))" for o in S.OPERATORS)
_F4 = f"""SELECT s.migration_id, 'OPERATOR_CHANGED' AS category, s.expr AS source_value, t.expr AS target_value, count(*) AS occurrences
 FROM components s JOIN components t ON s.migration_id = t.migration_id AND s.name = t.name AND s.expr <> t.expr
 WHERE s.kind = 'filter' AND t.kind = 'filter' AND s.side = 'SRC' AND t.side = 'TGT' AND ({_OPS})
 GROUP BY s.migration_id, s.expr, t.expr"""

_F5 = """SELECT migration_id, 'AGGREGATION_REMOVED' AS category, v AS source_value, CAST(NULL AS VARCHAR) AS target_value, CAST(1 AS BIGINT) AS occurrences
 FROM (SELECT DISTINCT migration_id, name || '(' || expr || ')' AS v FROM components WHERE kind = 'aggregation' AND side = 'SRC'
       EXCEPT SELECT DISTINCT migration_id, name || '(' || expr || ')' FROM components WHERE kind = 'aggregation' AND side = 'TGT')
 UNION ALL SELECT migration_id, 'AGGREGATION_ADDED', NULL, v, 1
 FROM (SELECT DISTINCT migration_id, name || '(' || expr || ')' AS v FROM components WHERE kind = 'aggregation' AND side = 'TGT'
       EXCEPT SELECT DISTINCT migration_id, name || '(' || expr || ')' FROM components WHERE kind = 'aggregation' AND side = 'SRC')
 UNION ALL SELECT s.migration_id, 'AGGREGATION_CHANGED', 'distinct=' || CAST(s.is_distinct AS VARCHAR), 'distinct=' || CAST(t.is_distinct AS VARCHAR), count(*)
 FROM components s JOIN components t ON s.migration_id = t.migration_id AND s.name = t.name AND s.expr = t.expr
 WHERE s.kind = 'aggregation' AND t.kind = 'aggregation' AND s.side = 'SRC' AND t.side = 'TGT' AND s.is_distinct <> t.is_distinct
 GROUP BY s.migration_id, s.name, s.expr, s.is_distinct, t.is_distinct"""

_F6 = """SELECT coalesce(a.migration_id, b.migration_id) AS migration_id, 'CASE_RULE_CHANGED' AS category, CAST(coalesce(a.n, 0) AS VARCHAR) AS source_value,
 CAST(coalesce(b.n, 0) AS VARCHAR) AS target_value, CAST(1 AS BIGINT) AS occurrences
 FROM (SELECT migration_id, count(*) AS n FROM components WHERE kind = 'rule' AND side = 'SRC' GROUP BY 1) a
 FULL JOIN (SELECT migration_id, count(*) AS n FROM components WHERE kind = 'rule' AND side = 'TGT' GROUP BY 1) b ON a.migration_id = b.migration_id
 WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)
 UNION ALL SELECT s.migration_id, 'CASE_RULE_CHANGED', concat_ws(' THEN ', s.expr, s.name), concat_ws(' THEN ', t.expr, t.name), 1
 FROM components s JOIN components t ON s.migration_id = t.migration_id AND s.ordinal = t.ordinal
 WHERE s.kind = 'rule' AND t.kind = 'rule' AND s.side = 'SRC' AND t.side = 'TGT'
 AND (s.expr IS DISTINCT FROM t.expr OR s.name IS DISTINCT FROM t.name)"""

_F7 = """SELECT migration_id, 'NULL_SEMANTICS_CHANGED' AS category, CAST(NULL AS VARCHAR) AS source_value, CAST(NULL AS VARCHAR) AS target_value, CAST(1 AS BIGINT) AS occurrences
 FROM (SELECT migration_id FROM ((SELECT DISTINCT migration_id, expr, name FROM components WHERE kind = 'filter' AND side = 'SRC'
   EXCEPT SELECT DISTINCT migration_id, expr, name FROM components WHERE kind = 'filter' AND side = 'TGT')
  UNION ALL (SELECT DISTINCT migration_id, expr, name FROM components WHERE kind = 'filter' AND side = 'TGT'
   EXCEPT SELECT DISTINCT migration_id, expr, name FROM components WHERE kind = 'filter' AND side = 'SRC'))
  GROUP BY migration_id)"""


def _c(spark, sf):
    return derived.load(spark, sf, "components")


@query("f01_diff_tables", C + _F1)
def f01(spark, sf):
    return S.diff_tables(_c(spark, sf))


@query("f02_diff_joins", C + _F2)
def f02(spark, sf):
    return S.diff_joins(_c(spark, sf))


@query("f03_diff_filters", C + _F3)
def f03(spark, sf):
    return S.diff_filters(_c(spark, sf))


@query("f04_operator_changed", C + _F4)
def f04(spark, sf):
    return S.operator_changed(_c(spark, sf))


@query("f05_diff_aggregations", C + _F5)
def f05(spark, sf):
    return S.diff_aggregations(_c(spark, sf))


@query("f06_diff_rules", C + _F6)
def f06(spark, sf):
    return S.diff_rules(_c(spark, sf))


@query("f07_diff_null_semantics", C + _F7)
def f07(spark, sf):
    return S.diff_null_semantics(_c(spark, sf), kind="filter")


_F8 = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (_F1, _F2, _F3, _F4, _F5, _F6, _F7))


@query("f08_structural_diff", C + _F8)
def f08(spark, sf):
    return S.structural_diff(_c(spark, sf), null_kind="filter")


@query("f09_rule_check", C + f""", d AS ({_F8}), n AS (SELECT m.migration_id, coalesce(sum(d.occurrences), 0) AS n
 FROM (SELECT DISTINCT migration_id FROM components) m LEFT JOIN d ON m.migration_id = d.migration_id GROUP BY m.migration_id)
SELECT migration_id, 'BusinessRuleValidator' AS check_name, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN n = 0 THEN 'INFO' ELSE 'HIGH' END AS severity, CAST(round(greatest(0.0, 1.0 - n * 0.2), 4) AS DOUBLE) AS score, CAST(n AS BIGINT) AS mismatch_count FROM n""")
def f09(spark, sf):
    return S.rule_check(spark, _c(spark, sf), null_kind="filter")


_SPLIT = """
SELECT signal_id,
 CASE WHEN op IS NOT NULL THEN 'comparison' WHEN nop IS NOT NULL THEN 'null_check' ELSE 'expression' END AS type,
 coalesce(op, nop) AS operator,
 CASE WHEN op IS NOT NULL THEN trim(split_part(cond, op, 1)) WHEN nop IS NOT NULL THEN trim(split_part(cond, 'IS', 1)) END AS "left",
 CASE WHEN op IS NOT NULL THEN trim(substr(cond, length(split_part(cond, op, 1)) + length(op) + 1)) WHEN nop IS NOT NULL THEN '' END AS "right"
FROM (SELECT signal_id, cond, CASE """ + " ".join(f"WHEN contains(cond, '{o}') THEN '{o}'" for o in S.SPLIT_OPERATORS) + """ END AS op,
 CASE WHEN contains(upper(cond), 'IS NOT NULL') THEN 'IS NOT NULL' WHEN contains(upper(cond), 'IS NULL') THEN 'IS NULL' END AS nop
 FROM (SELECT signal_id, source_expression AS cond FROM signals UNION ALL SELECT -signal_id, target_expression || ' IS NULL' FROM signals))"""


@query("f10_split_condition", derived.cte("signals") + _SPLIT)
def f10(spark, sf):
    s = derived.load(spark, sf, "signals")
    conds = s.select("signal_id", F.col("source_expression").alias("cond")).unionByName(
        s.select((-F.col("signal_id")).alias("signal_id"),
                 F.concat(F.col("target_expression"), F.lit(" IS NULL")).alias("cond")))
    return conds.select("signal_id", S.split_condition(F.col("cond")).alias("x")).select("signal_id", "x.*")


_F11 = derived.cte("refs", "catalog") + """,
r AS (SELECT query_id, lower(table_name) AS t, lower(column_name) AS c, table_name, column_name, lower(scope_table) AS scope FROM refs),
cat AS (SELECT DISTINCT lower(table_name) AS ct, lower(column_name) AS cc FROM catalog),
ctes AS (SELECT DISTINCT query_id, scope AS name FROM r WHERE query_id % 4 = 0),
scopes AS (SELECT DISTINCT query_id, scope FROM r WHERE (query_id, scope) NOT IN (SELECT (query_id, name) FROM ctes)),
unres AS (SELECT * FROM scopes WHERE scope NOT IN (SELECT ct FROM cat)),
okq AS (SELECT DISTINCT query_id FROM r WHERE query_id NOT IN (SELECT query_id FROM unres)),
rr AS (SELECT * FROM r WHERE query_id IN (SELECT query_id FROM okq)),
have AS (SELECT DISTINCT s.query_id, cat.cc AS c FROM scopes s JOIN cat ON s.scope = cat.ct WHERE s.query_id IN (SELECT query_id FROM okq)),
d AS (
 SELECT query_id, 'TABLE' AS kind, scope AS table_name, CAST(NULL AS VARCHAR) AS column_name FROM unres
 UNION ALL SELECT DISTINCT query_id, 'COLUMN', t, column_name FROM rr WHERE t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cat WHERE ct = rr.t AND cc = rr.c)
   AND NOT EXISTS (SELECT 1 FROM ctes WHERE ctes.query_id = rr.query_id AND ctes.name = rr.t)
 UNION ALL SELECT DISTINCT query_id, 'COLUMN', NULL, column_name FROM rr WHERE t IS NULL AND NOT EXISTS (SELECT 1 FROM have h WHERE h.query_id = rr.query_id AND h.c = rr.c))
"""


@query("f11_resolve_references", _F11 + "SELECT * FROM d")
def f11(spark, sf):
    refs = derived.load(spark, sf, "refs")
    return S.resolve_references(refs, derived.load(spark, sf, "catalog"), _ctes(refs))


def _ctes(refs):
    return refs.filter("query_id % 4 = 0").select("query_id", F.col("scope_table").alias("name")).distinct()


@query("f11_preflight_status", _F11 + """
, per AS (SELECT query_id, count(*) FILTER (WHERE kind = 'TABLE') AS u, count(*) FILTER (WHERE kind = 'COLUMN') AS m FROM d GROUP BY query_id),
q AS (SELECT DISTINCT r.query_id, r.query_id % 11 = 0 AS lost, CASE WHEN lost THEN 0 ELSE coalesce(per.u, 0) END AS unresolved_tables,
  CASE WHEN lost THEN 0 ELSE coalesce(per.m, 0) END AS missing_columns FROM r LEFT JOIN per USING (query_id))
SELECT query_id, CASE WHEN lost OR unresolved_tables + missing_columns > 0 THEN 'FAILED' ELSE 'PASS' END AS status,
 CASE WHEN lost THEN 'DATASET_NOT_FOUND' WHEN unresolved_tables + missing_columns > 0 THEN 'INPUT_SCHEMA_MISMATCH' END AS failure_category,
 unresolved_tables, missing_columns, NOT lost AND unresolved_tables + missing_columns = 0 AS execution_allowed FROM q""")
def f11b(spark, sf):
    refs = derived.load(spark, sf, "refs")
    return S.preflight_status(refs, derived.load(spark, sf, "catalog"), _ctes(refs), refs.filter("query_id % 11 <> 0"))


_KW = ", ".join(f"'{w}'" for w in S.FORBIDDEN_KEYWORDS + S.MUTATING_KEYWORDS)


# documents, some of them with a statement at the end, in all the places
# where a forbidden word can stand
_F12_TEXTS = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat(text, ' WITH a AS (DELETE FROM t) SELECT 1') WHEN 1 THEN concat(text, ';drop table t')
 WHEN 2 THEN concat(text, ' select updated, load_date from created_items') WHEN 3 THEN ' ' ELSE text END AS text FROM documents"""


@query("f12_screen_read_only", f"""
SELECT doc_id, CASE WHEN e THEN 'EMPTY_QUERY' WHEN len(hits) > 0 THEN 'FORBIDDEN_KEYWORD' END AS violation,
 CASE WHEN e THEN '' ELSE array_to_string(hits, ',') END AS keywords
FROM (SELECT doc_id, coalesce(regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '', TRUE) AS e,
 list_sort(list_distinct(list_filter(regexp_split_to_array(upper(text), '[^A-Z0-9_]+'),
   lambda x: list_contains([{_KW}], x)))) AS hits FROM ({_F12_TEXTS}))""")
def f12(spark, sf):
    read_table(spark, sf, "documents").createOrReplaceTempView("documents")
    return S.screen_read_only(spark.sql(_F12_TEXTS), "text", "doc_id")


@query("f13_query_hash", """
SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\r\\n?', '\n', 'g'),
 '[ \\t\\x0B\\f]+(\\n|$)', '\\1', 'g')), 1, 16) AS query_hash FROM documents""")
def f13(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", query_hash(F.col("text")).alias("query_hash"))


@query("f17_dedupe_transformations", derived.cte("transformations") + """,
k AS (SELECT *, regexp_replace(source, '^\\s+|\\s+$', '', 'g') AS s_, regexp_replace(target, '^\\s+|\\s+$', '', 'g') AS t_ FROM transformations),
f AS (SELECT migration_id, s_, t_, arg_min(type, seq) AS type, arg_min(source, seq) AS source, arg_min(target, seq) AS target FROM k GROUP BY ALL)
SELECT f.migration_id, f.type, f.source, f.target, (SELECT count(*) FROM k WHERE k.migration_id = f.migration_id AND k.s_ = f.s_ AND k.t_ = f.t_ AND k.type = f.type) AS occurrences FROM f""")
def f17(spark, sf):
    return S.dedupe_transformations(derived.load(spark, sf, "transformations"))


@query("f17_transformation_counts", derived.cte("transformations") + """,
k AS (SELECT *, regexp_replace(source, '^\\s+|\\s+$', '', 'g') AS s_, regexp_replace(target, '^\\s+|\\s+$', '', 'g') AS t_ FROM transformations),
f AS (SELECT migration_id, s_, t_, arg_min(type, seq) AS type FROM k GROUP BY ALL)
SELECT migration_id, count(*) FILTER (WHERE type <> 'ASSUMPTION') AS transformation_count, count(*) FILTER (WHERE type = 'ASSUMPTION') AS assumption_count
FROM f GROUP BY migration_id""")
def f17b(spark, sf):
    return S.transformation_counts(derived.load(spark, sf, "transformations"))


_CL = derived.cte("components", "clauses", "regions")
_CH = """, ch AS (SELECT coalesce(b.query_id, a.query_id) AS query_id, coalesce(b.kind, a.kind) AS kind,
   max(CASE WHEN b.text IS DISTINCT FROM a.text THEN 1 ELSE 0 END) AS d
  FROM (SELECT * FROM clauses WHERE side = 'BEFORE') b FULL JOIN (SELECT * FROM clauses WHERE side = 'AFTER') a
  ON b.query_id = a.query_id AND b.kind = a.kind AND b.ordinal = a.ordinal GROUP BY 1, 2),
fl AS (SELECT q.query_id, coalesce(max(d) FILTER (WHERE kind = 'JOIN'), 0) = 1 AS cj,
  coalesce(max(d) FILTER (WHERE kind = 'WHERE'), 0) = 1 AS cw, coalesce(max(d) FILTER (WHERE kind = 'GROUP BY'), 0) = 1 AS cg,
  coalesce(max(d) FILTER (WHERE kind = 'SELECT'), 0) = 1 AS cs
  FROM (SELECT DISTINCT query_id FROM clauses) q LEFT JOIN ch USING (query_id) GROUP BY q.query_id)
"""


def _clauses(spark, sf):
    derived.load(spark, sf, "components").createOrReplaceTempView("components")
    return derived.load(spark, sf, "clauses")


@query("f16_changed_regions", _CL + _CH + """SELECT query_id, CASE WHEN NOT (cw OR cs OR cg OR cj) THEN 'columns' ELSE
 array_to_string(list_filter([CASE WHEN cw THEN 'where_clause' END, CASE WHEN cs THEN 'select_projections' END,
  CASE WHEN cg THEN 'group_by_clause' END, CASE WHEN cj THEN 'join_clause' END], lambda x: x IS NOT NULL), ',') END AS regions FROM fl""")
def f16(spark, sf):
    return S.changed_regions(_clauses(spark, sf))


@query("f14_contract_check", _CL + """,
sb AS (SELECT query_id, ordinal, lower(alias) AS al FROM clauses WHERE kind = 'SELECT' AND side = 'BEFORE'),
sa AS (SELECT query_id, ordinal, lower(alias) AS al FROM clauses WHERE kind = 'SELECT' AND side = 'AFTER'),
al AS (SELECT coalesce(sb.query_id, sa.query_id) AS query_id, count(sb.al) AS nb, count(sa.al) AS na,
  max(CASE WHEN sb.al IS DISTINCT FROM sa.al THEN 1 ELSE 0 END) AS d FROM sb FULL JOIN sa ON sb.query_id = sa.query_id AND sb.ordinal = sa.ordinal GROUP BY 1),
tb AS (SELECT DISTINCT query_id, side, lower(alias) AS t FROM clauses WHERE kind = 'TABLE'),
ts AS (SELECT coalesce(b.query_id, a.query_id) AS query_id, max(CASE WHEN b.t IS NULL OR a.t IS NULL THEN 1 ELSE 0 END) AS td
  FROM (SELECT * FROM tb WHERE side = 'BEFORE') b FULL JOIN (SELECT * FROM tb WHERE side = 'AFTER') a ON b.query_id = a.query_id AND b.t = a.t GROUP BY 1),
j AS (SELECT q.query_id, CASE WHEN coalesce(al.nb, 0) > 0 AND coalesce(al.na, 0) > 0 AND al.d = 1 THEN 'ALIASES_CHANGED'
  WHEN coalesce(ts.td, 0) = 1 THEN 'TABLES_CHANGED' END AS violation
  FROM (SELECT DISTINCT query_id FROM clauses) q LEFT JOIN al USING (query_id) LEFT JOIN ts USING (query_id))
SELECT query_id, violation IS NULL AS contract_valid, violation FROM j""")
def f14(spark, sf):
    return S.contract_check(_clauses(spark, sf))


@query("f15_scope_check", _CL + _CH + """,
rg AS (SELECT fl.*, lower(coalesce(r.changed_region, 'columns')) AS region FROM fl LEFT JOIN regions r USING (query_id)),
sel AS (SELECT query_id, side, lower(alias) AS alias, ordinal, text FROM clauses WHERE kind = 'SELECT' AND alias IS NOT NULL AND alias <> ''),
lb AS (SELECT query_id, alias, max({'o': ordinal, 't': text}).t AS before FROM sel WHERE side = 'BEFORE' GROUP BY ALL),
la AS (SELECT query_id, alias, max({'o': ordinal, 't': text}).t AS after FROM sel WHERE side = 'AFTER' GROUP BY ALL),
bp AS (SELECT lb.query_id, min(lb.alias) AS a FROM lb JOIN la USING (query_id, alias) JOIN rg USING (query_id)
  WHERE lb.before <> la.after AND NOT contains(rg.region, lb.alias) AND NOT contains(lb.alias, rg.region)
  AND rg.region NOT IN ('select', 'columns') GROUP BY lb.query_id),
j AS (SELECT rg.query_id, rg.region, CASE WHEN cj AND NOT contains(region, 'join') THEN 'JOIN_CHANGED' WHEN cg THEN 'GROUP_BY_CHANGED'
  WHEN cw AND NOT contains(region, 'where') THEN 'WHERE_CHANGED' WHEN bp.a IS NOT NULL THEN 'PROJECTION_CHANGED' END AS violation
  FROM rg LEFT JOIN bp USING (query_id))
SELECT query_id, region, violation IS NULL AS scope_valid, violation FROM j""")
def f15(spark, sf):
    c = _clauses(spark, sf)
    return S.scope_check(c, derived.load(spark, sf, "regions"))


@query("f18_candidate_screen", derived.cte("artifacts") + f"""SELECT migration_id AS proposal_id, reason = 'CANDIDATE_ACCEPTED' AS accepted, reason FROM (
 SELECT migration_id, CASE WHEN coalesce(repair_status, '') <> 'PROPOSED' THEN 'STATUS_NOT_PROPOSED'
  WHEN trim(coalesce(proposed_sql, '')) = '' THEN 'EMPTY_PROPOSED_SQL' WHEN trim(coalesce(target_sql, '')) = '' THEN 'MISSING_ORIGINAL_TARGET_SQL'
  WHEN regexp_replace(trim(target_sql), '\\s+', ' ', 'g') = regexp_replace(trim(proposed_sql), '\\s+', ' ', 'g') THEN 'UNCHANGED_REPAIR_SQL'
  WHEN NOT coalesce(candidate_status = 'VALID_SYNTAX', TRUE) THEN 'SQL_SYNTAX_ERROR'
  WHEN NOT contains(upper(proposed_sql), 'SELECT') THEN 'SCHEMA_INCONSISTENCY'
  WHEN trim(coalesce(repair_id, '')) = '' THEN 'UNKNOWN_DISCREPANCY_MAPPING'
  WHEN NOT coalesce(evidence_score > 0, TRUE) THEN 'CONTRACT_ALIAS_MISMATCH' ELSE 'CANDIDATE_ACCEPTED' END AS reason FROM artifacts)""")
def f18(spark, sf):
    a = derived.load(spark, sf, "artifacts")
    p = a.select(F.col("migration_id").alias("proposal_id"), F.col("repair_status").alias("status"), "proposed_sql",
                 F.col("target_sql").alias("original_sql"), F.col("proposed_sql").alias("stored_sql"),
                 (F.col("candidate_status") == "VALID_SYNTAX").alias("syntax_ok"),
                 F.upper("proposed_sql").contains("SELECT").alias("has_select"),
                 F.col("repair_id").alias("discrepancy_id"), (F.col("evidence_score") > 0).alias("contract_ok"))
    return S.candidate_screen(p)
