"""Driver queries for G — diagnosis over the signals recipe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnose as G
from . import derived
from .registry import query

SIG = derived.cte("signals")


def _sig(spark, sf):
    return derived.load(spark, sf, "signals")


_SRC = "upper(coalesce(source_expression, ''))"
_TGT = "upper(coalesce(target_expression, ''))"
_RS = "coalesce(source_expression, '')"
_RT = "coalesce(target_expression, '')"


def _e(k):
    return f"(contains({_SRC}, '{k}') OR contains({_TGT}, '{k}'))"


_CLASSIFY = f"""CASE
 WHEN {_e('NULL')} OR {_e('COALESCE')} OR contains({_SRC}, 'NVL') OR contains({_TGT}, 'IFNULL')
   OR (contains({_SRC}, 'COUNT(*)') AND contains({_TGT}, 'COUNT(') AND NOT contains({_TGT}, 'COUNT(*)'))
   OR (contains({_TGT}, 'COUNT(*)') AND contains({_SRC}, 'COUNT(') AND NOT contains({_SRC}, 'COUNT(*)'))
   OR st = 'NULL_SEMANTICS_CHANGED' THEN 'NULL_SEMANTICS'
 WHEN st IN ('BOUNDARY_CASE', 'BOUNDARY_CONDITION_CHANGED', 'OPERATOR_INCLUSION')
   OR (contains({_RS}, '>') AND contains({_RT}, '>=')) OR (contains({_RS}, '>=') AND contains({_RT}, '>'))
   OR (contains({_RS}, '<') AND contains({_RT}, '<=')) OR (contains({_RS}, '<=') AND contains({_RT}, '<'))
   OR {_e('BETWEEN')} THEN 'BOUNDARY_CONDITION'
 WHEN {_e('JOIN')} OR st IN ('JOIN_DIFF', 'JOIN_TYPE_CHANGED', 'JOIN_CONDITION_CHANGED') THEN 'JOIN_SEMANTICS'
 WHEN st IN ('AGGREGATION_DIFF', 'AGGREGATE_MISMATCH', 'AGGREGATE_RESULT_DIFF') OR {_e('SUM(')} OR {_e('AVG(')}
   OR {_e('COUNT(')} OR {_e('MIN(')} OR {_e('MAX(')} OR {_e('GROUP BY')} OR {_e('HAVING')} THEN 'AGGREGATION_SEMANTICS'
 WHEN {' OR '.join(_e(k) for k in G.DATE_KEYWORDS)} THEN 'DATE_SEMANTICS'
 WHEN {_e('CAST(')} OR {_e('CONVERT')} OR st IN ('SCHEMA_TYPE_CHANGED', 'TYPE_DIFF') THEN 'TYPE_CONVERSION'
 WHEN {_e('CASE')} OR st IN ('CASE_RULE_CHANGED', 'CASE_BRANCH_DIFF') THEN 'CASE_LOGIC'
 WHEN st IN ('FILTER_DIFF', 'FILTER_ADDED', 'FILTER_REMOVED', 'FILTER_EXPRESSION_CHANGED')
   OR contains(upper(analysis_path), 'WHERE') OR contains(upper(analysis_path), 'FILTER') THEN 'FILTER_LOGIC'
 WHEN st IN ('COLUMN_MAPPING_CHANGED', 'SCHEMA_COLUMN_ADDED', 'SCHEMA_COLUMN_REMOVED', 'COLUMN_SHIFT')
   OR contains(st, 'COLUMN_MAPPING') OR contains(analysis_path, 'mapping') THEN 'COLUMN_MAPPING'
 WHEN {_e('UNION')} OR contains({_SRC}, 'INTERSECT') OR contains({_TGT}, 'EXCEPT') THEN 'SET_SEMANTICS'
 ELSE 'UNKNOWN' END"""

_DPATH = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.DEFAULT_PATHS.items()) + " END"
_SUB = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.SUBCATEGORIES.items()) + " END"


def _norm(x):
    s = f"regexp_replace(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
    s = f"regexp_replace({s}, '(\\d+)\\.0+(\\D|$)', '\\1\\2', 'g')"
    for k in G.NORMALIZED_KEYWORDS:
        s = f"regexp_replace({s}, '\\b{k}\\b', '{k.upper()}', 'gi')"
    return s


_CLS = SIG + f""", s0 AS (SELECT *, '' AS st FROM signals),
cls AS (SELECT *, {_CLASSIFY} AS category FROM s0),
sg AS (SELECT *, {_SUB} AS subcategory, {_DPATH} AS rule_path,
 substr(sha256(concat_ws(':', category, split_part(CASE WHEN analysis_path <> '' THEN analysis_path ELSE {_DPATH} END, '.', 1),
   {_norm('source_expression')}, {_norm('target_expression')})), 1, 16) AS signature FROM cls)
"""


@query("g04_classify", _CLS + "SELECT validation_id, signal_id, category, subcategory, rule_path FROM sg")
def g04(spark, sf):
    c = G.classify(G.normalize_signals(_sig(spark, sf)))
    return c.select("validation_id", "signal_id", "category", "subcategory", "rule_path")


@query("g05_normalize_expression", SIG + f"SELECT signal_id, {_norm('source_expression')} AS norm_source, {_norm('target_expression')} AS norm_target FROM signals")
def g05(spark, sf):
    s = _sig(spark, sf)
    return s.select("signal_id", G.normalize_expression(F.col("source_expression")).alias("norm_source"),
                    G.normalize_expression(F.col("target_expression")).alias("norm_target"))


@query("g06_signature", _CLS + "SELECT validation_id, signal_id, signature FROM sg")
def g06(spark, sf):
    return G.signed_signals(_sig(spark, sf), link=False).select("validation_id", "signal_id", "signature")


_LINK_CTES = """, st AS (SELECT validation_id, signal_id AS a_id, analysis_path AS a_path, source_expression AS a_src, target_expression AS a_tgt,
  CASE WHEN starts_with(analysis_path, 'columns[') AND ends_with(analysis_path, ']') THEN regexp_extract(analysis_path, '^columns\\[(.*)\\]$', 1) END AS a_pcol
  FROM signals WHERE source_validator IN ('BusinessRuleValidator', 'AST_ANALYZER')),
ex AS (SELECT *, CASE WHEN starts_with(analysis_path, 'columns[') AND ends_with(analysis_path, ']') THEN regexp_extract(analysis_path, '^columns\\[(.*)\\]$', 1) END AS pcol
  FROM signals WHERE source_validator IN ('RowValidator', 'EdgeCaseValidator')),
m AS (SELECT ex.validation_id, ex.signal_id, min({'i': st.a_id, 'p': st.a_path, 's': st.a_src, 't': st.a_tgt}) AS m
  FROM ex JOIN st ON ex.validation_id = st.validation_id
  WHERE NOT (ex.pcol IS NOT NULL AND ex.pcol <> '' AND st.a_pcol IS NOT NULL AND st.a_pcol <> '' AND ex.pcol <> st.a_pcol)
   AND (ex.analysis_path = '' OR st.a_path = '' OR ex.analysis_path = st.a_path OR starts_with(ex.analysis_path, st.a_path) OR starts_with(st.a_path, ex.analysis_path))
  GROUP BY ex.validation_id, ex.signal_id)"""
# signals with the linkage applied, then classified as above
_LINKED = _LINK_CTES + """,
lsignals AS (SELECT * FROM signals WHERE source_validator NOT IN ('RowValidator', 'EdgeCaseValidator') UNION ALL BY NAME
 SELECT ex.* EXCLUDE (pcol) REPLACE (coalesce(m.m.s, ex.source_expression) AS source_expression, coalesce(m.m.t, ex.target_expression) AS target_expression,
  CASE WHEN m.m.i IS NOT NULL AND coalesce(m.m.p, '') <> '' THEN m.m.p ELSE ex.analysis_path END AS analysis_path)
 FROM ex LEFT JOIN m ON ex.validation_id = m.validation_id AND ex.signal_id = m.signal_id)"""
_CLS_LINKED = _CLS.replace(SIG, SIG + _LINKED, 1).replace("FROM signals)", "FROM lsignals)", 1)


_ROWX = "(source_validator = 'RowValidator' OR contains(st, 'VALUE_MISMATCH') OR contains(st, 'mismatch'))"
_EDGEX = f"(NOT {_ROWX} AND (source_validator = 'EdgeCaseValidator' OR contains(st, 'EDGE_CASE')))"
_TOTAL = 400

_CONS = _CLS_LINKED + f""", g AS (
 SELECT validation_id, signature,
  min({{'v': source_validator, 't': st, 'p': analysis_path, 'c': category, 'sub': subcategory, 'rp': rule_path,
        's': source_expression, 'g': target_expression}}) AS f,
  bool_or(source_validator IN ('BusinessRuleValidator', 'AST_ANALYZER')) AS has_structural,
  bool_or({_ROWX} OR {_EDGEX}) AS has_execution, bool_or({_EDGEX}) AS has_edge_case,
  max(CASE WHEN {_ROWX} AND coalesce(mismatch_count, 0) > 0 THEN mismatch_count END) AS mx,
  count(*) FILTER (WHERE source_validator = 'RowValidator') AS nrow, bool_or({_ROWX}) AS anyrow, count(*) AS signal_count
 FROM sg GROUP BY validation_id, signature),
d AS (SELECT validation_id, signature, f.c AS category, f.sub AS subcategory,
  CASE WHEN f.p <> '' THEN f.p ELSE f.rp END AS analysis_path, f.s AS source_expression, f.g AS target_expression,
  has_structural, has_execution, has_edge_case, CASE WHEN anyrow THEN CAST(coalesce(mx, nrow) AS BIGINT) END AS affected_row_count,
  CAST({_TOTAL} AS BIGINT) AS total_output_rows, signal_count FROM g),
d2 AS (SELECT *,
  CASE WHEN coalesce(affected_row_count, 0) = 0 THEN CASE WHEN category IN ('BOUNDARY_CONDITION', 'NULL_SEMANTICS', 'JOIN_SEMANTICS') THEN 'LOW' ELSE 'INFO' END
   WHEN coalesce(affected_row_count, 0) / total_output_rows >= 0.25 OR (category = 'JOIN_SEMANTICS' AND coalesce(affected_row_count, 0) / total_output_rows >= 0.10) THEN 'CRITICAL'
   WHEN coalesce(affected_row_count, 0) / total_output_rows >= 0.01 OR category IN ('BOUNDARY_CONDITION', 'NULL_SEMANTICS', 'JOIN_SEMANTICS', 'CASE_LOGIC') THEN 'HIGH'
   WHEN coalesce(affected_row_count, 0) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN category = 'UNKNOWN' THEN 0.50 WHEN has_structural AND has_execution AND has_edge_case THEN 1.00
   WHEN has_structural AND has_execution THEN 0.95 WHEN has_execution AND NOT has_structural THEN 0.90
   WHEN has_structural AND NOT has_execution THEN 0.85 ELSE 0.60 END AS classification_confidence,
  CASE WHEN affected_row_count IS NULL THEN 0.0 ELSE round(affected_row_count / total_output_rows * 100.0, 3) END AS affected_percentage,
  printf('D-%03d', row_number() OVER (PARTITION BY validation_id ORDER BY signature)) AS discrepancy_id FROM d)
"""

_CONS_COLS = ("validation_id, signature, category, subcategory, analysis_path, source_expression, target_expression, "
              "has_structural, has_execution, has_edge_case, affected_row_count, total_output_rows, signal_count, "
              "severity, CAST(classification_confidence AS DOUBLE) AS classification_confidence, affected_percentage, discrepancy_id")


def _cons(spark, sf):
    return G.consolidate(_sig(spark, sf), total_rows=_TOTAL)


@query("g07_consolidate", _CONS + f"SELECT {_CONS_COLS} FROM d2")
def g07(spark, sf):
    return _cons(spark, sf).drop("validator_checks", "affected_output_columns")


@query("g07_validator_checks", _CONS.replace("count(*) AS signal_count", "count(*) AS signal_count, list_sort(list(DISTINCT source_validator)) AS vc")
       .replace("f.s AS source_expression", "vc, f.s AS source_expression")
       + "SELECT validation_id, signature, array_to_string(vc, ',') AS validator_checks FROM d2")
def g07b(spark, sf):
    return _cons(spark, sf).select("validation_id", "signature", F.array_join("validator_checks", ",").alias("validator_checks"))


_TYPED = f""", fc AS (SELECT validation_id, signature,
 min({{'v': source_validator, 't': st, 'p': analysis_path, 'c': category}}).c AS gcat FROM sg GROUP BY validation_id, signature),
e AS (SELECT sg.*, fc.gcat FROM sg JOIN fc USING (validation_id, signature)
 WHERE {_ROWX} OR {_EDGEX} OR source_validator IN ('BusinessRuleValidator', 'AST_ANALYZER')),
x AS (SELECT e.* EXCLUDE (row_key, source_value, target_value), raw.row_key, raw.source_value, raw.target_value
 FROM e JOIN signals raw ON raw.validation_id = e.validation_id AND raw.signal_id = e.signal_id),
typed AS (SELECT validation_id, signature, CAST(ordinal AS INTEGER) AS ordinal, type, "column", row_key, value, source_result, target_result, detail, total_count, total_count > 100 AS truncated FROM (
 SELECT validation_id, signature, row_number() OVER (PARTITION BY validation_id, signature ORDER BY source_validator, st, analysis_path, signal_id) AS ordinal,
  CASE WHEN {_ROWX} THEN 'ROW_DIFF' WHEN {_EDGEX} THEN CASE WHEN gcat = 'BOUNDARY_CONDITION' THEN 'BOUNDARY_CASE' ELSE 'ROW_DIFF' END ELSE 'RULE_DIFF' END AS type,
  CAST(NULL AS VARCHAR) AS "column", CASE WHEN {_ROWX} THEN row_key END AS row_key, CAST(NULL AS VARCHAR) AS value,
  CASE WHEN {_ROWX} THEN source_value WHEN {_EDGEX} THEN NULL ELSE source_expression END AS source_result,
  CASE WHEN {_ROWX} THEN target_value WHEN {_EDGEX} THEN NULL ELSE target_expression END AS target_result,
  CASE WHEN {_ROWX} THEN 'rows differ in a column' WHEN {_EDGEX} THEN 'an edge case gives another result' ELSE 'the rules differ' END AS detail,
  count(*) OVER (PARTITION BY validation_id, signature) AS total_count FROM x)
WHERE ordinal <= 100)"""


@query("g08_typed_evidence", _CLS_LINKED + _TYPED + "SELECT * FROM typed")
def g08(spark, sf):
    return G.typed_evidence(_sig(spark, sf), 100)


_LINK = SIG + _LINK_CTES + """
SELECT ex.validation_id, ex.signal_id, coalesce(m.m.s, ex.source_expression) AS source_expression, coalesce(m.m.t, ex.target_expression) AS target_expression,
 CASE WHEN m.m.i IS NOT NULL AND coalesce(m.m.p, '') <> '' THEN m.m.p ELSE ex.analysis_path END AS analysis_path
FROM ex LEFT JOIN m ON ex.validation_id = m.validation_id AND ex.signal_id = m.signal_id"""


@query("g03_link_execution_to_structure", _LINK)
def g03(spark, sf):
    l = G.link_execution_to_structure(_sig(spark, sf))
    return (l.filter(F.col("source_validator").isin(*G.EXECUTION))
            .select("validation_id", "signal_id", "source_expression", "target_expression", "analysis_path"))


_DIMS = ", ".join([f"('category', '{c}')" for c in G.CATEGORIES] + [f"('severity', '{v}')" for v in G.SEVERITIES])


@query("g12_diagnosis_report", _CONS + f""",
ids AS (SELECT DISTINCT validation_id FROM d2 UNION SELECT DISTINCT validation_id FROM signals),
dims(dimension, value) AS (VALUES {_DIMS}),
cnt AS (SELECT validation_id, 'category' AS dimension, category AS value, count(*) AS n FROM d2 GROUP BY ALL
  UNION ALL SELECT validation_id, 'severity', severity, count(*) FROM d2 GROUP BY ALL),
tot AS (SELECT validation_id, count(*) AS n, coalesce(sum(affected_row_count), 0) AS aff FROM d2 GROUP BY ALL),
sc AS (SELECT validation_id, count(*) AS n FROM signals GROUP BY ALL)
SELECT ids.validation_id, dims.dimension, dims.value, CAST(coalesce(cnt.n, 0) AS BIGINT) AS count
FROM ids CROSS JOIN dims LEFT JOIN cnt ON cnt.validation_id = ids.validation_id AND cnt.dimension = dims.dimension AND cnt.value = dims.value
UNION ALL SELECT ids.validation_id, 'total', 'discrepancies', CAST(coalesce(tot.n, 0) AS BIGINT) FROM ids LEFT JOIN tot USING (validation_id)
UNION ALL SELECT ids.validation_id, 'total', 'affected_rows', CAST(coalesce(tot.aff, 0) AS BIGINT) FROM ids LEFT JOIN tot USING (validation_id)
UNION ALL SELECT ids.validation_id, 'total', 'signals', CAST(coalesce(sc.n, 0) AS BIGINT) FROM ids LEFT JOIN sc USING (validation_id)""")
def g12(spark, sf):
    return G.diagnosis_report(_cons(spark, sf), _sig(spark, sf))


@query("g13_evidence_pack", _CONS + _TYPED + """,
exa AS (SELECT validation_id, signature, arg_min(concat_ws(' | ', type, row_key, source_result, target_result), ordinal) AS example FROM typed WHERE type <> 'RULE_DIFF' GROUP BY ALL),
sdf AS (SELECT validation_id, signature, string_agg(DISTINCT concat_ws(' -> ', source_result, target_result), '; ' ORDER BY concat_ws(' -> ', source_result, target_result)) AS diffs
  FROM typed WHERE type = 'RULE_DIFF' GROUP BY ALL),
pk AS (SELECT d2.*, exa.example, sdf.diffs FROM d2 LEFT JOIN exa USING (validation_id, signature) LEFT JOIN sdf USING (validation_id, signature))
SELECT validation_id, discrepancy_id, i.evidence_id, i.evidence_type, i.details FROM (
 SELECT validation_id, discrepancy_id, unnest(list_filter([
   CASE WHEN coalesce(source_expression, '') <> '' THEN {'evidence_id': 'E-001', 'evidence_type': 'SOURCE_EXPRESSION', 'details': MAP {'expression': source_expression, 'path': coalesce(analysis_path, '')}} END,
   CASE WHEN coalesce(target_expression, '') <> '' THEN {'evidence_id': 'E-002', 'evidence_type': 'TARGET_EXPRESSION', 'details': MAP {'expression': target_expression, 'path': coalesce(analysis_path, '')}} END,
   {'evidence_id': 'E-003', 'evidence_type': 'DISCREPANCY_IMPACT', 'details': MAP {'category': category, 'severity': severity,
     'affected_row_count': CAST(coalesce(affected_row_count, 0) AS VARCHAR), 'affected_percentage': printf('%.3f', coalesce(affected_percentage, 0.0))}},
   CASE WHEN example IS NOT NULL THEN {'evidence_id': 'E-004', 'evidence_type': 'REPRESENTATIVE_EXAMPLE', 'details': MAP {'example': example}} END,
   CASE WHEN diffs IS NOT NULL THEN {'evidence_id': 'E-005', 'evidence_type': 'STRUCTURAL_DIFFERENCE', 'details': MAP {'structural_differences': diffs}} END],
   lambda x: x IS NOT NULL)) AS i FROM pk)""")
def g13(spark, sf):
    return G.evidence_packs(_sig(spark, sf), total_rows=_TOTAL, cap=100)


@query("g14_grounding_check", derived.cte("claims", "evidence") + """,
ev AS (SELECT DISTINCT pack_id, evidence_id FROM evidence),
packs AS (SELECT pack_id FROM ev UNION SELECT pack_id FROM claims),
unk AS (SELECT c.pack_id, count(*) AS n FROM claims c WHERE c.evidence_ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.pack_id = c.pack_id AND ev.evidence_id = c.evidence_ref) GROUP BY c.pack_id),
pc AS (SELECT pack_id, claim_id, count(evidence_ref) AS n FROM claims GROUP BY ALL),
j AS (SELECT p.pack_id, coalesce((SELECT count(*) FROM ev WHERE ev.pack_id = p.pack_id), 0) AS evidence_items,
  coalesce((SELECT count(*) FROM pc WHERE pc.pack_id = p.pack_id), 0) AS claims,
  coalesce((SELECT count(*) FROM pc WHERE pc.pack_id = p.pack_id AND n = 0), 0) AS claims_without_refs,
  coalesce((SELECT n FROM unk WHERE unk.pack_id = p.pack_id), 0) AS unknown_refs FROM packs p)
SELECT *, evidence_items > 0 AND claims > 0 AND claims_without_refs = 0 AND unknown_refs = 0 AS is_valid FROM j""")
def g14(spark, sf):
    return G.grounding_check(derived.load(spark, sf, "claims"), derived.load(spark, sf, "evidence"))


@query("g15_evidence_confidence", _CONS + """SELECT validation_id, discrepancy_id,
 least(round(0.50 + CASE WHEN coalesce(source_expression, '') <> '' THEN 0.15 ELSE 0 END + CASE WHEN coalesce(target_expression, '') <> '' THEN 0.15 ELSE 0 END
  + CASE WHEN coalesce(affected_row_count, 0) > 0 THEN 0.10 ELSE 0 END, 2), 0.98)::DOUBLE AS diagnosis_confidence FROM d2""")
def g15(spark, sf):
    d = _cons(spark, sf)
    return G.evidence_confidence(G.evidence_pack(d), d)


@query("g09_severity", derived.cte("discrepancies") + """SELECT validation_id, l_linenumber, category,
 CASE WHEN affected_rows = 0 THEN CASE WHEN category IN ('BOUNDARY_CONDITION', 'NULL_SEMANTICS', 'JOIN_SEMANTICS') THEN 'LOW' ELSE 'INFO' END
  WHEN affected_rows / 100.0 >= 0.25 OR (category = 'JOIN_SEMANTICS' AND affected_rows / 100.0 >= 0.10) THEN 'CRITICAL'
  WHEN affected_rows / 100.0 >= 0.01 OR category IN ('BOUNDARY_CONDITION', 'NULL_SEMANTICS', 'JOIN_SEMANTICS', 'CASE_LOGIC') THEN 'HIGH'
  WHEN affected_rows > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 round(affected_rows / 100.0 * 100.0, 3) AS affected_percentage FROM discrepancies""")
def g09(spark, sf):
    d = derived.load(spark, sf, "discrepancies")
    total = F.lit(100)
    return d.select("validation_id", "l_linenumber", "category",
                    G.severity(F.col("category"), F.col("affected_rows"), total).alias("severity"),
                    G.affected_pct(F.col("affected_rows"), total).alias("affected_percentage"))


@query("g01_extract_signals", derived.cte("checks", "check_evidence") + """
SELECT e.validation_id, CAST(e.ordinal AS BIGINT) AS signal_id, e.check_name AS source_validator, coalesce(e.type, '') AS signal_type,
 e.source_value AS source_expression, e.target_value AS target_expression,
 CASE WHEN e.ev_column IS NOT NULL AND e.ev_column <> '' THEN 'columns[' || e.ev_column || ']'
  WHEN e.category = 'CASE_RULE_CHANGED' THEN 'business_rules[0].condition'
  WHEN e.category IS NOT NULL AND e.category <> '' THEN 'category[' || e.category || ']' ELSE '' END AS analysis_path,
 CAST(c.mismatch_count AS BIGINT) AS mismatch_count, e.ev_column AS "column", e.category AS payload_category
FROM check_evidence e JOIN checks c ON c.migration_id = e.validation_id AND c.check_name = e.check_name
WHERE c.status NOT IN ('PASS', 'SKIPPED')""")
def g01(spark, sf):
    c = derived.load(spark, sf, "checks").withColumnRenamed("migration_id", "validation_id")
    e = derived.load(spark, sf, "check_evidence").withColumnRenamed("ev_column", "column")
    return G.extract_signals(c, e)


# tables of the recipe stand in for case conditions
@query("g02_component_signals", derived.cte("components", "signals") + """,
c AS (SELECT migration_id, side, CASE kind WHEN 'table' THEN 'case' ELSE kind END AS kind, ordinal, name, expr, is_distinct FROM components),
j AS (SELECT s.migration_id AS validation_id, s.kind, s.ordinal, s.name AS sn, t.name AS tn, s.expr AS se, t.expr AS te, s.is_distinct AS sd, t.is_distinct AS td
  FROM c s JOIN c t ON s.side = 'SRC' AND t.side = 'TGT' AND s.migration_id = t.migration_id AND s.kind = t.kind AND s.ordinal = t.ordinal),
d AS (SELECT * FROM j WHERE CASE kind WHEN 'rule' THEN se <> te OR sn <> tn WHEN 'join' THEN se <> te OR sn <> tn
  WHEN 'aggregation' THEN se <> te OR sn <> tn OR sd <> td ELSE se <> te END)
SELECT validation_id, CAST(ordinal * 10 + CASE kind WHEN 'rule' THEN 0 WHEN 'filter' THEN 1 WHEN 'join' THEN 2 WHEN 'aggregation' THEN 3 ELSE 4 END AS BIGINT) AS signal_id,
 'AST_ANALYZER' AS source_validator,
 CASE kind WHEN 'rule' THEN 'CASE_RULE_CHANGED' WHEN 'filter' THEN 'FILTER_DIFF' WHEN 'join' THEN 'JOIN_DIFF' WHEN 'aggregation' THEN 'AGGREGATION_DIFF'
  ELSE CASE WHEN (se LIKE '%>%' AND te LIKE '%>=%') OR (se LIKE '%>=%' AND te LIKE '%>%') OR (se LIKE '%<%' AND te LIKE '%<=%') OR (se LIKE '%<=%' AND te LIKE '%<%')
   THEN 'OPERATOR_INCLUSION' ELSE 'CASE_CONDITION_DIFF' END END AS signal_type,
 CASE kind WHEN 'join' THEN sn || ' JOIN ON ' || se WHEN 'aggregation' THEN sn || '(' || CASE WHEN sd THEN 'DISTINCT ' ELSE '' END || se || ')' ELSE se END AS source_expression,
 CASE kind WHEN 'join' THEN tn || ' JOIN ON ' || te WHEN 'aggregation' THEN tn || '(' || CASE WHEN td THEN 'DISTINCT ' ELSE '' END || te || ')' ELSE te END AS target_expression,
 CASE kind WHEN 'rule' THEN printf('business_rules[%d]', ordinal - 1) WHEN 'filter' THEN printf('filters[%d].expression', ordinal - 1) WHEN 'join' THEN printf('joins[%d]', ordinal - 1)
  WHEN 'aggregation' THEN printf('aggregations[%d]', ordinal - 1) ELSE 'columns[' || sn || ']' END AS analysis_path,
 CAST(0 AS BIGINT) AS mismatch_count, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS payload_category
FROM d WHERE validation_id NOT IN (SELECT validation_id FROM signals WHERE source_validator = 'BusinessRuleValidator')""")
def g02(spark, sf):
    c = derived.load(spark, sf, "components").withColumn("kind", F.when(F.col("kind") == "table", "case").otherwise(F.col("kind")))
    # structural signals have no rows to show
    return G.component_signals(c, derived.load(spark, sf, "signals")).drop("row_key", "value", "source_value", "target_value", "detail")
