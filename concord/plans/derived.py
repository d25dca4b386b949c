"""Derived inputs over the driver tables.

Each recipe is plain SQL that Spark SQL and DuckDB both run unchanged, so
the Spark queries and their DuckDB oracles start from the same rows.  In
Spark the recipes are lazy views over the parquet scans: their work grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import register_tables

RECIPES: dict[str, str] = {
    "orders_src": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""",
    "orders_tgt": """
SELECT CASE WHEN o_orderkey % 103 = 0 THEN o_orderkey + 1000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
 CASE WHEN o_orderkey % 107 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 1.01 WHEN o_orderkey % 89 = 0 THEN o_totalprice + 0.0000001 ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 109 = 0 THEN concat(' ', o_orderpriority, ' ') ELSE o_orderpriority END AS o_orderpriority
 FROM orders WHERE o_orderkey % 101 <> 0
 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
 WHERE o_orderkey % 211 = 0 AND o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 0""",
    "items_src": """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem""",
    "items_tgt": """
SELECT l_orderkey, l_linenumber, l_partkey,
 CASE WHEN (l_orderkey * 7 + l_linenumber) % 97 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity
 FROM lineitem WHERE (l_orderkey * 3 + l_linenumber) % 101 <> 0""",
    "checks": """
WITH k AS (SELECT o_custkey AS migration_id, o_orderkey % 5 AS c, max(o_orderkey) AS k FROM orders GROUP BY o_custkey, o_orderkey % 5)
 , s AS (SELECT *, CASE k % 11 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARN' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'SKIPPED' ELSE 'PASS' END AS status FROM k)
 SELECT migration_id, CASE c WHEN 0 THEN 'SchemaValidator' WHEN 1 THEN 'RowValidator' WHEN 2 THEN 'AggregateValidator' WHEN 3 THEN 'BusinessRuleValidator' ELSE 'EdgeCaseValidator' END AS check_name,
 status, CASE WHEN status IN ('PASS','SKIPPED') THEN CAST(1 AS DOUBLE) WHEN status = 'ERROR' THEN CAST(0 AS DOUBLE) ELSE CAST(k % 100 AS DOUBLE) / 100 END AS score,
 CASE WHEN status = 'FAIL' THEN k % 50 + 1 ELSE 0 END AS mismatch_count FROM s""",
    "state_events": """
SELECT user_id AS migration_id, event_id, ts, event_id % 14 AS to_state,
 lag(event_id % 14) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events""",
    "signals": """
SELECT user_id AS validation_id, event_id AS signal_id,
 CASE event_id % 4 WHEN 0 THEN 'RowValidator' WHEN 1 THEN 'AggregateValidator' WHEN 2 THEN 'BusinessRuleValidator' ELSE 'EdgeCaseValidator' END AS source_validator,
 CASE event_id % 11 WHEN 0 THEN 'amount > 500' WHEN 1 THEN 'COALESCE(x, 0)' WHEN 2 THEN 'LEFT JOIN a' WHEN 3 THEN 'SUM(x)' WHEN 4 THEN 'a  =  1.00' WHEN 5 THEN 'UNION'
  WHEN 6 THEN 'DATE_TRUNC(month, d)' WHEN 7 THEN 'CAST(x AS INT)' WHEN 8 THEN 'CASE WHEN a = 1 THEN 1 ELSE 0 END' WHEN 9 THEN 'region = 1' ELSE 'total' END AS source_expression,
 CASE event_id % 11 WHEN 0 THEN 'amount >= 500' WHEN 1 THEN 'x' WHEN 2 THEN 'INNER JOIN a' WHEN 3 THEN 'AVG(x)' WHEN 4 THEN 'a  =  2.00' WHEN 5 THEN 'UNION ALL'
  WHEN 6 THEN 'd' WHEN 7 THEN 'x' WHEN 8 THEN 'CASE WHEN a = 2 THEN 1 ELSE 0 END' WHEN 9 THEN 'region = 2' ELSE 'amount' END AS target_expression,
 CASE event_id % 11 WHEN 9 THEN 'filters[0].expression' WHEN 10 THEN 'columns[mapping]' ELSE concat('columns[', event_type, ']') END AS analysis_path,
 event_id % 40 AS mismatch_count, concat('user ', CAST(user_id AS STRING)) AS row_key, CAST(event_id % 7 AS STRING) AS source_value, CAST(event_id % 5 AS STRING) AS target_value FROM events""",
    "discrepancies": """
SELECT l_orderkey AS validation_id, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 'BOUNDARY_CONDITION' WHEN 1 THEN 'JOIN_SEMANTICS' WHEN 2 THEN 'NULL_SEMANTICS' ELSE 'FILTER_LOGIC' END AS category,
 concat('columns[c', CAST(l_suppkey % 5 AS STRING), ']') AS analysis_path, CAST(l_quantity AS BIGINT) AS affected_rows FROM lineitem""",
    "refs": """
SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS table_name, p_type AS column_name, p_brand AS scope_table FROM part""",
    "catalog": """
SELECT DISTINCT p_brand AS table_name, p_type AS column_name FROM part WHERE p_size <= 5""",
    "evidence": """
SELECT conv_id AS pack_id, concat('E-00', CAST(turn AS STRING)) AS evidence_id FROM conversations""",
    "claims": """
SELECT conv_id AS pack_id, turn AS claim_id, concat('E-00', CAST(turn + turn % 3 AS STRING)) AS evidence_ref FROM conversations WHERE turn % 2 = 1""",
    "components": """
SELECT o_custkey % 300 AS migration_id, 'SRC' AS side,
 CASE o_orderkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'join' WHEN 2 THEN 'filter' WHEN 3 THEN 'aggregation' ELSE 'rule' END AS kind,
 row_number() OVER (PARTITION BY o_custkey % 300, o_orderkey % 5 ORDER BY o_orderkey) AS ordinal,
 concat(o_orderstatus, '_', CAST(o_orderkey % 17 AS STRING)) AS name,
 CASE WHEN o_orderkey % 2 = 0 THEN 'x > 500' ELSE 'y <= 10' END AS expr, o_orderkey % 3 = 0 AS is_distinct FROM orders
 UNION ALL SELECT o_custkey % 300, 'TGT',
 CASE o_orderkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'join' WHEN 2 THEN 'filter' WHEN 3 THEN 'aggregation' ELSE 'rule' END,
 row_number() OVER (PARTITION BY o_custkey % 300, o_orderkey % 5 ORDER BY o_orderkey),
 concat(o_orderstatus, '_', CAST((o_orderkey + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END) % 17 AS STRING)),
 CASE WHEN o_orderkey % 29 = 0 THEN 'x >= 500' WHEN o_orderkey % 2 = 0 THEN 'x > 500' ELSE 'y <= 10' END,
 CASE WHEN o_orderkey % 31 = 0 THEN o_orderkey % 3 <> 0 ELSE o_orderkey % 3 = 0 END FROM orders WHERE o_orderkey % 37 <> 0""",
    "clauses": """
SELECT migration_id AS query_id, CASE side WHEN 'SRC' THEN 'BEFORE' ELSE 'AFTER' END AS side,
 CASE kind WHEN 'join' THEN 'JOIN' WHEN 'filter' THEN 'WHERE' WHEN 'aggregation' THEN 'SELECT' WHEN 'table' THEN 'TABLE' ELSE 'GROUP BY' END AS kind,
 ordinal, CASE WHEN kind = 'table' THEN name ELSE concat(lower(name), '_', CAST(ordinal % 4 AS STRING)) END AS alias,
 CASE WHEN kind = 'join' THEN concat(name, ' ON ', expr) ELSE expr END AS text FROM components""",
    "regions": """
SELECT DISTINCT migration_id AS query_id, CASE migration_id % 5 WHEN 0 THEN 'where_clause' WHEN 1 THEN 'join_clause'
 WHEN 2 THEN 'columns' WHEN 3 THEN 'o_1' ELSE 'f_2' END AS changed_region FROM components""",
    "check_evidence": """
SELECT user_id AS validation_id, CASE event_id % 5 WHEN 0 THEN 'SchemaValidator' WHEN 1 THEN 'RowValidator' WHEN 2 THEN 'AggregateValidator'
 WHEN 3 THEN 'BusinessRuleValidator' ELSE 'EdgeCaseValidator' END AS check_name, event_id AS ordinal, upper(event_type) AS type,
 CASE WHEN event_id % 3 = 0 THEN event_type END AS ev_column,
 CASE WHEN event_id % 7 = 0 THEN 'CASE_RULE_CHANGED' WHEN event_id % 2 = 0 THEN 'VALUE_MISMATCH' END AS category,
 event_type AS source_value, concat(event_type, '_x') AS target_value FROM events""",
    "facts": """
SELECT c_custkey AS migration_id, c_custkey % 41 <> 0 AS source_ok, c_custkey % 43 <> 0 AS translation_ok, c_custkey % 47 <> 0 AS target_ok,
 c_custkey % 13 <> 0 AS schema_ok, c_custkey % 19 = 0 AS has_critical, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 ELSE 0 END AS remaining,
 c_custkey % 3 = 0 AS repair_attempted, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END END AS new_after_repair,
 CASE WHEN c_custkey % 3 = 0 THEN CASE c_custkey % 7 WHEN 0 THEN 'FAILED_VERIFICATION' WHEN 1 THEN 'PARTIALLY_RESOLVED' ELSE 'VERIFIED' END END AS verification_status,
 CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 53 <> 0 END AS dataset_unchanged, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 59 <> 0 END AS config_unchanged,
 CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 60 END AS rows_before, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 25 END AS rows_after FROM customer""",
    "lineage": """
SELECT c_custkey AS migration_id, CASE c_custkey % 4 WHEN 0 THEN 'DIRECT_PASS' WHEN 1 THEN 'REPAIRED_PASS' WHEN 2 THEN 'REPAIR_FAILED' ELSE 'REPAIR_NOT_EXECUTED' END AS verification_path,
 CASE WHEN c_custkey % 61 = 0 THEN '' ELSE concat('trans-', CAST(c_custkey AS STRING)) END AS translation_id,
 concat('src-', CAST(c_custkey AS STRING)) AS source_execution_id, CASE WHEN c_custkey % 67 = 0 THEN NULL ELSE concat('tgt-', CAST(c_custkey AS STRING)) END AS target_execution_id,
 concat('val-', CAST(c_custkey AS STRING)) AS validation_id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'diag' END AS diagnosis_id,
 CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'ai' END AS ai_diagnosis_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'rep' END AS repair_id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'ver' END AS verification_id FROM customer""",
    "artifacts": """
SELECT c_custkey AS migration_id, CASE c_custkey % 6 WHEN 0 THEN 'FAILED' ELSE 'SUCCESS' END AS translation_status,
 CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'SELECT 1' END AS target_sql, CASE WHEN c_custkey % 5 <> 0 THEN 'VALID_SYNTAX' END AS candidate_status,
 CASE WHEN c_custkey % 9 = 0 THEN 'TIMEOUT' ELSE 'SUCCESS' END AS target_execution_status, CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'FAIL' ELSE 'PASS' END AS validation_status,
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'rep' END AS repair_id, CASE c_custkey % 3 WHEN 0 THEN 'PROPOSED' WHEN 1 THEN 'VERIFIED' END AS repair_status, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'SELECT 2' END AS proposed_sql,
 CASE WHEN c_custkey % 12 = 0 THEN 'VERIFIED' ELSE 'BLOCKED' END AS final_status, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS evidence_score,
 CASE WHEN c_custkey % 6 = 0 THEN ' ' WHEN c_custkey % 6 <> 1 THEN 'ver' END AS verification_id, CASE WHEN c_custkey % 4 = 0 THEN 'verified' WHEN c_custkey % 4 = 1 THEN 'VERIFIED' END AS verification_status FROM customer""",
    "transformations": """
SELECT o_custkey AS migration_id, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'TRANSLATED_RULE' WHEN 1 THEN 'STRUCTURAL_DIFFERENCE' ELSE 'ASSUMPTION' END AS type,
 CASE WHEN o_orderkey % 2 = 0 THEN ' NVL' ELSE 'NVL ' END AS source, CASE WHEN o_orderkey % 5 = 0 THEN 'COALESCE' ELSE concat('IFNULL', CAST(o_orderkey % 3 AS STRING)) END AS target FROM orders""",
    "schema_cols": """
SELECT DISTINCT p_brand AS pair_id, 'SRC' AS side, p_type AS name, CASE max(p_size) OVER (PARTITION BY p_brand, p_type) % 4 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'DECIMAL(10,2)' WHEN 2 THEN 'VARCHAR' ELSE 'DATE' END AS type,
 dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS ordinal FROM part
 UNION ALL SELECT DISTINCT p_brand, 'TGT', p_type, CASE max(p_size) OVER (PARTITION BY p_brand, p_type) % 4 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'DOUBLE' WHEN 2 THEN 'STRING' ELSE 'TIMESTAMP' END,
 dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type DESC) FROM part WHERE p_size > 2""",
}


def cte(*names: str) -> str:
    """``WITH`` prefix defining the named recipes, for oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({RECIPES[n]})" for n in names) + "\n"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Recipe as a lazy DataFrame over the tables of ``sf_dir``."""
    _ensure_views(spark, sf_dir)
    return spark.sql(RECIPES[name])


_registered: dict[int, str] = {}


def _ensure_views(spark: SparkSession, sf_dir: str) -> None:
    sid = id(spark)
    if _registered.get(sid) != sf_dir or not spark.catalog.tableExists("orders"):
        register_tables(spark, sf_dir)
        _registered[sid] = sf_dir
