"""Driver queries for D — relation comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.compare.aggregates import aggregate_diff, aggregate_stats, default_specs
from ..operators.compare.edges import boundary_keyset_diff, edge_check, null_count_diff
from ..operators.compare.report import evidence, report_rollup, row_check, validate
from ..operators.compare.rows import compare_rows
from ..operators.compare.schema import schema_diff, schema_summary
from ..session import read_table
from . import derived
from . import oracle_sql as O
from .registry import query

OCOLS = [("o_custkey", "num"), ("o_orderstatus", "str"), ("o_totalprice", "num"),
         ("o_orderpriority", "str")]


def _orders(spark, sf):
    return derived.load(spark, sf, "orders_src"), derived.load(spark, sf, "orders_tgt")


def _items(spark, sf):
    return derived.load(spark, sf, "items_src"), derived.load(spark, sf, "items_tgt")


# ---------------------------------------------------------------- D2
_D02_SQL = derived.cte("schema_cols") + """,
tg(n, g) AS (VALUES ('VARCHAR','STRING'),('STRING','STRING'),('TEXT','STRING'),('CHAR','STRING'),('NVARCHAR','STRING'),
 ('INT','INTEGER'),('BIGINT','INTEGER'),('INTEGER','INTEGER'),('SMALLINT','INTEGER'),('TINYINT','INTEGER'),('INT64','INTEGER'),
 ('INT32','INTEGER'),('LONG','INTEGER'),('BYTE','INTEGER'),('SHORT','INTEGER'),('FLOAT','FLOAT'),('DOUBLE','FLOAT'),('REAL','FLOAT'),
 ('DECIMAL','FLOAT'),('NUMERIC','FLOAT'),('FLOAT8','FLOAT'),('FLOAT4','FLOAT'),('DOUBLE PRECISION','FLOAT'),('BOOLEAN','BOOLEAN'),
 ('BOOL','BOOLEAN'),('DATE','DATE'),('TIMESTAMP','TIMESTAMP'),('DATETIME','TIMESTAMP'),('TIMESTAMPTZ','TIMESTAMP'),
 ('TIMESTAMP WITH TIME ZONE','TIMESTAMP'),('TIMESTAMP_NTZ','TIMESTAMP'),('TIMESTAMP_LTZ','TIMESTAMP')),
c AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY ordinal, name) AS pos,
      coalesce((SELECT g FROM tg WHERE n = trim(upper(split_part(type, '(', 1)))), trim(upper(split_part(type, '(', 1)))) AS grp
      FROM schema_cols),
s AS (SELECT * FROM c WHERE side = 'SRC'), t AS (SELECT * FROM c WHERE side = 'TGT'),
j AS (SELECT coalesce(s.pair_id, t.pair_id) AS pair_id, coalesce(s.name, t.name) AS name, s.type AS s_type, t.type AS t_type,
      s.grp AS s_grp, t.grp AS t_grp, s.pos AS s_pos, t.pos AS t_pos
      FROM s FULL JOIN t ON s.pair_id = t.pair_id AND s.name = t.name)
SELECT pair_id, CASE WHEN t_pos IS NULL THEN 'COLUMN_MISSING' WHEN s_pos IS NULL THEN 'COLUMN_EXTRA' ELSE 'TYPE_CHANGED' END AS category,
 name AS "column", s_type AS source_type, t_type AS target_type
FROM j WHERE t_pos IS NULL OR s_pos IS NULL OR s_grp <> t_grp
UNION ALL
SELECT pair_id, 'COLUMN_ORDER_CHANGED', NULL, NULL, NULL FROM j GROUP BY pair_id
HAVING count(*) FILTER (WHERE s_pos IS NULL OR t_pos IS NULL) = 0 AND count(*) FILTER (WHERE s_pos <> t_pos) > 0
"""


@query("d02_schema_diff", _D02_SQL)
def d02_schema_diff(spark, sf):
    return schema_diff(derived.load(spark, sf, "schema_cols"))


_SCHEMA_J = _D02_SQL.split("SELECT pair_id, CASE WHEN t_pos IS NULL")[0]


@query("d02_schema_summary", _SCHEMA_J + """, d AS (SELECT pair_id, count(*) AS n FROM (
SELECT pair_id FROM j WHERE t_pos IS NULL OR s_pos IS NULL OR s_grp <> t_grp
UNION ALL SELECT pair_id FROM j GROUP BY pair_id
HAVING count(*) FILTER (WHERE s_pos IS NULL OR t_pos IS NULL) = 0 AND count(*) FILTER (WHERE s_pos <> t_pos) > 0) GROUP BY pair_id),
cnt AS (SELECT pair_id, count(s_type) AS src_cols, count(t_type) AS tgt_cols, count(*) FILTER (WHERE s_grp = t_grp) AS compatible FROM j GROUP BY pair_id)
SELECT cnt.pair_id, src_cols, tgt_cols, compatible, CAST(coalesce(d.n, 0) AS BIGINT) AS mismatch_count,
 round(CASE WHEN greatest(src_cols, tgt_cols) = 0 THEN 1.0 ELSE compatible / greatest(src_cols, tgt_cols) END, 4) AS score,
 CASE WHEN coalesce(d.n, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN coalesce(d.n, 0) = 0 THEN 'INFO' ELSE 'CRITICAL' END AS severity
FROM cnt LEFT JOIN d USING (pair_id)""")
def d02_schema_summary(spark, sf):
    return schema_summary(derived.load(spark, sf, "schema_cols"))


# ---------------------------------------------------------------- D3
@query("d03_key_presence", derived.cte("orders_src", "orders_tgt") + """
SELECT o_orderkey, 'MISSING_FROM_TARGET' AS presence FROM (SELECT o_orderkey FROM orders_src EXCEPT SELECT o_orderkey FROM orders_tgt)
UNION ALL
SELECT o_orderkey, 'EXTRA_IN_TARGET' FROM (SELECT o_orderkey FROM orders_tgt EXCEPT SELECT o_orderkey FROM orders_src)
""")
def d03_key_presence(spark, sf):
    s, t = _orders(spark, sf)
    return compare_rows(s, t).key_presence


# ---------------------------------------------------------------- D5
_ORDERS_EQ = ", ".join(
    f"{O.values_equal('s.' + c, k, 't.' + c, k)} AS {c.split('_', 1)[1]}_equal" for c, k in OCOLS)


@query("d05_values_equal", derived.cte("orders_src", "orders_tgt") + f"""
SELECT s.o_orderkey, {_ORDERS_EQ}
FROM orders_src s JOIN orders_tgt t ON s.o_orderkey = t.o_orderkey
""")
def d05_values_equal(spark, sf):
    from ..functions.values import values_equal
    s, t = _orders(spark, sf)
    j = s.alias("s").join(t.alias("t"), F.col("s.o_orderkey") == F.col("t.o_orderkey"))
    ty = dict(s.dtypes)
    from pyspark.sql import types as T
    kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    return j.select(F.col("s.o_orderkey"), *[
        values_equal(F.col("s." + c), kinds[ty[c]], F.col("t." + c), kinds[ty[c]])
        .alias(c.split("_", 1)[1] + "_equal") for c, _ in OCOLS])


# ------------------------------------------------- shared oracle pieces
_ORDERS_RES = derived.cte("orders_src", "orders_tgt") + """,
s AS (SELECT * FROM orders_src), t AS (SELECT * FROM orders_tgt),
ks AS (SELECT o_orderkey, sum(a) AS ks, sum(b) AS kt FROM (SELECT o_orderkey, 1 AS a, 0 AS b FROM s UNION ALL SELECT o_orderkey, 0, 1 FROM t) GROUP BY o_orderkey),
shared AS (SELECT o_orderkey FROM ks WHERE ks > 0 AND kt > 0),
rs AS (SELECT * FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t) WHERE o_orderkey IN (SELECT o_orderkey FROM shared)),
rt AS (SELECT * FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s) WHERE o_orderkey IN (SELECT o_orderkey FROM shared)),
pairs AS (SELECT rs.o_orderkey, """ + ", ".join(
    f"rs.{c} AS s_{c}, rt.{c} AS t_{c}" for c, _ in OCOLS) + """ FROM rs JOIN rt ON rs.o_orderkey = rt.o_orderkey),
cells AS (""" + " UNION ALL ".join(
    f"SELECT o_orderkey, '{c}' AS \"column\", {O.display('s_' + c, k)} AS source_value, {O.display('t_' + c, k)} AS target_value "
    f"FROM pairs WHERE NOT {O.values_equal('s_' + c, k, 't_' + c, k)}" for c, k in OCOLS) + """),
unp AS (SELECT o_orderkey, 'MISSING_FROM_TARGET' AS category FROM rs WHERE o_orderkey NOT IN (SELECT o_orderkey FROM rt)
        UNION ALL SELECT o_orderkey, 'EXTRA_IN_TARGET' FROM rt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM rs))
"""


@query("d06_cell_mismatches", _ORDERS_RES + "SELECT * FROM cells")
def d06_cell_mismatches(spark, sf):
    s, t = _orders(spark, sf)
    return compare_rows(s, t).cells


@query("d07_multiset_exact_match", derived.cte("items_src", "items_tgt") + """
SELECT l_orderkey, count(*) AS exact_pairs FROM (SELECT * FROM items_src INTERSECT ALL SELECT * FROM items_tgt) GROUP BY l_orderkey
""")
def d07_multiset_exact_match(spark, sf):
    s, t = _items(spark, sf)
    ks = compare_rows(s, t).key_stats
    return ks.filter(F.col("km") > 0).select("l_orderkey", F.col("km").alias("exact_pairs"))


_ITEM_COLS = ["l_linenumber", "l_partkey", "l_quantity"]
_ITEM_PAIRS = derived.cte("items_src", "items_tgt").replace("WITH", "WITH RECURSIVE", 1) + ", " + O.greedy_ctes("items_src", "items_tgt", "l_orderkey", _ITEM_COLS)


@query("d08_residual_pairing", _ITEM_PAIRS + f"""
SELECT l_orderkey, {", ".join(f"{p}_{c}" for p in "st" for c in _ITEM_COLS)}, CAST(n AS BIGINT) AS copies FROM pairs""")
def d08_residual_pairing(spark, sf):
    s, t = _items(spark, sf)
    return compare_rows(s, t).pairs.drop("_has_s", "_has_t").withColumnRenamed("_n", "copies")


# one key holds a seventh of all rows, and every value is a little off
_HOT = ("SELECT l_linenumber, l_quantity, l_extendedprice{0} AS l_extendedprice, l_discount, l_tax FROM lineitem")
_HOT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("d11_row_summary_hotkey", f"WITH src AS ({_HOT.format('')}), tgt AS ({_HOT.format(' + 0.000000001')}), "
       + O.pairing_ctes("src", "tgt", "l_linenumber", _HOT_COLS) + O.pairing_summary("src", "tgt", _HOT_COLS))
def d11_row_summary_hotkey(spark, sf):
    read_table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return compare_rows(spark.sql(_HOT.format("")), spark.sql(_HOT.format(" + 0.000000001D")), ["l_linenumber"]).summary


_ITEMS_RES = derived.cte("items_src", "items_tgt") + """,
ks AS (SELECT l_orderkey, sum(a) AS ks, sum(b) AS kt FROM (SELECT l_orderkey, 1 AS a, 0 AS b FROM items_src UNION ALL SELECT l_orderkey, 0, 1 FROM items_tgt) GROUP BY l_orderkey),
rs AS (SELECT l_orderkey, count(*) AS n FROM (SELECT * FROM items_src EXCEPT ALL SELECT * FROM items_tgt) GROUP BY l_orderkey),
rt AS (SELECT l_orderkey, count(*) AS n FROM (SELECT * FROM items_tgt EXCEPT ALL SELECT * FROM items_src) GROUP BY l_orderkey),
r AS (SELECT ks.l_orderkey, coalesce(rs.n, 0) AS rs, coalesce(rt.n, 0) AS rt FROM ks LEFT JOIN rs USING (l_orderkey) LEFT JOIN rt USING (l_orderkey)
      WHERE ks.ks > 0 AND ks.kt > 0)
"""


@query("d09_unpaired_duplicates", _ITEMS_RES + """
SELECT l_orderkey, CASE WHEN rs > rt THEN 'MISSING_FROM_TARGET' ELSE 'EXTRA_IN_TARGET' END AS category, abs(rs - rt) AS n_rows
FROM r WHERE rs <> rt
""")
def d09_unpaired_duplicates(spark, sf):
    s, t = _items(spark, sf)
    return compare_rows(s, t).unpaired.groupBy("l_orderkey", "category").agg(F.count("*").alias("n_rows"))


@query("d10_duplicate_keys", derived.cte("orders_src", "orders_tgt") + """,
ks AS (SELECT o_orderkey, sum(a) AS ks, sum(b) AS kt FROM (SELECT o_orderkey, 1 AS a, 0 AS b FROM orders_src UNION ALL SELECT o_orderkey, 0, 1 FROM orders_tgt) GROUP BY o_orderkey)
SELECT o_orderkey, CAST(ks AS BIGINT) AS ks, CAST(kt AS BIGINT) AS kt FROM ks WHERE ks > 0 AND kt > 0 AND (ks > 1 OR kt > 1)
""")
def d10_duplicate_keys(spark, sf):
    s, t = _orders(spark, sf)
    return compare_rows(s, t).duplicate_keys


_SUMMARY_SQL = """
, agg AS (SELECT
  (SELECT count(*) FROM s) AS src_rows, (SELECT count(*) FROM t) AS tgt_rows,
  (SELECT count(*) FROM shared) AS rows_compared,
  (SELECT count(*) FROM (SELECT * FROM s INTERSECT ALL SELECT * FROM t)) + (SELECT count(*) FROM pairs WHERE {clean}) AS rows_matched,
  (SELECT count(*) FROM ks WHERE kt = 0) AS missing_keys, (SELECT count(*) FROM ks WHERE ks = 0) AS extra_keys,
  (SELECT count(*) FROM ks WHERE ks > 0 AND kt > 0 AND (ks > 1 OR kt > 1)) AS duplicate_key_warnings,
  (SELECT count(*) FROM unp) AS unpaired_rows, (SELECT count(*) FROM cells) AS differing_cells,
  (SELECT max(ks) FROM ks) AS mks, (SELECT max(kt) FROM ks) AS mkt)
, m AS (SELECT *, missing_keys + extra_keys + unpaired_rows + differing_cells AS mismatch_count FROM agg)
, o AS (SELECT *, (missing_keys = 0 AND extra_keys = 0 AND src_rows = tgt_rows AND mks <= 1 AND mkt <= 1) AS one_to_one FROM m)
SELECT src_rows, tgt_rows, rows_compared, rows_matched, missing_keys, extra_keys, duplicate_key_warnings, unpaired_rows,
 differing_cells, mismatch_count, one_to_one,
 round(least(1.0, CASE WHEN src_rows = 0 THEN CASE WHEN tgt_rows = 0 THEN 1.0 ELSE 0.0 END
   WHEN one_to_one THEN greatest(0.0, (src_rows - mismatch_count) / src_rows) ELSE rows_matched / src_rows END), 4) AS score,
 CASE WHEN mismatch_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM o
"""

_ORDERS_CLEAN = " AND ".join(O.values_equal("s_" + c, k, "t_" + c, k) for c, k in OCOLS)


@query("d11_row_summary", _ORDERS_RES + _SUMMARY_SQL.format(clean=_ORDERS_CLEAN))
def d11_row_summary(spark, sf):
    s, t = _orders(spark, sf)
    return compare_rows(s, t).summary


@query("d11_row_summary_dupkeys", _ITEM_PAIRS + O.pairing_summary("items_src", "items_tgt", _ITEM_COLS))
def d11_row_summary_dupkeys(spark, sf):
    s, t = _items(spark, sf)
    return compare_rows(s, t).summary


_ROWCHECK_CTES = _ORDERS_RES + _SUMMARY_SQL.format(clean=_ORDERS_CLEAN).replace(
    "SELECT src_rows, tgt_rows, rows_compared, rows_matched, missing_keys, extra_keys, duplicate_key_warnings, unpaired_rows,\n differing_cells, mismatch_count, one_to_one,",
    ", fin AS (SELECT rows_matched, rows_compared, mismatch_count,").replace(
    "CASE WHEN mismatch_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM o",
    "CASE WHEN mismatch_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM o)")
_ROWCHECK_SELECT = """
SELECT 'RowValidator' AS check_name, status, CASE WHEN status = 'PASS' THEN 'INFO' ELSE 'CRITICAL' END AS severity, score,
 CAST(mismatch_count AS BIGINT) AS mismatch_count,
 CASE WHEN status = 'PASS' THEN printf('%d rows agree over %d shared keys', rows_matched, rows_compared)
 ELSE printf('%d rows or cells differ', mismatch_count) END AS summary FROM fin
"""


@query("d12_row_check", _ROWCHECK_CTES + _ROWCHECK_SELECT)
def d12_row_check(spark, sf):
    s, t = _orders(spark, sf)
    return row_check(s, t)


_EV = _ORDERS_RES + """,
pres AS (SELECT o_orderkey, CASE WHEN kt = 0 THEN 0 ELSE 1 END AS cls FROM ks WHERE ks = 0 OR kt = 0),
ev AS (
 SELECT cls, o_orderkey, 0 AS ord, CASE WHEN cls = 0 THEN 'MISSING_TARGET_ROW' ELSE 'MISSING_SOURCE_ROW' END AS type,
   NULL AS "column", NULL AS source_value, NULL AS target_value, CASE WHEN cls = 0 THEN 'MISSING_FROM_TARGET' ELSE 'EXTRA_IN_TARGET' END AS category FROM pres
 UNION ALL SELECT 2, o_orderkey, 1, 'VALUE_MISMATCH', "column", source_value, target_value, 'VALUE_MISMATCH' FROM cells
 UNION ALL SELECT 2, o_orderkey, 0, CASE WHEN category = 'MISSING_FROM_TARGET' THEN 'MISSING_TARGET_ROW' ELSE 'MISSING_SOURCE_ROW' END,
   NULL, NULL, NULL, category FROM unp
 UNION ALL SELECT 3, NULL, 0, 'DUPLICATE_KEY_WARNING', NULL,
   printf('key [''o_orderkey''] repeats in %d groups', n), NULL, 'NON_UNIQUE_KEY_WARNING'
   FROM (SELECT count(*) AS n FROM ks WHERE ks > 0 AND kt > 0 AND (ks > 1 OR kt > 1)) WHERE n > 0)
"""
_EV_KEY = "CASE WHEN cls = 3 THEN CAST(MAP {} AS MAP(VARCHAR, VARCHAR)) ELSE map([ 'o_orderkey' ], [ CAST(o_orderkey AS VARCHAR) ]) END"


@query("d13_top_evidence", _EV + f"""
SELECT type, {_EV_KEY} AS key, "column", source_value, target_value, category,
 (SELECT count(*) FROM ev) AS total_count, (SELECT count(*) > 100 FROM ev) AS truncated
FROM ev ORDER BY cls, o_orderkey NULLS FIRST, ord, "column" NULLS FIRST, source_value NULLS FIRST, target_value NULLS FIRST LIMIT 100
""")
def d13_top_evidence(spark, sf):
    s, t = _orders(spark, sf)
    return compare_rows(s, t).evidence(100)


# every type drifts: whole to text (some no number), broken to decimal,
# time to text, text stays
_DRIFT = """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'none' ELSE CAST(o_custkey AS STRING) END AS o_custkey,
 CAST(CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS DECIMAL(18, 4)) AS o_totalprice,
 CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate FROM orders"""


@query("d06_type_drift", """
SELECT o_orderkey, 'o_custkey' AS "column", CAST(o_custkey AS VARCHAR) AS source_value, 'none' AS target_value FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT o_orderkey, 'o_totalprice', CAST(CAST(o_totalprice AS DECIMAL(38, 9)) AS VARCHAR), CAST(CAST(CAST(o_totalprice * 2 AS DECIMAL(18, 4)) AS DECIMAL(38, 9)) AS VARCHAR) FROM orders WHERE o_orderkey % 89 = 0
UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, NULL FROM orders WHERE o_orderkey % 83 = 0 AND o_orderstatus IS NOT NULL""")
def d06_type_drift(spark, sf):
    orders = read_table(spark, sf, "orders")
    orders.createOrReplaceTempView("orders")
    src = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"))
    return compare_rows(src, spark.sql(_DRIFT)).cells


# ---------------------------------------------------------- D14-D16
_ICOLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


def _stats_sql(tbl: str) -> str:
    parts = [f"SELECT 0 AS ordinal, '*' AS \"column\", 'COUNT' AS function, CAST(count(*) AS DOUBLE) AS value FROM {tbl}"]
    i = 1
    for c in _ICOLS:
        for fn in ("SUM", "AVG", "MIN", "MAX"):
            parts.append(f"SELECT {i}, '{c}', '{fn}', CAST({fn.lower()}({c}) AS DOUBLE) FROM {tbl}")
            i += 1
    return " UNION ALL ".join(parts)


@query("d14_aggregate_stats", derived.cte("items_src") + _stats_sql("items_src"))
def d14_aggregate_stats(spark, sf):
    s, t = _items(spark, sf)
    return aggregate_stats(s, default_specs(s, t))


@query("d16_aggregate_diff", derived.cte("items_src", "items_tgt") + f"""
, a AS ({_stats_sql('items_src')}), b AS ({_stats_sql('items_tgt')})
SELECT a.ordinal, a."column", a.function, a.value AS source_value, b.value AS target_value,
 {O.values_equal('a.value', 'num', 'b.value', 'num')} AS matched FROM a JOIN b ON a.ordinal = b.ordinal
""")
def d16_aggregate_diff(spark, sf):
    s, t = _items(spark, sf)
    return aggregate_diff(s, t)


# ---------------------------------------------------------- D17-D19
_NULLS = "(SELECT " + " + ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c in
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]) + \
    " + count(*) FILTER (WHERE o_totalprice IS NULL OR isnan(o_totalprice)) FROM {t})"


@query("d17_null_count_diff", derived.cte("orders_src", "orders_tgt") + f"""
SELECT {_NULLS.format(t='orders_src')} AS source_nulls, {_NULLS.format(t='orders_tgt')} AS target_nulls,
 {_NULLS.format(t='orders_src')} <> {_NULLS.format(t='orders_tgt')} AS differs
""")
def d17_null_count_diff(spark, sf):
    s, t = _orders(spark, sf)
    return null_count_diff(s, t)


_BVALS = (24.0, 25.0, 26.0)
_BCELLS = " UNION ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, l_orderkey AS key FROM {{t}} WHERE CAST({c} AS DOUBLE) IN (24.0, 25.0, 26.0)"
    for c in _ICOLS)


@query("d18_boundary_keyset_diff", derived.cte("items_src", "items_tgt") + f"""
, s AS ({_BCELLS.format(t='items_src')}), t AS ({_BCELLS.format(t='items_tgt')}),
both_ AS (SELECT DISTINCT "column", value FROM s INTERSECT SELECT DISTINCT "column", value FROM t),
s2 AS (SELECT * FROM s WHERE ("column", value) IN (SELECT ("column", value) FROM both_)),
t2 AS (SELECT * FROM t WHERE ("column", value) IN (SELECT ("column", value) FROM both_)),
so AS (SELECT "column", value, count(*) AS n FROM (SELECT * FROM s2 EXCEPT SELECT * FROM t2) GROUP BY ALL),
tox AS (SELECT "column", value, count(*) AS n FROM (SELECT * FROM t2 EXCEPT SELECT * FROM s2) GROUP BY ALL)
SELECT 'l_orderkey' AS key_column, coalesce(so."column", tox."column") AS "column", coalesce(so.value, tox.value) AS value,
 coalesce(so.n, 0) AS source_only_keys, coalesce(tox.n, 0) AS target_only_keys
FROM so FULL JOIN tox ON so."column" = tox."column" AND so.value = tox.value
""")
def d18_boundary_keyset_diff(spark, sf):
    s, t = _items(spark, sf)
    return boundary_keyset_diff(s, t, ["l_orderkey"], _BVALS)


@query("d19_edge_check", derived.cte("items_src", "items_tgt") + f"""
, s AS ({_BCELLS.format(t='items_src')}), t AS ({_BCELLS.format(t='items_tgt')}),
both_ AS (SELECT DISTINCT "column", value FROM s INTERSECT SELECT DISTINCT "column", value FROM t),
s2 AS (SELECT * FROM s WHERE ("column", value) IN (SELECT ("column", value) FROM both_)),
t2 AS (SELECT * FROM t WHERE ("column", value) IN (SELECT ("column", value) FROM both_)),
bad AS (SELECT DISTINCT "column", value FROM ((SELECT * FROM s2 EXCEPT SELECT * FROM t2) UNION ALL (SELECT * FROM t2 EXCEPT SELECT * FROM s2))),
nn AS (SELECT (SELECT count(*) FILTER (WHERE l_orderkey IS NULL) + count(*) FILTER (WHERE l_linenumber IS NULL) + count(*) FILTER (WHERE l_partkey IS NULL)
   + count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity)) FROM items_src) AS a,
  (SELECT count(*) FILTER (WHERE l_orderkey IS NULL) + count(*) FILTER (WHERE l_linenumber IS NULL) + count(*) FILTER (WHERE l_partkey IS NULL)
   + count(*) FILTER (WHERE l_quantity IS NULL OR isnan(l_quantity)) FROM items_tgt) AS b),
m AS (SELECT CAST(CASE WHEN a <> b THEN 1 ELSE 0 END + (SELECT count(*) FROM bad) AS BIGINT) AS mm FROM nn)
SELECT 'EdgeCaseValidator' AS check_name, CASE WHEN mm = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN mm = 0 THEN 'INFO' ELSE 'HIGH' END AS severity, CAST(CASE WHEN mm = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score, mm AS mismatch_count,
 'EDGE_CASE' AS scenario FROM m""")
def d19_edge_check(spark, sf):
    s, t = _items(spark, sf)
    return edge_check(s, t, ["l_orderkey"], _BVALS)


# --------------------------------------------------------------- D20
@query("d20_report_rollup", derived.cte("checks") + """
SELECT migration_id AS validation_id, count(*) AS checks_run,
 count(*) FILTER (WHERE status = 'PASS') AS checks_passed, count(*) FILTER (WHERE status = 'WARN') AS checks_warned,
 count(*) FILTER (WHERE status = 'FAIL') AS checks_failed, count(*) FILTER (WHERE status = 'ERROR') AS checks_errored,
 CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status = 'ERROR') > 0 THEN 'ERROR'
  WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS overall_status
FROM checks GROUP BY migration_id
""")
def d20_report_rollup(spark, sf):
    c = derived.load(spark, sf, "checks").withColumnRenamed("migration_id", "validation_id")
    return report_rollup(c)


_OCOLS_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_TGC = ("CASE upper(split_part({x}, '(', 1)) WHEN 'VARCHAR' THEN 'STRING' WHEN 'BIGINT' THEN 'INTEGER' "
        "WHEN 'INTEGER' THEN 'INTEGER' WHEN 'DOUBLE' THEN 'FLOAT' ELSE upper({x}) END")
_AGG_ITEMS = [("*", "COUNT")] + [(c, f) for c in ("o_orderkey", "o_custkey", "o_totalprice")
                                 for f in ("SUM", "AVG", "MIN", "MAX")]


def _agg_expr(tbl, c, f):
    if f == "COUNT":
        return f"(SELECT CAST(count(*) AS DOUBLE) FROM {tbl})"
    return f"(SELECT CAST({f.lower()}({c}) AS DOUBLE) FROM {tbl})"


_OB = " UNION ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, o_orderkey AS key FROM {{t}} "
    f"WHERE CAST({c} AS DOUBLE) IN (499.99, 500.0, 500.01)" for c in ("o_orderkey", "o_custkey", "o_totalprice"))
_NUL = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL" + (" OR isnan(o_totalprice))" if c == "o_totalprice" else ")")
                  for c in _OCOLS_ALL)
_TY = ", ".join(f"{{'n': '{c}', 's': (SELECT typeof({c}) FROM orders_src LIMIT 1), "
                f"'t': (SELECT typeof({c}) FROM orders_tgt LIMIT 1)}}" for c in _OCOLS_ALL)
_AM = ", ".join(O.values_equal(_agg_expr("orders_src", c, f), "num", _agg_expr("orders_tgt", c, f), "num")
                for c, f in _AGG_ITEMS)

_D23_SQL = _ROWCHECK_CTES + f""",
rowchk AS ({_ROWCHECK_SELECT}),
ty AS (SELECT unnest([{_TY}]) AS x),
sch AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_TGC.format(x='x.s')} = {_TGC.format(x='x.t')}) AS ok FROM ty),
am AS (SELECT unnest([{_AM}]) AS m),
ag AS (SELECT count(*) AS total, count(*) FILTER (WHERE m) AS ok FROM am),
bs AS ({_OB.format(t='orders_src')}), bt AS ({_OB.format(t='orders_tgt')}),
both_ AS (SELECT DISTINCT "column", value FROM bs INTERSECT SELECT DISTINCT "column", value FROM bt),
bs2 AS (SELECT * FROM bs WHERE ("column", value) IN (SELECT ("column", value) FROM both_)),
bt2 AS (SELECT * FROM bt WHERE ("column", value) IN (SELECT ("column", value) FROM both_)),
bad AS (SELECT DISTINCT "column", value FROM ((SELECT * FROM bs2 EXCEPT SELECT * FROM bt2)
        UNION ALL (SELECT * FROM bt2 EXCEPT SELECT * FROM bs2))),
ed AS (SELECT CAST(CASE WHEN (SELECT {_NUL} FROM orders_src) <> (SELECT {_NUL} FROM orders_tgt) THEN 1 ELSE 0 END
        + (SELECT count(*) FROM bad) AS BIGINT) AS mm)
SELECT 'SchemaValidator' AS check_name, CASE WHEN n = ok THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN n = ok THEN 'INFO' ELSE 'CRITICAL' END AS severity, round(ok / n, 4) AS score,
 CAST(n - ok AS BIGINT) AS mismatch_count, printf('%d of %d columns fit', ok, n) AS summary,
 0 AS check_order FROM sch
UNION ALL SELECT *, 1 FROM rowchk
UNION ALL SELECT 'AggregateValidator', CASE WHEN total = ok THEN 'PASS' ELSE 'FAIL' END,
 CASE WHEN total = ok THEN 'INFO' ELSE 'HIGH' END, round(ok / total, 4), CAST(total - ok AS BIGINT),
 printf('%d aggregates differ', total - ok), 2 FROM ag
UNION ALL SELECT 'BusinessRuleValidator', 'SKIPPED', 'INFO', 1.0, 0, 'no components of both queries to compare', 3
UNION ALL SELECT 'EdgeCaseValidator', CASE WHEN mm = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN mm = 0 THEN 'INFO' ELSE 'HIGH' END,
 CASE WHEN mm = 0 THEN 1.0 ELSE 0.0 END, mm, 'edge cases: EDGE_CASE', 4 FROM ed
"""


@query("d23_validate", _D23_SQL)
def d23_validate(spark, sf):
    s, t = _orders(spark, sf)
    return validate(s, t)


_AGG_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS col, '{f}' AS fn, {_agg_expr('orders_src', c, f)} AS s, {_agg_expr('orders_tgt', c, f)} AS t" for c, f in _AGG_ITEMS)


@query("d23_evidence", _EV + f""",
ag AS ({_AGG_ROWS}), nn AS (SELECT (SELECT {_NUL} FROM orders_src) AS s, (SELECT {_NUL} FROM orders_tgt) AS t),
bs AS ({_OB.format(t='orders_src')}), bt AS ({_OB.format(t='orders_tgt')}),
bk AS (SELECT coalesce(bs."column", bt."column") AS col, coalesce(bs.value, bt.value) AS value, bs.key AS sk, bt.key AS tk
  FROM bs FULL JOIN bt ON bs."column" = bt."column" AND bs.value = bt.value AND bs.key = bt.key),
bd AS (SELECT col, value, count(*) FILTER (WHERE tk IS NULL) AS so, count(*) FILTER (WHERE sk IS NULL) AS tg FROM bk GROUP BY ALL
  HAVING count(sk) > 0 AND count(tk) > 0 AND (so > 0 OR tg > 0))
SELECT 'RowValidator' AS check_name, type, {_EV_KEY} AS key, "column", source_value, target_value, category FROM ev
UNION ALL SELECT 'AggregateValidator', 'AGGREGATE_MISMATCH', CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)), col, printf('%.10e', s), printf('%.10e', t), fn FROM ag WHERE NOT {O.values_equal('s', 'num', 't', 'num')}
UNION ALL SELECT 'EdgeCaseValidator', 'EDGE_CASE_FAILURE', CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)), NULL, CAST(s AS VARCHAR), CAST(t AS VARCHAR), 'NULL_SEMANTICS' FROM nn WHERE s <> t
UNION ALL SELECT 'EdgeCaseValidator', 'EDGE_CASE_FAILURE', map(['o_orderkey'], [printf('%.2f', value)]), col, CAST(so AS VARCHAR), CAST(tg AS VARCHAR), 'BOUNDARY_VALUE' FROM bd""")
def d23_evidence(spark, sf):
    s, t = _orders(spark, sf)
    return evidence(s, t)


_LI_B = _BCELLS.replace("24.0, 25.0, 26.0", "499.99, 500.0, 500.01")
_LI_NULLS = "(SELECT " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL" + (" OR isnan(l_quantity))" if c == "l_quantity" else ")") for c in _ICOLS) + " FROM {t})"
_LI_ITEMS = [("*", "COUNT")] + [(c, f) for c in _ICOLS for f in ("SUM", "AVG", "MIN", "MAX")]
_LI_AM = ", ".join(O.values_equal(_agg_expr("items_src", c, f), "num", _agg_expr("items_tgt", c, f), "num") for c, f in _LI_ITEMS)
_LI_TY = ", ".join(f"{{'s': (SELECT typeof({c}) FROM items_src LIMIT 1), 't': (SELECT typeof({c}) FROM items_tgt LIMIT 1)}}" for c in _ICOLS)
_LI_FIN = O.pairing_summary("items_src", "items_tgt", _ITEM_COLS).replace("SELECT src_rows, tgt_rows, rows_compared, CAST(", ", fin AS (SELECT src_rows, tgt_rows, rows_compared, CAST(") + ")"


@query("d23_validate_lineitem", _ITEM_PAIRS + _LI_FIN + f""",
ty AS (SELECT unnest([{_LI_TY}]) AS x),
sch AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_TGC.format(x='x.s')} = {_TGC.format(x='x.t')}) AS ok FROM ty),
ag AS (SELECT count(*) AS total, count(*) FILTER (WHERE m) AS ok FROM (SELECT unnest([{_LI_AM}]) AS m)),
bs AS ({_LI_B.format(t='items_src')}), bt AS ({_LI_B.format(t='items_tgt')}),
bad AS (SELECT DISTINCT "column", value FROM ((SELECT * FROM bs EXCEPT SELECT * FROM bt) UNION ALL (SELECT * FROM bt EXCEPT SELECT * FROM bs))
  WHERE ("column", value) IN (SELECT ("column", value) FROM bs) AND ("column", value) IN (SELECT ("column", value) FROM bt)),
edge AS (SELECT CAST(CASE WHEN {_LI_NULLS.format(t="items_src")} <> {_LI_NULLS.format(t="items_tgt")} THEN 1 ELSE 0 END + (SELECT count(*) FROM bad) AS BIGINT) AS mm)
SELECT 'SchemaValidator' AS check_name, CASE WHEN n = ok THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN n = ok THEN 'INFO' ELSE 'CRITICAL' END AS severity,
 round(ok / n, 4) AS score, CAST(n - ok AS BIGINT) AS mismatch_count, printf('%d of %d columns fit', ok, n) AS summary, 0 AS check_order FROM sch
UNION ALL SELECT 'RowValidator', status, CASE WHEN status = 'PASS' THEN 'INFO' ELSE 'CRITICAL' END, score, mismatch_count,
 CASE WHEN status = 'PASS' THEN printf('%d rows agree over %d shared keys', rows_matched, rows_compared) ELSE printf('%d rows or cells differ', mismatch_count) END, 1 FROM fin
UNION ALL SELECT 'AggregateValidator', CASE WHEN total = ok THEN 'PASS' ELSE 'FAIL' END, CASE WHEN total = ok THEN 'INFO' ELSE 'HIGH' END, round(ok / total, 4),
 CAST(total - ok AS BIGINT), printf('%d aggregates differ', total - ok), 2 FROM ag
UNION ALL SELECT 'BusinessRuleValidator', 'SKIPPED', 'INFO', 1.0, 0, 'no components of both queries to compare', 3
UNION ALL SELECT 'EdgeCaseValidator', CASE WHEN mm = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN mm = 0 THEN 'INFO' ELSE 'HIGH' END,
 CASE WHEN mm = 0 THEN 1.0 ELSE 0.0 END, mm, 'edge cases: EDGE_CASE', 4 FROM edge""")
def d23_validate_lineitem(spark, sf):
    s, t = _items(spark, sf)
    return validate(s, t)
