"""Driver queries for E — data quality and profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inject, quality
from ..operators.quality import Rule
from ..session import TABLES, read_table
from . import derived
from .q_sources import COLUMNS
from .registry import query

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")


def _orders_faulty(spark, sf):
    """orders with two orphan customer keys (C5) and two NULL ones."""
    o = read_table(spark, sf, "orders")
    o = inject.orphan_fk(o, "o_custkey", "o_orderkey", (-99999, -99998))
    first4 = inject.first_rows(o, "o_orderkey", 4).filter(F.col("_pos") > 2)
    return (o.join(F.broadcast(first4), "o_orderkey", "left")
            .withColumn("o_custkey", F.when(F.col("_pos").isNotNull(), F.lit(None).cast("bigint"))
                        .otherwise(F.col("o_custkey"))).drop("_pos"))


_FAULTY_SQL = """orders_f AS (SELECT o_orderkey, CASE pos WHEN 1 THEN -99999 WHEN 2 THEN -99998 WHEN 3 THEN NULL WHEN 4 THEN NULL
 ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos
 FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4)) USING (o_orderkey))"""


@query("e01_pk_duplicates", "SELECT l_orderkey, count(*) AS occurrences FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def e01(spark, sf):
    return quality.pk_duplicates(read_table(spark, sf, "lineitem"), "l_orderkey")


@query("e02_fk_orphans", "WITH " + _FAULTY_SQL + """
SELECT DISTINCT o_custkey AS k FROM orders_f WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)""")
def e02(spark, sf):
    return quality.fk_orphan_keys(_orders_faulty(spark, sf), read_table(spark, sf, "customer"), "o_custkey", "c_custkey")


@query("e03_fk_orphans_strict", "WITH " + _FAULTY_SQL + """
SELECT k FROM (SELECT DISTINCT o_custkey AS k FROM orders_f) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey IS NOT DISTINCT FROM k)""")
def e03(spark, sf):
    return quality.fk_orphan_keys(_orders_faulty(spark, sf), read_table(spark, sf, "customer"), "o_custkey",
                                  "c_custkey", strict=True)


@query("e04_cross_table_consistency", derived.cte("orders_src", "orders_tgt") + """
SELECT count(*) AS mismatches FROM (SELECT o_orderkey, o_totalprice FROM orders_tgt WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL) c
JOIN (SELECT o_orderkey, o_totalprice FROM orders_src WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL) p
ON c.o_orderkey = p.o_orderkey WHERE c.o_totalprice <> p.o_totalprice""")
def e04(spark, sf):
    s, t = derived.load(spark, sf, "orders_src"), derived.load(spark, sf, "orders_tgt")
    return quality.consistency_mismatches(t, s, "o_orderkey", "o_totalprice").agg(F.count("*").alias("mismatches"))


@query("e05_allowed_domain", """
SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL
 AND c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')""")
def e05(spark, sf):
    return quality.domain_violations(read_table(spark, sf, "customer"), "c_mktsegment", SEGMENTS)


_E06_RULES = [
    Rule("customer_pk_unique", "pk", "customer", "c_custkey"),
    Rule("orders_pk_unique", "pk", "orders", "o_orderkey"),
    Rule("lineitem_pk_unique", "pk", "lineitem", "l_orderkey"),
    Rule("orders_customer_fk", "fk", "orders", "o_custkey", "customer", "c_custkey"),
    Rule("orders_customer_fk_strict", "fk_strict", "orders", "o_custkey", "customer", "c_custkey"),
    Rule("lineitem_orders_fk", "fk", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    Rule("lineitem_part_fk", "fk", "lineitem", "l_partkey", "part", "p_partkey"),
    Rule("customer_nation_fk", "fk", "customer", "c_nationkey", "nation", "n_nationkey"),
    Rule("customer_allowed_segments", "domain", "customer", "c_mktsegment", allowed=SEGMENTS),
    Rule("support_cases_customer_fk", "fk", "support_cases", "customer_id", "customer", "c_custkey"),
]


@query("e06_integrity_report", "WITH " + _FAULTY_SQL + """
, r AS (
 SELECT 'customer_pk_unique' AS check_name, 'customer' AS table_name, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY c_custkey HAVING count(*) > 1)) AS violations
 UNION ALL SELECT 'orders_pk_unique', 'orders', (SELECT count(*) FROM (SELECT o_orderkey FROM orders_f GROUP BY o_orderkey HAVING count(*) > 1))
 UNION ALL SELECT 'lineitem_pk_unique', 'lineitem', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1))
 UNION ALL SELECT 'orders_customer_fk', 'orders', (SELECT count(DISTINCT o_custkey) FROM orders_f WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
 UNION ALL SELECT 'orders_customer_fk_strict', 'orders', (SELECT count(*) FROM (SELECT DISTINCT o_custkey AS k FROM orders_f) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey IS NOT DISTINCT FROM k))
 UNION ALL SELECT 'lineitem_orders_fk', 'lineitem', (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders_f))
 UNION ALL SELECT 'lineitem_part_fk', 'lineitem', (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
 UNION ALL SELECT 'customer_nation_fk', 'customer', (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))
 UNION ALL SELECT 'customer_allowed_segments', 'customer', (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')))
SELECT check_name, table_name, violations = 0 AS passed, violations FROM r""")
def e06(spark, sf):
    tables = {n: read_table(spark, sf, n) for n in ("customer", "lineitem", "part", "nation")}
    tables["orders"] = _orders_faulty(spark, sf).select("o_orderkey", "o_custkey")
    return quality.integrity_report(tables, _E06_RULES).drop("message")


def _kind(column: str) -> str:
    """num, dbl, str or other, by the driver tables' schemas."""
    if column in ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"):
        return "dbl"
    if column in ("o_orderdate", "l_shipdate", "ts", "embedding"):
        return "other"
    if column.endswith(("key", "_id", "turn", "label", "n_chars", "p_size", "l_linenumber", "quality", "toxic")):
        return "num"
    return "str"


def _profile_sql(table: str) -> str:
    parts = []
    for i, c in enumerate(COLUMNS[table].split()):
        k = _kind(c)
        nul = f"count(*) FILTER (WHERE {c} IS NULL" + (f" OR isnan({c}))" if k == "dbl" else ")")
        mn = f"CAST(min({c}) AS DOUBLE)" if k in ("num", "dbl") else "CAST(NULL AS DOUBLE)"
        mx = f"CAST(max({c}) AS DOUBLE)" if k in ("num", "dbl") else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, {i} AS ordinal, count(*) AS row_count, {nul} AS null_count, "
            f"CASE WHEN count(*) > 0 THEN round({nul} / count(*), 4) ELSE 0.0 END AS null_rate, "
            f"count(DISTINCT {c}) AS distinct_count, {mn} AS min_val, {mx} AS max_val, {k == 'str'} AS is_text FROM {table}")
    return " UNION ALL ".join(parts)


_ALL_PROFILES = " UNION ALL ".join(_profile_sql(t) for t in TABLES)


@query("e07_profile_basic", f"SELECT * EXCLUDE (is_text) FROM ({_ALL_PROFILES})")
def e07(spark, sf):
    return reduce(DataFrame.unionByName, [quality.profile_basic(read_table(spark, sf, t), t) for t in TABLES])


@query("e08_profile_numeric", f"SELECT table_name, column_name, min_val, max_val FROM ({_ALL_PROFILES}) WHERE min_val IS NOT NULL")
def e08(spark, sf):
    return e07(spark, sf).filter(F.col("min_val").isNotNull()).select("table_name", "column_name", "min_val", "max_val")


def _cat_sql(table: str) -> str:
    parts = []
    for c in COLUMNS[table].split():
        if _kind(c) == "str":
            parts.append(
                f"SELECT '{table}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, "
                f"round(count(*) / sum(count(*)) OVER (), 4) AS share FROM {table} WHERE {c} IS NOT NULL "
                f"AND (SELECT count(DISTINCT {c}) FROM {table}) <= 20 GROUP BY {c}")
    return " UNION ALL ".join(parts)


_ALL_SHARES = " UNION ALL ".join(x for x in map(_cat_sql, TABLES) if x)


@query("e09_profile_categorical", _ALL_SHARES)
def e09(spark, sf):
    return reduce(DataFrame.unionByName, [quality.profile_categorical(read_table(spark, sf, t), t) for t in TABLES])


@query("e10_dataset_profile", f"""WITH b AS ({_ALL_PROFILES})
 SELECT table_name, column_name, 'row_count' AS metric, CAST(NULL AS VARCHAR) AS label, CAST(row_count AS DOUBLE) AS value FROM b
 UNION ALL SELECT table_name, column_name, 'null_rate', NULL, CAST(null_rate AS DOUBLE) FROM b
 UNION ALL SELECT table_name, column_name, 'distinct_count', NULL, CAST(distinct_count AS DOUBLE) FROM b
 UNION ALL SELECT table_name, column_name, 'shares_omitted', NULL, CAST(distinct_count AS DOUBLE) FROM b WHERE is_text AND distinct_count > 20
 UNION ALL SELECT table_name, column_name, 'min', NULL, min_val FROM b WHERE min_val IS NOT NULL
 UNION ALL SELECT table_name, column_name, 'max', NULL, max_val FROM b WHERE max_val IS NOT NULL
 UNION ALL SELECT table_name, column_name, 'share', value, share FROM ({_ALL_SHARES})""")
def e10(spark, sf):
    return quality.dataset_profile({t: read_table(spark, sf, t) for t in TABLES})
