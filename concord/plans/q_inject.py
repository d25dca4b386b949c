"""Driver queries for C — fault injection on orders / lineitem / customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inject
from ..session import read_table
from .registry import query

OCOLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _o(spark, sf):
    return read_table(spark, sf, "orders")


def _first(table: str, key: str, n: int, where: str = "TRUE") -> str:
    return (f"f AS (SELECT {key}, row_number() OVER (ORDER BY {key}) AS pos FROM "
            f"(SELECT {key} FROM {table} WHERE {where} ORDER BY {key} LIMIT {n}))")


def _orders_with(col_expr: dict[str, str]) -> str:
    cols = [c.strip() for c in OCOLS.split(",")]
    return ", ".join(col_expr.get(c, f"o.{c}") + (f" AS {c}" if c in col_expr else "") for c in cols)


@query("c01_boundary_triple", "WITH " + _first("orders", "o_orderkey", 3, "o_orderstatus = 'F'") + " SELECT " + _orders_with({
    "o_totalprice": "CASE f.pos WHEN 1 THEN CAST(499.99 AS DOUBLE) WHEN 2 THEN CAST(500.0 AS DOUBLE) WHEN 3 THEN CAST(500.01 AS DOUBLE) ELSE o.o_totalprice END"})
    + " FROM orders o LEFT JOIN f USING (o_orderkey)")
def c01(spark, sf):
    return inject.inject_boundary_triple(_o(spark, sf), "o_totalprice", "o_orderkey", 500.0, 0.01,
                                         F.col("o_orderstatus") == "F")


@query("c02_flood_boundary", "WITH " + _first("orders", "o_orderkey", 3, "o_orderstatus = 'F'") + " SELECT " + _orders_with({
    "o_totalprice": "CASE WHEN f.pos IS NULL AND o.o_orderstatus = 'O' THEN CAST(500.0 AS DOUBLE) ELSE o.o_totalprice END"})
    + " FROM orders o LEFT JOIN f USING (o_orderkey)")
def c02(spark, sf):
    o = _o(spark, sf)
    triple = inject.first_rows(o, "o_orderkey", 3, F.col("o_orderstatus") == "F")
    out, _ = inject.flood_boundary(o, "o_totalprice", "o_orderkey", 500.0, F.col("o_orderstatus") == "O", triple)
    return out


@query("c02_flood_count", "WITH " + _first("orders", "o_orderkey", 3, "o_orderstatus = 'F'")
       + " SELECT count(*) AS boundary_rows FROM orders o LEFT JOIN f USING (o_orderkey) WHERE f.pos IS NULL AND o.o_orderstatus = 'O'")
def c02b(spark, sf):
    o = _o(spark, sf)
    triple = inject.first_rows(o, "o_orderkey", 3, F.col("o_orderstatus") == "F")
    return inject.flood_boundary(o, "o_totalprice", "o_orderkey", 500.0, F.col("o_orderstatus") == "O", triple)[1]


_LCOLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
          "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _items_with(col_expr: dict[str, str]) -> str:
    return ", ".join(col_expr.get(c, f"l.{c}") + (f" AS {c}" if c in col_expr else "") for c in _LCOLS)


_LFIRST = ("f AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS pos FROM "
           "(SELECT l_orderkey, l_linenumber FROM lineitem WHERE {w} ORDER BY l_orderkey, l_linenumber LIMIT {n}))")


@query("c03_null_out", "WITH " + _LFIRST.format(w="l_returnflag = 'R'", n=5) + " SELECT " + _items_with({
    "l_quantity": "CASE WHEN f.pos IS NOT NULL THEN NULL ELSE l.l_quantity END"})
    + " FROM lineitem l LEFT JOIN f USING (l_orderkey, l_linenumber)")
def c03(spark, sf):
    l = read_table(spark, sf, "lineitem")
    return inject.null_out(l, "l_quantity", ["l_orderkey", "l_linenumber"], 5, F.col("l_returnflag") == "R")


@query("c04_null_head", "WITH " + _first("orders", "o_orderkey", 11) + " SELECT " + _orders_with({
    "o_orderpriority": "CASE WHEN f.pos IS NOT NULL THEN NULL ELSE o.o_orderpriority END"})
    + " FROM orders o LEFT JOIN f USING (o_orderkey)")
def c04(spark, sf):
    return inject.null_head(_o(spark, sf), "o_orderpriority", "o_orderkey", 11)


@query("c05_orphan_fk", "WITH " + _first("orders", "o_orderkey", 2) + " SELECT " + _orders_with({
    "o_custkey": "CASE f.pos WHEN 1 THEN CAST(-99999 AS BIGINT) WHEN 2 THEN CAST(-99998 AS BIGINT) ELSE o.o_custkey END"})
    + " FROM orders o LEFT JOIN f USING (o_orderkey)")
def c05(spark, sf):
    return inject.orphan_fk(_o(spark, sf), "o_custkey", "o_orderkey", (-99999, -99998))


@query("c06_null_join_key", "WITH " + _first("orders", "o_orderkey", 2) + " SELECT " + _orders_with({
    "o_custkey": "CASE WHEN f.pos IS NOT NULL THEN NULL ELSE o.o_custkey END"})
    + " FROM orders o LEFT JOIN f USING (o_orderkey)")
def c06(spark, sf):
    return inject.null_join_key(_o(spark, sf), "o_custkey", "o_orderkey", 2)


@query("c07_duplicate_rows", """
SELECT * FROM customer UNION ALL (SELECT * FROM customer ORDER BY c_custkey LIMIT 1)""")
def c07(spark, sf):
    return inject.duplicate_rows(read_table(spark, sf, "customer"), "c_custkey", 1)


@query("c08_force_group", "WITH " + _first("orders", "o_orderkey", 3) + ", g AS (SELECT min(c_custkey) AS gk FROM customer) SELECT " + _orders_with({
    "o_custkey": "CASE WHEN f.pos IS NOT NULL THEN g.gk ELSE o.o_custkey END",
    "o_orderstatus": "CASE WHEN f.pos IS NOT NULL THEN 'R' ELSE o.o_orderstatus END",
    "o_totalprice": "CASE WHEN f.pos IS NOT NULL THEN CAST(150.0 AS DOUBLE) ELSE o.o_totalprice END"})
    + " FROM orders o LEFT JOIN f USING (o_orderkey) CROSS JOIN g")
def c08(spark, sf):
    return inject.force_group_to_first(_o(spark, sf), "o_orderkey", read_table(spark, sf, "customer"),
                                       "c_custkey", "o_custkey", {"o_orderstatus": "R", "o_totalprice": 150.0}, 3)


@query("c09_zero_head", "WITH " + _LFIRST.format(w="TRUE", n=5) + " SELECT " + _items_with({
    "l_extendedprice": "CASE WHEN f.pos IS NOT NULL THEN CAST(0.0 AS DOUBLE) ELSE l.l_extendedprice END"})
    + " FROM lineitem l LEFT JOIN f USING (l_orderkey, l_linenumber)")
def c09(spark, sf):
    return inject.zero_head(read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"], 5)


@query("c10_date_edges", "WITH " + _first("orders", "o_orderkey", 2) + " SELECT " + _orders_with({
    "o_orderdate": "CASE f.pos WHEN 1 THEN TIMESTAMP '2023-01-31 23:59:59' WHEN 2 THEN TIMESTAMP '2023-02-28 00:00:00' ELSE o.o_orderdate END"})
    + " FROM orders o LEFT JOIN f USING (o_orderkey)")
def c10(spark, sf):
    return inject.date_edges(_o(spark, sf), "o_orderdate", "o_orderkey")


@query("c11_sign_edges", """WITH f AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS pos FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 2))
SELECT c.c_custkey, c.c_name, c.c_nationkey,
 CASE f.pos WHEN 1 THEN CAST(-150.75 AS DOUBLE) WHEN 2 THEN CAST(0.0 AS DOUBLE) ELSE c.c_acctbal END AS c_acctbal, c.c_mktsegment
FROM customer c LEFT JOIN f USING (c_custkey)""")
def c11(spark, sf):
    return inject.sign_edges(read_table(spark, sf, "customer"), "c_acctbal", "c_custkey")
