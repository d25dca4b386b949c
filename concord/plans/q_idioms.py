"""Driver queries for B — the query idioms of the corpus on the driver
tables (customers -> customer, accounts/transactions -> orders/lineitem)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import read_table
from . import idioms
from .registry import query


def T(spark, sf, name):
    return read_table(spark, sf, name)


@query("b01_filter_project_sort", """
SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC""")
def b01(spark, sf):
    c = T(spark, sf, "customer")
    return (c.filter(F.col("c_mktsegment") == "BUILDING")
            .select("c_custkey", "c_name", "c_mktsegment", "c_acctbal").orderBy(F.desc("c_acctbal")))


@query("b02_inner_join_filter", """
SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_orderstatus, o.o_totalprice
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'O'""")
def b02(spark, sf):
    c, o = T(spark, sf, "customer"), T(spark, sf, "orders")
    return (c.join(o.filter(F.col("o_orderstatus") == "O"), c.c_custkey == o.o_custkey)
            .select("c_custkey", "c_name", "o_orderkey", "o_orderstatus", "o_totalprice"))


@query("b03_inner_then_left_join", """
SELECT c.c_custkey, o.o_orderkey, l.l_linenumber, l.l_quantity
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
WHERE o.o_orderstatus = 'F'""")
def b03(spark, sf):
    c, o, l = T(spark, sf, "customer"), T(spark, sf, "orders"), T(spark, sf, "lineitem")
    co = c.join(o.filter(F.col("o_orderstatus") == "F"), c.c_custkey == o.o_custkey)
    return (co.join(l, co.o_orderkey == l.l_orderkey, "left")
            .select("c_custkey", "o_orderkey", "l_linenumber", "l_quantity"))


@query("b04_group_aggregates", """
SELECT o_orderpriority, count(*) AS total_orders, round(sum(o_totalprice), 2) AS total_price,
 round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY o_orderpriority""")
def b04(spark, sf):
    o = T(spark, sf, "orders")
    return o.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("total_orders"), F.round(F.sum("o_totalprice"), 2).alias("total_price"),
        F.round(F.avg("o_totalprice"), 2).alias("avg_price"))


@query("b05_count_col_vs_star", """
SELECT c.c_custkey, count(o.o_orderkey) AS order_count, count(*) AS row_count,
 round(sum(o.o_totalprice), 2) AS total_spent,
 CAST(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(NULLIF(100 * count(o.o_totalprice), 0) AS DOUBLE) AS avg_spent,
 max(o.o_totalprice) AS max_spent
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""")
def b05(spark, sf):
    c, o = T(spark, sf, "customer"), T(spark, sf, "orders")
    return (c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey")
            .agg(F.count("o_orderkey").alias("order_count"), F.count(F.lit(1)).alias("row_count"),
                 F.round(F.sum("o_totalprice"), 2).alias("total_spent"),
                 # average of cents: exact integer sum, one division
                 F.try_divide(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double"),
                              (F.count("o_totalprice") * 100).cast("double")).alias("avg_spent"),
                 F.max("o_totalprice").alias("max_spent")))


@query("b06_case_tiering", """
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_extendedprice >= 50000 THEN 'PLATINUM'
 WHEN l_extendedprice >= 20000 THEN 'GOLD' WHEN l_extendedprice > 0 THEN 'SILVER' ELSE 'ZERO' END AS tier FROM lineitem""")
def b06(spark, sf):
    l = T(spark, sf, "lineitem")
    p = F.col("l_extendedprice")
    return l.select("l_orderkey", "l_linenumber", "l_extendedprice",
                    idioms.tier(p, [(p >= 50000, "PLATINUM"), (p >= 20000, "GOLD"), (p > 0, "SILVER")],
                                "ZERO").alias("tier"))


_B07 = """
SELECT c.c_custkey, c.c_mktsegment, round(sum(o.o_totalprice), 2) AS total_amount,
 CASE WHEN o.o_totalprice > 150000 THEN 'HIGH_RISK' ELSE 'NORMAL' END AS risk_class
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F'
GROUP BY c.c_custkey, c.c_mktsegment, o.o_totalprice"""


@query("b07_flagship_join_group_case", _B07)
def b07(spark, sf):
    c, o = T(spark, sf, "customer"), T(spark, sf, "orders")
    j = o.filter(F.col("o_orderstatus") == "F").join(c, o.o_custkey == c.c_custkey)
    return (j.groupBy("c_custkey", "c_mktsegment", "o_totalprice")
            .agg(F.round(F.sum("o_totalprice"), 2).alias("total_amount"))
            .select("c_custkey", "c_mktsegment", "total_amount",
                    F.when(F.col("o_totalprice") > 150000, F.lit("HIGH_RISK")).otherwise(F.lit("NORMAL"))
                    .alias("risk_class")))


@query("b08_case_over_aggregate", """
SELECT c.c_custkey, c.c_mktsegment, round(sum(o.o_totalprice), 2) AS total_amount,
 CASE WHEN sum(o.o_totalprice) > 1500000.00 THEN 'HIGH_RISK' ELSE 'NORMAL' END AS risk_class
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_custkey, c.c_mktsegment""")
def b08(spark, sf):
    c, o = T(spark, sf, "customer"), T(spark, sf, "orders")
    j = c.join(o.filter(F.col("o_orderstatus") == "F"), c.c_custkey == o.o_custkey)
    g = j.groupBy("c_custkey", "c_mktsegment").agg(F.sum("o_totalprice").alias("_s"))
    return g.select("c_custkey", "c_mktsegment", F.round("_s", 2).alias("total_amount"),
                    F.when(F.col("_s") > 1500000.0, F.lit("HIGH_RISK")).otherwise(F.lit("NORMAL"))
                    .alias("risk_class"))


@query("b09_null_handling", """
SELECT c.c_custkey, coalesce(o.o_orderstatus, 'NO_ORDER') AS order_ref, coalesce(o.o_totalprice, 0) AS safe_amount,
 o.o_orderkey IS NULL AS no_order
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey""")
def b09(spark, sf):
    c, o = T(spark, sf, "customer"), T(spark, sf, "orders")
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    return j.select("c_custkey", F.coalesce("o_orderstatus", F.lit("NO_ORDER")).alias("order_ref"),
                    F.zeroifnull("o_totalprice").alias("safe_amount"),
                    F.col("o_orderkey").isNull().alias("no_order"))


@query("b10_date_parts_range", """
SELECT o_orderkey, o_orderdate, CAST(extract(year FROM o_orderdate) AS INTEGER) AS tx_year,
 CAST(extract(month FROM o_orderdate) AS INTEGER) AS tx_month, CAST(extract(day FROM o_orderdate) AS INTEGER) AS tx_day,
 CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start
FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' ORDER BY o_orderdate""")
def b10(spark, sf):
    o = T(spark, sf, "orders")
    d = F.col("o_orderdate")
    return (o.filter((d >= F.lit("1995-01-01").cast("timestamp_ntz")) & (d < F.lit("1996-01-01").cast("timestamp_ntz")))
            .select("o_orderkey", "o_orderdate", F.year(d).alias("tx_year"), F.month(d).alias("tx_month"),
                    F.dayofmonth(d).alias("tx_day"),
                    F.date_trunc("month", d).cast("timestamp_ntz").alias("month_start"))
            .orderBy("o_orderdate"))


@query("b11_row_number", """
SELECT o_custkey, o_orderkey, o_totalprice,
 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank_num FROM orders""")
def b11(spark, sf):
    o = T(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rank_num"))


@query("b12_rank_vs_row_number", """
SELECT l_orderkey, l_linenumber, l_quantity,
 CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS INTEGER) AS rnk,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS INTEGER) AS rn FROM lineitem""")
def b12(spark, sf):
    l = T(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"))
    w2 = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    return l.select("l_orderkey", "l_linenumber", "l_quantity", F.rank().over(w).alias("rnk"),
                    F.row_number().over(w2).alias("rn"))


@query("b13_qualify_first_row", """
SELECT o_custkey, o_orderkey, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def b13(spark, sf):
    o = T(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return idioms.first_per_group(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("b14_top_n", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def b14(spark, sf):
    o = T(spark, sf, "orders")
    return o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("b15_keep_dense_rank", """
WITH last_d AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY o_custkey),
first_d AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY o_custkey),
a AS (SELECT o.o_custkey, max(o.o_totalprice) AS last_max_price FROM orders o JOIN last_d USING (o_custkey) WHERE o.o_orderdate = last_d.d GROUP BY o.o_custkey),
b AS (SELECT o.o_custkey, max(o.o_orderpriority) AS first_max_priority FROM orders o JOIN first_d USING (o_custkey) WHERE o.o_orderdate = first_d.d GROUP BY o.o_custkey)
SELECT a.o_custkey, a.last_max_price, b.first_max_priority FROM a JOIN b USING (o_custkey)""")
def b15(spark, sf):
    o = T(spark, sf, "orders")
    a = idioms.keep_dense_rank(o, ["o_custkey"], "MAX", "o_totalprice", "o_orderdate", "LAST",
                               alias="last_max_price")
    b = idioms.keep_dense_rank(o, ["o_custkey"], "MAX", "o_orderpriority", "o_orderdate", "FIRST",
                               alias="first_max_priority")
    return a.join(b, "o_custkey")


@query("b16_array_agg_limit1", """
SELECT l_orderkey, max({'o': l_quantity, 'v': l_partkey}).v AS top_partkey FROM lineitem GROUP BY l_orderkey""")
def b16(spark, sf):
    l = T(spark, sf, "lineitem")
    return idioms.arg_extreme(l, ["l_orderkey"], "l_partkey", "l_quantity", True, alias="top_partkey")


@query("b17_array_agg", """
SELECT o_custkey, list_sort(list(o_orderkey)) AS order_keys FROM orders GROUP BY o_custkey""")
def b17(spark, sf):
    o = T(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("order_keys"))


@query("b18_conditional_aggregation", """
SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS pass_count,
 CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS BIGINT) AS fail_count, round(avg(o_totalprice), 2) AS avg_price,
 min(o_totalprice) AS min_price, max(o_totalprice) AS max_price FROM orders GROUP BY o_orderpriority""")
def b18(spark, sf):
    o = T(spark, sf, "orders")
    f = F.col("o_orderstatus") == "F"
    return o.groupBy("o_orderpriority").agg(
        F.sum(F.when(f, 1).otherwise(0)).cast("long").alias("pass_count"),
        F.sum(F.when(~f, 1).otherwise(0)).cast("long").alias("fail_count"),
        F.round(F.avg("o_totalprice"), 2).alias("avg_price"),
        F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"))


@query("b19_count_distinct_fanout", """
SELECT c.c_custkey, count(DISTINCT o.o_orderkey) AS distinct_orders, count(o.o_orderkey) AS fanout_rows
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY c.c_custkey""")
def b19(spark, sf):
    c, o, l = T(spark, sf, "customer"), T(spark, sf, "orders"), T(spark, sf, "lineitem")
    j = c.join(o, c.c_custkey == o.o_custkey, "left").join(l, F.col("o_orderkey") == l.l_orderkey, "left")
    return j.groupBy("c_custkey").agg(F.count_distinct("o_orderkey").alias("distinct_orders"),
                                      F.count("o_orderkey").alias("fanout_rows"))


@query("b20_sum_distinct", """
SELECT o_orderpriority, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS sum_distinct_cust, CAST(sum(o_custkey) AS BIGINT) AS sum_cust
FROM orders GROUP BY o_orderpriority""")
def b20(spark, sf):
    o = T(spark, sf, "orders")
    return o.groupBy("o_orderpriority").agg(F.sum_distinct("o_custkey").alias("sum_distinct_cust"),
                                            F.sum("o_custkey").alias("sum_cust"))


@query("b21_match_cardinality", """
SELECT c.c_custkey, count(o.o_orderkey) AS match_count,
 CASE WHEN count(o.o_orderkey) = 0 THEN 'NO_MATCH' WHEN count(o.o_orderkey) = 1 THEN 'SINGLE_MATCH' ELSE 'MULTI_ENTITY' END AS match_type
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey ORDER BY match_type NULLS FIRST""")
def b21(spark, sf):
    c, o = T(spark, sf, "customer"), T(spark, sf, "orders")
    return idioms.match_cardinality(c, o, "c_custkey", "o_custkey").orderBy(F.asc_nulls_first("match_type"))


@query("b22_having", """
SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 10""")
def b22(spark, sf):
    o = T(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")).filter(F.col("n_orders") > 10)


@query("b23_to_char_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders""")
def b23(spark, sf):
    o = T(spark, sf, "orders")
    return o.select("o_orderkey", idioms.to_char_date(F.col("o_orderdate")).alias("order_day"))


@query("b24_union_distinct", """
SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_nationkey < 5""")
def b24(spark, sf):
    o, c = T(spark, sf, "orders"), T(spark, sf, "customer")
    a = o.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("custkey"))
    b = c.filter(F.col("c_nationkey") < 5).select(F.col("c_custkey").alias("custkey"))
    return a.union(b).distinct()


@query("b24_union_all", """
SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey < 5""")
def b24b(spark, sf):
    o, c = T(spark, sf, "orders"), T(spark, sf, "customer")
    a = o.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("custkey"))
    b = c.filter(F.col("c_nationkey") < 5).select(F.col("c_custkey").alias("custkey"))
    return a.union(b)


@query("b25_bare_table_name", """
SELECT c.c_custkey, lower(r.r_name) || '.' || lower(n.n_name) || '.' || c.c_mktsegment AS qualified_name,
 regexp_extract(lower(r.r_name) || '.' || lower(n.n_name) || '.' || c.c_mktsegment, '([^.]+)$', 1) AS table_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def b25(spark, sf):
    c, n, r = T(spark, sf, "customer"), T(spark, sf, "nation"), T(spark, sf, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    q = F.concat_ws(".", F.lower("r_name"), F.lower("n_name"), F.col("c_mktsegment"))
    return j.select("c_custkey", q.alias("qualified_name"), idioms.bare_name(q).alias("table_name"))
