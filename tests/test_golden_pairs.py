"""The eleven golden query pairs on the formula-defined tables (A14):
EXCEPT ALL counts, missing/extra keys and the expected row-check status."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from concord.operators.compare import compare_rows
from range_tables import range_tables


def _pairs(spark):
    js = range_tables(spark, "join_semantics", register=False)
    p, s = js["primary_entity"], js["secondary_entity"]
    cr = range_tables(spark, "customer_risk", register=False)
    tx, acct = cr["transactions"], cr["accounts"]
    ns = range_tables(spark, "null_semantics", register=False)["product_catalog"]
    em = range_tables(spark, "enterprise_metrics", register=False)["enterprise_metrics"]
    ps = p.join(s, "ref_code", "left")
    pi = p.join(s, "ref_code", "inner")
    w = Window.partitionBy("customer_id").orderBy(F.desc("balance"))
    done = F.col("status") == "COMPLETED"
    return {
        "count_distinct_loss": (ps.groupBy("ref_code").agg(F.count_distinct(p.entity_id).alias("entity_count")),
                                ps.groupBy("ref_code").agg(F.count(p.entity_id).alias("entity_count"))),
        "join_drift": (ps.groupBy("ref_code").agg(F.count("detail_id").alias("detail_count")),
                       pi.groupBy("ref_code").agg(F.count("detail_id").alias("detail_count"))),
        "conditional_aggregation": (
            em.groupBy("department").agg(F.sum(F.when(F.col("gate_status") == "PASS", F.col("score")).otherwise(0))
                                         .alias("passing_score")),
            em.groupBy("department").agg(F.sum("score").alias("passing_score"))),
        "filter_removal": (tx.filter(done).groupBy("customer_id").agg(F.sum("amount").alias("total_completed")),
                           tx.groupBy("customer_id").agg(F.sum("amount").alias("total_completed"))),
        "null_handling": (ns.select("product_id", F.coalesce("list_price", F.lit(0.0)).alias("price")),
                          ns.select("product_id", F.col("list_price").alias("price"))),
        "window_function": (acct.select("account_id", F.rank().over(w).alias("rnk")),
                            acct.select("account_id", F.row_number().over(w.orderBy(F.desc("balance"), "account_id"))
                                        .alias("rnk"))),
        "boundary_condition": (
            tx.select("transaction_id", F.when(F.col("amount") > 500.0, "HIGH").otherwise("LOW").alias("risk_level")),
            tx.select("transaction_id", F.when(F.col("amount") >= 500.0, "HIGH").otherwise("LOW").alias("risk_level"))),
        "unauthorized_join_change": (ps.groupBy("ref_code").agg(F.sum(p.base_val).alias("total_base")),
                                     pi.groupBy("ref_code").agg(F.sum(p.base_val).alias("total_base"))),
        "unauthorized_where_change": (tx.filter(done).groupBy("customer_id").agg(F.sum("amount").alias("total")),
                                      tx.groupBy("customer_id").agg(F.sum("amount").alias("total"))),
        "unrelated_projection_change": (ns.select("product_id", "list_price", "status"),
                                        ns.select("product_id", (F.col("list_price") * 10).alias("list_price"), "status")),
        "already_correct_query": (tx.groupBy("customer_id").agg(F.sum("amount").alias("total")),
                                  tx.groupBy("customer_id").agg(F.sum("amount").alias("total"))),
    }


# pair: (rows S, rows T, missing keys, extra keys, S-T, T-S, status)
EXPECTED = {
    "count_distinct_loss": (50, 50, 0, 0, 40, 40, "FAIL"),
    "join_drift": (50, 40, 10, 0, 10, 0, "FAIL"),
    "conditional_aggregation": (8, 8, 0, 0, 4, 4, "FAIL"),
    "filter_removal": (4000, 5000, 0, 1000, 0, 1000, "FAIL"),
    "null_handling": (3000, 3000, 0, 0, 1000, 1000, "FAIL"),
    "window_function": (10000, 10000, 0, 0, 5000, 5000, "FAIL"),
    "boundary_condition": (10000, 10000, 0, 0, 5000, 5000, "FAIL"),
    "unauthorized_join_change": (50, 40, 10, 0, 10, 0, "FAIL"),
    "unauthorized_where_change": (4000, 5000, 0, 1000, 0, 1000, "FAIL"),
    "unrelated_projection_change": (3000, 3000, 0, 0, 2000, 2000, "FAIL"),
    "already_correct_query": (5000, 5000, 0, 0, 0, 0, "PASS"),
}


@pytest.fixture(scope="module")
def pairs(spark):
    return _pairs(spark)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_golden_pair(spark, pairs, name):
    s, t = pairs[name]
    rs, rt, miss, extra, s_t, t_s, status = EXPECTED[name]
    assert s.count() == rs and t.count() == rt
    assert s.exceptAll(t).count() == s_t and t.exceptAll(s).count() == t_s
    out = compare_rows(s, t).summary.collect()[0]
    assert (out.missing_keys, out.extra_keys) == (miss, extra)
    assert out.status == status
