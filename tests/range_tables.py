"""A14 — formula-defined tables over ``range(1, n+1)`` (no randomness).

These are the small named datasets the reference ships for its golden
query pairs; here they are plain ``spark.range`` projections, so any size
can be generated on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _i():
    return F.col("id")


def customer_risk(spark: SparkSession, customers: int = 5000, accounts: int = 10000,
                  transactions: int = 10000, cases: int = 1000) -> dict[str, DataFrame]:
    i = _i()
    cust = spark.range(1, customers + 1).select(
        i.alias("customer_id"), F.concat(F.lit("First_"), i.cast("string")).alias("first_name"),
        F.concat(F.lit("Last_"), i.cast("string")).alias("last_name"),
        F.date_add(F.lit("1970-01-01").cast("date"), (i % 15000).cast("int")).alias("date_of_birth"),
        F.when(i % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("gender"),
        F.concat(F.lit("user"), i.cast("string"), F.lit("@example.com")).alias("email"),
        F.lpad(i.cast("string"), 10, "0").alias("phone"),
        F.concat(F.lit("City_"), (i % 50).cast("string")).alias("city"),
        F.concat(F.lit("State_"), (i % 10).cast("string")).alias("state"), F.lit("US").alias("country"),
        F.concat(F.lit("SEG_"), (i % 5).cast("string")).alias("customer_segment"),
        F.date_add(F.lit("2020-01-01").cast("date"), (i % 1000).cast("int")).alias("customer_since"),
        (F.lit(50000.0) + (i % 100) * 1000.0).alias("annual_income"), (F.lit(600) + i % 200).alias("credit_score"),
        F.when(i % 3 == 0, "HIGH").when(i % 3 == 1, "MEDIUM").otherwise("LOW").alias("risk_tier"),
        F.when(i % 10 == 0, "INACTIVE").otherwise("ACTIVE").alias("status"))
    acct = spark.range(1, accounts + 1).select(
        i.alias("account_id"), ((i % customers) + 1).alias("customer_id"), ((i % 100) * 15.5).alias("balance"),
        F.when(i % 4 == 0, "CHECKING").when(i % 4 == 1, "SAVINGS").when(i % 4 == 2, "CREDIT")
        .otherwise("INVESTMENT").alias("account_type"), F.lit("ACTIVE").alias("status"))
    tx = spark.range(1, transactions + 1).select(
        i.alias("transaction_id"), ((i % customers) + 1).alias("customer_id"),
        ((i % accounts) + 1).alias("account_id"),
        F.when(i % 2 == 0, F.lit(500.0)).otherwise((i % 1000) * 1.5).alias("amount"),
        F.when(i % 5 == 0, "PENDING").otherwise("COMPLETED").alias("status"))
    sc = spark.range(1, cases + 1).select(i.alias("case_id"), ((i % customers) + 1).alias("customer_id"),
                                          F.lit("OPEN").alias("status"))
    return {"customers": cust, "accounts": acct, "transactions": tx, "support_cases": sc}


def customer_aggregation(spark: SparkSession, regions: int = 100, sales: int = 5000) -> dict[str, DataFrame]:
    i = _i()
    return {
        "sales_region": spark.range(1, regions + 1).select(
            i.alias("region_id"), F.concat(F.lit("Region_"), i.cast("string")).alias("region_name")),
        "monthly_sales": spark.range(1, sales + 1).select(
            i.alias("sale_id"), ((i % 10) + 1).alias("region_id"), (i * 25.0).alias("revenue"),
            ((i % 12) + 1).alias("sale_month"), F.lit(2026).alias("sale_year")),
    }


def null_semantics(spark: SparkSession, n: int = 3000) -> dict[str, DataFrame]:
    i = _i()
    return {
        "product_catalog": spark.range(1, n + 1).select(
            i.alias("product_id"), F.concat(F.lit("Product_"), i.cast("string")).alias("product_name"),
            F.when(i % 3 == 0, F.lit(None).cast("double")).otherwise(i * 10.0).alias("list_price"),
            F.when(i % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("Active")).alias("status")),
        "inventory_levels": spark.range(1, n + 1).select(
            i.alias("item_id"), ((i % n) + 1).alias("product_id"),
            F.when(i % 4 == 0, F.lit(None).cast("long")).otherwise(i % 50).alias("stock_qty")),
    }


def join_semantics(spark: SparkSession, primary: int = 2000, secondary: int = 4000) -> dict[str, DataFrame]:
    i = _i()
    return {
        "primary_entity": spark.range(1, primary + 1).select(
            i.alias("entity_id"), F.concat(F.lit("Code_"), (i % 50).cast("string")).alias("ref_code"),
            (i * 100).alias("base_val")),
        "secondary_entity": spark.range(1, secondary + 1).select(
            i.alias("detail_id"), ((i % 1500) + 1).alias("entity_id"),
            F.concat(F.lit("Code_"), (i % 40).cast("string")).alias("ref_code"),
            ((i % 10) * 5.5).alias("secondary_val")),
    }


def date_semantics(spark: SparkSession, n: int = 4000) -> dict[str, DataFrame]:
    i = _i()
    return {"event_logs": spark.range(1, n + 1).select(
        i.alias("event_id"), F.date_add(F.lit("2026-01-01").cast("date"), (i % 365).cast("int")).alias("event_date"),
        (F.lit("2026-01-01 08:00:00").cast("timestamp") + F.make_interval(secs=(i % 86400).cast("int")))
        .alias("event_time"), (i % 100).alias("user_id"))}


def enterprise_metrics(spark: SparkSession, n: int = 5000) -> dict[str, DataFrame]:
    i = _i()
    return {"enterprise_metrics": spark.range(1, n + 1).select(
        i.alias("metric_id"), F.concat(F.lit("Dept_"), (i % 8).cast("string")).alias("department"),
        (i * 12.5).alias("score"), F.when(i % 2 == 0, "PASS").otherwise("FAIL").alias("gate_status"))}


DATASETS = {
    "customer_risk": customer_risk,
    "customer_aggregation": customer_aggregation,
    "null_semantics": null_semantics,
    "join_semantics": join_semantics,
    "date_semantics": date_semantics,
    "mixed_business_logic": enterprise_metrics,
    "enterprise_metrics": enterprise_metrics,
}


def range_tables(spark: SparkSession, dataset: str, register: bool = True) -> dict[str, DataFrame]:
    tables = DATASETS[dataset](spark)
    if register:
        for k, v in tables.items():
            v.createOrReplaceTempView(k)
    return tables
