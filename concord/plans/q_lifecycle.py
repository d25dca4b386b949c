"""Driver queries for A1, A3–A7, A11, A15 and D22: tables go through files
in the cluster's shared folder and are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.compare.report import compare_pair
from ..operators.compare.rows import key_presence
from ..session import ensure_checkpoint_dir, literal_rows, read_table
from ..sources import audit, capture, catalog, ingest
from .registry import query


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lifecycle-{uuid.uuid4().hex}"


@query("a01_register_views", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def a01(spark, sf):
    catalog.register_views(spark, {"orders_view": f"{sf}/orders.parquet"})
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM orders_view GROUP BY o_orderstatus")


@query("a03_ingest_csv", "SELECT * FROM customer")
def a03(spark, sf):
    customer, folder = read_table(spark, sf, "customer"), _folder(spark)
    path = ingest.export_csv({"customer": customer}, folder)["customer"]
    return ingest.ingest_csv(spark, path, f"{folder}/ingested", schema=customer.schema)


_LISTING = """SELECT doc_id, concat('/in/', source, '/', CASE doc_id % 5 WHEN 0 THEN concat('My File-', CAST(doc_id % 40 AS STRING), '.csv')
 WHEN 1 THEN concat('__', lang, '.b.parquet') WHEN 2 THEN concat('.hidden', CAST(doc_id % 7 AS STRING)) WHEN 3 THEN '---.csv'
 ELSE concat('T', CAST(doc_id AS STRING)) END) AS path FROM documents"""


@query("a04_resolve_table_names", f"""
WITH b AS (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS base FROM ({_LISTING})),
s AS (SELECT path, CASE WHEN regexp_matches(base, '^.+\\.[^.]*$') AND NOT starts_with(base, '.') THEN regexp_extract(base, '^(.*)\\.[^.]*$', 1) ELSE base END AS stem FROM b),
n AS (SELECT path, lower(trim(regexp_replace(regexp_replace(stem, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS name FROM s),
t AS (SELECT path, CASE WHEN name = '' THEN 'table_data' ELSE name END AS table_name FROM n)
SELECT path, table_name, count(*) OVER (PARTITION BY table_name) > 1 AS collision FROM t""")
def a04(spark, sf):
    read_table(spark, sf, "documents").createOrReplaceTempView("documents")
    return ingest.resolve_table_names(spark.sql(_LISTING))


@query("a05_export_parquet", "SELECT * FROM part")
def a05(spark, sf):
    return spark.read.parquet(ingest.export_parquet({"part": read_table(spark, sf, "part")}, _folder(spark))["part"])


@query("a06_export_csv", "SELECT * FROM supplier")
def a06(spark, sf):
    supplier = read_table(spark, sf, "supplier")
    path = ingest.export_csv({"supplier": supplier}, _folder(spark))["supplier"]
    return spark.read.option("header", True).schema(supplier.schema).csv(path)


@query("a07_capture_result", """
SELECT 'orders' AS execution_id, (SELECT count(*) FROM orders) AS row_count, 6 AS column_count, (SELECT least(500, count(*)) FROM orders) AS sample_rows""")
def a07(spark, sf):
    c = capture.capture_result(read_table(spark, sf, "orders"), "orders", _folder(spark))
    return literal_rows(spark, [(c.execution_id, c.row_count, len(c.columns), c.sample.count())],
                        "execution_id string, row_count long, column_count int, sample_rows long")


_DATASETS = "SELECT DISTINCT source AS dataset_id, concat('Set ', upper(lang)) AS display_name, lang AS tag FROM documents"


@query("a11_catalog_search", f"""
SELECT dataset_id, display_name, tag FROM ({_DATASETS}) WHERE contains(lower(display_name), 'e') AND (contains(lower(display_name), 'de') OR contains(lower(dataset_id), 'de') OR contains(lower(tag), 'de'))""")
def a11(spark, sf):
    read_table(spark, sf, "documents").createOrReplaceTempView("documents")
    d = spark.sql(_DATASETS).withColumn("tags", F.array("tag"))
    return catalog.catalog_search(d, " De ").drop("tags")


@query("a15_audit_log", "SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderdate AS created_at, 'validation' AS kind FROM orders")
def a15(spark, sf):
    root, orders = _folder(spark), read_table(spark, sf, "orders")
    audit.append_audit(orders.limit(0), root, "check", "o_orderkey", "o_orderdate")
    audit.append_audit(orders, root, "validation", "o_orderkey", "o_orderdate")
    audit.append_audit(orders, root, "event", "o_custkey", "o_orderdate")
    return audit.get_audit(spark, root, "validation").select("record_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "kind")


# whole tables; the second query lost customers whose orders are all open
_PAIR = ("SELECT o_custkey, count(*) AS n FROM {t} GROUP BY o_custkey",
         "SELECT o_custkey, count(*) AS n FROM {t} GROUP BY o_custkey HAVING min(o_orderstatus) <> 'O'")


@query("d22_compare_pair", f"""
SELECT coalesce(s.o_custkey, t.o_custkey) AS o_custkey, CASE WHEN t.o_custkey IS NULL THEN 'MISSING_FROM_TARGET' ELSE 'EXTRA_IN_TARGET' END AS presence
FROM ({_PAIR[0].format(t='orders')}) s FULL JOIN ({_PAIR[1].format(t='orders')}) t ON s.o_custkey = t.o_custkey WHERE s.o_custkey IS NULL OR t.o_custkey IS NULL""")
def d22(spark, sf):
    s, t = compare_pair(spark, *[q.format(t="orders_pair") for q in _PAIR], {"orders_pair": f"{sf}/orders.parquet"})
    return key_presence(s, t, ["o_custkey"])

