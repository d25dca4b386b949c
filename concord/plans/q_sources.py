"""Driver queries for A — catalog, preview and checksums over the driver
tables themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import normalize_type
from ..session import TABLES, read_table
from ..sources import catalog, checksum
from .registry import query


_TG = ("CASE upper(split_part(data_type, '(', 1)) WHEN 'VARCHAR' THEN 'STRING' WHEN 'BIGINT' THEN 'INTEGER' "
       "WHEN 'INTEGER' THEN 'INTEGER' WHEN 'DOUBLE' THEN 'FLOAT' WHEN 'FLOAT' THEN 'FLOAT' WHEN 'TIMESTAMP' THEN 'TIMESTAMP' "
       "WHEN 'FLOAT[]' THEN 'ARRAY<FLOAT>' WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'DATE' THEN 'DATE' ELSE upper(data_type) END")


def _counts_sql(tables) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in tables)


@query("a08_describe_table", f"""
SELECT c.table_name, c.column_name AS name, {_TG} AS type_group, c.is_nullable = 'YES' AS nullable, CAST(c.ordinal_position AS INTEGER) AS ordinal, n.row_count
FROM information_schema.columns c JOIN ({_counts_sql(TABLES)}) n ON c.table_name = n.table_name
WHERE c.table_name IN ({', '.join(repr(t) for t in TABLES)})""")
def a08(spark, sf):
    parts = [catalog.describe_with_count(read_table(spark, sf, t), t) for t in TABLES]
    d = reduce(DataFrame.unionByName, parts)
    return d.select("table_name", "name", normalize_type(F.col("type")).alias("type_group"), "nullable", "ordinal",
                    "row_count")


@query("a09_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def a09(spark, sf):
    tables = {t: read_table(spark, sf, t) for t in ("orders", "lineitem")}
    return catalog.preview(tables, "ORDERS", limit=1000, order_by=["o_orderkey"])


# three data sets; one has no display name, one neither tags nor hash
DATASETS = {"sales": TABLES[:7], "stream": ("events",), "corpus": TABLES[8:]}
_MANIFEST = " UNION ALL ".join(f"SELECT '{d}' AS dataset_id, * FROM ({_counts_sql(t)})" for d, t in DATASETS.items())


@query("a10_catalog_summary", f"""WITH m AS ({_MANIFEST})
SELECT dataset_id, CASE WHEN dataset_id = 'corpus' THEN dataset_id ELSE upper(dataset_id) END AS display_name, CAST(sum(row_count) AS BIGINT) AS total_rows,
 count(DISTINCT table_name) AS table_count, CASE WHEN dataset_id = 'stream' THEN CAST([] AS VARCHAR[]) ELSE list_sort(list(table_name)) END AS tags,
 CASE WHEN dataset_id = 'stream' THEN '' ELSE sha256(string_agg(table_name || ':' || row_count, ',' ORDER BY table_name)) END AS dataset_hash FROM m GROUP BY dataset_id""")
def a10(spark, sf):
    parts = [catalog.table_manifest({t: read_table(spark, sf, t) for t in names}, d) for d, names in DATASETS.items()]
    m = reduce(DataFrame.unionByName, parts)
    known = F.col("dataset_id") != "stream"
    about = m.groupBy("dataset_id").agg(
        F.array_sort(F.collect_set("table_name")).alias("tags"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "table_name", F.col("row_count").cast("string")))), ","), 256).alias("dataset_hash"))
    datasets = about.select("dataset_id", F.when(F.col("dataset_id") != "corpus", F.upper("dataset_id")).alias("display_name"),
                            F.when(known, F.col("tags")).alias("tags"), F.when(known, F.col("dataset_hash")).alias("dataset_hash"))
    return catalog.catalog_summary(m, datasets)


# One small change per table, in SQL of both engines: (column, new value,
# rows).  Text, whole and broken numbers, times, nulls and arrays all occur.
CHANGES = {
    "region": ("r_name", "concat(r_name, ' ')", "r_regionkey = 1"),
    "nation": ("n_regionkey", "n_regionkey + 1", "n_nationkey = 7"),
    "customer": ("c_acctbal", "c_acctbal + 0.0000001", "c_custkey = (SELECT min(c_custkey) FROM customer)"),
    "supplier": ("s_name", "NULL", "s_suppkey = (SELECT max(s_suppkey) FROM supplier)"),
    "part": ("p_size", "-p_size", "p_partkey = (SELECT max(p_partkey) FROM part)"),
    "orders": ("o_totalprice", "o_totalprice + 0.0000001", "o_orderkey = (SELECT min(o_orderkey) FROM orders)"),
    "lineitem": ("l_linenumber", "l_linenumber + 100", "l_orderkey = (SELECT max(l_orderkey) FROM lineitem)"),
    "events": ("ts", "ts + INTERVAL '1' MINUTE", "event_id = (SELECT max(event_id) FROM events)"),
    "documents": ("text", "concat('x', text)", "doc_id = (SELECT min(doc_id) FROM documents)"),
    "embeddings": ("embedding", "NULL", "vec_id = (SELECT min(vec_id) FROM embeddings)"),
    "pages": ("url", "upper(url)", "page_id = (SELECT min(page_id) FROM pages)"),
    "benchmark": ("text", "lower(text)", "item_id = (SELECT min(item_id) FROM benchmark)"),
    "labels": ("toxic", "1 - toxic", "doc_id = (SELECT max(doc_id) FROM labels)"),
    "conversations": ("role", "'x'", "conv_id = (SELECT max(conv_id) FROM conversations)"),
}
# The columns of the driver's tables, in order.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def changed_sql(table: str) -> str:
    """``table`` with its change, as SQL."""
    column, value, rows = CHANGES[table]
    cols = [f"CASE WHEN {rows} THEN {value} ELSE {c} END AS {c}" if c == column else c for c in COLUMNS[table].split()]
    return f"SELECT {', '.join(cols)} FROM {table}"


def differs_sql(a: str, b: str) -> str:
    """Whether two queries give different multisets of rows."""
    return f"(EXISTS ({a} EXCEPT ALL {b}) OR EXISTS ({b} EXCEPT ALL {a}))"


_CK = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, "
    f"NOT {differs_sql(f'SELECT * FROM {t}', f'(SELECT * FROM {t} ORDER BY 1 DESC)')} AS same_reordered, "
    f"NOT {differs_sql(f'SELECT * FROM {t}', changed_sql(t))} AS same_changed" for t in TABLES)


def _versions(spark, sf, t):
    """Checksums of a table, of its rows in another order and partitioning,
    and of its changed copy."""
    df = read_table(spark, sf, t)
    df.createOrReplaceTempView(t)
    other = df.repartition(7, F.xxhash64(df.columns[0])).sortWithinPartitions(F.desc(df.columns[0]))
    return {"base": checksum.table_checksum(df, t), "reordered": checksum.table_checksum(other, t),
            "changed": checksum.table_checksum(spark.sql(changed_sql(t)), t)}


@query("a13_table_checksum", _CK)
def a13(spark, sf):
    """Checksums agree exactly where the rows do: with the same rows in
    another order, and not with one changed value."""
    parts = [df.withColumn("version", F.lit(v)) for t in TABLES for v, df in _versions(spark, sf, t).items()]
    of = lambda v: F.max(F.when(F.col("version") == v, F.col("checksum")))
    return reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(
        F.max(F.when(F.col("version") == "base", F.col("row_count"))).alias("row_count"),
        (of("base") == of("reordered")).alias("same_reordered"), (of("base") == of("changed")).alias("same_changed"))


@query("a13_dataset_fingerprint", f"""
SELECT bool_and(same_reordered) AS same_reordered, bool_and(same_changed) AS same_changed FROM ({_CK})""")
def a13b(spark, sf):
    parts = [df.withColumn("version", F.lit(v)) for t in TABLES for v, df in _versions(spark, sf, t).items()]
    prints = checksum.dataset_fingerprint(reduce(DataFrame.unionByName, parts), "version")
    of = lambda v: F.max(F.when(F.col("version") == v, F.col("dataset_hash")))
    return prints.agg((of("base") == of("reordered")).alias("same_reordered"), (of("base") == of("changed")).alias("same_changed"))
