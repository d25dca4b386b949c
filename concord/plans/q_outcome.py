"""Driver queries for H — before/after outcomes over the discrepancies
recipe (before = all rows, after = ``l_linenumber % 3 <> 0``) and facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import outcome as H
from ..session import TABLES
from . import derived
from .q_sources import changed_sql, differs_sql
from .registry import query


def _ba(spark, sf):
    d = derived.load(spark, sf, "discrepancies").select(
        F.col("validation_id").alias("pair_id"), F.col("l_linenumber").cast("string").alias("discrepancy_id"),
        F.col("l_linenumber").cast("long").alias("ordinal"), "category", "analysis_path",
        F.col("affected_rows").alias("affected_row_count"))
    return d, d.filter(F.col("ordinal") % 3 != 0).withColumn(
        "affected_row_count", F.col("affected_row_count") - F.col("ordinal"))


_D = derived.cte("discrepancies") + """,
b AS (SELECT validation_id AS pair_id, CAST(l_linenumber AS VARCHAR) AS discrepancy_id, CAST(l_linenumber AS BIGINT) AS ordinal, category,
  analysis_path, affected_rows AS affected_row_count, concat_ws('|', category, analysis_path, '', '') AS sig, lower(analysis_path) AS reg FROM discrepancies),
a AS (SELECT pair_id, discrepancy_id, ordinal, category, analysis_path, affected_row_count - ordinal AS affected_row_count, sig, reg FROM b WHERE ordinal % 3 <> 0)
"""


@query("h01_semantic_signature", _D + "SELECT pair_id, discrepancy_id, sig AS semantic_signature, reg AS affected_region FROM b")
def h01(spark, sf):
    b, _ = _ba(spark, sf)
    n = H.normalize(b)
    return n.select("pair_id", "discrepancy_id", H.semantic_signature(n).alias("semantic_signature"),
                    H.affected_region(n).alias("affected_region"))


@query("h03_target_outcome", _D + """,
t AS (SELECT * FROM b WHERE ordinal = 1),
m AS (SELECT t.pair_id, t.discrepancy_id, min({'c': CASE WHEN t.sig = a.sig THEN 0 WHEN (t.reg = a.reg OR (t.reg <> 'global' AND contains(a.reg, t.reg))) AND t.category = a.category THEN 1 ELSE 2 END,
   'o': a.ordinal, 'i': a.discrepancy_id, 'r': a.affected_row_count}) AS m
  FROM t JOIN a ON t.pair_id = a.pair_id WHERE t.sig = a.sig OR t.reg = a.reg OR (t.reg <> 'global' AND contains(a.reg, t.reg)) GROUP BY t.pair_id, t.discrepancy_id)
SELECT t.pair_id, t.discrepancy_id AS discrepancy_id_before, t.category, t.reg AS affected_region,
 CASE WHEN m.m.c <= 1 THEN 'PERSISTS' WHEN m.m.c = 2 THEN 'CHANGED' ELSE 'RESOLVED' END AS status,
 t.affected_row_count AS affected_rows_before, CAST(CASE WHEN m.m.c IS NULL THEN 0 ELSE m.m.r END AS BIGINT) AS affected_rows_after,
 CAST(CASE WHEN m.m.c <= 1 THEN CASE WHEN t.affected_row_count > 0 THEN greatest(0, t.affected_row_count - m.m.r) ELSE 0 END WHEN m.m.c = 2 THEN 0 ELSE t.affected_row_count END AS BIGINT) AS reduction_count,
 CAST(CASE WHEN m.m.c <= 1 THEN CASE WHEN t.affected_row_count > 0 THEN round(greatest(0, t.affected_row_count - m.m.r) / t.affected_row_count * 100.0, 2) ELSE 0 END
   WHEN m.m.c = 2 THEN 0 ELSE 100.0 END AS DOUBLE) AS reduction_percentage, m.m.i AS matching_after_id
FROM t LEFT JOIN m ON t.pair_id = m.pair_id AND t.discrepancy_id = m.discrepancy_id""")
def h03(spark, sf):
    b, a = _ba(spark, sf)
    return H.target_outcome(b.filter(F.col("ordinal") == 1), a)


@query("h04_classify_before_after", _D + """,
bs AS (SELECT pair_id, sig, max({'o': ordinal, 'i': discrepancy_id, 'r': reg}) AS r FROM b GROUP BY ALL),
as_ AS (SELECT pair_id, sig, max({'o': ordinal, 'i': discrepancy_id}).i AS a_id FROM a GROUP BY ALL),
fr AS (SELECT pair_id, reg, min({'o': ordinal, 'i': discrepancy_id}).i AS ar_id FROM a GROUP BY ALL),
res AS (SELECT bs.pair_id, coalesce(as_.a_id, fr.ar_id) AS rem, bs.r.i AS b_id FROM bs LEFT JOIN as_ ON bs.pair_id = as_.pair_id AND bs.sig = as_.sig
  LEFT JOIN fr ON bs.pair_id = fr.pair_id AND bs.r.r = fr.reg)
SELECT DISTINCT pair_id, CASE WHEN rem IS NULL THEN 'RESOLVED' ELSE 'REMAINING' END AS outcome, coalesce(rem, b_id) AS discrepancy_id FROM res
UNION SELECT pair_id, 'NEW', discrepancy_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.pair_id = a.pair_id AND b.sig = a.sig)
 AND NOT EXISTS (SELECT 1 FROM b WHERE b.pair_id = a.pair_id AND b.reg = a.reg)""")
def h04(spark, sf):
    b, a = _ba(spark, sf)
    return H.classify_before_after(b, a)


_FACTS = derived.cte("facts")


@query("h05_reduction", _FACTS + """SELECT migration_id,
 CAST(CASE WHEN rows_before IS NOT NULL AND rows_after IS NOT NULL AND rows_before > 0 THEN greatest(0, rows_before - rows_after) ELSE 0 END AS BIGINT) AS reduction_count,
 CAST(CASE WHEN rows_before IS NOT NULL AND rows_after IS NOT NULL AND rows_before > 0 THEN round(greatest(0, rows_before - rows_after) / rows_before * 100.0, 2) ELSE 0 END AS DOUBLE) AS reduction_percentage
FROM facts""")
def h05(spark, sf):
    f = derived.load(spark, sf, "facts")
    c, p = H.reduction(F.col("rows_before"), F.col("rows_after"))
    return f.select("migration_id", c.cast("long").alias("reduction_count"), p.cast("double").alias("reduction_percentage"))


@query("h06_verification_status", _FACTS + """SELECT migration_id, CASE
 WHEN NOT coalesce(translation_ok, TRUE) THEN 'CANDIDATE_REJECTED' WHEN NOT coalesce(target_ok, TRUE) THEN 'EXECUTION_FAILED'
 WHEN NOT coalesce(dataset_unchanged, TRUE) THEN 'FAILED_VERIFICATION' WHEN NOT coalesce(config_unchanged, TRUE) THEN 'FAILED_VERIFICATION'
 WHEN NOT coalesce(schema_ok, TRUE) THEN 'FAILED_VERIFICATION' WHEN coalesce(new_after_repair, 0) > 0 THEN 'NEW_DISCREPANCIES'
 WHEN rows_after = 0 THEN CASE WHEN rows_before = 0 THEN 'FAILED_VERIFICATION' ELSE 'VERIFIED' END
 WHEN rows_before > 0 AND rows_after IS NOT NULL AND greatest(0, rows_before - rows_after) > 0 THEN 'PARTIALLY_RESOLVED'
 ELSE 'FAILED_VERIFICATION' END AS status FROM facts WHERE repair_attempted""")
def h06(spark, sf):
    f = derived.load(spark, sf, "facts").filter(F.col("repair_attempted"))
    _, pct = H.reduction(F.col("rows_before"), F.col("rows_after"))
    tstat = F.when(F.col("rows_after") == 0, F.lit("RESOLVED")).otherwise(F.lit("PERSISTS"))
    return f.select("migration_id", H.verification_status(
        F.col("translation_ok"), F.col("target_ok"), F.col("dataset_unchanged"), F.col("config_unchanged"),
        F.col("schema_ok"), F.col("new_after_repair"), tstat, F.col("rows_before"), pct).alias("status"))


@query("h08_verification_evidence", _FACTS + """SELECT migration_id, e.evidence_id, e.evidence_type, e.details FROM (SELECT migration_id, unnest(list_filter([
 {'evidence_id': 'EV-001', 'evidence_type': 'BEFORE_VALIDATION_REF', 'details': MAP {'validation_id_before': 'val-' || migration_id}},
 CASE WHEN repair_attempted THEN {'evidence_id': 'EV-002', 'evidence_type': 'AFTER_VALIDATION_REF', 'details': MAP {'validation_id_after': 'val-after-' || migration_id}} END,
 {'evidence_id': 'EV-003', 'evidence_type': 'AFFECTED_ROWS_BEFORE', 'details': MAP {'affected_rows_before': coalesce(CAST(rows_before AS VARCHAR), '')}}, {'evidence_id': 'EV-004', 'evidence_type': 'AFFECTED_ROWS_AFTER', 'details': MAP {'affected_rows_after': coalesce(CAST(rows_after AS VARCHAR), '')}},
 {'evidence_id': 'EV-005', 'evidence_type': 'TARGET_SIGNATURE_BEFORE', 'details': MAP {'signature_before': 'sig'}},
 CASE WHEN coalesce(rows_after, 0) = 0 THEN {'evidence_id': 'EV-006', 'evidence_type': 'TARGET_DISCREPANCY_RESOLVED', 'details': MAP {'resolved_discrepancy_ids': ''}}
  ELSE {'evidence_id': 'EV-006', 'evidence_type': 'TARGET_DISCREPANCY_PERSISTS', 'details': MAP {'signature_after': 'sig'}} END,
 CASE WHEN coalesce(new_after_repair, 0) > 0 THEN {'evidence_id': 'EV-007', 'evidence_type': 'NEW_DISCREPANCIES_INTRODUCED', 'details': MAP {'new_discrepancies': coalesce(CAST(new_after_repair AS VARCHAR), '')}} END],
 lambda x: x IS NOT NULL)) AS e FROM facts)""")
def h08(spark, sf):
    f = derived.load(spark, sf, "facts")
    v = f.select("migration_id", F.concat(F.lit("val-"), F.col("migration_id").cast("string")).alias("validation_id_before"),
                 F.when(F.col("repair_attempted"), F.concat(F.lit("val-after-"), F.col("migration_id").cast("string")))
                 .alias("validation_id_after"),
                 "rows_before", "rows_after", F.lit("sig").alias("signature_before"),
                 F.when(F.coalesce(F.col("rows_after"), F.lit(0)) != 0, F.lit("sig")).alias("signature_after"),
                 F.col("new_after_repair").alias("new_count"))
    return H.verification_evidence(v)


# after a run: four tables have changed rows, one another configuration
_H07_CHANGED = ("customer", "orders", "events", "embeddings")


def _h07_sql():
    return " UNION ALL ".join(
        f"SELECT '{t}' AS migration_id, "
        + (f"NOT {differs_sql(f'SELECT * FROM {t}', changed_sql(t))}" if t in _H07_CHANGED else f"NOT {differs_sql(f'SELECT * FROM {t}', f'SELECT * FROM {t}')}")
        + f" AS dataset_unchanged, {'FALSE' if t == 'nation' else 'TRUE'} AS config_unchanged" for t in TABLES)


@query("h07_immutability", _h07_sql())
def h07(spark, sf):
    from ..functions.text import sha16
    from ..session import register_tables
    from ..sources.checksum import table_checksum

    base = register_tables(spark, sf)
    after = {t: spark.sql(changed_sql(t)) if t in _H07_CHANGED else df for t, df in base.items()}

    def hashes(tables, cfg_names):
        return reduce(DataFrame.unionByName, [
            table_checksum(df, t).select(F.col("table_name").alias("migration_id"), F.col("checksum").alias("dataset_hash"),
                                         sha16(F.lit(cfg_names.get(t, t))).alias("config_hash")) for t, df in tables.items()])

    return H.immutability(hashes(base, {}), hashes(after, {"nation": "nation-v2"}))
