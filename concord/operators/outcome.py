"""H — before/after outcome analysis of a repair, for many pairs at once.

Discrepancy frames carry ``(pair_id, discrepancy_id, ordinal, category,
analysis_path, source_expression, target_expression, signature,
affected_columns, source_location, affected_row_count)``; missing optional
columns are NULL (``normalize``).  ``ordinal`` is the list order used for
"first match" rules.  All matching is scoped to one ``pair_id``: a
before/after report pair of a single migration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gram_length, grams, leading_gram

P = "pair_id"
COLUMNS = {"pair_id": "long", "discrepancy_id": "string", "ordinal": "long", "category": "string",
           "analysis_path": "string", "source_expression": "string", "target_expression": "string",
           "signature": "string", "affected_columns": "array<string>", "source_location": "string",
           "affected_row_count": "long"}


def normalize(d: DataFrame) -> DataFrame:
    return d.select(*[(F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def _norm_text(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.regexp_replace(s, ";", "")


def semantic_signature(d: DataFrame) -> Column:
    """H1: the stored signature, else ``category|path|src|tgt`` of the
    normalised (lower-case, trimmed, space-collapsed, ``;``-free) texts."""
    built = F.concat_ws("|", F.coalesce(F.col("category"), F.lit("")), F.coalesce(F.col("analysis_path"), F.lit("")),
                        _norm_text(F.col("source_expression")), _norm_text(F.col("target_expression")))
    return F.when(F.coalesce(F.col("signature"), F.lit("")) != "", F.col("signature")).otherwise(built)


def affected_region(d: DataFrame) -> Column:
    """H2: path, else ``columns[sorted,cols]``, else location, else
    ``global``; lower-case."""
    cols = F.array_join(F.array_sort(F.coalesce(F.col("affected_columns"), F.array().cast("array<string>"))), ",")
    return F.lower(F.when(F.coalesce(F.col("analysis_path"), F.lit("")) != "", F.col("analysis_path"))
                   .when(F.size(F.coalesce(F.col("affected_columns"), F.array())) > 0,
                         F.concat(F.lit("columns["), cols, F.lit("]")))
                   .when(F.coalesce(F.col("source_location"), F.lit("")) != "", F.col("source_location"))
                   .otherwise(F.lit("global")))


def _prep(d: DataFrame) -> DataFrame:
    n = normalize(d)
    return n.withColumn("_sig", semantic_signature(n)).withColumn("_reg", affected_region(n))


def reduction(before: Column, after: Column) -> tuple[Column, Column]:
    """H5: (count, pct): ``max(0, b-a)`` and its share of ``b`` (2 dp);
    both 0 when b <= 0 or either side is NULL."""
    ok = before.isNotNull() & after.isNotNull() & (before > 0)
    cnt = F.when(ok, F.greatest(F.lit(0), before - after)).otherwise(F.lit(0))
    pct = F.when(ok, F.round(F.greatest(F.lit(0), before - after) / before * 100.0, 2)).otherwise(F.lit(0.0))
    return cnt, pct


def _held_regions(t: DataFrame, a: DataFrame) -> DataFrame:
    """The first after record of each (target region, category) whose region
    is longer and holds the target's: ``(pair_id, category, _reg, _at)``.
    Only regions longer than the shortest of the pair's targets are cut into
    grams, and only into lengths that these start with."""
    mine = t.filter(F.col("_reg") != "global")
    asked = mine.groupBy(P).agg(F.min(F.length("_reg")).alias("_short"), F.bit_or(gram_length(F.col("_reg"))).alias("_lengths"))
    longer = a.withColumnRenamed("_reg", "a_reg").join(asked, P).filter(F.length("a_reg") > F.col("_short"))
    longer = longer.groupBy(P, "a_reg", "category", "_lengths").agg(F.min("_at").alias("_at"))
    met = longer.withColumn("gram", F.explode(grams(F.col("a_reg"), F.col("_lengths")))).join(
        mine.select(P, "_reg").distinct().withColumn("gram", leading_gram(F.col("_reg"))), [P, "gram"])
    return (met.filter(F.col("a_reg").contains(F.col("_reg")) & (F.col("a_reg") != F.col("_reg")))
            .groupBy(P, "_reg", "category").agg(F.min("_at").alias("_at")))


def target_outcome(targets: DataFrame, after: DataFrame) -> DataFrame:
    """H3: outcome of each targeted before-discrepancy against the after
    list of its pair: an exact signature match, else a same-region
    (equal, or the before region contained in the after region unless
    ``global``) match of the same category -> PERSISTS; a same-region match
    of another category -> CHANGED; none -> RESOLVED."""
    t, a = _prep(targets), _prep(after)
    a = a.select(P, "category", "_sig", "_reg", F.struct("ordinal", F.col("discrepancy_id").alias("a_id"), F.col("affected_row_count").alias("a_rows")).alias("_at"))
    # an after record counts for every region of a target that lies in its own
    a = a.unionByName(_held_regions(t, a), allowMissingColumns=True)
    d = t.select(P, "discrepancy_id", "category", "_sig", "_reg", "affected_row_count", F.lit(True).alias("_target")).unionByName(a, allowMissingColumns=True)
    first = lambda *by: F.min("_at").over(Window.partitionBy(P, *by))
    d = d.withColumn("_same", first("_sig"))
    d = d.withColumn("_alike", first("_reg", "category")).withColumn("_near", first("_reg")).filter("_target")
    found = lambda cls, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(cls).alias("_cls"), F.col(c).alias("_at")))
    best = F.coalesce(found(0, "_same"), F.when(F.col("category").isNotNull(), found(1, "_alike")), found(2, "_near"))
    # rows of one id share the best class, then the first record
    d = d.withColumn("_best", F.min(best).over(Window.partitionBy(P, "discrepancy_id")))
    known = F.col(P).isNotNull() & F.col("discrepancy_id").isNotNull()
    o = d.withColumn("m", F.when(known & F.col("_best").isNotNull(), F.struct("_best._cls", "_best._at.a_id", "_best._at.a_rows")))
    status = (F.when(F.col("m._cls") <= 1, F.lit("PERSISTS")).when(F.col("m._cls") == 2, F.lit("CHANGED"))
              .otherwise(F.lit("RESOLVED")))
    before = F.col("affected_row_count")
    after_rows = F.when(F.col("m._cls").isNull(), F.lit(0)).otherwise(F.col("m.a_rows"))
    cnt, pct = reduction(before, after_rows)
    persists = F.col("m._cls") <= 1
    red_cnt = F.when(persists, cnt).when(F.col("m._cls") == 2, F.lit(0)).otherwise(before)
    red_pct = F.when(persists, pct).when(F.col("m._cls") == 2, F.lit(0.0)).otherwise(F.lit(100.0))
    return o.select(P, F.col("discrepancy_id").alias("discrepancy_id_before"), "category",
                    F.col("_reg").alias("affected_region"), status.alias("status"),
                    before.alias("affected_rows_before"), after_rows.cast("long").alias("affected_rows_after"),
                    red_cnt.cast("long").alias("reduction_count"), red_pct.cast("double").alias("reduction_percentage"),
                    F.col("m.a_id").alias("matching_after_id"))


def classify_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """H4: ``(pair_id, outcome, discrepancy_id)`` with outcome RESOLVED
    (before ids), REMAINING or NEW (after ids).  Signatures match first,
    then equal regions; when several records share a signature the last
    one in list order stands for it.  Equi-joins only."""
    both = _prep(before).withColumn("_after", F.lit(False)).unionByName(_prep(after).withColumn("_after", F.lit(True)), allowMissingColumns=True)
    d = both.select(P, "discrepancy_id", "ordinal", "_sig", "_reg", "_after")
    of = lambda after, c: F.when(F.col("_after") == after, F.col(c))
    listed = lambda by: Window.partitionBy(P, by).orderBy("ordinal", "discrepancy_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the last before record and the last after record of a signature stand for it
    d = d.withColumns({"b_last": F.last(of(False, "discrepancy_id"), ignorenulls=True).over(listed("_sig")),
                       "a_id": F.last(of(True, "discrepancy_id"), ignorenulls=True).over(listed("_sig"))})
    d = d.withColumns({"ar_id": F.first(of(True, "discrepancy_id"), ignorenulls=True).over(listed("_reg")),
                       "br_id": F.first(of(False, "discrepancy_id"), ignorenulls=True).over(listed("_reg"))})
    left = F.coalesce("a_id", "ar_id")
    return d.filter(F.when(F.col("_after"), F.col("b_last").isNull() & F.col("br_id").isNull()).otherwise(F.col("discrepancy_id") == F.col("b_last"))).select(
        P, F.when(F.col("_after"), F.lit("NEW")).when(left.isNull(), F.lit("RESOLVED")).otherwise(F.lit("REMAINING")).alias("outcome"),
        F.when(F.col("_after"), F.col("discrepancy_id")).otherwise(F.coalesce(left, F.col("discrepancy_id"))).alias("discrepancy_id")).distinct()


def verification_status(candidate_valid: Column, execution_succeeded: Column, dataset_unchanged: Column,
                        config_unchanged: Column, contract_preserved: Column, new_count: Column,
                        target_status: Column, rows_before: Column, reduction_pct: Column) -> Column:
    """H6: ordered rules; 0 -> 0 is never VERIFIED, NULL rows before with a
    resolved target is."""
    t = lambda c: F.coalesce(c, F.lit(True))
    return (F.when(~t(candidate_valid), F.lit("CANDIDATE_REJECTED"))
            .when(~t(execution_succeeded), F.lit("EXECUTION_FAILED"))
            .when(~t(dataset_unchanged), F.lit("FAILED_VERIFICATION"))
            .when(~t(config_unchanged), F.lit("FAILED_VERIFICATION"))
            .when(~t(contract_preserved), F.lit("FAILED_VERIFICATION"))
            .when(F.coalesce(new_count, F.lit(0)) > 0, F.lit("NEW_DISCREPANCIES"))
            .when(target_status == "RESOLVED",
                  F.when(rows_before == 0, F.lit("FAILED_VERIFICATION")).otherwise(F.lit("VERIFIED")))
            .when((target_status == "PERSISTS") & (F.coalesce(reduction_pct, F.lit(0.0)) > 0), F.lit("PARTIALLY_RESOLVED"))
            .otherwise(F.lit("FAILED_VERIFICATION")))


def immutability(before: DataFrame, after: DataFrame, key: str = "migration_id") -> DataFrame:
    """H7: ``(key, dataset_unchanged, config_unchanged)`` from
    ``(key, dataset_hash, config_hash)`` frames of both runs."""
    b = before.select(key, F.col("dataset_hash").alias("b_d"), F.col("config_hash").alias("b_c"))
    a = after.select(key, F.col("dataset_hash").alias("a_d"), F.col("config_hash").alias("a_c"))
    j = b.join(a, key, "full")
    return j.select(key, F.coalesce(F.col("b_d") == F.col("a_d"), F.lit(False)).alias("dataset_unchanged"),
                    F.coalesce(F.col("b_c") == F.col("a_c"), F.lit(False)).alias("config_unchanged"))


def verification_evidence(v: DataFrame) -> DataFrame:
    """H8: EV-001..EV-007 rows from one verification row per key with
    ``validation_id_before, validation_id_after, rows_before, rows_after,
    signature_before, signature_after, new_count`` and, where there are any,
    the texts ``resolved_ids`` and ``new_ids``; ``details`` holds what an item
    is about (a map of texts)."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in v.columns else F.lit("")
    ev = lambda i, t, key, c: F.struct(F.lit(i).alias("evidence_id"), F.lit(t).alias("evidence_type"), F.create_map(F.lit(key), said(c)).alias("details"))
    new = ev("EV-007", "NEW_DISCREPANCIES_INTRODUCED", "new_discrepancy_ids", "new_ids") if "new_ids" in v.columns \
        else ev("EV-007", "NEW_DISCREPANCIES_INTRODUCED", "new_discrepancies", "new_count")
    items = F.array(
        ev("EV-001", "BEFORE_VALIDATION_REF", "validation_id_before", "validation_id_before"),
        F.when(has("validation_id_after"), ev("EV-002", "AFTER_VALIDATION_REF", "validation_id_after", "validation_id_after")),
        ev("EV-003", "AFFECTED_ROWS_BEFORE", "affected_rows_before", "rows_before"), ev("EV-004", "AFFECTED_ROWS_AFTER", "affected_rows_after", "rows_after"),
        ev("EV-005", "TARGET_SIGNATURE_BEFORE", "signature_before", "signature_before"),
        F.when(F.col("signature_after").isNull(), ev("EV-006", "TARGET_DISCREPANCY_RESOLVED", "resolved_discrepancy_ids", "resolved_ids"))
        .otherwise(ev("EV-006", "TARGET_DISCREPANCY_PERSISTS", "signature_after", "signature_after")),
        F.when(F.coalesce(F.col("new_count"), F.lit(0)) > 0, new))
    keys = [c for c in v.columns if c in ("migration_id", "pair_id")]
    return (v.select(*keys, F.explode(F.filter(items, lambda x: x.isNotNull())).alias("e"))
            .select(*keys, "e.evidence_id", "e.evidence_type", "e.details"))
