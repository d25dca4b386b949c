"""G — discrepancy diagnosis over signal tables of many validations.

A signal row: ``(validation_id, signal_id, source_validator, signal_type,
source_expression, target_expression, analysis_path, mismatch_count,
column)``; missing optional columns are added as NULL by
``normalize_signals``.  Classification is one chained CASE, signatures are
SHA-256 over normalised text, consolidation is a group-by on
``(validation_id, signature)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gram_length, grams, leading_gram, prefixes, sha16, strip
from ..session import written

V = "validation_id"
STRUCTURAL = ("BusinessRuleValidator", "AST_ANALYZER")
EXECUTION = ("RowValidator", "EdgeCaseValidator")

# Discrepancy categories (in priority order of the rules that
# produce them) and severities.
CATEGORIES = ("NULL_SEMANTICS", "BOUNDARY_CONDITION", "JOIN_SEMANTICS", "AGGREGATION_SEMANTICS",
              "DATE_SEMANTICS", "TYPE_CONVERSION", "CASE_LOGIC", "FILTER_LOGIC", "COLUMN_MAPPING",
              "SET_SEMANTICS", "UNKNOWN")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
SUBCATEGORIES = {
    "NULL_SEMANTICS": "NULL_TREATMENT_DIVERGENCE",
    "BOUNDARY_CONDITION": "OPERATOR_INCLUSION",
    "JOIN_SEMANTICS": "JOIN_TYPE_OR_CONDITION_CHANGED",
    "AGGREGATION_SEMANTICS": "AGGREGATE_FUNCTION_OR_GROUPING_CHANGED",
    "DATE_SEMANTICS": "DATE_TRUNC_OR_INTERVAL_CHANGED",
    "TYPE_CONVERSION": "CAST_OR_COERCION_CHANGED",
    "CASE_LOGIC": "CASE_BRANCH_CONDITION_CHANGED",
    "FILTER_LOGIC": "FILTER_PREDICATE_CHANGED",
    "COLUMN_MAPPING": "OUTPUT_COLUMN_SHIFT",
    "SET_SEMANTICS": "UNION_OR_SET_OPERATOR_CHANGED",
    "UNKNOWN": "UNCLASSIFIED_DISCREPANCY",
}
DEFAULT_PATHS = {
    "NULL_SEMANTICS": "filters[0]",
    "BOUNDARY_CONDITION": "business_rules[0].condition.operator",
    "JOIN_SEMANTICS": "joins[0]",
    "AGGREGATION_SEMANTICS": "aggregations[0]",
    "DATE_SEMANTICS": "expressions[date]",
    "TYPE_CONVERSION": "columns[type]",
    "CASE_LOGIC": "business_rules[0]",
    "FILTER_LOGIC": "filters[0]",
    "COLUMN_MAPPING": "columns[mapping]",
    "SET_SEMANTICS": "set_operations[0]",
    "UNKNOWN": "unspecified",
}
DATE_KEYWORDS = ("DATE", "TIME", "TIMESTAMP", "DATE_TRUNC", "TRUNC", "EXTRACT", "YEAR", "MONTH", "DAY",
                 "INTERVAL")
# Keywords upper-cased by the expression normaliser.
NORMALIZED_KEYWORDS = ("select", "from", "where", "join", "left", "right", "inner", "outer", "on", "group",
                       "by", "having", "order", "case", "when", "then", "else", "end", "is", "null", "not",
                       "and", "or", "sum", "count", "avg", "min", "max", "distinct", "cast", "as")

SIGNAL_COLUMNS = {"validation_id": "long", "signal_id": "long", "source_validator": "string",
                  "signal_type": "string", "source_expression": "string", "target_expression": "string",
                  "analysis_path": "string", "mismatch_count": "long", "column": "string",
                  "payload_category": "string", "row_key": "string", "value": "string", "source_value": "string",
                  "target_value": "string", "detail": "string"}


def normalize_signals(s: DataFrame) -> DataFrame:
    cols = []
    for c, t in SIGNAL_COLUMNS.items():
        cols.append((F.col(c) if c in s.columns else F.lit(None)).cast(t).alias(c))
    out = s.select(*cols)
    return (out.withColumn("signal_type", F.coalesce("signal_type", F.lit("")))
            .withColumn("analysis_path", F.coalesce("analysis_path", F.lit(""))))


# ------------------------------------------------------------------ G4
def _has(c: Column, s: str) -> Column:
    return c.contains(s)


def classify(s: DataFrame) -> DataFrame:
    """First matching rule in priority order -> category, subcategory,
    default path (``rule_path``)."""
    st = F.col("signal_type")
    src_raw = F.coalesce(F.col("source_expression"), F.lit(""))
    tgt_raw = F.coalesce(F.col("target_expression"), F.lit(""))
    # columns of their own: as parts of the rules they would be made anew for every keyword
    s = s.withColumns({"_src": F.upper(src_raw), "_tgt": F.upper(tgt_raw), "_path": F.upper("analysis_path")})
    src, tgt = F.col("_src"), F.col("_tgt")
    either = lambda k: _has(src, k) | _has(tgt, k)
    null_rule = (either("NULL") | either("COALESCE") | _has(src, "NVL") | _has(tgt, "IFNULL")
                 | (_has(src, "COUNT(*)") & _has(tgt, "COUNT(") & ~_has(tgt, "COUNT(*)"))
                 | (_has(tgt, "COUNT(*)") & _has(src, "COUNT(") & ~_has(src, "COUNT(*)"))
                 | (st == "NULL_SEMANTICS_CHANGED"))
    boundary = (st.isin("BOUNDARY_CASE", "BOUNDARY_CONDITION_CHANGED", "OPERATOR_INCLUSION")
                | (_has(src_raw, ">") & _has(tgt_raw, ">=")) | (_has(src_raw, ">=") & _has(tgt_raw, ">"))
                | (_has(src_raw, "<") & _has(tgt_raw, "<=")) | (_has(src_raw, "<=") & _has(tgt_raw, "<"))
                | either("BETWEEN"))
    join = (either("JOIN") | st.isin("JOIN_DIFF", "JOIN_TYPE_CHANGED", "JOIN_CONDITION_CHANGED")
            | F.coalesce(F.col("payload_category").isin("JOIN_TYPE_CHANGED", "JOIN_CONDITION_CHANGED"),
                         F.lit(False)))
    agg = (st.isin("AGGREGATION_DIFF", "AGGREGATE_MISMATCH", "AGGREGATE_RESULT_DIFF")
           | reduce(lambda a, b: a | b, [either(f) for f in ("SUM(", "AVG(", "COUNT(", "MIN(", "MAX(")])
           | either("GROUP BY") | either("HAVING"))
    date = reduce(lambda a, b: a | b, [either(k) for k in DATE_KEYWORDS])
    conv = either("CAST(") | either("CONVERT") | st.isin("SCHEMA_TYPE_CHANGED", "TYPE_DIFF")
    case = either("CASE") | st.isin("CASE_RULE_CHANGED", "CASE_BRANCH_DIFF")
    path_up = F.col("_path")
    filt = (st.isin("FILTER_DIFF", "FILTER_ADDED", "FILTER_REMOVED", "FILTER_EXPRESSION_CHANGED")
            | path_up.contains("WHERE") | path_up.contains("FILTER"))
    mapping = (st.isin("COLUMN_MAPPING_CHANGED", "SCHEMA_COLUMN_ADDED", "SCHEMA_COLUMN_REMOVED", "COLUMN_SHIFT")
               | st.contains("COLUMN_MAPPING") | F.col("analysis_path").contains("mapping"))
    sets = either("UNION") | _has(src, "INTERSECT") | _has(tgt, "EXCEPT")
    rules = [null_rule, boundary, join, agg, date, conv, case, filt, mapping, sets]
    cat = None
    for cond, name in zip(rules, CATEGORIES[:-1]):
        cat = F.when(cond, F.lit(name)) if cat is None else cat.when(cond, F.lit(name))
    cat = cat.otherwise(F.lit("UNKNOWN"))
    sub = F.element_at(F.create_map(*[F.lit(x) for kv in SUBCATEGORIES.items() for x in kv]), F.col("category"))
    dpath = F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_PATHS.items() for x in kv]), F.col("category"))
    return (s.withColumn("category", cat).drop("_src", "_tgt", "_path").withColumn("subcategory", sub)
            .withColumn("rule_path", dpath))


# ------------------------------------------------------------ G5 / G6
def normalize_expression(c: Column) -> Column:
    """Collapse whitespace, drop ``.0`` tails of numbers, upper-case
    the SQL keywords; NULL/empty -> empty."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\s+", " ")
    s = F.regexp_replace(s, r"(\d+)\.0+(\D|$)", "$1$2")
    # A keyword match ``\bkw\b`` is a whole word token equal to the keyword
    # (ignoring case): split at word boundaries once, upper-case the keyword
    # tokens and join back, instead of one regex pass per keyword.
    kws = F.array(*[F.lit(k) for k in NORMALIZED_KEYWORDS])
    tokens = F.split(s, r"\b", -1)
    fixed = F.transform(tokens, lambda w: F.when(F.array_contains(kws, F.lower(w)), F.upper(w)).otherwise(w))
    return F.array_join(fixed, "")


def signature(category: Column, path: Column, src: Column, tgt: Column) -> Column:
    """sha256-16 of ``category:path:norm(src):norm(tgt)``, path cut at
    its first dot."""
    p = F.substring_index(F.coalesce(path, F.lit("")), ".", 1)
    return sha16(F.concat_ws(":", category, p, normalize_expression(src), normalize_expression(tgt)))


# ------------------------------------------------------------------ G1
def extract_signals(checks: DataFrame, evidence: DataFrame) -> DataFrame:
    """G1: one signal per evidence item of a non-PASS, non-SKIPPED check.

    ``checks``: ``(validation_id, check_name, status, mismatch_count)``;
    ``evidence``: ``(validation_id, check_name, ordinal, type, column,
    category, source_value, target_value)``."""
    c = checks.filter(~F.col("status").isin("PASS", "SKIPPED")).select(V, "check_name", "mismatch_count")
    e = evidence.join(c, [V, "check_name"])
    path = (F.when(F.col("column").isNotNull() & (F.col("column") != ""),
                   F.concat(F.lit("columns["), F.col("column"), F.lit("]")))
            .when(F.col("category") == "CASE_RULE_CHANGED", F.lit("business_rules[0].condition"))
            .when(F.col("category").isNotNull() & (F.col("category") != ""),
                  F.concat(F.lit("category["), F.col("category"), F.lit("]")))
            .otherwise(F.lit("")))
    return e.select(V, F.col("ordinal").cast("long").alias("signal_id"),
                    F.col("check_name").alias("source_validator"),
                    F.coalesce(F.col("type"), F.lit("")).alias("signal_type"),
                    F.col("source_value").alias("source_expression"),
                    F.col("target_value").alias("target_expression"),
                    path.alias("analysis_path"), F.col("mismatch_count").cast("long"), "column",
                    F.col("category").alias("payload_category"))


# ------------------------------------------------------------------ G2
def component_signals(components: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Positional differences of rules / case conditions / filters /
    joins / aggregations as AST signals; validations that already have a
    rule-check signal get none.

    A case condition (kind ``case``) whose comparison only gained or lost
    equality is an OPERATOR_INCLUSION, any other change of it a
    CASE_CONDITION_DIFF.  Joins are told apart by type and condition,
    aggregations by function, argument and DISTINCT; filters by their text
    alone."""
    side = lambda k, p: components.filter(F.col("side") == k).select(
        F.col("migration_id").alias(V), "kind", "ordinal", F.col("name").alias(p + "name"), F.col("expr").alias(p + "expr"),
        F.coalesce("is_distinct", F.lit(False)).alias(p + "distinct"))
    j = side("SRC", "s_").join(side("TGT", "t_"), [V, "kind", "ordinal"])
    kind, differ = F.col("kind"), lambda c: ~F.col("s_" + c).eqNullSafe(F.col("t_" + c))
    changed = (F.when(kind == "rule", differ("expr") | differ("name"))
               .when(kind.isin("case", "filter"), differ("expr"))
               .when(kind == "join", differ("expr") | differ("name"))
               .when(kind == "aggregation", differ("expr") | differ("name") | differ("distinct")).otherwise(False))
    s, t = F.col("s_expr"), F.col("t_expr")
    inclusion = reduce(lambda a, b: a | b, [(a.contains(o) & b.contains(o + "=")) for o in "><" for a, b in ((s, t), (t, s))])
    typ = (F.when(kind == "rule", "CASE_RULE_CHANGED").when(kind == "filter", "FILTER_DIFF").when(kind == "join", "JOIN_DIFF")
           .when(kind == "aggregation", "AGGREGATION_DIFF").when(inclusion, "OPERATOR_INCLUSION").otherwise("CASE_CONDITION_DIFF"))

    def text(p: str) -> Column:
        return (F.when(kind == "join", F.concat(F.col(p + "name"), F.lit(" JOIN ON "), F.col(p + "expr")))
                .when(kind == "aggregation", F.concat(F.col(p + "name"), F.lit("("), F.when(F.col(p + "distinct"), "DISTINCT ").otherwise(""), F.col(p + "expr"), F.lit(")")))
                .otherwise(F.col(p + "expr")))

    at = (F.col("ordinal") - 1).cast("string")
    path = (F.when(kind == "rule", F.concat(F.lit("business_rules["), at, F.lit("]")))
            .when(kind == "filter", F.concat(F.lit("filters["), at, F.lit("].expression")))
            .when(kind == "join", F.concat(F.lit("joins["), at, F.lit("]")))
            .when(kind == "aggregation", F.concat(F.lit("aggregations["), at, F.lit("]")))
            .otherwise(F.coalesce(F.concat(F.lit("columns["), F.coalesce("s_name", "t_name"), F.lit("]")), F.concat(F.lit("case_expressions["), at, F.lit("].whens[0]")))))
    rank = F.when(kind == "rule", 0).when(kind == "filter", 1).when(kind == "join", 2).when(kind == "aggregation", 3).otherwise(4)
    out = j.filter(changed).select(
        V, (F.col("ordinal") * 10 + rank).cast("long").alias("signal_id"), F.lit("AST_ANALYZER").alias("source_validator"), typ.alias("signal_type"),
        text("s_").alias("source_expression"), text("t_").alias("target_expression"), path.alias("analysis_path"), F.lit(0).cast("long").alias("mismatch_count"))
    if signals is not None:
        has_rule = signals.filter(F.col("source_validator") == "BusinessRuleValidator").select(V).distinct()
        out = out.join(has_rule, V, "left_anti")
    return normalize_signals(out)


# ------------------------------------------------------------------ G3
def link_execution_to_structure(signals: DataFrame) -> DataFrame:
    """A row/edge signal takes the expressions and path of the first
    (lowest ``signal_id``) compatible structural signal of its validation:
    paths equal or one a prefix of the other (or either empty), same
    column, or its column named in the structural expressions; signals
    about two different explicit columns never link.

    Every way to match is a key that both sides write out: a path's
    prefixes, an empty path, a column.  Structural signals are reduced to the
    first one per key and column first, so a lookup is one row whatever a
    validation holds, and signals that ask the same are looked up once."""
    s = normalize_signals(signals)
    path_column = lambda p: F.when(F.col(p).startswith("columns[") & F.col(p).endswith("]"), F.regexp_extract(p, r"^columns\[(.*)\]$", 1))
    said = lambda c: F.when(c != "", c)
    st = s.filter(F.col("source_validator").isin(*STRUCTURAL)).select(
        V, F.col("signal_id").alias("a_id"), F.col("analysis_path").alias("a_path"), said(F.col("column")).alias("a_col"),
        F.coalesce(said(F.col("column")), said(path_column("analysis_path"))).alias("a_of"),
        F.col("source_expression").alias("a_src"), F.col("target_expression").alias("a_tgt"))
    ex = s.filter(F.col("source_validator").isin(*EXECUTION))
    asked = ex.select(V, F.col("analysis_path").alias("path"), said(F.col("column")).alias("col"),
                      F.coalesce(said(F.col("column")), said(path_column("analysis_path"))).alias("of")).distinct()

    key = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    one = lambda kind, text: F.when(text.isNotNull(), F.array(key(kind, text))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    each = lambda kind, texts: F.transform(texts, lambda t: key(kind, t))
    empty = lambda c: F.when(F.col(c) == "", F.lit(""))
    # signals about a column meet those about it and those about none; signals about none meet all
    lanes = lambda of: F.array(F.lit("*"), F.coalesce(F.concat(F.lit("="), of), F.lit("")))
    st_keys = F.concat(one("all", F.lit("")), one("bare", empty("a_path")), one("under", said(F.col("a_path"))),
                       each("over", prefixes(F.col("a_path"))), one("column", F.col("a_col")))
    ex_keys = F.concat(one("all", empty("path")), one("bare", F.lit("")), each("under", prefixes(F.col("path"))),
                       one("over", said(F.col("path"))), one("column", F.col("col")), one("named", F.col("col")))
    by = [V, "key", "lane"]
    reduced = st.groupBy(V, "a_path", "a_col", "a_of").agg(F.min("a_id").alias("a_id"))
    first = reduced.select(V, "a_id", F.explode(st_keys).alias("key"), "a_of").select(V, "a_id", "key", F.explode(lanes(F.col("a_of"))).alias("lane")).groupBy(*by).agg(F.min("a_id").alias("a_id"))
    # columns named in expressions: found through the grams of the text, then checked
    text = F.concat(F.coalesce("a_src", F.lit("")), F.lit(" "), F.coalesce("a_tgt", F.lit("")))
    texts = st.groupBy(V, text.alias("text"), "a_of").agg(F.min("a_id").alias("a_id"))
    columns = asked.filter(F.col("col").isNotNull()).select(V, "col", leading_gram(F.col("col")).alias("gram")).distinct()
    lengths = s.filter(F.col("source_validator").isin(*EXECUTION) & said(F.col("column")).isNotNull()).groupBy(V).agg(F.bit_or(gram_length(F.col("column"))).alias("lengths"))
    texts = texts.join(lengths, V)
    named = (texts.withColumn("gram", F.explode(grams(F.col("text"), F.col("lengths")))).join(columns, [V, "gram"]).filter(F.col("text").contains(F.col("col")))
             .select(V, "a_id", key("named", F.col("col")).alias("key"), F.explode(lanes(F.col("a_of"))).alias("lane")).groupBy(*by).agg(F.min("a_id").alias("a_id")))

    wanted = F.when(F.col("of").isNull(), F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), F.col("of")), F.lit("")))
    kind = [V, "path", "col"]
    looked = asked.select(*kind, F.explode(ex_keys).alias("key"), wanted.alias("lanes")).select(*kind, "key", F.explode("lanes").alias("lane"))
    found = looked.join(first.unionByName(named), by).groupBy(*kind).agg(F.min("a_id").alias("a_id"))
    found = found.join(st.select(V, "a_id", "a_path", "a_src", "a_tgt"), [V, "a_id"]).withColumnRenamed(V, "_v")
    same = (ex[V] == found["_v"]) & (ex["analysis_path"] == found["path"]) & said(ex["column"]).eqNullSafe(found["col"])
    linked = ex.join(found, same, "left").select(
        *[ex[c] for c in ex.columns if c not in ("source_expression", "target_expression", "analysis_path")],
        F.coalesce("a_src", "source_expression").alias("source_expression"), F.coalesce("a_tgt", "target_expression").alias("target_expression"),
        F.when(F.coalesce("a_path", F.lit("")) != "", F.col("a_path")).otherwise(F.col("analysis_path")).alias("analysis_path"))
    rest = s.filter(~F.col("source_validator").isin(*EXECUTION))
    return rest.unionByName(linked.select(*s.columns))


# ------------------------------------------------------------ G9-G11
def severity(category: Column, affected: Column, total: Column) -> Column:
    """G9."""
    pct = F.when(total > 0, affected / total).otherwise(F.lit(0.0))
    bnj = category.isin("BOUNDARY_CONDITION", "NULL_SEMANTICS", "JOIN_SEMANTICS")
    return (F.when(affected == 0, F.when(bnj, F.lit("LOW")).otherwise(F.lit("INFO")))
            .when((pct >= 0.25) | ((category == "JOIN_SEMANTICS") & (pct >= 0.10)), F.lit("CRITICAL"))
            .when((pct >= 0.01) | bnj | (category == "CASE_LOGIC"), F.lit("HIGH"))
            .when(pct > 0.0, F.lit("MEDIUM")).otherwise(F.lit("LOW")))


def confidence(structural: Column, execution: Column, edge: Column, unknown: Column) -> Column:
    """G10."""
    return (F.when(unknown, F.lit(0.50))
            .when(structural & execution & edge, F.lit(1.00))
            .when(structural & execution, F.lit(0.95))
            .when(execution & ~structural, F.lit(0.90))
            .when(structural & ~execution, F.lit(0.85)).otherwise(F.lit(0.60)))


def affected_pct(rows: Column, total: Column) -> Column:
    """Rows / total * 100, 3 dp, 0 when total is 0."""
    return F.when(rows.isNull(), F.lit(0.0)).when(total > 0, F.round(rows / total * 100.0, 3)) \
        .otherwise(F.lit(0.0))


# ------------------------------------------------------------------ G7
def signed_signals(signals: DataFrame, link: bool = True) -> DataFrame:
    """Signals after linkage with category and signature."""
    s = link_execution_to_structure(signals) if link else normalize_signals(signals)
    c = classify(s)
    path = F.when(F.col("analysis_path") != "", F.col("analysis_path")).otherwise(F.col("rule_path"))
    return c.withColumn("signature", signature(F.col("category"), path, F.col("source_expression"),
                                               F.col("target_expression")))


def consolidate(signals: DataFrame, totals: DataFrame | None = None, total_rows: int | None = None,
                link: bool = True, signed: bool = False) -> DataFrame:
    """G7 (+G9–G11): one discrepancy per (validation, signature).

    ``totals``: optional ``(validation_id, total_output_rows)``; else the
    constant ``total_rows`` (0 when neither is given).  ``signed``: the
    signals come from ``signed_signals``."""
    s = signals if signed else signed_signals(signals, link)
    is_struct = F.col("source_validator").isin(*STRUCTURAL)
    is_row = ((F.col("source_validator") == "RowValidator") | F.col("signal_type").contains("VALUE_MISMATCH")
              | F.col("signal_type").contains("mismatch"))
    is_edge = ~is_row & ((F.col("source_validator") == "EdgeCaseValidator") | F.col("signal_type").contains("EDGE_CASE"))
    g = s.groupBy(V, "signature").agg(
        F.min(F.struct("source_validator", "signal_type", "analysis_path", "category", "subcategory", "rule_path",
                       "source_expression", "target_expression", "column")).alias("first"),
        F.bool_or(is_struct).alias("has_structural"),
        F.bool_or(is_row | is_edge).alias("has_execution"),
        F.bool_or(is_edge).alias("has_edge_case"),
        F.max(F.when(is_row, F.when(F.coalesce(F.col("mismatch_count"), F.lit(0)) > 0, F.col("mismatch_count"))
                     .otherwise(F.lit(None)))).alias("_max_rows"),
        F.count(F.when(F.col("source_validator") == "RowValidator", 1)).alias("_n_row"),
        F.bool_or(is_row).alias("_any_row"),
        F.sort_array(F.collect_set("source_validator")).alias("validator_checks"),
        F.sort_array(F.collect_set(F.when(is_row, F.col("column")))).alias("affected_output_columns"),
        F.count("*").alias("signal_count"))
    rows = F.when(F.col("_any_row"), F.coalesce(F.col("_max_rows"), F.col("_n_row").cast("long")))
    if totals is not None:
        g = g.join(totals, V, "left")
        total = F.coalesce(F.col("total_output_rows"), F.lit(0))
    else:
        total = F.lit(total_rows or 0)
    w = Window.partitionBy(V).orderBy("signature")
    out = g.select(
        V, "signature", F.col("first.category").alias("category"), F.col("first.subcategory").alias("subcategory"),
        F.when(F.col("first.analysis_path") != "", F.col("first.analysis_path"))
        .otherwise(F.col("first.rule_path")).alias("analysis_path"),
        F.col("first.source_expression").alias("source_expression"),
        F.col("first.target_expression").alias("target_expression"),
        "has_structural", "has_execution", "has_edge_case", rows.cast("long").alias("affected_row_count"),
        total.cast("long").alias("total_output_rows"), "validator_checks", "affected_output_columns",
        "signal_count")
    out = (out.withColumn("severity", severity(F.col("category"), F.coalesce(F.col("affected_row_count"), F.lit(0)),
                                               F.col("total_output_rows")))
           .withColumn("classification_confidence",
                       confidence(F.col("has_structural"), F.col("has_execution"), F.col("has_edge_case"),
                                  F.col("category") == "UNKNOWN"))
           .withColumn("affected_percentage", affected_pct(F.col("affected_row_count"), F.col("total_output_rows")))
           .withColumn("discrepancy_id", F.format_string("D-%03d", F.row_number().over(w))))
    return out


def typed_evidence(signals: DataFrame, cap: int = 100, link: bool = True, signed: bool = False) -> DataFrame:
    """ROW_DIFF / BOUNDARY_CASE / RULE_DIFF evidence per discrepancy,
    ordered by (validator, type, path).  A row difference carries its column,
    key, value and both results; a rule difference both expressions; every
    item a detail.  The first ``cap`` of a group are listed (the limit is
    applied per partition before the shuffle, so a hot group is cut there);
    ``total_count`` is the number of all, ``truncated`` says if some are left
    out.  ``signed``: the signals come from ``signed_signals``."""
    s = signals if signed else signed_signals(signals, link)
    is_row = ((F.col("source_validator") == "RowValidator") | F.col("signal_type").contains("VALUE_MISMATCH")
              | F.col("signal_type").contains("mismatch"))
    is_edge = (F.col("source_validator") == "EdgeCaseValidator") | F.col("signal_type").contains("EDGE_CASE")
    is_rule = F.col("source_validator").isin(*STRUCTURAL)
    of_group = s.groupBy(V, "signature").agg(
        F.min(F.struct("source_validator", "signal_type", "analysis_path", "category")).getField("category").alias("_gcat"),
        F.count(F.when(is_row | is_edge | is_rule, 1)).alias("total_count"))
    e = s.join(of_group, [V, "signature"]).filter(is_row | is_edge | is_rule)
    typ = (F.when(is_row, F.lit("ROW_DIFF"))
           .when(is_edge, F.when(F.col("_gcat") == "BOUNDARY_CONDITION", F.lit("BOUNDARY_CASE")).otherwise(F.lit("ROW_DIFF")))
           .otherwise(F.lit("RULE_DIFF")))
    said = (F.when(is_row, F.concat(F.lit("rows differ in "), F.coalesce("column", F.lit("a column"))))
            .when(is_edge, F.lit("an edge case gives another result")).otherwise(F.lit("the rules differ")))
    w = Window.partitionBy(V, "signature").orderBy("source_validator", "signal_type", "analysis_path", "signal_id")
    return (e.withColumn("ordinal", F.row_number().over(w)).filter(F.col("ordinal") <= cap)
            .select(V, "signature", "ordinal", typ.alias("type"), "column",
                    F.when(is_row, F.col("row_key")).alias("row_key"), F.when(is_row, F.col("value")).alias("value"),
                    F.when(is_row, F.col("source_value")).when(is_edge, F.lit(None)).when(is_rule, F.col("source_expression")).alias("source_result"),
                    F.when(is_row, F.col("target_value")).when(is_edge, F.lit(None)).when(is_rule, F.col("target_expression")).alias("target_result"),
                    F.coalesce("detail", said).alias("detail"), "total_count", (F.col("total_count") > cap).alias("truncated")))


# ------------------------------------------------------------------ G12
def diagnosis_report(discrepancies: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """G12 in long form: ``(validation_id, dimension, value, count)`` for
    every category and severity (zeros included) plus ``total`` rows
    (discrepancies, signals, affected rows)."""
    d = discrepancies
    ids = d.select(V).distinct()
    if signals is not None:
        ids = ids.unionByName(signals.select(V)).distinct()
    dims = F.array(*[F.struct(F.lit("category").alias("dimension"), F.lit(c).alias("value")) for c in CATEGORIES],
                   *[F.struct(F.lit("severity").alias("dimension"), F.lit(s).alias("value")) for s in SEVERITIES])
    grid = ids.select(V, F.explode(dims).alias("d")).select(V, "d.*")
    cat = d.groupBy(V, F.lit("category").alias("dimension"), F.col("category").alias("value")).agg(F.count("*").alias("count"))
    sev = d.groupBy(V, F.lit("severity").alias("dimension"), F.col("severity").alias("value")).agg(F.count("*").alias("count"))
    counts = grid.join(cat.unionByName(sev), [V, "dimension", "value"], "left").fillna(0, ["count"])
    tot = d.groupBy(V).agg(F.count("*").alias("n"), F.coalesce(F.sum("affected_row_count"), F.lit(0)).alias("aff"))
    totals = ids.join(tot, V, "left").fillna(0, ["n", "aff"])
    parts = [totals.select(V, F.lit("total").alias("dimension"), F.lit("discrepancies").alias("value"),
                           F.col("n").cast("long").alias("count")),
             totals.select(V, F.lit("total").alias("dimension"), F.lit("affected_rows").alias("value"),
                           F.col("aff").cast("long").alias("count"))]
    if signals is not None:
        sc = signals.groupBy(V).agg(F.count("*").alias("count"))
        parts.append(ids.join(sc, V, "left").fillna(0, ["count"]).select(
            V, F.lit("total").alias("dimension"), F.lit("signals").alias("value"), F.col("count").cast("long")))
    return reduce(DataFrame.unionByName, [counts.select(V, "dimension", "value", F.col("count").cast("long"))] + parts)


# ------------------------------------------------------------------ G13
def evidence_pack(discrepancies: DataFrame, examples: DataFrame | None = None,
                  structural: DataFrame | None = None) -> DataFrame:
    """Stable evidence ids per discrepancy, with their ``details`` (a
    map of texts).  E-001 source expression, E-002 target expression (present
    only when given), E-003 impact (always), E-004 representative example
    (``example`` of ``examples``, the first in order), E-005 structural
    differences (all ``difference`` texts of ``structural``).  Inputs are
    keyed by ``(validation_id, discrepancy_id)``."""
    d = discrepancies
    keys = [V, "discrepancy_id"]
    no_text = F.lit(None).cast("string")
    if examples is not None:
        d = d.join(examples.groupBy(*keys).agg(F.array_min(F.collect_set("example")).alias("_ex")), keys, "left")
    else:
        d = d.withColumn("_ex", no_text)
    if structural is not None:
        d = d.join(structural.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("difference")), "; ").alias("_st")), keys, "left")
    else:
        d = d.withColumn("_st", no_text)
    nonempty = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    texts = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])
    item = lambda i, t, details: F.struct(F.lit(i).alias("evidence_id"), F.lit(t).alias("evidence_type"), details.alias("details"))
    rule = lambda c: texts(expression=F.col(c), path=F.coalesce("analysis_path", F.lit("")))
    columns = {"affected_columns": F.array_join("affected_columns", ",")} if "affected_columns" in d.columns else {}
    impact = texts(category=F.col("category"), severity=F.col("severity"), affected_row_count=F.coalesce("affected_row_count", F.lit(0)),
                   affected_percentage=F.format_string("%.3f", F.coalesce("affected_percentage", F.lit(0.0))), **columns)
    items = F.array(
        F.when(nonempty("source_expression"), item("E-001", "SOURCE_EXPRESSION", rule("source_expression"))),
        F.when(nonempty("target_expression"), item("E-002", "TARGET_EXPRESSION", rule("target_expression"))),
        item("E-003", "DISCREPANCY_IMPACT", impact),
        F.when(F.col("_ex").isNotNull(), item("E-004", "REPRESENTATIVE_EXAMPLE", texts(example=F.col("_ex")))),
        F.when(F.col("_st").isNotNull(), item("E-005", "STRUCTURAL_DIFFERENCE", texts(structural_differences=F.col("_st")))))
    return (d.select(*keys, F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i"))
            .select(*keys, "i.evidence_id", "i.evidence_type", "i.details"))


def pack_inputs(discrepancies: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples and structural differences of discrepancies from their typed
    evidence (G8): the first row or boundary item, and every rule item."""
    e = discrepancies.select(V, "signature", "discrepancy_id").join(evidence, [V, "signature"])
    rule = F.col("type") == "RULE_DIFF"
    first = e.filter(~rule).withColumn("_no", F.row_number().over(Window.partitionBy(V, "discrepancy_id").orderBy("ordinal"))).filter("_no = 1")
    return (first.select(V, "discrepancy_id", F.concat_ws(" | ", "type", "row_key", "source_result", "target_result").alias("example")),
            e.filter(rule).select(V, "discrepancy_id", F.concat_ws(" -> ", "source_result", "target_result").alias("difference")))


def evidence_packs(signals: DataFrame, total_rows: int | None = None, cap: int = 100) -> DataFrame:
    """G13 from signals: the packs of their discrepancies (G7) with examples
    and structural differences from their typed evidence (G8).  Signals are
    linked, classified and signed once, and written for all three."""
    s = written(signed_signals(signals), "signed-signals")
    d = consolidate(s, total_rows=total_rows, signed=True)
    return evidence_pack(d, *pack_inputs(d, typed_evidence(s, cap, signed=True)))


# ------------------------------------------------------------------ G14
def grounding_check(claims: DataFrame, evidence: DataFrame, pack: str = "pack_id") -> DataFrame:
    """G14 per pack: valid iff the pack has evidence, has claims, every
    claim cites at least one reference and every reference exists.
    ``claims``: ``(pack_id, claim_id, evidence_ref)`` with one row per
    reference (NULL ref = claim without references); ``evidence``:
    ``(pack_id, evidence_id)``."""
    ev = evidence.select(pack, "evidence_id").distinct()
    refs = claims.filter(F.col("evidence_ref").isNotNull())
    unknown = (refs.join(ev, (refs[pack] == ev[pack]) & (refs["evidence_ref"] == ev["evidence_id"]), "left_anti")
               .groupBy(pack).agg(F.count("*").alias("unknown_refs")))
    per_claim = claims.groupBy(pack, "claim_id").agg(F.count("evidence_ref").alias("_n"))
    no_ref = per_claim.filter(F.col("_n") == 0).groupBy(pack).agg(F.count("*").alias("claims_without_refs"))
    nclaims = per_claim.groupBy(pack).agg(F.count("*").alias("claims"))
    nev = ev.groupBy(pack).agg(F.count("*").alias("evidence_items"))
    packs = ev.select(pack).unionByName(claims.select(pack)).distinct()
    j = (packs.join(nev, pack, "left").join(nclaims, pack, "left").join(no_ref, pack, "left")
         .join(unknown, pack, "left").fillna(0, ["evidence_items", "claims", "claims_without_refs", "unknown_refs"]))
    valid = ((F.col("evidence_items") > 0) & (F.col("claims") > 0) & (F.col("claims_without_refs") == 0)
             & (F.col("unknown_refs") == 0))
    return j.select(pack, "evidence_items", "claims", "claims_without_refs", "unknown_refs", valid.alias("is_valid"))


# ------------------------------------------------------------------ G15
def evidence_confidence(pack_items: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """G15 per pack: 0.50 + 0.15 (source) + 0.15 (target) + 0.10 (impact
    with affected rows > 0) + 0.08 (example), capped at 0.98."""
    keys = [V, "discrepancy_id"]
    t = F.col("evidence_type")
    g = pack_items.groupBy(*keys).agg(
        F.bool_or(t == "SOURCE_EXPRESSION").alias("_s"), F.bool_or(t == "TARGET_EXPRESSION").alias("_t"),
        F.bool_or(t == "DISCREPANCY_IMPACT").alias("_i"), F.bool_or(t == "REPRESENTATIVE_EXAMPLE").alias("_e"))
    if affected is not None:
        g = g.join(affected.select(*keys, "affected_row_count"), keys, "left")
    else:
        g = g.withColumn("affected_row_count", F.lit(None).cast("long"))
    score = (F.lit(0.50) + F.when(F.col("_s"), 0.15).otherwise(0.0) + F.when(F.col("_t"), 0.15).otherwise(0.0)
             + F.when(F.col("_i") & (F.coalesce(F.col("affected_row_count"), F.lit(0)) > 0), 0.10).otherwise(0.0)
             + F.when(F.col("_e"), 0.08).otherwise(0.0))
    return g.select(*keys, F.least(F.round(score, 2), F.lit(0.98)).alias("diagnosis_confidence"))


def repair_confidence(diag: Column, scope_valid: Column, contract_valid: Column, minimal: Column) -> Column:
    """G15 repair confidence: 0 unless scope and contract are valid, else
    ``diag * 0.95 (+0.02 if minimal)`` capped at 0.96."""
    s = diag * 0.95 + F.when(minimal, F.lit(0.02)).otherwise(F.lit(0.0))
    return F.when(~scope_valid | ~contract_valid, F.lit(0.0)).otherwise(F.least(F.round(s, 2), F.lit(0.96)))
