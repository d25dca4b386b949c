"""F — structural comparison of query inventories, many migrations at once.

Input is a long ``components`` table of already extracted query parts:
``(migration_id, side, kind, ordinal, name, expr, is_distinct)`` with side
``SRC``/``TGT`` and kind ``table | join | filter | aggregation | rule``
(joins: name = join type, expr = condition; aggregations: name =
function; rules: expr = condition, name = result).  Extraction from SQL
text is not part of this library.  Every diff is a join or aggregation
keyed by ``migration_id``; none enumerates all pairs of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIFF_COLS = ["migration_id", "category", "source_value", "target_value", "occurrences"]
M = "migration_id"


def _side(c: DataFrame, kind: str, side: str) -> DataFrame:
    return c.filter((F.col("kind") == kind) & (F.col("side") == side))


def _set_diff(c: DataFrame, kind: str, value: Column, removed: str, added: str) -> DataFrame:
    """Set difference of ``value`` per migration (one row per distinct value)."""
    s = _side(c, kind, "SRC").select(M, value.alias("v")).distinct().withColumn("_s", F.lit(1))
    t = _side(c, kind, "TGT").select(M, value.alias("v")).distinct().withColumn("_t", F.lit(1))
    j = s.join(t, [M, "v"], "full").filter(F.col("_s").isNull() | F.col("_t").isNull())
    return j.select(M, F.when(F.col("_t").isNull(), F.lit(removed)).otherwise(F.lit(added)).alias("category"),
                    F.when(F.col("_t").isNull(), F.col("v")).alias("source_value"),
                    F.when(F.col("_s").isNull(), F.col("v")).alias("target_value"),
                    F.lit(1).cast("long").alias("occurrences"))


def diff_tables(c: DataFrame) -> DataFrame:
    """TABLE_REMOVED / TABLE_ADDED."""
    return _set_diff(c, "table", F.col("name"), "TABLE_REMOVED", "TABLE_ADDED")


def _positional(c: DataFrame, kind: str) -> DataFrame:
    s = _side(c, kind, "SRC").select(M, "ordinal", F.col("name").alias("s_name"), F.col("expr").alias("s_expr"))
    t = _side(c, kind, "TGT").select(M, "ordinal", F.col("name").alias("t_name"), F.col("expr").alias("t_expr"))
    return s.join(t, [M, "ordinal"])


def diff_joins(c: DataFrame) -> DataFrame:
    """positional pairing; JOIN_TYPE_CHANGED, JOIN_CONDITION_CHANGED;
    surplus joins on either side are ignored."""
    j = _positional(c, "join")
    items = F.array(
        F.when(~F.col("s_name").eqNullSafe(F.col("t_name")),
               F.struct(F.lit("JOIN_TYPE_CHANGED").alias("category"), F.col("s_name").alias("source_value"),
                        F.col("t_name").alias("target_value"))),
        F.when(~F.col("s_expr").eqNullSafe(F.col("t_expr")),
               F.struct(F.lit("JOIN_CONDITION_CHANGED").alias("category"), F.col("s_expr").alias("source_value"),
                        F.col("t_expr").alias("target_value"))))
    return (j.select(M, F.explode(F.filter(items, lambda x: x.isNotNull())).alias("d"))
            .select(M, "d.*", F.lit(1).cast("long").alias("occurrences")))


def diff_filters(c: DataFrame) -> DataFrame:
    """FILTER_REMOVED / FILTER_ADDED on the expression text."""
    return _set_diff(c, "filter", F.col("expr"), "FILTER_REMOVED", "FILTER_ADDED")


# Comparison operators probed in order by F4.
OPERATORS = (">", ">=", "<", "<=", "=", "!=")


def operator_changed(c: DataFrame, scope: str = "name") -> DataFrame:
    """a (source filter, target filter) pair of the same scope is an
    OPERATOR_CHANGED when some operator occurs in the source text and not in
    the target text (the texts then differ).  Filters of equal text are one
    row with their number; a source text is listed under the operators it
    has, a target text under those it lacks, and the two meet under an
    operator; one row per pair of texts, ``occurrences`` is the number of
    pairs of filters."""
    def texts(side: str, n: str, listed: bool) -> DataFrame:
        expr = F.col("expr")
        ops = F.filter(F.array(*[F.when(expr.contains(op) == F.lit(listed), F.lit(i)) for i, op in enumerate(OPERATORS)]), lambda x: x.isNotNull())
        return (_side(c, "filter", side).groupBy(M, F.col(scope).alias("_scope"), "expr").agg(F.count(F.lit(1)).alias(n))
                .select(M, "_scope", F.col("expr").alias(f"{n}_text"), n, F.explode(ops).alias("_op")))

    pairs = texts("SRC", "_ns", True).join(texts("TGT", "_nt", False), [M, "_scope", "_op"])
    one = pairs.groupBy(M, "_scope", "_ns_text", "_nt_text").agg(F.max(F.col("_ns") * F.col("_nt")).alias("_n"))
    return one.groupBy(M, F.col("_ns_text").alias("source_value"), F.col("_nt_text").alias("target_value")).agg(F.sum("_n").alias("occurrences")).select(
        M, F.lit("OPERATOR_CHANGED").alias("category"), "source_value", "target_value", F.col("occurrences").cast("long"))


def diff_aggregations(c: DataFrame) -> DataFrame:
    """set difference on ``function(expr)``; AGGREGATION_CHANGED for
    pairs with the same function and expression whose DISTINCT flag
    differs (counted per pair through the flag groups)."""
    label = F.concat(F.col("name"), F.lit("("), F.col("expr"), F.lit(")"))
    sd = _set_diff(c, "aggregation", label, "AGGREGATION_REMOVED", "AGGREGATION_ADDED")
    g = lambda side: (_side(c, "aggregation", side)
                      .groupBy(M, "name", "expr", F.col("is_distinct").alias(f"_d{side}"))
                      .agg(F.count("*").alias(f"_n{side}")))
    j = g("SRC").join(g("TGT"), [M, "name", "expr"]).filter(F.col("_dSRC") != F.col("_dTGT"))
    ch = j.select(M, F.lit("AGGREGATION_CHANGED").alias("category"),
                  F.concat(F.lit("distinct="), F.col("_dSRC").cast("string")).alias("source_value"),
                  F.concat(F.lit("distinct="), F.col("_dTGT").cast("string")).alias("target_value"),
                  (F.col("_nSRC") * F.col("_nTGT")).cast("long").alias("occurrences"))
    return sd.unionByName(ch)


def diff_rules(c: DataFrame) -> DataFrame:
    """CASE_RULE_CHANGED for a changed rule count and for each
    position whose condition or result differs."""
    s = _side(c, "rule", "SRC").groupBy(M).agg(F.count("*").alias("_ns"))
    t = _side(c, "rule", "TGT").groupBy(M).agg(F.count("*").alias("_nt"))
    cnt = (s.join(t, M, "full").fillna(0, ["_ns", "_nt"]).filter(F.col("_ns") != F.col("_nt"))
           .select(M, F.lit("CASE_RULE_CHANGED").alias("category"), F.col("_ns").cast("string").alias("source_value"),
                   F.col("_nt").cast("string").alias("target_value"), F.lit(1).cast("long").alias("occurrences")))
    p = _positional(c, "rule").filter(~F.col("s_expr").eqNullSafe(F.col("t_expr"))
                                      | ~F.col("s_name").eqNullSafe(F.col("t_name")))
    pos = p.select(M, F.lit("CASE_RULE_CHANGED").alias("category"),
                   F.concat_ws(" THEN ", "s_expr", "s_name").alias("source_value"),
                   F.concat_ws(" THEN ", "t_expr", "t_name").alias("target_value"),
                   F.lit(1).cast("long").alias("occurrences"))
    return cnt.unionByName(pos)


def diff_null_semantics(c: DataFrame, kind: str = "null") -> DataFrame:
    """one NULL_SEMANTICS_CHANGED per migration whose set of
    (expr, name) of ``kind`` differs between the sides (a set comparison
    by full outer join, no collection)."""
    s = _side(c, kind, "SRC").select(M, "expr", "name").distinct().withColumn("_s", F.lit(1))
    t = _side(c, kind, "TGT").select(F.col(M).alias("_tm"), F.col("expr").alias("_te"),
                                     F.col("name").alias("_tn")).distinct().withColumn("_t", F.lit(1))
    j = s.join(t, [F.col(M) == F.col("_tm"), F.col("expr").eqNullSafe(F.col("_te")),
                   F.col("name").eqNullSafe(F.col("_tn"))], "full")
    d = (j.select(F.coalesce(F.col(M), F.col("_tm")).alias(M), (F.col("_s").isNull() | F.col("_t").isNull()).alias("_d"))
         .groupBy(M).agg(F.max(F.col("_d").cast("int")).alias("_d")).filter(F.col("_d") == 1))
    return d.select(M, F.lit("NULL_SEMANTICS_CHANGED").alias("category"),
                    F.lit(None).cast("string").alias("source_value"), F.lit(None).cast("string").alias("target_value"),
                    F.lit(1).cast("long").alias("occurrences"))


def structural_diff(c: DataFrame, null_kind: str = "null") -> DataFrame:
    """F8: union of F1–F7.

    All but F4 in one pass: a component is written under each rule that
    looks at it, with the key by which that rule compares the sides; one
    aggregation per (migration, rule, key) sees both sides, and the rows
    follow from its counts.  Only what a rule must show is carried: the texts
    of a position (F2, F6) and the null predicates of a query (F7)."""
    kind, name, expr = F.col("kind"), F.col("name"), F.col("expr")
    lane = lambda rule, k, key: F.when(kind == k, F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(None).cast("string").alias("key2")))
    label = F.concat(name, F.lit("("), expr, F.lit(")"))
    pair = F.when(kind == "aggregation", F.struct(F.lit("distinct").alias("rule"), name.alias("key"), expr.alias("key2")))
    lanes = F.array(lane("table", "table", name), lane("filter", "filter", expr), lane("aggregation", "aggregation", label), pair, lane("join", "join", F.col("ordinal")),
                    lane("rule", "rule", F.col("ordinal")), lane("rules", "rule", F.lit("")), lane("null", null_kind, F.lit("")))
    each = c.filter(F.col("side").isin("SRC", "TGT")).select(M, "side", "name", "expr", "is_distinct", F.explode(F.filter(lanes, lambda x: x.isNotNull())).alias("l"))
    of = lambda side, cond=None: F.count(F.when((F.col("side") == side) if cond is None else (F.col("side") == side) & cond, 1))
    shown = lambda side: F.collect_set(F.when((F.col("side") == side) & F.col("l.rule").isin("join", "rule", "null"), F.struct("name", "expr")))
    flag = F.col("is_distinct")
    g = each.groupBy(M, "l").agg(of("SRC").alias("ns"), of("TGT").alias("nt"), of("SRC", flag).alias("st"), of("SRC", ~flag).alias("sf"),
                                 of("TGT", flag).alias("tt"), of("TGT", ~flag).alias("tf"), shown("SRC").alias("s"), shown("TGT").alias("t"))
    rule, key = F.col("l.rule"), F.col("l.key")
    null = F.lit(None).cast("string")
    row = lambda when, category, s, t, n=F.lit(1).cast("long"): F.when(when, F.struct(
        F.lit(category).alias("category"), s.cast("string").alias("source_value"), t.cast("string").alias("target_value"), n.cast("long").alias("occurrences")))
    gone, new = F.col("nt") == 0, F.col("ns") == 0
    rows = []
    for k in ("table", "filter", "aggregation"):
        rows += [row((rule == k) & gone, f"{k.upper()}_REMOVED", key, null), row((rule == k) & new, f"{k.upper()}_ADDED", null, key)]
    both = (F.size("s") > 0) & (F.size("t") > 0)
    s, t = F.get("s", F.lit(0)), F.get("t", F.lit(0))
    other = lambda c: ~s[c].eqNullSafe(t[c])
    then = lambda x: F.concat_ws(" THEN ", x["expr"], x["name"])
    dist = lambda v: F.lit(f"distinct={v}")
    rows += [
        row((rule == "join") & both & other("name"), "JOIN_TYPE_CHANGED", s["name"], t["name"]),
        row((rule == "join") & both & other("expr"), "JOIN_CONDITION_CHANGED", s["expr"], t["expr"]),
        row((rule == "rule") & both & (other("name") | other("expr")), "CASE_RULE_CHANGED", then(s), then(t)),
        row((rule == "rules") & (F.col("ns") != F.col("nt")), "CASE_RULE_CHANGED", F.col("ns"), F.col("nt")),
        row((rule == "distinct") & (F.col("st") * F.col("tf") > 0), "AGGREGATION_CHANGED", dist("true"), dist("false"), F.col("st") * F.col("tf")),
        row((rule == "distinct") & (F.col("sf") * F.col("tt") > 0), "AGGREGATION_CHANGED", dist("false"), dist("true"), F.col("sf") * F.col("tt")),
        row((rule == "null") & (F.array_sort("s") != F.array_sort("t")), "NULL_SEMANTICS_CHANGED", null, null)]
    found = g.select(M, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("d")).select(M, "d.*")
    return found.select(*DIFF_COLS).unionByName(operator_changed(c).select(*DIFF_COLS))


def structural_summary(c: DataFrame, null_kind: str = "null") -> DataFrame:
    """Per migration: number of diffs and the identical flag."""
    mig = c.select(M).distinct()
    d = structural_diff(c, null_kind).groupBy(M).agg(F.sum("occurrences").alias("n_diffs"))
    return (mig.join(d, M, "left").fillna(0, ["n_diffs"])
            .withColumn("is_identical", F.col("n_diffs") == 0))


def rule_check(spark, components: DataFrame | None, null_kind: str = "null") -> DataFrame:
    """per migration, score ``max(0, 1 - 0.2 n)`` over the structural
    diffs; FAIL is HIGH; SKIPPED (score 1.0) when no analysis is given."""
    if components is None:
        from ..session import literal_rows
        return literal_rows(
            spark, [("BusinessRuleValidator", "SKIPPED", "INFO", 1.0, 0, "no components of both queries to compare")],
            "check_name string, status string, severity string, score double, mismatch_count long, summary string")
    s = structural_summary(components, null_kind)
    n = F.col("n_diffs")
    return s.select(M, F.lit("BusinessRuleValidator").alias("check_name"),
                    F.when(n == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
                    F.when(n == 0, F.lit("INFO")).otherwise(F.lit("HIGH")).alias("severity"),
                    F.round(F.greatest(F.lit(0.0), F.lit(1.0) - n * F.lit(0.2)), 4).alias("score"),
                    n.cast("long").alias("mismatch_count"))


def rule_check_sides(components: DataFrame) -> DataFrame:
    """F9 over many migrations where some lack a side: SKIPPED rows for
    migrations missing SRC or TGT components, checked rows otherwise."""
    sides = components.groupBy(M).agg(F.count_distinct("side").alias("_sides"))
    full = components.join(sides.filter(F.col("_sides") == 2).select(M), M, "left_semi")
    checked = rule_check(components.sparkSession, full)
    skipped = sides.filter(F.col("_sides") < 2).select(
        M, F.lit("BusinessRuleValidator").alias("check_name"), F.lit("SKIPPED").alias("status"),
        F.lit("INFO").alias("severity"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("mismatch_count"))
    return checked.unionByName(skipped)


# ---------------------------------------------------------------- F10
# Comparison operators tried in order when splitting a condition.
SPLIT_OPERATORS = (">=", "<=", "!=", "<>", ">", "<", "=")


def split_condition(cond: Column) -> Column:
    """struct(type, operator, left, right) of a condition text."""
    op = None
    for o in SPLIT_OPERATORS:
        op = F.when(cond.contains(o), F.lit(o)) if op is None else op.when(cond.contains(o), F.lit(o))
    up = F.upper(cond)
    null_op = F.when(up.contains("IS NOT NULL"), F.lit("IS NOT NULL")).when(up.contains("IS NULL"), F.lit("IS NULL"))
    oper = op.otherwise(null_op)
    is_cmp = op.otherwise(F.lit(None)).isNotNull()
    left = right = None
    for o in SPLIT_OPERATORS:
        lo = F.trim(F.substring_index(cond, o, 1))
        ro = F.trim(cond.substr(F.length(F.substring_index(cond, o, 1)) + F.lit(len(o) + 1), F.lit(1 << 30)))
        left = F.when(oper == o, lo) if left is None else left.when(oper == o, lo)
        right = F.when(oper == o, ro) if right is None else right.when(oper == o, ro)
    left = left.when(null_op.isNotNull(), F.trim(F.substring_index(cond, "IS", 1)))
    right = right.when(null_op.isNotNull(), F.lit(""))
    typ = F.when(is_cmp, F.lit("comparison")).when(null_op.isNotNull(), F.lit("null_check")).otherwise(F.lit("expression"))
    return F.struct(typ.alias("type"), oper.alias("operator"), left.alias("left"), right.alias("right"))


# ---------------------------------------------------------------- F11
def resolve_references(refs: DataFrame, catalog: DataFrame, ctes: DataFrame | None = None) -> DataFrame:
    """F11 detail rows ``(query_id, kind, table_name, column_name)``.

    ``refs``: ``(query_id, table_name, column_name, scope_table)`` where
    ``table_name`` is NULL for an unqualified column and ``scope_table``
    lists the tables the query reads.  ``catalog``: ``(table_name,
    column_name)``.  Names compare case-insensitively.  A query with an
    unresolved table reports only its tables (kind ``TABLE``); otherwise
    qualified columns must exist in their table and unqualified columns in
    at least one referenced table (kind ``COLUMN``); duplicates removed.
    ``ctes``: optional ``(query_id, name)``; their names and the columns
    they qualify are not checked."""
    r = refs.select("query_id", F.lower("table_name").alias("t"), F.lower("column_name").alias("c"),
                    F.col("table_name"), F.col("column_name"), F.lower("scope_table").alias("scope"))
    cat = catalog.select(F.lower("table_name").alias("ct"), F.lower("column_name").alias("cc")).distinct()
    cat_t = cat.select(F.col("ct").alias("scope")).distinct()
    scopes = r.select("query_id", "scope").distinct()
    if ctes is not None:
        scopes = scopes.join(ctes.select("query_id", F.lower("name").alias("scope")), ["query_id", "scope"],
                             "left_anti")
    unresolved = scopes.join(cat_t, "scope", "left_anti")
    bad_t = unresolved.select("query_id", F.lit("TABLE").alias("kind"), F.col("scope").alias("table_name"),
                              F.lit(None).cast("string").alias("column_name"))
    ok_q = r.select("query_id").distinct().join(unresolved.select("query_id").distinct(), "query_id", "left_anti")
    rr = r.join(ok_q, "query_id", "left_semi")
    qual = rr.filter(F.col("t").isNotNull())
    if ctes is not None:
        qual = qual.join(ctes.select("query_id", F.lower("name").alias("t")), ["query_id", "t"], "left_anti")
    qual = (qual.join(cat, (F.col("t") == F.col("ct")) & (F.col("c") == F.col("cc")), "left_anti")
            .select("query_id", F.lit("COLUMN").alias("kind"), F.col("t").alias("table_name"), "column_name"))
    # unqualified: the column must exist in one of the query's tables
    qs = scopes.join(ok_q, "query_id", "left_semi")
    have = qs.join(cat, F.col("scope") == F.col("ct")).select("query_id", F.col("cc").alias("c")).distinct()
    unq = (rr.filter(F.col("t").isNull()).join(have, ["query_id", "c"], "left_anti")
           .select("query_id", F.lit("COLUMN").alias("kind"), F.lit(None).cast("string").alias("table_name"),
                   "column_name"))
    cols = qual.unionByName(unq)
    cols = cols.dropDuplicates(["query_id", "table_name", "column_name"])
    return bad_t.unionByName(cols)


def preflight_status(refs: DataFrame, catalog: DataFrame, ctes: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """F11 per query: PASS, or FAILED with ``INPUT_SCHEMA_MISMATCH``, or with
    ``DATASET_NOT_FOUND`` (nothing else checked) for a query that is not in
    ``known``, the queries whose dataset exists."""
    d = resolve_references(refs, catalog, ctes)
    per = d.groupBy("query_id").agg(F.count(F.when(F.col("kind") == "TABLE", 1)).alias("unresolved_tables"),
                                    F.count(F.when(F.col("kind") == "COLUMN", 1)).alias("missing_columns"))
    q = refs.select("query_id").distinct().join(per, "query_id", "left").fillna(0, ["unresolved_tables",
                                                                                     "missing_columns"])
    if known is not None:
        q = q.join(known.select("query_id").distinct().withColumn("_known", F.lit(True)), "query_id", "left")
    lost = F.col("_known").isNull() if known is not None else F.lit(False)
    bad = lost | ((F.col("unresolved_tables") + F.col("missing_columns")) > 0)
    count = lambda c: F.when(lost, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    return q.select("query_id", F.when(bad, F.lit("FAILED")).otherwise(F.lit("PASS")).alias("status"),
                    F.when(lost, F.lit("DATASET_NOT_FOUND")).when(bad, F.lit("INPUT_SCHEMA_MISMATCH")).alias("failure_category"),
                    count("unresolved_tables"), count("missing_columns"), (~bad).alias("execution_allowed"))


# ---------------------------------------------------------------- F12
# Whole-token keywords that make a query not read-only.
FORBIDDEN_KEYWORDS = ("ATTACH", "DETACH", "COPY", "INSTALL", "LOAD", "EXPORT")
MUTATING_KEYWORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE")


def screen_read_only(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """F12 (keyword tier): ``(id, violation, keywords)``; an empty text is
    a violation, otherwise the sorted forbidden words found.  A word ends at
    any sign that is not a letter, digit or underscore, so a verb next to a
    bracket or semicolon counts."""
    words = F.array(*[F.lit(w) for w in FORBIDDEN_KEYWORDS + MUTATING_KEYWORDS])
    tokens = F.split(F.upper(F.col(text_col)), r"[^A-Z0-9_]+")
    hits = F.array_sort(F.array_distinct(F.filter(tokens, lambda x: F.array_contains(words, x))))
    empty = F.coalesce(strip_col(F.col(text_col)) == "", F.lit(True))
    return df.select(F.col(id_col), F.when(empty, F.lit("EMPTY_QUERY"))
                     .when(F.size(hits) > 0, F.lit("FORBIDDEN_KEYWORD")).alias("violation"),
                     F.when(empty, F.lit("")).otherwise(F.array_join(hits, ",")).alias("keywords"))


def strip_col(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# ---------------------------------------------------------------- F17
def dedupe_transformations(t: DataFrame) -> DataFrame:
    """``(migration_id, seq, type, source, target)`` rows grouped by
    stripped (source, target).  The type of the first occurrence (lowest
    seq) wins; occurrences count only rows of that type."""
    k = t.select(M, "seq", "type", "source", "target", strip_col(F.col("source")).alias("_s"),
                 strip_col(F.col("target")).alias("_t"))
    per_type = k.groupBy(M, "_s", "_t", "type").agg(
        F.min(F.struct("seq", "source", "target")).alias("first"), F.count("*").alias("n"))
    g = per_type.groupBy(M, "_s", "_t").agg(
        F.min(F.struct(F.col("first.seq").alias("seq"), F.col("type"), F.col("first.source").alias("source"),
                       F.col("first.target").alias("target"), F.col("n"))).alias("w"))
    return g.select(M, "w.type", "w.source", "w.target", F.col("w.n").alias("occurrences"))


def transformation_counts(t: DataFrame) -> DataFrame:
    """F17 counts per migration; assumptions are counted apart."""
    d = dedupe_transformations(t)
    return d.groupBy(M).agg(F.count(F.when(F.col("type") != "ASSUMPTION", 1)).alias("transformation_count"),
                            F.count(F.when(F.col("type") == "ASSUMPTION", 1)).alias("assumption_count"))


# ------------------------------------------------------------ F14-F16
# Clause tables: (query_id, side BEFORE|AFTER, kind, ordinal, alias, text)
# with kind JOIN / WHERE / GROUP BY / SELECT / TABLE.
Q = "query_id"


def _flags(clauses: DataFrame) -> DataFrame:
    """Per query: which of four clause kinds have another text at some
    position, in one pass: both sides of a position meet, then a query's
    positions."""
    kinds = ("JOIN", "WHERE", "GROUP BY", "SELECT")
    at = lambda side: F.collect_set(F.when(F.col("kind").isin(*kinds) & (F.col("side") == side), F.col("text")))
    place = clauses.groupBy(Q, "kind", "ordinal").agg(at("BEFORE").alias("b"), at("AFTER").alias("a"))
    place = place.select(Q, "kind", (F.array_sort("b") != F.array_sort("a")).alias("differs"))
    return place.groupBy(Q).agg(*[F.coalesce(F.max((F.col("kind") == k) & F.col("differs")), F.lit(False)).alias(f"changed_{k.replace(' ', '_').lower()}") for k in kinds])


def changed_regions(clauses: DataFrame) -> DataFrame:
    """F16: ``(query_id, regions)`` — the changed clause kinds among
    where_clause, select_projections, group_by_clause, join_clause (in that
    order), or ``columns`` when none changed."""
    f = _flags(clauses)
    arr = F.filter(F.array(F.when(F.col("changed_where"), F.lit("where_clause")),
                           F.when(F.col("changed_select"), F.lit("select_projections")),
                           F.when(F.col("changed_group_by"), F.lit("group_by_clause")),
                           F.when(F.col("changed_join"), F.lit("join_clause"))), lambda x: x.isNotNull())
    return f.select(Q, F.when(F.size(arr) == 0, F.lit("columns")).otherwise(F.array_join(arr, ",")).alias("regions"))


def contract_check(clauses: DataFrame) -> DataFrame:
    """output aliases (lower-case, in order) must be equal when both
    sides have any, and the referenced table sets must be equal."""
    sel = clauses.filter(F.col("kind") == "SELECT").withColumn("alias", F.lower("alias"))
    b = sel.filter(F.col("side") == "BEFORE").select(Q, "ordinal", F.col("alias").alias("b"))
    a = sel.filter(F.col("side") == "AFTER").select(Q, "ordinal", F.col("alias").alias("a"))
    al = (b.join(a, [Q, "ordinal"], "full").groupBy(Q)
          .agg(F.count("b").alias("_nb"), F.count("a").alias("_na"),
               F.max((~F.col("b").eqNullSafe(F.col("a"))).cast("int")).alias("_d")))
    tb = clauses.filter(F.col("kind") == "TABLE").select(Q, "side", F.lower("alias").alias("t")).distinct()
    ts = (tb.filter(F.col("side") == "BEFORE").select(Q, "t", F.lit(1).alias("_b"))
          .join(tb.filter(F.col("side") == "AFTER").select(Q, "t", F.lit(1).alias("_a")), [Q, "t"], "full")
          .groupBy(Q).agg(F.max((F.col("_b").isNull() | F.col("_a").isNull()).cast("int")).alias("_td")))
    j = clauses.select(Q).distinct().join(al, Q, "left").join(ts, Q, "left")
    alias_bad = (F.coalesce(F.col("_nb"), F.lit(0)) > 0) & (F.coalesce(F.col("_na"), F.lit(0)) > 0) & (F.col("_d") == 1)
    table_bad = F.coalesce(F.col("_td"), F.lit(0)) == 1
    reason = F.when(alias_bad, F.lit("ALIASES_CHANGED")).when(table_bad, F.lit("TABLES_CHANGED"))
    return j.select(Q, reason.isNull().alias("contract_valid"), reason.alias("violation"))


def scope_check(clauses: DataFrame, regions: DataFrame) -> DataFrame:
    """first failing rule per query, given ``regions (query_id,
    changed_region)``: JOIN changed outside a join region, any GROUP BY
    change, WHERE changed outside a where region, a projection of another
    alias changed (unless the region is select/columns)."""
    f = _flags(clauses).join(regions.select(Q, F.lower(F.coalesce("changed_region", F.lit("columns")))
                                            .alias("region")), Q, "left") \
        .withColumn("region", F.coalesce("region", F.lit("columns")))
    sel = clauses.filter(F.col("kind") == "SELECT").withColumn("alias", F.lower("alias")).filter(
        F.col("alias").isNotNull() & (F.col("alias") != ""))
    # alias -> text per side; the last occurrence of an alias stands for it
    last = lambda side: F.array_max(F.collect_list(F.when(F.col("side") == side, F.struct("ordinal", "text"))))["text"]
    proj = sel.groupBy(Q, "alias").agg(last("BEFORE").alias("before"), last("AFTER").alias("after")).join(f.select(Q, "region"), Q) \
        .filter((F.col("before") != F.col("after")) & ~F.col("region").contains(F.col("alias"))
                & ~F.col("alias").contains(F.col("region")) & ~F.col("region").isin("select", "columns"))
    bad_proj = proj.groupBy(Q).agg(F.min("alias").alias("_alias"))
    j = f.join(bad_proj, Q, "left")
    reason = (F.when(F.col("changed_join") & ~F.col("region").contains("join"), F.lit("JOIN_CHANGED"))
              .when(F.col("changed_group_by"), F.lit("GROUP_BY_CHANGED"))
              .when(F.col("changed_where") & ~F.col("region").contains("where"), F.lit("WHERE_CHANGED"))
              .when(F.col("_alias").isNotNull(), F.lit("PROJECTION_CHANGED")))
    return j.select(Q, "region", reason.isNull().alias("scope_valid"), reason.alias("violation"))


# ---------------------------------------------------------------- F18
def candidate_screen(p: DataFrame) -> DataFrame:
    """first failure reason per proposal, else CANDIDATE_ACCEPTED.

    Columns: ``proposal_id, status, proposed_sql, original_sql, stored_sql,
    syntax_ok, read_only_ok, has_select, discrepancy_id, tables_ok,
    contract_ok, scope_ok, proposal_fingerprint, expected_fingerprint``;
    the parser-backed facts (syntax, read-only, select, tables, contract,
    scope) come in as booleans."""
    def col(c, t="string"):
        return F.col(c) if c in p.columns else F.lit(None).cast(t)

    prop = strip_col(F.coalesce(col("proposed_sql"), F.lit("")))
    orig = strip_col(F.coalesce(col("original_sql"), F.lit("")))
    norm = lambda x: F.regexp_replace(x, r"\s+", " ")
    semi = lambda x: strip_col(F.regexp_replace(strip_col(x), r";+$", ""))
    t = lambda c: F.coalesce(col(c, "boolean"), F.lit(True))
    reason = (F.when(F.coalesce(col("status"), F.lit("")) != "PROPOSED", F.lit("STATUS_NOT_PROPOSED"))
              .when(prop == "", F.lit("EMPTY_PROPOSED_SQL"))
              .when(orig == "", F.lit("MISSING_ORIGINAL_TARGET_SQL"))
              .when(norm(orig) == norm(prop), F.lit("UNCHANGED_REPAIR_SQL"))
              .when(col("stored_sql").isNotNull() & (semi(col("stored_sql")) != semi(prop)),
                    F.lit("REPAIR_ARTIFACT_MISMATCH"))
              .when(~t("syntax_ok"), F.lit("SQL_SYNTAX_ERROR"))
              .when(~t("read_only_ok"), F.lit("READ_ONLY_VIOLATION"))
              .when(~t("has_select"), F.lit("SCHEMA_INCONSISTENCY"))
              .when(F.coalesce(col("discrepancy_id"), F.lit("")) == "", F.lit("UNKNOWN_DISCREPANCY_MAPPING"))
              .when(~t("tables_ok"), F.lit("MISSING_REQUIRED_TABLE"))
              .when(~t("contract_ok"), F.lit("CONTRACT_ALIAS_MISMATCH"))
              .when(~t("scope_ok"), F.lit("SCOPE_CONSTRAINT_VIOLATION"))
              .when(col("expected_fingerprint").isNotNull() & col("proposal_fingerprint").isNotNull()
                    & (col("expected_fingerprint") != col("proposal_fingerprint")),
                    F.lit("DISCREPANCY_FINGERPRINT_MISMATCH"))
              .otherwise(F.lit("CANDIDATE_ACCEPTED")))
    return p.select("proposal_id", (reason == "CANDIDATE_ACCEPTED").alias("accepted"), reason.alias("reason"))
