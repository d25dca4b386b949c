"""SQL text helpers used only to write the DuckDB oracles of the driver
queries (the Spark side never parses SQL built here)."""

from __future__ import annotations

from ..functions.values import ABS_TOL, NUMERIC_TEXT, REL_TOL


def num(x: str, kind: str) -> str:
    if kind == "num":
        return f"CAST({x} AS DOUBLE)"
    if kind == "str":
        return f"(CASE WHEN regexp_matches({x}, '{NUMERIC_TEXT}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"
    return "CAST(NULL AS DOUBLE)"


def null_like(x: str, kind: str) -> str:
    if kind == "num":
        return f"({x} IS NULL OR isnan(CAST({x} AS DOUBLE)))"
    return f"({x} IS NULL)"


def text(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def values_equal(a: str, ak: str, b: str, bk: str, abs_tol: float = ABS_TOL,
                 rel_tol: float = REL_TOL) -> str:
    x, y = num(a, ak), num(b, bk)
    return (f"(CASE WHEN {null_like(a, ak)} AND {null_like(b, bk)} THEN TRUE "
            f"WHEN {null_like(a, ak)} OR {null_like(b, bk)} THEN FALSE "
            f"WHEN {x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({x}) AND NOT isnan({y}) THEN "
            f"coalesce({x} = {y} OR abs({x} - {y}) <= {abs_tol!r} OR "
            f"(greatest(abs({x}), abs({y})) > 0 AND abs({x} - {y}) / greatest(abs({x}), abs({y})) <= {rel_tol!r}), FALSE) "
            f"ELSE coalesce({text(a)} = {text(b)}, FALSE) END)")


def display(x: str, kind: str) -> str:
    if kind == "num":
        return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'NaN' "
                f"WHEN abs({x}) < 1e20 THEN CAST(CAST({x} AS DECIMAL(38,9)) AS VARCHAR) "
                f"ELSE CAST({x} AS VARCHAR) END)")
    return f"CAST({x} AS VARCHAR)"


# ------------------------------------------------------- residual pairing
def _canon(c: str) -> str:
    d = f"CAST({c} AS DOUBLE)"
    e = f"floor(log10(abs({d})))"
    return (f"CASE WHEN {c} IS NULL THEN 'null' WHEN abs({d}) < 0.1 THEN CAST(floor({d} * 1000000 + 0.5) AS VARCHAR) "
            f"ELSE CAST({e} AS VARCHAR) || ':' || CAST(floor({d} / power(10.0, {e}) * 100000 + 0.5) AS VARCHAR) END")


def pairing_ctes(src: str, tgt: str, key: str, cols: list[str]) -> str:
    """Residual pairing of two tables with numeric columns: ``key_counts``,
    ``pairs`` (key, s_<c>, t_<c>, n; one side NULL: unpaired, ``side`` 2
    means both).  Copies are intervals in value order; two rows meet where
    their intervals overlap."""
    cl = ", ".join(cols)
    order = ", ".join(f"{c} NULLS FIRST" for c in cols)
    canon = [_canon(c) for c in cols]

    def meet(name: str, rows: str, group: str) -> str:
        """``name``: rows with their interval; ``name_p``: pairs; ``name_l``: what is left."""
        total = lambda s: f"sum(CASE WHEN side = {s} THEN n ELSE 0 END) OVER (PARTITION BY {group})"
        return f"""{name} AS (SELECT *, least({total(0)}, {total(1)}) AS m,
 coalesce(sum(n) OVER (PARTITION BY {group}, side ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM {rows}),
{name}_p AS (SELECT a.{key}, {', '.join(f'a.{c} AS s_{c}' for c in cols)}, {', '.join(f'b.{c} AS t_{c}' for c in cols)}, 2 AS side,
 least(a.f + a.n, b.f + b.n) - greatest(a.f, b.f) AS n FROM {name} a JOIN {name} b
 ON {' AND '.join(f'a.{g} = b.{g}' for g in group.split(', '))} AND a.side = 0 AND b.side = 1 AND a.f < b.f + b.n AND b.f < a.f + a.n),
{name}_l AS (SELECT {key}, {cl}, side, f + n - greatest(f, m) AS n FROM {name} WHERE f + n > greatest(f, m))"""

    sig = [" || '|' || ".join(["'" + str(j) + "'"] + [c for i, c in enumerate(canon) if i != j]) for j in range(len(cols))]
    each = " UNION ALL ".join(f"SELECT *, {j} AS j, {s} AS sig FROM al_l" for j, s in enumerate(sig))
    return f"""key_counts AS (SELECT {key}, sum(a) AS ks, sum(b) AS kt FROM (SELECT {key}, 1 AS a, 0 AS b FROM {src} UNION ALL SELECT {key}, 0, 1 FROM {tgt}) GROUP BY {key}),
residual AS (SELECT {key}, {cl}, side, count(*) AS n FROM (
  SELECT *, 0 AS side FROM (SELECT {key}, {cl} FROM {src} EXCEPT ALL SELECT {key}, {cl} FROM {tgt})
  UNION ALL SELECT *, 1 FROM (SELECT {key}, {cl} FROM {tgt} EXCEPT ALL SELECT {key}, {cl} FROM {src}))
 WHERE {key} IN (SELECT {key} FROM key_counts WHERE ks > 0 AND kt > 0) GROUP BY ALL),
al_in AS (SELECT *, {" || '|' || ".join(canon)} AS sig FROM residual),
{meet('al', 'al_in', f'{key}, sig')},
each_one AS ({each}),
met AS (SELECT *, min(side) OVER (PARTITION BY {key}, j, sig) <> max(side) OVER (PARTITION BY {key}, j, sig) AS ok FROM each_one),
first_one AS (SELECT *, min(CASE WHEN ok THEN j END) OVER (PARTITION BY {key}, {cl}, side) AS jj FROM met),
on_in AS (SELECT {key}, {cl}, side, n, sig FROM first_one WHERE j = jj),
{meet('on1', 'on_in', f'{key}, sig')},
re_in AS (SELECT * FROM on1_l UNION ALL SELECT {key}, {cl}, side, n FROM first_one WHERE jj IS NULL AND j = 0),
{meet('re', 're_in', key)},
pairs AS (SELECT * FROM al_p UNION ALL SELECT * FROM on1_p UNION ALL SELECT * FROM re_p
 UNION ALL SELECT {key}, {cl}, {', '.join('NULL' for _ in cols)}, 0, n FROM re_l WHERE side = 0
 UNION ALL SELECT {key}, {', '.join('NULL' for _ in cols)}, {cl}, 1, n FROM re_l WHERE side = 1)"""


def greedy_ctes(src: str, tgt: str, key: str, cols: list[str]) -> str:
    """The same tables by the rule itself, for a WITH RECURSIVE: of a key's
    residual rows the pair with the most equal columns goes first (ties:
    first source row, then first target row, in value order), then the
    next."""
    cl, order = ", ".join(cols), ", ".join(f"{c} NULLS FIRST" for c in cols)
    rest = lambda a, b, n: f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS {n} FROM (SELECT {key}, {cl} FROM {a} EXCEPT ALL SELECT {key}, {cl} FROM {b})
 WHERE {key} IN (SELECT {key} FROM key_counts WHERE ks > 0 AND kt > 0)"""  # noqa: E731
    n_equal = " + ".join(f"CASE WHEN {values_equal('rs.' + c, 'num', 'rt.' + c, 'num')} THEN 1 ELSE 0 END" for c in cols)
    none = ", ".join("NULL" for _ in cols)
    return f"""key_counts AS (SELECT {key}, sum(a) AS ks, sum(b) AS kt FROM (SELECT {key}, 1 AS a, 0 AS b FROM {src} UNION ALL SELECT {key}, 0, 1 FROM {tgt}) GROUP BY {key}),
rs AS MATERIALIZED ({rest(src, tgt, 'i')}),
rt AS MATERIALIZED ({rest(tgt, src, 'j')}),
ed AS MATERIALIZED (SELECT rs.{key} AS k, i, j, {n_equal} AS n FROM rs JOIN rt ON rs.{key} = rt.{key}),
walk(k, us, ut, i, j) AS (
  SELECT DISTINCT k, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM ed
  UNION ALL SELECT k, list_append(us, i), list_append(ut, j), i, j FROM (
    SELECT w.k, w.us, w.ut, e.i, e.j, row_number() OVER (PARTITION BY w.k ORDER BY e.n DESC, e.i, e.j) AS r
    FROM walk w JOIN ed e ON e.k = w.k WHERE NOT list_contains(w.us, e.i) AND NOT list_contains(w.ut, e.j)) WHERE r = 1),
taken AS (SELECT k, i, j FROM walk WHERE i IS NOT NULL),
pairs AS (SELECT *, count(*) AS n FROM (
  SELECT rs.{key}, {', '.join(f'rs.{c} AS s_{c}' for c in cols)}, {', '.join(f'rt.{c} AS t_{c}' for c in cols)}, 2 AS side
  FROM taken JOIN rs ON rs.{key} = k AND rs.i = taken.i JOIN rt ON rt.{key} = k AND rt.j = taken.j
  UNION ALL SELECT {key}, {cl}, {none}, 0 FROM rs WHERE NOT EXISTS (SELECT 1 FROM taken WHERE k = rs.{key} AND taken.i = rs.i)
  UNION ALL SELECT {key}, {none}, {cl}, 1 FROM rt WHERE NOT EXISTS (SELECT 1 FROM taken WHERE k = rt.{key} AND taken.j = rt.j)) GROUP BY ALL)"""


def pairing_summary(src: str, tgt: str, cols: list[str]) -> str:
    """The D11 row from the tables of ``pairing_ctes``."""
    equal = [values_equal("s_" + c, "num", "t_" + c, "num") for c in cols]
    diff = " + ".join(f"CASE WHEN {e} THEN 0 ELSE 1 END" for e in equal)
    return f""", tot AS (SELECT (SELECT count(*) FROM {src}) AS src_rows, (SELECT count(*) FROM {tgt}) AS tgt_rows,
  (SELECT count(*) FROM key_counts WHERE ks > 0 AND kt > 0) AS rows_compared,
  (SELECT count(*) FROM (SELECT * FROM {src} INTERSECT ALL SELECT * FROM {tgt})) + (SELECT coalesce(sum(n), 0) FROM pairs WHERE side = 2 AND {diff} = 0) AS rows_matched,
  (SELECT count(*) FROM key_counts WHERE kt = 0) AS missing_keys, (SELECT count(*) FROM key_counts WHERE ks = 0) AS extra_keys,
  (SELECT count(*) FROM key_counts WHERE ks > 0 AND kt > 0 AND (ks > 1 OR kt > 1)) AS duplicate_key_warnings,
  (SELECT coalesce(sum(n), 0) FROM pairs WHERE side < 2) AS unpaired_rows, (SELECT coalesce(sum(n * ({diff})), 0) FROM pairs WHERE side = 2) AS differing_cells,
  (SELECT max(ks) FROM key_counts) AS mks, (SELECT max(kt) FROM key_counts) AS mkt),
mis AS (SELECT *, missing_keys + extra_keys + unpaired_rows + differing_cells AS mismatch_count FROM tot),
one AS (SELECT *, (missing_keys = 0 AND extra_keys = 0 AND src_rows = tgt_rows AND mks <= 1 AND mkt <= 1) AS one_to_one FROM mis)
SELECT src_rows, tgt_rows, rows_compared, CAST(rows_matched AS BIGINT) AS rows_matched, missing_keys, extra_keys, duplicate_key_warnings,
 CAST(unpaired_rows AS BIGINT) AS unpaired_rows, CAST(differing_cells AS BIGINT) AS differing_cells, CAST(mismatch_count AS BIGINT) AS mismatch_count, one_to_one,
 round(least(1.0, CASE WHEN one_to_one THEN greatest(0.0, (src_rows - mismatch_count) / src_rows) ELSE rows_matched / src_rows END), 4) AS score,
 CASE WHEN mismatch_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM one"""
