"""D5 — scalar equality with NULL rules and numeric tolerance, as a
Column expression (stays inside whole-stage codegen, no UDF).

Rules: NULL and float NaN are null-like; two null-like values are equal,
one is not.  If both values read as numbers (numeric/boolean columns, or
strings matching the numeric grammar) they are equal when
``|a-b| <= abs_tol`` or ``|a-b| / max(|a|,|b|) <= rel_tol`` (exact equality,
including infinities, short-circuits to equal).  Otherwise the values are
compared as text with surrounding whitespace removed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import FRACTIONAL_TYPES, NUMERIC_TYPES

ABS_TOL = 1e-6
REL_TOL = 1e-5

# Fixed value: the accepted spelling of a number inside text.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
EDGE_SPACE = r"^\s+|\s+$"


def null_like(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, FRACTIONAL_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(c: Column, dt: T.DataType) -> Column:
    """Fold float NaN into NULL so that null-safe joins treat them alike."""
    if isinstance(dt, FRACTIONAL_TYPES):
        return F.when(F.isnan(c), F.lit(None).cast(dt)).otherwise(c)
    return c


def as_number(c: Column, dt: T.DataType) -> Column:
    """Double value when the value reads as a number, else NULL."""
    if isinstance(dt, NUMERIC_TYPES) or isinstance(dt, T.BooleanType):
        return c.cast("double")
    if isinstance(dt, T.StringType):
        return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))
    return F.lit(None).cast("double")


def as_text(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), EDGE_SPACE, "")


def values_equal(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType,
                 abs_tol: float = ABS_TOL, rel_tol: float = REL_TOL) -> Column:
    """Boolean Column, never NULL."""
    an, bn = null_like(a, a_type), null_like(b, b_type)
    x, y = as_number(a, a_type), as_number(b, b_type)
    diff = F.abs(x - y)
    top = F.greatest(F.abs(x), F.abs(y))
    numeric_eq = ((x == y) | (diff <= F.lit(abs_tol))
                  | ((top > 0) & (diff / top <= F.lit(rel_tol))))
    both_numbers = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    if isinstance(a_type, T.BooleanType) and isinstance(b_type, T.BooleanType):
        text_eq = a == b
    else:
        text_eq = as_text(a) == as_text(b)
    return (F.when(an & bn, F.lit(True))
            .when(an | bn, F.lit(False))
            .when(both_numbers, F.coalesce(numeric_eq, F.lit(False)))
            .otherwise(F.coalesce(text_eq, F.lit(False))))


def display_value(c: Column, dt: T.DataType) -> Column:
    """Evidence text of a value.  Fractional numbers are written with nine
    decimals so the text does not depend on the engine's float printer."""
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        return (F.when(d.isNull(), F.lit(None).cast("string"))
                .when(F.isnan(d), F.lit("NaN"))
                .when(F.abs(d) < 1e20, d.try_cast(T.DecimalType(38, 9)).cast("string"))
                .otherwise(d.cast("string")))
    return c.cast("string")
