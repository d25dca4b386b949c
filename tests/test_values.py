"""D5 value equality follows the NULL and tolerance rules."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.values import values_equal

CASES = [
    # (a, a_type, b, b_type, expected)
    (None, "double", None, "double", True),
    (float("nan"), "double", float("nan"), "double", True),
    (None, "double", float("nan"), "double", True),
    (None, "double", 10.0, "double", False),
    (float("nan"), "double", 10.0, "double", False),
    ("NULL", "string", None, "string", False),
    ("NaN", "string", None, "string", False),
    ("nan", "string", "nan", "string", True),
    ("NULL", "string", "NULL", "string", True),
    ("10", "string", "10.0", "string", True),
    ("test", "string", " test ", "string", True),
    (10.0, "double", 11.0, "double", False),
    (100.0, "double", 100.0000001, "double", True),
    (100000.0, "double", 100000.5, "double", True),     # relative tolerance
    (100000.0, "double", 100002.0, "double", False),
    (float("inf"), "double", float("inf"), "double", True),
    ("1_000", "string", "1000", "string", False),      # not a number in our grammar
    ("abc", "string", "abd", "string", False),
]


def test_column_expression(spark):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("ad", T.DoubleType()),
                           T.StructField("bd", T.DoubleType()), T.StructField("as_", T.StringType()),
                           T.StructField("bs", T.StringType())])
    rows = []
    for i, (a, at, b, bt, _) in enumerate(CASES):
        rows.append((i, a if at == "double" else None, b if bt == "double" else None,
                     a if at == "string" else None, b if bt == "string" else None))
    df = spark.createDataFrame(rows, schema)
    out = {}
    for r in df.select("i", values_equal(F.col("ad"), T.DoubleType(), F.col("bd"), T.DoubleType()).alias("d"),
                       values_equal(F.col("as_"), T.StringType(), F.col("bs"), T.StringType()).alias("s")).collect():
        a, at, b, bt, exp = CASES[r.i]
        out[r.i] = r.d if at == "double" else r.s
        assert out[r.i] is exp, (CASES[r.i], out[r.i])


def test_numeric_vs_text_column(spark):
    df = spark.createDataFrame([(1.0, "1"), (2.5, " 2.50 "), (3.0, "x")], "a double, b string")
    got = [r.e for r in df.select(values_equal(F.col("a"), T.DoubleType(), F.col("b"), T.StringType())
                                  .alias("e")).collect()]
    assert got == [True, True, False]
    assert not math.isnan(1.0)
