"""Capacity checks are exact: nothing is rounded on the way, and they never raise."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation, localcontext

import pytest
from pyspark.sql import functions as F

from carryover.functions.transforms import SPARK_TYPES
from carryover.operators import prechecks as P
from carryover.spec import ColumnInfo

TEXTS = ["0", "-0", "007", "1.0", "1.50", "-1.5", "1.00000000001", "1e3", "15e-1", "1500e-2", "1e-40", "1e400", "127", "128", "-128", "-129", "255", "256",
         "8388607", "8388608", "16777215", "16777216", "4294967295", "4294967296", "9007199254740993", "9223372036854775807", "9223372036854775808",
         "-9223372036854775808", "18446744073709551615", "18446744073709551616", "9" * 30, "9" * 31, "9" * 38, "9" * 39, "9" * 60, ".5", "5.", "", " ", "x", "1x", "+3", None]


def fits(text, info):
    try:
        value = Decimal(text.strip())
    except InvalidOperation:
        return False
    if info.type in P.INTEGER_RANGE:
        low, high = P.INTEGER_RANGE[info.type]
        return value == value.to_integral_value() and low <= value <= high if abs(value.adjusted()) < 100 or not value else False
    with localcontext(prec=500):
        digits, behind = value.normalize().as_tuple()[1:]
    return not value or (-behind <= info.scale and len(digits) + behind <= info.precision - info.scale)


@pytest.mark.parametrize("info", [*(ColumnInfo(t) for t in P.INTEGER_RANGE), ColumnInfo("decimal", precision=30, scale=0), ColumnInfo("decimal", precision=38, scale=0),
                                  ColumnInfo("decimal", precision=6, scale=1), ColumnInfo("decimal", precision=38, scale=20)])
def test_text_into_numbers(spark, info):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    lost = {r.i for r in df.where(P.out_of_capacity(F.col("t"), info)).collect()}
    assert lost == {i for i, t in enumerate(TEXTS) if t is not None and not fits(t, info)}


def test_numbers_into_floats(spark):
    df = spark.sql("SELECT 9007199254740992 AS even, 9007199254740993 AS odd, 0.1BD AS tenth, 0.5BD AS half, CAST('NaN' AS DOUBLE) AS nan, 16777217 AS wide")
    count = lambda c, t: df.where(P.out_of_capacity(F.col(c), ColumnInfo(t))).count()
    assert [count(c, "double") for c in ("even", "odd", "tenth", "half")] == [0, 1, 0, 0]
    assert [count(c, "float") for c in ("half", "tenth", "wide")] == [0, 1, 1]


@pytest.mark.parametrize("digits", range(7))
def test_every_fraction(spark, digits):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2020-01-02 03:04:05.123456' AS at, TIMESTAMP_NTZ '2020-01-02 03:04:05' AS plain, '03:04:05.1200' AS clock")
    lost = lambda c, t: df.where(P.temporal_loss(F.col(c), ColumnInfo(t), digits)).count()
    assert lost("at", "datetime") == (digits < 6) and lost("plain", "datetime") == 0 and lost("clock", "time") == (digits < 2)
    with pytest.raises(ValueError):
        P.temporal_loss(F.col("at"), ColumnInfo("datetime"), 7)


def test_every_integer_has_a_type():
    assert set(P.INTEGER_RANGE) <= set(SPARK_TYPES)


@pytest.mark.parametrize("dtype", ["decimal(12,2)", "decimal(38,18)", "decimal(38,0)", "bigint", "int"])
def test_arithmetic_and_text_agree(spark, dtype):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(F.col("t").try_cast("decimal(38,18)").try_cast(dtype).alias("v")).where("v IS NOT NULL")
    kinds = [*(ColumnInfo(t) for t in P.INTEGER_RANGE), ColumnInfo("decimal", precision=6, scale=1), ColumnInfo("decimal", precision=3, scale=3), ColumnInfo("decimal", precision=38, scale=0),
             ColumnInfo("float"), ColumnInfo("double")]
    row = df.agg(*[F.count_if(P.out_of_capacity(F.col("v"), k) != P.out_of_capacity(F.col("v"), k, dtype)).alias(f"d{i}") for i, k in enumerate(kinds)]).first()
    assert set(row) == {0}
