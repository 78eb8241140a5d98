import hashlib
from datetime import date

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradewind.functions import money

numbers = st.lists(
    st.one_of(
        st.floats(-1e6, 1e6, allow_nan=False),
        st.integers(-10**6, 10**6).map(lambda i: i / 1000),
        st.integers(-10**5, 10**5).map(lambda i: i / 8),
    ),
    min_size=50,
    max_size=200,
)
quiet = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def column(spark, values, fn):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    return [r.r for r in df.select("i", fn(F.col("x")).alias("r")).orderBy("i").collect()]


@quiet
@given(numbers)
def test_round_exact_is_python_round(spark, values):
    for digits in (0, 1, 2, 4):
        got = column(spark, values, lambda c: money.round_exact(c, digits))
        assert [g + 0.0 for g in got] == [float(round(v, digits)) + 0.0 for v in values]


@quiet
@given(numbers)
def test_round_array_is_numpy_round(spark, values):
    got = column(spark, values, lambda c: money.round_array(c, 2))
    assert got == [float(x) for x in np.round(np.array(values), 2)]


def test_known_ties(spark):
    values = [2.5, 3.5, 1.005, 2.675, 1.425, 1.115, 0.125, -0.125, 2.45, 2.35]
    for digits in (0, 1, 2):
        assert column(spark, values, lambda c: money.round_exact(c, digits)) == [
            float(round(v, digits)) for v in values
        ]


def test_exact_sum_does_not_depend_on_order_or_size(spark):
    rows = [(1, 0.1)] * 1000 + [(1, 1e13 + 0.5), (1, -1e13), (2, None), (3, -0.0001), (3, -2.5)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {r.k: float(r.s) for r in df.groupBy("k").agg(money.exact_sum(F.col("x")).alias("s")).collect()}
    assert got == {1: 100.5, 2: 0.0, 3: -2.5001}


def test_split_sales_returns(spark):
    rows = [
        # quantity, price, total, is_return -> sales, returns
        (-2.0, 3.0, 0.0, False, 6.0, 0.0),
        (2.0, 3.0, None, False, 0.0, 0.0),
        (2.0, None, 5.0, False, 5.0, 0.0),
        (2.0, 3.0, 0.0, True, 0.0, 6.0),
        (2.0, 3.0, -7.0, True, 0.0, 7.0),
        (2.0, 3.0, -7.0, False, 0.0, 0.0),
        (2.0, 3.0, 6.0, None, 6.0, 0.0),
        (None, None, None, True, 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "q double, p double, t double, r boolean, ws double, wr double")
    s, r = money.split_sales_returns(F.col("q"), F.col("p"), F.col("t"), F.col("r"))
    assert df.filter((s != F.col("ws")) | (r != F.col("wr"))).collect() == []


def test_bands_and_percentages(spark):
    rates = [None, 9.9, 10.0, 10.1, 22.0, 22.1, 30.0, 30.1]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rates)], "i int, r double").orderBy("i")
    risk = [x.v for x in df.select(money.risk_band(F.col("r")).alias("v")).collect()]
    assert risk[1:] == ["low", "low", "medium", "medium", "high", "high", "high"]
    heat = [x.v for x in df.select(money.heat_class(F.col("r")).alias("v")).collect()]
    assert heat == ["neutral", "green", "neutral", "neutral", "neutral", "neutral", "neutral", "red"]
    one = spark.range(1)
    assert one.select(money.pct_or_zero(F.lit(5.0), F.lit(0.0))).first()[0] == 0.0
    assert one.select(money.pct_or_null(F.lit(5.0), F.lit(0.0))).first()[0] is None
    assert one.select(money.share_pct(F.lit(5.0), F.lit(0.0))).first()[0] == 500.0


def test_confidence_hash(spark):
    start, end = date(2026, 1, 1), date(2026, 1, 31)
    name = "ნიკორა (#317)"
    want = 70 + int(hashlib.md5(f"{name}|{start}|{end}".encode()).hexdigest()[:8], 16) % 11
    assert spark.range(1).select(money.confidence_hash(F.lit(name), start, end)).first()[0] == want
