import pytest
from pyspark.sql import functions as F

from creditloom.catalog import RATING_DOMAIN
from creditloom.functions import columns as c
from creditloom.functions.formatting import fixed2, format_magnitude, format_metric, thousands2
from creditloom.operators import clip, filters


def one(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_dirty_ratings(spark):
    df = spark.createDataFrame(
        [("\tAAA ",), (" bb",), ("n/r",), ("",), (None,), (" Ccc",)], "r string"
    )
    found = one(df, c.normalize_rating(F.col("r")))
    assert found == ["AAA", "BB", "NAN", "NAN", "NAN", "CCC"]
    assert one(df, c.rating_ordinal(c.normalize_rating(F.col("r")))) == [1, 5, 11, 11, 11, 7]
    assert one(df, c.ig_label(F.col("r"))) == [1, 0, 0, 0, 0, 0]


def test_rating_order_is_the_scale(spark):
    df = spark.createDataFrame([(r,) for r in RATING_DOMAIN], "r string")
    assert one(df, c.rating_ordinal(F.col("r"))) == list(range(1, 12))


def test_dirty_numbers(spark):
    texts = ["1.5", " 1.5 ", "1e3", "1.5d", "n/a", "1,000", "NaN", "inf", "", None, "-.5", "5."]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    expected = [1.5, 1.5, 1000.0, None, None, None, None, float("inf"), None, None, -0.5, 5.0]
    assert one(c.coerce_numeric(df, ["x"]), "x") == expected


def test_numbers_by_type(spark):
    df = spark.createDataFrame(
        [(float("nan"), 1, True), (2.5, None, None)], "a double, b int, c boolean"
    )
    rows = [tuple(r) for r in c.coerce_numeric(df, ["a", "b", "c"]).collect()]
    assert rows == [(None, 1.0, 1.0), (2.5, None, None)]


def test_dirty_years(spark):
    df = spark.createDataFrame([("2010",), ("2010.0",), ("x",), (None,), ("NaN",), ("2010d",), ("2010f",)], "y string")
    assert one(df, c.normalize_year(F.col("y"))) == [2010, 2010, None, None, None, None, None]
    numbers = spark.createDataFrame([(2010.0, 2011), (float("nan"), None)], "y double, z int")
    assert one(numbers, c.normalize_year(F.col("y"))) == [2010, None]
    assert one(numbers, c.normalize_year(F.col("z"))) == [2011, None]


def test_column_names_with_any_characters(spark):
    df = spark.createDataFrame([(1.0,)], ["a.b `c` (d)'s"])
    assert one(c.coerce_numeric(df, df.columns), c.col(df.columns[0])) == [1.0]


@pytest.mark.parametrize(
    "value", [0.125, 2.675, 1.005, -0.001, 0.375, 462785.19499999995, 1e15 / 3, 0.0, 123456.785]
)
def test_text_is_the_rounded_binary_value(spark, value):
    df = spark.createDataFrame([(value,)], "x double")
    assert one(df, fixed2(F.col("x"))) == [f"{value:.2f}"]
    assert one(df, thousands2(F.col("x"))) == [f"{value:,.2f}"]


def test_metric_text(spark):
    df = spark.createDataFrame(
        [("ROA", 0.1234), ("Gross Profit Margin", 12.5), ("Cash", 1234567.891), ("ROE", None)],
        "n string, v double",
    )
    found = one(df, format_metric(F.col("n"), F.col("v")))
    assert found == ["12.34%", "12.50%", "1,234,567.89", "N/A"]


def test_magnitudes(spark):
    values = [2.5e9, -3e6, 1000.0, 999.99, 0.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = one(df, format_magnitude(F.col("v")))
    assert found == ["2.50 tỷ", "-3.00 tr", "1.00 nghìn", "999.99", "0.00", "N/A", "N/A"]


def test_rescale(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (-0.1,), (None,)], "v double")
    assert one(df, c.rescale_score(F.col("v"))) == [50.0, 100.0, 1.5, -0.1, None]


def test_winsorize_tails(spark):
    rows = [(float(i), None) for i in range(10000)] + [(None, None), (float("nan"), None)]
    df = spark.createDataFrame(rows, "x double, empty double")
    out = clip.winsorize_all(df, ["x", "empty", "absent"])
    low, high, n = out.agg(F.min("x"), F.max("x"), F.count("x")).first()
    assert (low, high, n) == (pytest.approx(99.99), pytest.approx(9899.01), 10000)
    assert out.where("x is null").count() == 2


def test_winsorize_by_sketch(spark):
    df = spark.range(10000).select(F.col("id").cast("double").alias("x"))
    out = clip.winsorize(df, "x", relative_error=0.0001)
    low, high = out.agg(F.min("x"), F.max("x")).first()
    assert abs(low - 99.99) < 3 and abs(high - 9899.01) < 3


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", 2001, 1.0), ("a", 2003, 2.0), ("a", 2004, 3.0), ("a", 2004, 4.0), ("a", 2009, 5.0)]
    rows += [("b", 2020, 6.0), (None, 2020, 7.0), ("c", None, 8.0)]
    return spark.createDataFrame(rows, "`Company Code` string, Year int, v double")


def test_years(small, rows_of):
    assert filters.filter_years(small, []).count() == 8
    assert filters.filter_years(small, ["2004"]).count() == 2
    assert filters.recent_years(small, 11).count() == 3
    empty_years = small.where("Year is null")
    assert filters.recent_years(empty_years).count() == 1


def test_last_years_of_each_company(small):
    kept = filters.last_k_entity_years(small, 2)
    assert sorted(r["v"] for r in kept.collect()) == [3.0, 4.0, 5.0, 6.0]


def test_last_years_without_broadcast(small, monkeypatch):
    from creditloom.operators import joins

    monkeypatch.setattr(joins.lookup_join, "__defaults__", ("inner", 0))
    kept = filters.last_k_entity_years(small, 2)
    assert sorted(r["v"] for r in kept.collect()) == [3.0, 4.0, 5.0, 6.0]


def test_rows_of_one_company(small):
    assert filters.entity_rows(small, "a").count() == 5
    first = filters.entity_year_row(small, "a", 2004).collect()
    assert [r["v"] for r in first] == [3.0]
    assert filters.entity_year_row(small, "a", 1900).count() == 0


def test_complete_cases(spark):
    df = spark.createDataFrame([("1", 1.0), ("x", 1.0), ("2", float("nan"))], "a string, b double")
    assert [tuple(r) for r in filters.complete_cases(df, ["a", "b"]).collect()] == [(1.0, 1.0)]


def test_valid_labels(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "label double")
    assert filters.valid_labels(df).count() == 2
