import pytest
from pyspark.sql import functions as F

from creditloom.functions.columns import col
from creditloom.operators import company, market

SCHEMA = "`Company Code` string, Year int, Rating string, Score double, ROA double, note string"


@pytest.fixture(scope="module")
def panel(spark):
    rows = [
        ("a", 2010, " aa", 0.5, 0.1, "x"),
        ("a", 2010, "aa", 0.7, None, "y"),
        ("a", 2012, None, 0.6, 0.0, None),
        ("a", 2013, "junk", 0.9, 0.3, None),
        ("b", 2010, "BBB", 60.0, 0.2, "z"),
        (None, 2013, "d", None, float("nan"), "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_market_kpis(panel):
    row = market.market_kpis(panel).first()
    assert (row["n_entities"], row["n_rows"]) == (3, 6)
    assert row["mean_score"] == pytest.approx((0.5 + 0.7 + 0.6 + 0.9 + 60) / 5)
    assert market.distinct_years(panel).count() == 3
    assert [r[0] for r in market.distinct_entities(panel).collect()] == ["a", "b"]


def test_distribution_is_dense(panel):
    rows = {r["rating"]: r for r in market.rating_distribution(panel).collect()}
    assert len(rows) == 11
    assert (rows["AA"]["n"], rows["NAN"]["n"], rows["AAA"]["n"]) == (2, 2, 0)
    assert sum(r["share_pct"] for r in rows.values()) == pytest.approx(100, abs=0.06)
    chosen = market.rating_distribution(panel, years=[2013])
    assert chosen.agg(F.sum("n")).first()[0] == 2
    assert market.rating_distribution_by_year(panel).count() == 33


def test_distribution_of_nothing(panel):
    rows = market.rating_distribution(panel.limit(0)).collect()
    assert [r["n"] for r in rows] == [0] * 11
    assert {r["share_pct"] for r in rows} == {None}


def test_rating_by_year(panel):
    rows = market.rating_by_year(panel).collect()
    assert [(r["Year"], r["AA"], r["BBB"], r["D"], r["NAN"]) for r in rows] == [
        (2010, 2, 1, 0, 0),
        (2012, 0, 0, 0, 1),
        (2013, 0, 0, 1, 1),
    ]


def test_densify_without_groups(spark):
    df = spark.createDataFrame([("a", 3)], "k string, n bigint")
    found = market.densify_domain(df, ["a", "b"], "k", "n")
    assert sorted(map(tuple, found.collect())) == [("a", 3), ("b", 0)]


def test_merged_records(spark):
    rows = [
        ("a", 2010, 1.0, "u", None),
        ("a", 2010, 3.0, "t", None),
        ("a", 2010, None, None, None),
        ("b", 2011, float("nan"), "v", True),
    ]
    df = spark.createDataFrame(
        rows, "`Company Code` string, Year int, x double, s string, f boolean"
    )
    found = company.merge_records(df)
    assert found.columns == df.columns
    assert found.schema["f"].dataType.simpleString() == "boolean"
    assert sorted(map(tuple, found.collect())) == [
        ("a", 2010, 2.0, "t", None),
        ("b", 2011, None, "v", True),
    ]


def test_merge_with_missing_keys(panel):
    found = company.merge_records(panel)
    assert found.count() == 5
    row = found.where("`Company Code` is null").first()
    assert (row["Rating"], row["Score"], row["ROA"]) == ("d", None, None)


def test_growth_over_gaps(spark):
    rows = [("a", 2010, 1.0), ("a", 2012, None), ("a", 2013, 0.0), ("a", 2014, 2.0)]
    df = spark.createDataFrame(rows, "`Company Code` string, Year int, v double")
    filled = company.growth_pct(df, ["v"]).orderBy("Year").collect()
    assert [r["v growth %"] for r in filled] == [None, 0.0, -100.0, None]
    plain = company.growth_pct(df, ["v"], ffill=False).orderBy("Year").collect()
    assert [r["v growth %"] for r in plain] == [None, None, None, None]


def test_score_against_market(panel):
    rows = {(r[0], r[1]): r for r in company.score_vs_market(panel).collect()}
    market_2010 = (0.5 + 0.7 + 60.0) / 3
    a = rows[("a", 2010)]
    assert a["company_score"] == pytest.approx(0.6)
    assert a["market_score"] == pytest.approx(market_2010)
    assert a["difference"] == pytest.approx(0.6 - market_2010)
    both_fractions = rows[("a", 2012)]
    assert both_fractions["company_score"] == pytest.approx(60.0)
    assert rows[(None, 2013)]["company_score"] is None


def test_metrics_against_market(panel):
    rows = company.metrics_vs_market(panel, order=["Score"]).collect()
    by_key = {(r[0], r[1]): r for r in rows}
    assert {r["metric"] for r in rows} == {"ROA"}
    assert by_key[("a", 2010)]["company_value"] == 0.1
    assert by_key[("a", 2010)]["market_value"] == pytest.approx(0.15)
    assert by_key[(None, 2013)]["company_value"] == 0.0
    assert company.metrics_vs_market_long(panel).count() == 2 * len(rows)


def test_cards(panel):
    row = company.metric_cards(company.merge_records(panel)).where("Year = 2012").first()
    assert (row["Rating"], row["Score"]) == ("NAN", "60.00")


def test_group_rows(spark):
    df = spark.createDataFrame(
        [("a", 2010, 0.25, "n/a", " aa")],
        "`Company Code` string, Year int, ROA double, Cash string, Rating string",
    )
    rows = [tuple(r)[2:] for r in company.metric_group_long(df).collect()]
    assert ("Profitability", "ROA", 0.25, "25.00%") in rows
    assert ("Profitability", "Rating", None, " aa") in rows
    assert ("Liquidity", "Cash", None, "n/a") in rows
    exact = company.metric_group_long(df, exact_only=True)
    assert exact.where("metric = 'Rating'").count() == 0


def test_trend_and_pivot(panel):
    trend = company.yearly_trend(panel)
    assert trend.columns == ["Company Code", "Year", "Score", "ROA"]
    long = company.comparison_pivot(panel, ["ROA", "Rating", "ROA", "absent"])
    assert long.count() == 5
    assert {r["indicator"] for r in long.collect()} == {"ROA"}


def test_detail(panel):
    assert [r["Year"] for r in company.entity_detail(panel, "a", all_years=True).collect()] == [
        2013,
        2012,
        2010,
        2010,
    ]
    assert [r["Year"] for r in company.entity_detail(panel, "a").collect()] == [2013]
    assert company.entity_detail(panel, "a", year_value=2010).count() == 2


def test_rows_without_a_year(spark):
    rows = [("x", None, "A", 10.0), ("x", 2010, "A", 20.0), ("x", 2011, "B", 30.0), ("x", 2012, "B", 60.0)]
    df = spark.createDataFrame(rows, "`Company Code` string, Year int, Rating string, ROA double")
    grown = {r["Year"]: r["ROA growth %"] for r in company.growth_pct(df, ["ROA"]).collect()}
    assert grown == {2010: None, 2011: 50.0, 2012: 100.0}
    some = {r["Year"]: r["ROA growth %"] for r in company.growth_pct(df, ["ROA"], years=[2010, 2012]).collect()}
    assert some == {2010: None, 2012: 200.0}
    years = lambda found: {r["Year"] for r in found.collect()}
    for found in (
        market.rating_by_year(df),
        market.rating_distribution_by_year(df),
        company.yearly_trend(df, ["ROA"]),
        company.comparison_pivot(df, ["ROA"]),
    ):
        assert years(found) == {2010, 2011, 2012}
