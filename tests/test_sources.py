import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from creditloom.catalog import METRIC_GROUPS
from creditloom.sources import panel_io, resolve


def test_entity_column():
    assert resolve.detect_entity(["x", "Company", "Company Code"]) == "Company Code"
    assert resolve.detect_entity(["x", "Company"]) == "Company"
    assert resolve.detect_entity(["Ticker", "ROA"]) == "Ticker"
    assert resolve.detect_entity(["ROA", "Ticker"]) is None


def test_rating_column():
    assert resolve.detect_rating(["Credit Rating", " RATING "]) == " RATING "
    assert resolve.detect_rating(["x", "Credit Rating"]) == "Credit Rating"
    assert resolve.detect_rating(["x"]) is None


def test_metric_groups():
    columns = ["Company Code", "roa", "Cash", "Operating Cash Flow"]
    find = resolve.resolve_metric_group
    assert find(columns, ["ROA", "ROA"]) == ["roa"]
    assert find(["cash flow", "Cash"], ["Cash"]) == ["Cash"]
    assert find(["cash flow", "net cash"], ["Cash"]) == ["cash flow"]
    assert find(columns, ["Cash and Cash Equivalents", "Cash Equivalents"]) == ["Cash"]
    assert find(columns, ["Cash and Cash Equivalents", "Cash"], exact_only=True) == ["Cash"]
    assert find(columns, METRIC_GROUPS["Coverage"], exact_only=True) == []


def test_usable_features(spark):
    df = spark.createDataFrame([("x", 1.0, None), ("2", None, None)], "ROA string, ROE double, `Quick Ratio` double")
    assert resolve.usable_features(df) == ["ROA", "ROE"]
    assert resolve.usable_features(df.select("ROA").limit(0)) == []
    assert resolve.feature_subset(["ROE", "Score"], ["ROA", "ROE"]) == ["ROE"]
    assert resolve.feature_subset([], ["ROA"]) == ["ROA"]


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException):
        panel_io.read_panel(spark, str(tmp_path / "none.csv"))


def test_csv_with_year(spark, tmp_path):
    path = str(tmp_path / "panel.csv")
    with open(path, "w") as out:
        out.write("Company,Year,Rating,ROA\nx,2010.0,AAA,0.1\ny,bad,B,\n")
    panel, entity = panel_io.read_and_expand(spark, path)
    assert entity == "Company"
    assert panel.schema["Year"].dataType.simpleString() == "int"
    found = sorted((r["Company"], r["Year"], r["ROA"]) for r in panel.collect())
    assert found == [("x", 2010, 0.1), ("y", None, None)]


def test_csv_without_year_is_expanded(spark, tmp_path):
    source, target = str(tmp_path / "raw.csv"), str(tmp_path / "out")
    with open(source, "w") as out:
        out.write("Company Code,Rating,ROA\n2,B,0.3\n1,AAA,0.2\n1,AA,0.1\n")
    written = panel_io.export_expanded(spark, source, target)
    assert written.count() == 2 * 15
    years = written.agg(F.min("Year"), F.max("Year"), F.count_distinct("Year")).first()
    assert tuple(years) == (2010, 2024, 15)
    assert written.where("`Company Code` = 1").select("Rating").distinct().collect()[0][0] == "AA"


def test_generated_ids(spark):
    raw = spark.createDataFrame([(0.1,), (0.2,)], ["ROA"]).repartition(2)
    panel, entity = panel_io.to_panel(raw, 2020, 2021)
    assert entity == "Company"
    assert panel.count() == 4
    assert panel.select("Company").distinct().count() == 2


def test_one_row_per_company_by_order(spark):
    raw = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "e string, o int, v string")
    found = panel_io.one_row_per_entity(raw, "e", ["o"])
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, "y"), ("b", 3, None)]


@pytest.mark.parametrize("fmt", ["csv", "parquet", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(
        [("a", 2010, " aa", 1.5), ("b", 2011, None, None)],
        "`Company Code` string, Year int, Rating string, `Gross Profit` double",
    )
    path = str(tmp_path / fmt)
    panel_io.write_panel(df, path, fmt=fmt)
    panel_io.write_panel(df, path, fmt=fmt)
    back = panel_io.read_panel(spark, path, df.schema, fmt=fmt)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_single_file_and_partitions(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("Company"), (F.col("id") % 3).cast("int").alias("Year"))
    one, many = tmp_path / "one", tmp_path / "many"
    panel_io.write_panel(df.repartition(4), str(one), fmt="csv", single_file=True)
    assert len(list(one.glob("part-*"))) == 1
    panel_io.write_panel(df.repartition(4), str(many), partition_by=["Year"])
    assert sorted(p.name for p in many.glob("Year=*")) == ["Year=0", "Year=1", "Year=2"]
    assert panel_io.read_panel(spark, str(many), fmt="parquet").count() == 1000
    assert panel_io.panel_counts(df).first()["n_rows"] == 1000
    assert panel_io.sample_rows(df).count() == 5
