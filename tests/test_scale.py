"""Hot keys, other partitionings, and plans."""

import os
import re

import pytest
from pyspark.sql import functions as F

from creditloom.functions.columns import col, ig_label
from creditloom.operators import (
    clip,
    company,
    evaluate,
    features,
    filters,
    joins,
    market,
    models,
    peers,
    running,
)

PACKAGE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "creditloom")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows are one company in one year, and copies of one another."""
    hot = spark.range(1000).select(
        F.lit(1).cast("bigint").alias("Company Code"),
        F.lit(2020).alias("Year"),
        F.lit(" aaa").alias("Rating"),
        F.lit(0.5).alias("Score"),
        F.lit(1.25).alias("ROA"),
        F.lit("x").alias("note"),
    )
    i = F.col("id")
    rest = spark.range(2000).select(
        (i % 97 + 2).alias("Company Code"),
        (i % 5 + 2016).cast("int").alias("Year"),
        F.element_at(F.array(*map(F.lit, ["AA", "b", "CCC ", "?"])), (i % 4 + 1).cast("int")).alias("Rating"),
        ((i % 101) / 100).alias("Score"),
        (i % 13).cast("double").alias("ROA"),
        F.when(i % 3 == 0, "y").when(i % 3 == 1, "x").alias("note"),
    )
    return hot.union(rest).cache()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(skewed, rows_of, how):
    table = skewed.where("`Company Code` < 50").groupBy("Company Code").agg(F.avg("ROA").alias("mean"))
    keyless = skewed.withColumn("Company Code", F.when(F.col("ROA") > 2, F.col("Company Code")))
    for rows in (skewed, keyless):
        plain = rows_of(rows.join(table, "Company Code", how))
        for other in (
            joins.salted_join(rows.repartition(9), table, ["Company Code"], how, salts=4),
            joins.salted_join(rows, table, ["Company Code"], how, share=0.1),
            joins.lookup_join(rows, table, ["Company Code"], how, max_cells=3),
            joins.lookup_join(rows, table, ["Company Code"], how),
        ):
            assert rows_of(other) == plain


def test_salted_join_on_two_keys(skewed, rows_of):
    table = skewed.groupBy("Company Code", "Year").agg(F.count(F.lit(1)).alias("n"))
    on = ["Company Code", "Year"]
    assert rows_of(joins.salted_join(skewed, table, on, share=0.1)) == rows_of(skewed.join(table, on))


def test_hot_key_is_spread(skewed):
    assert [tuple(r) for r in joins.hot_keys(skewed, ["Company Code"], 0.1).collect()] == [(1,)]
    table = skewed.groupBy("Company Code").agg(F.avg("ROA").alias("mean"))
    rows = skewed.where("`Company Code` = 1").repartition(8)
    joined = joins.salted_join(rows, table, ["Company Code"], share=0.1, salts=64)
    joined.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    joined.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = joins.salted_join(rows, table, ["Company Code"], share=0.1, salts=64)
        tasks = again.groupBy(F.spark_partition_id()).count().collect()
    finally:
        joined.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        joined.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in tasks) == 1000
    assert len(tasks) >= 3


def test_lookup_join_checks_the_size(skewed):
    table = skewed.groupBy("Company Code").agg(F.avg("ROA").alias("mean"))
    small = joins.lookup_join(skewed, table, ["Company Code"])._jdf.queryExecution().toString()
    large = joins.lookup_join(skewed, table, ["Company Code"], max_cells=5)
    assert "BroadcastHashJoin" in small
    assert "__salt" in large._jdf.queryExecution().toString()


def brute_running(pairs):
    total, out = 0, {}
    for x, n in sorted(pairs, reverse=True):
        total += n
        out[x] = total
    return out


@pytest.mark.parametrize("range_rows", [1_000_000, 50, 7])
def test_running_sums(spark, range_rows):
    pairs = [(float((i * 7919) % 1009), i % 5) for i in range(1000)]
    df = spark.createDataFrame(pairs, "x double, n bigint")
    found = running.running_sums(df, "x", ["n"], range_rows=range_rows)
    assert {r["x"]: r["cum_n"] for r in found.collect()} == brute_running(pairs)


def labelled(df):
    return df.withColumn("label", ig_label(col("Rating")))


def operators():
    yield "distribution", lambda d: market.rating_distribution(d)
    yield "by year", lambda d: market.rating_by_year(d)
    yield "long", lambda d: market.rating_distribution_by_year(d)
    yield "kpis", lambda d: market.market_kpis(d)
    yield "last years", lambda d: filters.last_k_entity_years(d, 2)
    yield "recent", lambda d: filters.recent_years(d, 1)
    yield "merge", lambda d: company.merge_records(d)
    yield "growth", lambda d: company.growth_pct(d, ["Score", "ROA"])
    yield "score", lambda d: company.score_vs_market(d)
    yield "metrics", lambda d: company.metrics_vs_market(d)
    yield "winsorize", lambda d: clip.winsorize_all(d, ["Score", "ROA"], p=0.9)
    yield "split", lambda d: features.split_stratified(labelled(d))
    yield "roc", lambda d: evaluate.roc_points(labelled(d), score="Score")
    yield "sweep", lambda d: evaluate.threshold_sweep(labelled(d), score="Score")
    yield "segments", lambda d: models.kmeans_segments(d, ["Score", "ROA"])
    yield "peers", lambda d: peers.all_peers(d, ["Score", "ROA"], n=3, block_points=64)
    yield "forest", lambda d: models.train_rf(labelled(d), ["Score", "ROA"], trees=4).forest.nodes


@pytest.mark.parametrize("operator", [f for _, f in operators()], ids=[n for n, _ in operators()])
def test_partitioning_does_not_matter(skewed, operator):
    def result(df):
        rounded = [
            F.round(col(f.name), 9) if f.dataType.simpleString() == "double" else col(f.name)
            for f in df.schema
        ]
        return sorted((tuple(r) for r in df.select(*rounded).collect()), key=repr)

    first = result(operator(skewed.repartition(1)))
    assert result(operator(skewed.repartition(17))) == first
    assert first


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, skewed, tmp_path):
    path = str(tmp_path / "panel")
    skewed.write.partitionBy("Year").parquet(path)
    scan = spark.read.parquet(path)
    text = plan(filters.filter_years(filters.entity_rows(scan, "7"), [2019]).select("ROA"))
    assert "PartitionFilters: [isnotnull(Year" in text or "PartitionFilters: [Year" in text
    assert "EqualTo(`Company Code`,7)" in text
    assert "ReadSchema: struct<Company Code:bigint,ROA:double>" in text


def test_one_shuffle_for_the_distribution(skewed):
    assert plan(market.rating_distribution(skewed)).count("Exchange") == 1
    assert plan(market.rating_distribution_by_year(skewed)).count("Exchange") == 1


def test_top_k_is_not_a_full_sort(skewed):
    from creditloom.operators.anomaly import top_anomalies

    assert "TakeOrderedAndProject" in plan(top_anomalies(skewed, 5, score="ROA"))


def sources():
    """All modules but those of ``llm``, which has a test of its own."""
    for folder, _, names in os.walk(PACKAGE):
        if os.path.relpath(folder, PACKAGE).split(os.sep)[0] == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                path = os.path.join(folder, name)
                yield os.path.relpath(path, PACKAGE), open(path, encoding="utf-8").read()


def test_rows_stay_on_the_cluster():
    """Bounded results only reach the driver, each at a place known here."""
    allowed = {
        ("operators/quantiles.py", "collect"): 4,
        ("operators/explain.py", "collect"): 1,
        ("operators/joins.py", "collect"): 1,
        ("operators/lr_grid.py", "collect"): 2,
        ("operators/neighbours.py", "collect"): 2,
        ("operators/forest.py", "collect"): 4,
        ("operators/anomaly.py", "toPandas"): 1,
        ("operators/segments.py", "collect"): 2,
        ("sources/resolve.py", "collect"): 1,
    }
    found = {}
    for path, text in sources():
        for call in ("collect", "toPandas", "toLocalIterator"):
            n = len(re.findall(rf"\.{call}\(", text))
            if n:
                found[(path.replace(os.sep, "/"), call)] = n
        assert "localCheckpoint" not in text
        assert "crossJoin" not in text
    assert found == allowed


def test_panel_is_built_in_small_tasks(spark, monkeypatch, tmp_path):
    from creditloom.plans import panel as module

    folder = str(tmp_path)
    ids = spark.range(300)
    tables = {
        "customer": ids.selectExpr("id AS c_custkey", "100.0D * id AS c_acctbal"),
        "part": ids.selectExpr("id AS p_partkey", "10.0D AS p_retailprice"),
        "orders": ids.selectExpr(
            "id AS o_orderkey", "id % 50 AS o_custkey",
            "CAST('1995-06-01' AS TIMESTAMP) AS o_orderdate",
        ),
        "lineitem": spark.range(900).selectExpr(
            "id % 300 AS l_orderkey", "id % 300 AS l_partkey", "'R' AS l_returnflag",
            "'O' AS l_linestatus", "5.0D * id AS l_extendedprice", "0.1D AS l_discount",
            "0.05D AS l_tax", "2.0D AS l_quantity",
        ),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}.parquet")

    names = list(module.small_tasks(spark, 0))
    before = {name: spark.conf.get(name) for name in names}
    during, build = {}, module.build_panel

    def noted(*args):
        during.update({name: spark.conf.get(name) for name in names})
        return build(*args)

    monkeypatch.setattr(module, "build_panel", noted)
    monkeypatch.setattr(module, "TASK_LINES", 10)
    monkeypatch.setattr(module, "_tables", {})
    assert module.panel(spark, folder).count() == 50
    assert during["spark.sql.shuffle.partitions"] == "90"
    assert during["spark.sql.files.maxPartitionBytes"] == module.SCAN_BYTES
    assert {name: spark.conf.get(name) for name in names} == before
