import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import quantiles


@pytest.fixture
def tight(monkeypatch):
    """Rough sketches and short final lists, so that many rounds are needed."""
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 20)
    monkeypatch.setattr(quantiles, "FINAL_VALUES", 5)


def frames():
    rng = random.Random(7)
    yield "even", [rng.uniform(-5, 5) for _ in range(3000)]
    yield "hot value", [3.0] * 1500 + [rng.gauss(0, 10) for _ in range(1500)]
    yield "two hot values", [0.0] * 1400 + [1.0] * 1400 + [rng.random() for _ in range(200)]
    yield "whole numbers", [float(rng.randrange(40)) for _ in range(3000)]
    yield "long tails", [rng.paretovariate(0.3) * rng.choice([-1, 1]) for _ in range(3000)]
    yield "constant", [2.0] * 1000
    yield "single", [4.0]


@pytest.mark.parametrize("values", [v for _, v in frames()], ids=[n for n, _ in frames()])
def test_equal_to_sorting(spark, tight, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    found = quantiles.exact_quantiles(df, {"x": F.col("x")}, probs)["x"]
    assert found == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12, abs=1e-12)


def test_every_rank(spark, tight):
    values = [random.Random(1).choice([1.0, 2.0, 2.5, 7.0, -3.0]) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    n, found = quantiles.order_statistics(df, {"x": F.col("x")}, lambda n: list(range(n)))["x"]
    assert n == 60
    assert [found[i] for i in range(60)] == sorted(values)


def test_missing_and_infinite(spark):
    df = spark.createDataFrame([(None,), (float("inf"),), (1.0,), (float("-inf"),)], "x double")
    exprs = {"x": F.col("x"), "none": F.lit(None).cast("double")}
    found = quantiles.exact_quantiles(df, exprs, [0.0, 0.5, 1.0])
    assert found["none"] is None
    assert found["x"] == [float("-inf"), 1.0, float("inf")]


def test_two_scans_whatever_the_values(spark, monkeypatch):
    """Also with hot values and many distinct ones; what is searched further is written once."""
    scans = []
    plain = quantiles._one_row
    monkeypatch.setattr(quantiles, "_one_row", lambda df, e: scans.append("sketch") or plain(df, e))
    counted = quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda *a: scans.append("counts") or counted(*a))
    rng = random.Random(3)
    values = [rng.choice([0.0, 1.0, rng.gauss(0, 1)]) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    for final in (100_000, 3):
        monkeypatch.setattr(quantiles, "FINAL_VALUES", final)
        scans.clear()
        found = quantiles.exact_quantiles(df, {"x": F.col("x")}, [0.01, 0.5, 0.9])["x"]
        assert found == pytest.approx(np.quantile(values, [0.01, 0.5, 0.9]).tolist(), rel=1e-12)
        assert scans == ["sketch", "counts"]
