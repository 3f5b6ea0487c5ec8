import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from creditloom.operators import evaluate


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


def noisy(seed=3, n=400, levels=37):
    rng = random.Random(seed)
    return [(int(rng.random() < s / levels), s / levels) for s in (rng.randrange(levels) for _ in range(n))]


@pytest.fixture(params=[1_000_000, 5])
def range_rows(request):
    return request.param


def brute_points(pairs):
    points = {}
    for t in {s for _, s in pairs}:
        tp = sum(y for y, s in pairs if s >= t)
        points[t] = (tp, sum(1 for _, s in pairs if s >= t) - tp)
    return points


def test_curves(spark, range_rows):
    pairs = noisy()
    pos = sum(y for y, _ in pairs)
    neg = len(pairs) - pos
    roc = evaluate.roc_points(frame(spark, pairs), range_rows=range_rows).collect()
    pr = evaluate.pr_points(frame(spark, pairs), range_rows=range_rows).collect()
    brute = brute_points(pairs)
    assert len(roc) == len(pr) == len(brute) + 1
    for r in roc:
        tp, fp = brute.get(r["threshold"], (0, 0))
        assert (r["tpr"], r["fpr"]) == pytest.approx((tp / pos, fp / neg))
    for r in pr:
        if r["threshold"] is not None:
            tp, fp = brute[r["threshold"]]
            assert (r["precision"], r["recall"]) == pytest.approx((tp / (tp + fp), tp / pos))
    ordered = sorted((r["fpr"], r["tpr"]) for r in roc)
    assert ordered[0] == (0, 0) and ordered[-1] == (1, 1)
    assert all(a[1] <= b[1] for a, b in zip(ordered, ordered[1:]))


def test_areas(spark, range_rows):
    pairs = noisy()
    df = frame(spark, pairs)
    exact = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert evaluate.auc_roc(df, range_rows=range_rows).first()[0] == pytest.approx(exact)
    pos = sum(y for y, _ in pairs)
    total, last = 0.0, 0.0
    for _, (tp, fp) in sorted(brute_points(pairs).items(), reverse=True):
        total += (tp / pos - last) * tp / (tp + fp)
        last = tp / pos
    found = evaluate.average_precision(df, range_rows=range_rows).first()[0]
    assert found == pytest.approx(total)
    both = evaluate.holdout_metrics(df, threshold=0.3).first()
    assert both["auc_roc"] == pytest.approx(exact)
    assert both["average_precision"] == pytest.approx(total)
    right = sum(y == (s >= 0.3) for y, s in pairs) / len(pairs)
    assert both["accuracy"] == pytest.approx(right)


def test_one_class_and_nothing(spark):
    ones = frame(spark, [(1, 0.2), (1, 0.9)])
    assert evaluate.auc_roc(ones).first()[0] is None
    assert evaluate.average_precision(ones).first()[0] == 1.0
    row = evaluate.threshold_metrics(ones, 0.5).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (0, 0, 1, 1)
    zeros = frame(spark, [(0, 0.2)])
    row = evaluate.threshold_metrics(zeros, 0.5).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    nothing = frame(spark, [])
    assert evaluate.auc_roc(nothing).first()[0] is None
    assert evaluate.threshold_sweep(nothing).count() == 91


def test_unusable_rows_are_left_out(spark):
    df = frame(spark, [(1, 0.9), (0, 0.1), (None, 0.5), (1, None), (2, 0.3), (0, float("nan"))])
    assert evaluate.auc_roc(df).first()[0] == 1.0
    row = evaluate.threshold_metrics(df).first()
    assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == 2


@pytest.mark.parametrize("thresholds", [evaluate.THRESHOLDS, [0.5], [0.2, 0.4]])
def test_sweep_is_the_threshold_metric_at_each(spark, thresholds):
    pairs = noisy(levels=20) + [(1, 0.05), (0, 0.95), (1, 1.5), (0, -1.0)]
    df = frame(spark, pairs)
    swept = {r["threshold"]: r for r in evaluate.threshold_sweep(df, thresholds).collect()}
    assert sorted(swept) == thresholds
    for t, r in swept.items():
        tp = sum(y for y, s in pairs if s >= t)
        chosen = sum(1 for _, s in pairs if s >= t)
        pos = sum(y for y, _ in pairs)
        assert (r["tp"], r["fp"], r["fn"]) == (tp, chosen - tp, pos - tp)
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == len(pairs)
        assert r["f1"] == pytest.approx(2 * tp / (chosen + pos))
    one = evaluate.threshold_metrics(df, thresholds[0]).first()
    for name in ("tn", "fp", "fn", "tp", "precision", "recall", "f1"):
        assert one[name] == swept[thresholds[0]][name]
