"""Evaluation of a score against a 0/1 label."""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.columns import col
from creditloom.operators.running import RANGE_ROWS, running_sums
from creditloom.staging import stage

# Positions of the threshold control, 0.05 to 0.95 in steps of 0.01.
THRESHOLDS = [i / 100 for i in range(5, 96)]


def _zero_if_undefined(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg) per distinct score; a score shared by many rows is added up on
    the map side."""
    rows = df.select(col(score).cast("double").alias("score"), col(label).cast("int").alias("y"))
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("y").isin(0, 1))
    return rows.groupBy("score").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )


def curve_counts(
    df: DataFrame, label: str = "label", score: str = "score", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(threshold, pos, neg, tp, fp, n_pos, n_neg) at each distinct score, from which all
    curves and areas follow."""
    counts = stage(score_counts(df, label, score), "score-counts")
    summed = running_sums(counts, "score", ["pos", "neg"], range_rows=range_rows)
    points = summed.select(
        F.col("score").alias("threshold"),
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
    )
    # From the counts, not from the running sums: those are taken once.
    totals = counts.agg(
        F.struct(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).alias("t")
    ).scalar()
    return points.withColumn("__t", totals).select(
        "threshold",
        "pos",
        "neg",
        "tp",
        "fp",
        F.col("__t.n_pos").alias("n_pos"),
        F.col("__t.n_neg").alias("n_neg"),
    )


def _with_end_point(points: DataFrame, **values: float) -> DataFrame:
    """Add the end of the curve, which belongs to no score of the data."""
    nothing = F.lit(None).cast("double").alias("threshold")
    end = points.sparkSession.range(1).select(
        nothing, *[F.lit(float(v)).alias(name) for name, v in values.items()]
    )
    return points.unionByName(end)


def roc_points(
    df: DataFrame, label: str = "label", score: str = "score", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """False and true positive rate at each distinct score, and the origin."""
    points = curve_counts(df, label, score, range_rows).select(
        "threshold",
        F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", "n_pos").alias("tpr"),
    )
    return _with_end_point(points, fpr=0.0, tpr=0.0)


def pr_points(
    df: DataFrame, label: str = "label", score: str = "score", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Precision and recall at each distinct score, and the end (recall 0, precision 1)."""
    points = curve_counts(df, label, score, range_rows).select(
        "threshold",
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", "n_pos").alias("recall"),
    )
    return _with_end_point(points, precision=1.0, recall=0.0)


def _roc_area(counts: DataFrame) -> Column:
    """Trapezoids between neighbouring points, in counts; twice the area is exact."""
    twice = (F.col("tp") * 2 - F.col("pos")).cast("decimal(38,0)") * F.col("neg")
    return F.try_divide(
        F.sum(twice).cast("double") / 2, F.max("n_pos").cast("double") * F.max("n_neg")
    )


def auc_roc(
    df: DataFrame, label: str = "label", score: str = "score", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Area under the ROC curve; NULL when only one class occurs."""
    counts = curve_counts(df, label, score, range_rows)
    return counts.agg(_roc_area(counts).alias("auc_roc"))


def average_precision(
    df: DataFrame, label: str = "label", score: str = "score", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Precision at each step of recall, weighted by the step (no interpolation)."""
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    step = F.try_divide("pos", "n_pos")
    return curve_counts(df, label, score, range_rows).agg(
        F.sum(precision * step).alias("average_precision")
    )


def _rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    precision = _zero_if_undefined(tp, tp + fp)
    recall = _zero_if_undefined(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": _zero_if_undefined(tp * 2, tp * 2 + fp + fn),
    }


def threshold_metrics(
    df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score"
) -> DataFrame:
    """Confusion counts, precision, recall and F1 for ``score >= threshold``."""
    positive = col(label) == 1
    chosen = col(score) >= F.lit(float(threshold))
    usable = df.where(col(label).isin(0, 1) & col(score).isNotNull() & ~F.isnan(col(score)))
    counts = usable.agg(
        F.count_if(~positive & ~chosen).alias("tn"),
        F.count_if(~positive & chosen).alias("fp"),
        F.count_if(positive & ~chosen).alias("fn"),
        F.count_if(positive & chosen).alias("tp"),
    )
    return counts.withColumns(_rates(*[F.col(x) for x in ("tn", "fp", "fn", "tp")]))


def threshold_sweep(
    df: DataFrame,
    thresholds: list[float] = THRESHOLDS,
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """``threshold_metrics`` at every threshold in one pass.

    The rows are counted per interval between thresholds; only those counts, one per
    threshold, are added up.
    """
    levels = sorted(set(float(t) for t in thresholds))
    splits = [float("-inf"), *levels, float("inf")]
    usable = df.select(col(score).cast("double").alias("score"), col(label).cast("int").alias("y"))
    usable = usable.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("y").isin(0, 1))
    if len(levels) > 1:
        cut = Bucketizer(splits=splits, inputCol="score", outputCol="level").transform(usable)
    else:
        cut = usable.withColumn("level", (F.col("score") >= levels[0]).cast("double"))
    histogram = cut.groupBy(F.col("level").cast("int").alias("level")).agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    # A row in interval k passes the thresholds 1..k; level 0 holds the totals.
    passed = (
        histogram.select(F.explode(F.sequence(F.lit(0), "level")).alias("i"), "pos", "neg")
        .groupBy("i")
        .agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    )
    counted = F.map_from_entries(F.collect_list(F.struct("i", F.struct("tp", "fp"))))
    # One row in and len(thresholds) rows out.
    swept = passed.agg(counted.alias("m")).select(
        "m", F.posexplode(F.array(*map(F.lit, levels))).alias("pos0", "threshold")
    )
    none = F.struct(F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"))
    at = F.coalesce(F.try_element_at("m", F.col("pos0") + 1), none)
    total = F.coalesce(F.try_element_at("m", F.lit(0)), none)
    counts = swept.select(
        "threshold",
        (total["fp"] - at["fp"]).alias("tn"),
        at["fp"].alias("fp"),
        (total["tp"] - at["tp"]).alias("fn"),
        at["tp"].alias("tp"),
    )
    return counts.withColumns(_rates(*[F.col(x) for x in ("tn", "fp", "fn", "tp")]))


def holdout_metrics(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    prediction: str | None = None,
    threshold: float = 0.5,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """ROC area, average precision and accuracy of scored rows, as one row."""
    guess = (
        col(prediction).cast("int")
        if prediction
        else (col(score) >= F.lit(float(threshold))).cast("int")
    )
    counts = curve_counts(df, label, score, range_rows)
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    areas = counts.agg(
        _roc_area(counts).alias("auc_roc"),
        F.sum(precision * F.try_divide("pos", "n_pos")).alias("average_precision"),
    )
    accuracy = df.where(col(label).isin(0, 1)).agg(
        F.avg((col(label).cast("int") == guess).cast("double")).alias("accuracy")
    )
    return areas.withColumn("accuracy", accuracy.scalar())
