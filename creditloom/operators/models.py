"""Investment-grade classifiers and segments on spark.ml."""

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.catalog import ENTITY, YEAR
from creditloom.functions.columns import col, is_finite, numeric
from creditloom.operators.evaluate import holdout_metrics
from creditloom.operators.features import fold_number, in_train, split_stratified
from creditloom.operators.forest import FINISH_ROWS, Forest, grow_forest
from creditloom.operators.lr_grid import Folds, fit_grid, grid_areas
from creditloom.operators.quantiles import exact_quantiles
from creditloom.operators.segments import cluster
from creditloom.staging import stage

KEYS = (ENTITY, YEAR)

# Fewest rows for a model, before and after cleaning.
MIN_ROWS = 200
MIN_CLEAN_ROWS = 20

# An iteration over fewer rows than this costs less than the task that does it.
ROWS_PER_TASK = 25_000

METRICS_SCHEMA = "auc_roc double, average_precision double, accuracy double"


def _inputs(features: list[str]) -> list[str]:
    """Names of the model inputs; they do not depend on the characters of the features."""
    return [f"f{i}" for i in range(len(features))]


def with_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns(
        {f: numeric(df, name) for f, name in zip(_inputs(features), features)}
    )


def _filling(medians: dict[str, float]) -> SQLTransformer:
    """Adds each input with its exact median in place of missing values, as ``<input>_filled``."""
    filled = [f"coalesce({f}, double('{m!r}')) AS {f}_filled" for f, m in medians.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def _medians(rows: DataFrame, exprs: dict) -> dict[str, float]:
    """Exact medians, all from the same passes; 0 for a column without values."""
    return {name: m[0] if m else 0.0 for name, m in exact_quantiles(rows, exprs, [0.5]).items()}


def _few_tasks(df: DataFrame, n: int) -> DataFrame:
    """Merge the partitions of a small iterative input; no effect on a large one."""
    return df.coalesce(max(1, -(-n // ROWS_PER_TASK)))


def _spread(df: DataFrame, n: int) -> DataFrame:
    """Deal a small table over all cores, by content: a row of it costs far more to score or
    to explain than to read. A large table has tasks enough and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if n >= cores * ROWS_PER_TASK:
        return df
    return stage(df.repartition(cores, *[col(c) for c in df.columns]), "spread")


@dataclass
class _Fitted:
    """What classifiers share: the rows of both parts, the scored test part, its metrics."""

    features: list[str]
    train: DataFrame
    test: DataFrame
    keys: tuple[str, ...] = KEYS

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    @cached_property
    def holdout(self) -> DataFrame:
        """Scored rows of the test part, written when they are first asked for."""
        kept = [*[col(k) for k in self.keys], "label", *[col(name) for name in self.features]]
        return stage(self.predict(self.test).select(*kept, "p_ig", "prediction"), "holdout")

    def metrics(self) -> DataFrame:
        return holdout_metrics(self.holdout, score="p_ig", prediction="prediction")


@dataclass(kw_only=True)
class Classifier(_Fitted):
    """A fitted spark.ml pipeline."""

    model: PipelineModel

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``p_ig`` and ``prediction`` to every row, in place of columns of these names.

        The model sees its inputs and one struct of all columns, so columns that are
        called like its own stay as they are.
        """
        inputs = [
            numeric(df, name).alias(f)
            for f, name in zip(_inputs(self.features), self.features, strict=True)
        ]
        packed = df.select(F.struct(*[col(c) for c in df.columns]).alias("__row"), *inputs)
        scored = self.model.transform(packed)
        kept = [c for c in df.columns if c.lower() not in ("p_ig", "prediction")]
        return scored.select(
            *[F.col("__row").getField(c).alias(c) for c in kept],
            vector_to_array("probability")[1].alias("p_ig"),
            "prediction",
        )


@dataclass(kw_only=True)
class ForestClassifier(_Fitted):
    """A fitted forest."""

    forest: Forest

    def vector(self, df: DataFrame):
        return F.array(*[numeric(df, name) for name in self.features])

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``p_ig`` and ``prediction`` to every row, in place of columns of these names."""
        row = F.struct(*[col(c) for c in df.columns]).alias("__row")
        scored = self.forest.add_scores(df.select(row, self.vector(df).alias("x")), score="p_ig")
        kept = [c for c in df.columns if c.lower() not in ("p_ig", "prediction")]
        return scored.select(
            *[F.col("__row").getField(c).alias(c) for c in kept],
            "p_ig",
            (F.col("p_ig") > 0.5).cast("double").alias("prediction"),
        )


def _labelled(df: DataFrame, features: list[str], keys) -> DataFrame:
    rows = df.select(
        *[col(k) for k in keys],
        numeric(df, "label").alias("label"),
        *[numeric(df, name).alias(name) for name in features],
    )
    return rows.where(F.col("label").isin(0.0, 1.0))


@dataclass
class _Sizes:
    train_pos: int
    train_neg: int
    test: int

    @property
    def train(self) -> int:
        return self.train_pos + self.train_neg

    def usable(self, least: int) -> bool:
        """Enough rows, both classes in the training part and a test part."""
        enough = self.train + self.test >= max(least, MIN_CLEAN_ROWS)
        return enough and min(self.train_pos, self.train_neg, self.test) > 0


def _sizes(parts: DataFrame) -> _Sizes:
    positive = F.col("label") == 1
    counts = parts.agg(
        F.count_if(F.col("is_train") & positive),
        F.count_if(F.col("is_train") & ~positive),
        F.count_if(~F.col("is_train")),
    )
    return _Sizes(*counts.first())


def size_guards(df: DataFrame, features: list[str], keys=KEYS) -> DataFrame:
    """One row: complete rows, rows by part and label, and which models may be fitted."""
    rows = _labelled(df, features, keys)
    for name in features:
        rows = rows.where(is_finite(col(name)))
    train, positive = in_train(*[col(k) for k in keys]), F.col("label") == 1
    counts = rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(train & positive).alias("train_pos"),
        F.count_if(train & ~positive).alias("train_neg"),
        F.count_if(~train).alias("test"),
    )
    whole = F.least("train_pos", "train_neg", "test") > 0
    return counts.withColumns(
        {
            "enough_for_lr": whole & (F.col("n_rows") >= max(MIN_ROWS, MIN_CLEAN_ROWS)),
            "enough_for_forest": whole & (F.col("n_rows") >= MIN_CLEAN_ROWS),
            "enough_for_anomalies": F.col("n_rows") >= max(50, 3 * len(features)),
        }
    )


def _fit(
    estimator: Pipeline, parts: DataFrame, sizes: _Sizes, features: list[str], keys
) -> Classifier:
    """Fit on the rows with ``is_train``; the others are the test part."""
    train = parts.where("is_train").drop("is_train")
    model = estimator.fit(_few_tasks(with_inputs(train, features), sizes.train))
    test = parts.where(~F.col("is_train")).drop("is_train")
    return Classifier(features, train, test, tuple(keys), model=model)


def train_lr(
    df: DataFrame, features: list[str], keys=KEYS, max_iter: int = 50
) -> Classifier | None:
    """Median imputation and logistic regression on 80 % of the keys; None if the data
    are too few or hold one class only. ``df`` is the result of ``build_ml``."""
    rows = _labelled(df, features, keys)
    parts = stage(rows.withColumn("is_train", in_train(*[col(k) for k in keys])), "lr")
    sizes = _sizes(parts)
    if not sizes.usable(MIN_ROWS):
        return None
    names = _inputs(features)
    filled = [f"{f}_filled" for f in names]
    training = with_inputs(parts.where("is_train"), features)
    steps = [
        _filling(_medians(training, {f: F.col(f) for f in names})),
        VectorAssembler(inputCols=filled, outputCol="vector", handleInvalid="keep"),
        LogisticRegression(featuresCol="vector", labelCol="label", maxIter=max_iter),
    ]
    return _fit(Pipeline(stages=steps), parts, sizes, features, keys)


def train_rf(
    df: DataFrame,
    features: list[str],
    keys=KEYS,
    trees: int = 400,
    max_depth: int = 30,
    min_leaf: int = 2,
    seed: int = 42,
    finish: int = FINISH_ROWS,
) -> ForestClassifier | None:
    """Random forest with balanced class weights on a stratified 80 % of the rows."""
    labelled = _labelled(df, features, keys)
    for name in features:
        labelled = labelled.where(is_finite(col(name)))
    rows = stage(labelled, "rf")
    parts = split_stratified(rows, keys=keys)
    sizes = _sizes(parts)
    if not sizes.usable(MIN_CLEAN_ROWS):
        return None
    parts = _spread(parts, sizes.train + sizes.test)
    train = parts.where("is_train").drop("is_train")
    test = parts.where(~F.col("is_train")).drop("is_train")
    vectors = train.select("label", F.array(*[col(name) for name in features]).alias("x"))
    forest = grow_forest(vectors, trees, max_depth, min_leaf, seed=seed, finish=finish)
    return ForestClassifier(features, train, test, tuple(keys), forest=forest)


def metrics_or_empty(fitted: _Fitted | None, df: DataFrame) -> DataFrame:
    if fitted is None:
        return df.sparkSession.createDataFrame([], METRICS_SCHEMA)
    return fitted.metrics()


def score_ig(fitted: _Fitted | None, df: DataFrame, keys=KEYS) -> DataFrame:
    """P(IG) of every company-year; missing ratios are imputed by the model."""
    names = [col(k) for k in keys]
    if fitted is None:
        return df.select(*names, F.lit(None).cast("double").alias("p_ig")).limit(0)
    return fitted.predict(df).select(*names, "p_ig")


def rf_score_ig(fitted: ForestClassifier | None, df: DataFrame, keys=KEYS) -> DataFrame:
    """P(IG) by the forest of every company-year whose ratios are all finite."""
    if fitted is None:
        return score_ig(None, df, keys)
    needed = dict.fromkeys([*keys, *fitted.features])
    usable = df.select(*[col(name) for name in needed])
    for name in fitted.features:
        usable = usable.where(is_finite(numeric(df, name)))
    return score_ig(fitted, usable, keys)


def cv_lr(
    df: DataFrame,
    features: list[str],
    keys=KEYS,
    folds: int = 3,
    reg_params: tuple[float, ...] = (0.0, 0.01, 0.1),
    elastic_nets: tuple[float, ...] = (0.0, 0.5, 1.0),
    max_iter: int = 100,
) -> DataFrame:
    """Mean ROC area over the folds for each setting, the best one marked.

    All folds and settings are fitted together; imputation and scaling are those of the
    fold's training part. Without regularisation the elastic-net share has no effect, so
    that fit is shared.
    """
    result = "reg_param double, elastic_net double, mean_auc double, is_best boolean"
    fold = fold_number(*[col(k) for k in keys], folds=folds).alias("fold")
    rows = with_inputs(_labelled(df, features, keys), features)
    names = _inputs(features)
    staged = stage(rows.select("label", *names, fold), "cv")
    lean = _few_tasks(staged, staged.count())
    if lean.select("label").distinct().count() < 2:
        return df.sparkSession.createDataFrame([], result)
    # The medians of all folds come from the same passes over the rows.
    medians = _medians(
        lean, {f"{k}:{f}": F.when(F.col("fold") != k, F.col(f)) for k in range(folds) for f in names}
    )
    table = np.array([[medians[f"{k}:{f}"] for f in names] for k in range(folds)])
    data = Folds(lean, names, folds, table)
    settings = [(r, e) for r in reg_params for e in elastic_nets]
    distinct = list(dict.fromkeys((r, e if r else 0.0) for r, e in settings))
    areas = grid_areas(lean, data, fit_grid(lean, data, distinct, max_iter))
    of = {g: sum(areas.get((k, i), 0.0) for k in range(folds)) / folds for i, g in enumerate(distinct)}
    means = [of[(r, e if r else 0.0)] for r, e in settings]
    best = means.index(max(means))
    found = [(r, e, m, i == best) for i, ((r, e), m) in enumerate(zip(settings, means))]
    return df.sparkSession.createDataFrame(found, result)


def kmeans_segments(
    df: DataFrame, features: list[str], keys=KEYS, k: int = 5, seed: int = 42
) -> DataFrame:
    """Cluster of every company-year with all ratios."""
    complete = with_inputs(df, features)
    for name in _inputs(features):
        complete = complete.where(is_finite(F.col(name)))
    lean = complete.select(*[col(c) for c in keys], *_inputs(features))
    found = cluster(lean, _inputs(features), k, seed)
    return found.select(*[col(c) for c in keys], "cluster")
