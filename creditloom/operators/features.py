"""Model input: labels, complete features, splits, imputation and scaling."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.catalog import ENTITY, RATING, RATIO_FEATURES, YEAR
from creditloom.functions.columns import col, ig_label, key_hash, key_hash52, numeric
from creditloom.operators.quantiles import exact_quantiles, order_statistics
from creditloom.sources.resolve import feature_subset

KEYS = (ENTITY, YEAR)


def present_features(df: DataFrame, catalog: list[str] = RATIO_FEATURES) -> list[str]:
    return [name for name in catalog if name in df.columns]


def prepare_ml(
    df: DataFrame,
    rating: str = RATING,
    keys=KEYS,
    catalog: list[str] = RATIO_FEATURES,
) -> DataFrame:
    """Keys, label and all catalogue features of rows in which none of them is missing."""
    features = present_features(df, catalog)
    lean = df.where(col(rating).isNotNull()).select(
        *[col(k) for k in keys],
        ig_label(col(rating)).alias("label"),
        *[numeric(df, name).alias(name) for name in features],
    )
    return lean.dropna(subset=features)


def build_ml(
    df: DataFrame,
    chosen: list[str],
    rating: str = RATING,
    keys=KEYS,
    catalog: list[str] = RATIO_FEATURES,
) -> DataFrame:
    """``prepare_ml`` with the chosen features; the others still decide which rows stay."""
    features = feature_subset(chosen, present_features(df, catalog))
    base = prepare_ml(df, rating, keys, catalog)
    return base.select(*[col(k) for k in keys], "label", *[col(name) for name in features])


def in_train(*keys: Column, share: int = 80) -> Column:
    """Whether the key falls in the training part; does not depend on the partitioning."""
    return key_hash(*keys) % 100 < share


def split_80_20(df: DataFrame, keys=KEYS, share: int = 80) -> DataFrame:
    """Add ``is_train``. All rows of a key go to the same part."""
    return df.withColumn("is_train", in_train(*[col(k) for k in keys], share=share))


def split_stratified(
    df: DataFrame, label: str = "label", keys=KEYS, test_share: float = 0.2
) -> DataFrame:
    """Add ``is_train`` such that each label gives its share of rows to the test part.

    Per label the rows with the lowest key hashes are the test part. The hash at which
    the share is reached is an exact order statistic, so no row is shuffled. Rows with
    the same key stay together.
    """
    hashed = key_hash52(*[col(k) for k in keys]).cast("double")
    by_label = {str(v): F.when(col(label) == v, hashed) for v in (0, 1)}
    found = order_statistics(df, by_label, lambda n: [max(math.ceil(n * test_share) - 1, 0)])
    in_test = F.lit(False)
    for value in (0, 1):
        for limit in found[str(value)][1].values():
            in_test = in_test | ((col(label) == value) & (hashed <= F.lit(limit)))
    return df.withColumn("is_train", ~in_test)


def fold_number(*keys: Column, folds: int = 3) -> Column:
    return (key_hash(*keys) % folds).cast("int")


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing numbers become the exact median of their column."""
    exprs = {name: numeric(df, name) for name in cols}
    medians = exact_quantiles(df, exprs, [0.5])
    filled = {
        name: F.coalesce(exprs[name], F.lit(medians[name][0])) if medians[name] else exprs[name]
        for name in cols
    }
    return df.withColumns(filled)


def standardize(df: DataFrame, cols: list[str], population: bool = True) -> DataFrame:
    """z-scores of all columns from one aggregate. A constant column gives 0.

    ``population`` divides by the population deviation, else by the sample deviation.
    """
    deviation = F.stddev_pop if population else F.stddev_samp
    exprs = {name: numeric(df, name) for name in cols}
    stats = df.agg(
        F.struct(
            *[F.avg(exprs[name]).alias(f"m{i}") for i, name in enumerate(cols)],
            *[deviation(exprs[name]).alias(f"s{i}") for i, name in enumerate(cols)],
        ).alias("stats")
    ).scalar()
    scaled = {}
    for i, name in enumerate(cols):
        spread = F.col(f"__stats.s{i}")
        unit = F.when(spread > 0, spread).otherwise(1.0)
        scaled[name] = (exprs[name] - F.col(f"__stats.m{i}")) / unit
    return df.withColumn("__stats", stats).withColumns(scaled).drop("__stats")
