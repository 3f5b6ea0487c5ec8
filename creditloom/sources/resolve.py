"""Choice of columns by name. Only the schema is read, except in ``usable_features``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.catalog import ENTITY_CANDIDATES, EXPECTED_METRICS, RATIO_FEATURES
from creditloom.functions.columns import numeric


def detect_entity(columns: list[str]) -> str | None:
    """Company column, or None when an id has to be generated."""
    for name in ENTITY_CANDIDATES:
        if name in columns:
            return name
    if columns and columns[0] not in EXPECTED_METRICS:
        return columns[0]
    return None


def detect_rating(columns: list[str]) -> str | None:
    """Column called rating in any case, else the first one that contains the word."""
    words = {name: name.strip().lower() for name in columns}
    exact = [name for name, word in words.items() if word == "rating"]
    partial = [name for name, word in words.items() if "rating" in word]
    return next(iter(exact + partial), None)


def matching_column(columns: list[str], alias: str, exact_only: bool = False) -> str | None:
    """The best column for one metric name: equal in any case before containing the name or
    contained in it (off with ``exact_only``, since short names match often); of equally
    good ones the first."""
    word = alias.lower()

    def rank(name: str) -> int:
        other = name.lower()
        return 0 if other == word else 1 if word in other or other in word else 2

    best = min(columns, key=rank, default=None)  # the first of the smallest ranks
    return best if best is not None and rank(best) <= (0 if exact_only else 1) else None


def resolve_metric_group(
    columns: list[str], aliases: list[str], exact_only: bool = False
) -> list[str]:
    """Existing columns for a list of metric names, in the order of the names, each once."""
    best = (matching_column(columns, alias, exact_only) for alias in aliases)
    return list(dict.fromkeys(name for name in best if name is not None))


def resolve_all_groups(
    columns: list[str], groups: dict[str, list[str]], exact_only: bool = False
) -> dict[str, list[str]]:
    return {g: resolve_metric_group(columns, names, exact_only) for g, names in groups.items()}


def feature_counts(df: DataFrame, catalog: list[str] = RATIO_FEATURES) -> DataFrame:
    """(feature, n_values) for every catalogue column of ``df``, from one aggregate."""
    present = [name for name in catalog if name in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "feature string, n_values bigint")
    counts = df.agg(*[F.count(numeric(df, name)).alias(f"n{i}") for i, name in enumerate(present)])
    pairs = [
        F.struct(F.lit(name).alias("feature"), F.col(f"n{i}").alias("n_values"))
        for i, name in enumerate(present)
    ]
    return counts.select(F.inline(F.array(*pairs)))


def usable_features(df: DataFrame, catalog: list[str] = RATIO_FEATURES) -> list[str]:
    """Catalogue columns with at least one number; the driver gets one row per column."""
    rows = feature_counts(df, catalog).where("n_values > 0").collect()
    counted = {row["feature"] for row in rows}
    return [name for name in catalog if name in counted]


def feature_subset(chosen: list[str], usable: list[str]) -> list[str]:
    """The chosen features that are usable, in the order chosen; all when none is chosen."""
    return [name for name in (chosen or usable) if name in usable]
