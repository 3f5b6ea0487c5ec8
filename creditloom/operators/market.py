"""Views over all companies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.catalog import ENTITY, RATING, RATING_DOMAIN, SCORE, YEAR
from creditloom.functions.columns import col, normalize_rating, numeric, rating_ordinal
from creditloom.operators.filters import filter_years, known_years


def densify_domain(
    df: DataFrame, domain: list, on: str, value: str, by: list[str] | None = None, fill=0
) -> DataFrame:
    """One row per value of a fixed ``domain`` (and per key of ``by``), absent ones filled.

    ``df`` is an aggregate with at most one row per (by, on). The values of the domain
    become columns and rows again, so nothing is joined.
    """
    groups = [col(name) for name in by or []]
    wide = df.groupBy(*groups).agg(
        *[
            F.coalesce(F.max(F.when(col(on) == F.lit(v), col(value))), F.lit(fill)).alias(f"v{i}")
            for i, v in enumerate(domain)
        ]
    )
    pairs = [
        F.struct(F.lit(v).alias(on), F.col(f"v{i}").alias(value)) for i, v in enumerate(domain)
    ]
    return wide.select(*groups, F.inline(F.array(*pairs)))


def market_kpis(df: DataFrame, entity: str = ENTITY, score: str = SCORE) -> DataFrame:
    """Companies (a missing id counts as one), rows and the mean score."""
    measures = [
        (F.count_distinct(col(entity)) + F.max(col(entity).isNull().cast("int"))).alias("n_entities"),
        F.count(F.lit(1)).alias("n_rows"),
    ]
    if score in df.columns:
        measures.append(F.avg(numeric(df, score)).alias("mean_score"))
    return df.agg(*measures)


def distinct_years(df: DataFrame, year: str = YEAR) -> DataFrame:
    return df.select(col(year)).dropna().distinct().orderBy(col(year))


def distinct_entities(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    """Company ids as text, in text order."""
    names = df.select(col(entity).cast("string").alias(entity))
    return names.dropna().distinct().orderBy(col(entity))


def _rating_counts(df: DataFrame, rating: str, by: list[str]) -> DataFrame:
    """One count per rating of the domain, wide; counted on the map side in one pass."""
    word = normalize_rating(col(rating))
    rated = df.select(*[col(name) for name in by], word.alias("__rating"))
    return rated.groupBy(*[col(name) for name in by]).agg(
        *[F.count_if(F.col("__rating") == r).alias(r) for r in RATING_DOMAIN]
    )


def _rating_rows(wide: DataFrame, by: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(r).alias("rating"), F.col(r).alias("n")) for r in RATING_DOMAIN]
    keys = [col(name) for name in by]
    return wide.select(*keys, F.inline(F.array(*pairs))).withColumn(
        "rating_ord", rating_ordinal(F.col("rating"))
    )


def rating_distribution(
    df: DataFrame, rating: str = RATING, years: list[int] | None = None, year: str = YEAR
) -> DataFrame:
    """Rows per rating over the whole scale, with the share in percent."""
    wide = _rating_counts(filter_years(df, years or [], year), rating, [])
    total = sum((F.col(r) for r in RATING_DOMAIN[1:]), F.col(RATING_DOMAIN[0]))
    rows = _rating_rows(wide.withColumn("__total", total), ["__total"])
    share = F.bround(F.try_divide(F.col("n") * 100.0, F.col("__total")), 2)
    return rows.withColumn("share_pct", share).drop("__total")


def rating_by_year(
    df: DataFrame, rating: str = RATING, years: list[int] | None = None, year: str = YEAR
) -> DataFrame:
    """Year x rating counts: one column per rating of the scale. Rows without a year do
    not count."""
    rows = known_years(filter_years(df, years or [], year), year)
    return _rating_counts(rows, rating, [year]).orderBy(col(year))


def rating_distribution_by_year(
    df: DataFrame, rating: str = RATING, year: str = YEAR
) -> DataFrame:
    """Every known year with every rating of the scale, zero where none occurs."""
    return _rating_rows(_rating_counts(known_years(df, year), rating, [year]), [year])
