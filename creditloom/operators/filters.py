"""Row filters."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.catalog import ENTITY, YEAR
from creditloom.functions.columns import col, numeric
from creditloom.operators.joins import lookup_join
from creditloom.staging import stage


def filter_years(df: DataFrame, years: list[int], year: str = YEAR) -> DataFrame:
    """Rows of the listed years; an empty list keeps all rows."""
    return df.where(col(year).isin([int(y) for y in years])) if years else df


def known_years(df: DataFrame, year: str = YEAR) -> DataFrame:
    """Rows that have a year."""
    return df.where(col(year).isNotNull())


def recent_years(df: DataFrame, back: int = 9, year: str = YEAR) -> DataFrame:
    """Rows from ``back`` years before the latest year on; all rows if no year is known."""
    latest = df.agg(F.max(col(year)).alias("latest")).scalar()
    return df.where(F.coalesce(col(year) >= latest - F.lit(back), latest.isNull()))


def last_k_entity_years(
    df: DataFrame, k: int = 3, entity: str = ENTITY, year: str = YEAR
) -> DataFrame:
    """Rows of the last ``k`` years that each company has.

    The years of a company are reduced to a set before anything is sorted, so a company
    with a large share of the rows costs no more than another.
    """
    years = F.sort_array(F.collect_set(col(year)), asc=False)
    first = F.coalesce(F.try_element_at(years, F.lit(k)), F.array_min(years))
    known = df.where(col(entity).isNotNull() & col(year).isNotNull())
    cutoffs = known.groupBy(col(entity)).agg(first.alias("__first_year"))
    # Written once; the join looks at its size first.
    joined = lookup_join(df, stage(cutoffs, "first-years"), [entity])
    kept = joined.where(col(year) >= F.col("__first_year"))
    return kept.select(*[col(name) for name in df.columns])


def _same_value(df: DataFrame, name: str, value) -> Column:
    """Compare in the column's own type where possible, so that the scan can filter."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType) and re.fullmatch("-?[0-9]+", str(value)):
        return col(name) == F.lit(int(value))
    return col(name).cast("string") == F.lit(str(value))


def entity_rows(df: DataFrame, value, entity: str = ENTITY) -> DataFrame:
    """All rows of one company, the id given as text or number."""
    return df.where(_same_value(df, entity, value))


def first_records(
    df: DataFrame, keys: list[str], order: list[str] | None = None
) -> DataFrame:
    """First row for each key by ``order``, then by the other columns."""
    rest = [name for name in df.columns if name not in keys]
    ranked = [*(order or []), *[name for name in rest if name not in (order or [])]]
    first = F.min(F.struct(*[col(name) for name in ranked])).alias("__first")
    kept = df.groupBy(*[col(k) for k in keys]).agg(first)
    return kept.select(
        *[
            col(name) if name in keys else F.col("__first").getField(name).alias(name)
            for name in df.columns
        ]
    )


def entity_year_row(
    df: DataFrame,
    value,
    year_value: int,
    order: list[str] | None = None,
    entity: str = ENTITY,
    year: str = YEAR,
) -> DataFrame:
    """First row of one company-year; no row when the pair does not occur."""
    rows = entity_rows(df, value, entity).where(col(year) == F.lit(int(year_value)))
    return first_records(rows, [entity, year], order)


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a number in every listed column; the columns become doubles."""
    coerced = df.withColumns({name: numeric(df, name) for name in cols})
    return coerced.dropna(subset=cols)


def valid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(col(label).isin(0, 1))
