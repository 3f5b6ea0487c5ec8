"""Views per company and year."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.catalog import (
    CARD_AMOUNTS,
    ENTITY,
    KEY_METRICS,
    METRIC_GROUPS,
    RATING,
    RATING_DESCRIPTION,
    SCORE,
    TREND_METRICS,
    YEAR,
)
from creditloom.functions.columns import col, is_numeric, numeric, rescale_score
from creditloom.functions.formatting import fixed2, format_magnitude, format_metric
from creditloom.operators.filters import entity_rows, filter_years, first_records, known_years
from creditloom.operators.joins import lookup_join
from creditloom.sources.resolve import resolve_all_groups
from creditloom.staging import stage

KEYS = (ENTITY, YEAR)


def _others(df: DataFrame, keys, numeric_ones: bool) -> list[str]:
    return [n for n in df.columns if n not in keys and is_numeric(df, n) == numeric_ones]


def merge_records_mean(df: DataFrame, keys=KEYS, cols: list[str] | None = None) -> DataFrame:
    """Mean of each numeric column over the records of a company-year."""
    cols = _others(df, keys, True) if cols is None else cols
    means = [F.avg(numeric(df, name)).alias(name) for name in cols]
    grouped = df.groupBy(*[col(k) for k in keys])
    return grouped.agg(*means) if means else df.select(*[col(k) for k in keys]).distinct()


def _modes(cols: list[str], kinds: list[T.DataType]) -> list[tuple]:
    """(aggregate, column) pairs: the most frequent value, the smallest one on a tie."""
    rank = F.struct((-F.col("__n")).alias("n"), F.col("__value").alias("value"))
    pairs = []
    for i, (name, kind) in enumerate(zip(cols, kinds)):
        mine = (F.col("__i") == i) & F.col("__value").isNotNull()
        best = F.min(F.when(mine, rank)).alias(f"__m{i}")
        pairs.append((best, F.col(f"__m{i}").getField("value").cast(kind).alias(name)))
    return pairs


def merge_records(
    df: DataFrame,
    keys=KEYS,
    numbers: list[str] | None = None,
    words: list[str] | None = None,
) -> DataFrame:
    """One row per company-year: means of the numeric columns, modes of the others.

    Each record gives one row with its numbers and one row per text column. Equal rows
    are counted and added up on the map side, so neither a large company-year nor a
    column with many values is gathered in one group, and nothing is joined.
    """
    numbers = _others(df, keys, True) if numbers is None else numbers
    words = _others(df, keys, False) if words is None else words
    if not words:
        return merge_records_mean(df, keys, numbers)
    names = [col(k) for k in keys]
    no_number = [F.lit(None).cast("double").alias(f"__x{j}") for j in range(len(numbers))]
    has_number = [numeric(df, name).alias(f"__x{j}") for j, name in enumerate(numbers)]
    parts = [
        F.struct(
            F.lit(i).alias("__i"), col(name).cast("string").alias("__value"), *no_number
        )
        for i, name in enumerate(words)
    ]
    if numbers:
        nothing = F.lit(None).cast("string").alias("__value")
        parts.append(F.struct(F.lit(-1).alias("__i"), nothing, *has_number))
    long = df.select(*names, F.inline(F.array(*parts)))
    sums = [F.sum(f"__x{j}").alias(f"__s{j}") for j in range(len(numbers))]
    counts = [F.count(f"__x{j}").alias(f"__c{j}") for j in range(len(numbers))]
    counted = long.groupBy(*names, "__i", "__value").agg(
        F.count(F.lit(1)).alias("__n"), *sums, *counts
    )
    modes = _modes(words, [df.schema[name].dataType for name in words])
    means = [
        F.try_divide(F.sum(f"__s{j}"), F.sum(f"__c{j}")).alias(name)
        for j, name in enumerate(numbers)
    ]
    merged = counted.groupBy(*names).agg(*means, *[best for best, _ in modes])
    found = {name: col(name) for name in numbers}
    found.update({name: value for name, (_, value) in zip(words, modes)})
    rest = [found[name] for name in df.columns if name in found]
    return merged.select(*names, *rest)


def merge_records_mode(df: DataFrame, keys=KEYS, cols: list[str] | None = None) -> DataFrame:
    """Most frequent value of each text column, the smallest one on a tie, NULL when all
    values are NULL."""
    cols = _others(df, keys, False) if cols is None else cols
    if not cols:
        return df.select(*[col(k) for k in keys]).distinct()
    return merge_records(df, keys, numbers=[], words=cols)


def yearly_trend(
    df: DataFrame, cols: list[str] = TREND_METRICS, by=KEYS, year: str = YEAR
) -> DataFrame:
    """Mean per company and known year of all trend metrics present, from one aggregate."""
    present = [name for name in cols if name in df.columns]
    return merge_records_mean(known_years(df, year), by, present)


def comparison_pivot(
    df: DataFrame, cols: list[str], by=KEYS, year: str = YEAR
) -> DataFrame:
    """Mean of the chosen indicators, one row per company, indicator and known year."""
    present = [name for name in dict.fromkeys(cols) if name in df.columns and is_numeric(df, name)]
    means = merge_records_mean(known_years(df, year), by, present)
    quoted = [col(name) for name in present]
    return means.unpivot([col(k) for k in by], quoted, "indicator", "mean")


def growth_pct(
    df: DataFrame,
    cols: list[str],
    ffill: bool = True,
    entity: str = ENTITY,
    year: str = YEAR,
    years: list[int] | None = None,
) -> DataFrame:
    """Percent change of the yearly means to the year before that the company has, among
    the listed years (all known ones by default).

    With ``ffill`` a missing mean takes the last known one first. A zero base gives NULL.
    Rows are reduced to one per company-year before they are ordered.
    """
    rows = known_years(filter_years(df, years or [], year), year)
    means = merge_records_mean(rows, (entity, year), cols)
    by_year = Window.partitionBy(col(entity)).orderBy(col(year))
    values = means
    if ffill:
        so_far = by_year.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        values = means.withColumns(
            {name: F.last(col(name), ignorenulls=True).over(so_far) for name in cols}
        )
    change = {
        f"{name} growth %": F.try_divide(
            col(name) - F.lag(col(name)).over(by_year), F.lag(col(name)).over(by_year)
        )
        * 100
        for name in cols
    }
    grown = values.withColumns(change)
    return grown.select(col(entity), col(year), *[col(name) for name in change])


def score_vs_market(
    df: DataFrame, score: str = SCORE, entity: str = ENTITY, year: str = YEAR
) -> DataFrame:
    """Mean score of each company-year beside the mean of all rows of that year.

    Both are brought to 0-100 when both are fractions.
    """
    value = numeric(df, score)
    sums = df.groupBy(col(entity), col(year)).agg(
        F.sum(value).alias("__sum"), F.count(value).alias("__n")
    )
    # Rows of a year become sums per company-year first; the market is their sum.
    sums = stage(sums, "company-years")
    own = sums.select(col(entity), col(year), F.try_divide("__sum", "__n").alias("own"))
    market = sums.groupBy(col(year)).agg(
        F.try_divide(F.sum("__sum"), F.sum("__n")).alias("market")
    )
    both = lookup_join(own, market, [year])
    factor = F.when(F.col("own").between(0, 1) & F.col("market").between(0, 1), 100.0).otherwise(1.0)
    return both.select(
        col(entity),
        col(year),
        (F.col("own") * factor).alias("company_score"),
        (F.col("market") * factor).alias("market_score"),
        ((F.col("own") - F.col("market")) * factor).alias("difference"),
    )


def metrics_vs_market(
    df: DataFrame,
    metrics: list[str] = KEY_METRICS,
    limit: int | None = None,
    order: list[str] | None = None,
    entity: str = ENTITY,
    year: str = YEAR,
) -> DataFrame:
    """First record of each company-year against the mean of the year, for the
    metrics present (the first ``limit`` of them); a missing company value counts as 0."""
    present = [name for name in metrics if name in df.columns][:limit]
    extra = [name for name in (order or []) if name not in present]
    values = {name: numeric(df, name) for name in present}
    lean = df.select(
        col(entity),
        col(year),
        *[col(name) for name in extra],
        *[values[name].alias(name) for name in present],
    )
    own = first_records(lean, [entity, year], order)
    means = [F.avg(col(name)).alias(f"__market{i}") for i, name in enumerate(present)]
    # Written once; the join looks at its size first.
    market = stage(lean.groupBy(col(year)).agg(*means), "market-means")
    both = lookup_join(own, market, [year])
    rows = [
        F.struct(
            F.lit(name).alias("metric"),
            F.coalesce(col(name), F.lit(0.0)).alias("company_value"),
            F.col(f"__market{i}").alias("market_value"),
        )
        for i, name in enumerate(present)
    ]
    long = both.select(col(entity), col(year), F.inline(F.array(*rows)))
    return long.withColumn("difference", F.col("company_value") - F.col("market_value"))


def metrics_vs_market_long(df: DataFrame, *args, entity=ENTITY, year=YEAR, **kwargs) -> DataFrame:
    """The same comparison as (metric, side, value) rows."""
    wide = metrics_vs_market(df, *args, entity=entity, year=year, **kwargs)
    sides = F.array(
        F.struct(F.lit("company").alias("side"), F.col("company_value").alias("value")),
        F.struct(F.lit("market").alias("side"), F.col("market_value").alias("value")),
    )
    return wide.select(col(entity), col(year), "metric", F.inline(sides))


def metric_cards(
    df: DataFrame, entity: str = ENTITY, year: str = YEAR, rating: str = RATING, score: str = SCORE
) -> DataFrame:
    """Headline figures of each row as text; use on merged records."""
    shown = [col(entity), col(year)]
    if rating in df.columns:
        shown.append(F.coalesce(F.upper(col(rating)), F.lit("NAN")).alias(rating))
    if RATING_DESCRIPTION in df.columns:
        shown.append(col(RATING_DESCRIPTION))
    if score in df.columns:
        shown.append(fixed2(rescale_score(numeric(df, score))).alias(score))
    for name in CARD_AMOUNTS:
        if name in df.columns:
            shown.append(format_magnitude(numeric(df, name)).alias(name))
    return df.select(*shown)


def metric_group_long(
    df: DataFrame,
    groups: dict[str, list[str]] = METRIC_GROUPS,
    exact_only: bool = False,
    entity: str = ENTITY,
    year: str = YEAR,
) -> DataFrame:
    """(group, metric, value, text) rows of the metrics that a company-year has."""
    rows = []
    for group, names in resolve_all_groups(df.columns, groups, exact_only).items():
        for name in dict.fromkeys(names):
            is_text = isinstance(df.schema[name].dataType, T.StringType)
            raw = col(name) if is_text else F.lit(None).cast("string")
            rows.append(
                F.struct(
                    F.lit(group).alias("metric_group"),
                    F.lit(name).alias("metric"),
                    numeric(df, name).alias("value"),
                    raw.alias("raw"),
                )
            )
    long = df.select(col(entity), col(year), F.inline(F.array(*rows)))
    value = F.col("value")
    text = F.when(value.isNotNull(), format_metric(F.col("metric"), value)).otherwise(F.col("raw"))
    return long.withColumn("text", text).drop("raw").where(F.col("text").isNotNull())


def entity_detail(
    df: DataFrame,
    value,
    all_years: bool = False,
    year_value: int | None = None,
    entity: str = ENTITY,
    year: str = YEAR,
) -> DataFrame:
    """All columns of one company, latest year first; one year unless ``all_years``."""
    rows = entity_rows(df, value, entity)
    if not all_years:
        if year_value is None:
            wanted = rows.agg(F.max(col(year)).alias("y")).scalar()
        else:
            wanted = F.lit(int(year_value))
        rows = rows.where(col(year) == wanted)
    # The partition splits a year with many rows when the rows are ranged for sorting.
    placed = rows.withColumn("__place", F.spark_partition_id())
    return placed.orderBy(col(year).desc(), "__place").drop("__place")
