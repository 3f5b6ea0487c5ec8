"""Clipping of outliers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.columns import col, numeric
from creditloom.operators.quantiles import exact_quantiles


def winsorize_all(
    df: DataFrame, cols: list[str], p: float = 0.99, relative_error: float = 0.0
) -> DataFrame:
    """Clip each column to its [1-p, p] quantiles; absent and empty columns are left.

    Quantiles are exact by default; ``relative_error`` > 0 takes them from one sketch.
    NULL stays NULL.
    """
    present = [name for name in dict.fromkeys(cols) if name in df.columns]
    if not present:
        return df
    probs = [round(1 - p, 12), p]
    exprs = {name: numeric(df, name) for name in present}
    if relative_error > 0:
        numbers = df.select(*[exprs[name].alias(name) for name in present])
        found = numbers.approxQuantile(["`" + n + "`" for n in present], probs, relative_error)
        bounds = dict(zip(present, found))
    else:
        bounds = exact_quantiles(df, exprs, probs)
    clipped = {}
    for name in present:
        if bounds[name]:
            low, high = bounds[name]
            x = exprs[name]
            clipped[name] = F.when(x < low, low).when(x > high, high).otherwise(x)
    return df.select(
        *[clipped[name].alias(name) if name in clipped else col(name) for name in df.columns]
    )


def winsorize(df: DataFrame, name: str, p: float = 0.99, relative_error: float = 0.0) -> DataFrame:
    return winsorize_all(df, [name], p, relative_error)
