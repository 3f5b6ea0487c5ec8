"""Running sums over a whole table in a global order.

The rows are cut into ranges of the order column, a small window over the range totals
gives each range its offset, and the running sums are taken inside each range.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows per range; the number of ranges follows the number of rows.
RANGE_ROWS = 100_000


def _range_bounds(df: DataFrame, order: str, n: int, range_rows: int) -> list[float]:
    """Inner bounds of ranges with about ``range_rows`` rows each; none for a small table."""
    ranges = -(-n // range_rows)
    if ranges <= 1:
        return []
    probs = [i / ranges for i in range(1, ranges)]
    found = df.approxQuantile(order, probs, 1.0 / (4 * ranges))
    return sorted(set(found))


def running_sums(
    df: DataFrame,
    order: str,
    sums: list[str],
    descending: bool = True,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add ``cum_<name>`` for each of ``sums``: total of the rows up to and with this one.

    ``df`` must hold one row per value of the double column ``order`` (an aggregate on
    it), so that a value shared by many rows is one row here and ranges stay even, and
    be staged, since bounds, totals and sums have to see the same rows.
    """
    staged = df
    bounds = _range_bounds(staged, order, staged.count(), range_rows)
    ranged = staged.withColumn("__range", F.lit(0.0))
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        ranged = Bucketizer(splits=splits, inputCol=order, outputCol="__range").transform(staged)
    direction = -1.0 if descending else 1.0
    across = Window.orderBy(F.col("__range") * direction).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One row per range.
    totals = ranged.groupBy("__range").agg(*[F.sum(name).alias(name) for name in sums])
    offsets = totals.select(
        "__range",
        *[F.coalesce(F.sum(name).over(across), F.lit(0)).alias(f"__off_{name}") for name in sums],
    )
    key = F.col(order).desc() if descending else F.col(order).asc()
    within = (
        Window.partitionBy("__range")
        .orderBy(key)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    added = ranged.join(F.broadcast(offsets), "__range").withColumns(
        {f"cum_{n}": F.sum(n).over(within) + F.col(f"__off_{n}") for n in sums}
    )
    return added.drop("__range", *[f"__off_{name}" for name in sums])
