"""Joins of row-level data with lookup tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.columns import col

# About 32 MB of numbers.
BROADCAST_CELLS = 4_000_000
# A key with a larger share of the rows is spread over SALTS tasks.
HOT_SHARE = 1 / 1000
SALTS = 1024
SAMPLE_ROWS = 1_000_000


def fits_broadcast(table: DataFrame, max_cells: int = BROADCAST_CELLS) -> bool:
    """Whether rows x columns of ``table`` stay within the bound.

    Only partial counts move, and columns that are not keys are pruned from the count.
    """
    return table.count() * len(table.columns) <= max_cells


def hot_keys(rows: DataFrame, on: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than about ``share`` of the rows; at most about 1 / ``share`` keys.

    A sample finds them: it decides how rows are spread, never which rows are kept.
    """
    n = rows.count()
    fraction = min(1.0, SAMPLE_ROWS / max(n, 1))
    keys = rows.select(*[col(k) for k in on]).dropna()
    if fraction < 1.0:
        keys = keys.sample(fraction=fraction, seed=42)
    frequent = keys.groupBy(*[col(k) for k in on]).count().where(
        F.col("count") > max(1.0, share * n * fraction)
    )
    found = frequent.select(*[col(k) for k in on]).collect()
    return rows.sparkSession.createDataFrame(found, keys.schema)


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "inner",
    salts: int = SALTS,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Shuffled equi-join in which the hot keys of ``rows`` are spread over many tasks.

    Only the few hot keys are repeated on the side of ``table``. The salt of a row is its
    input partition: that spreads equal rows too, and a retried task gives each row the
    salt it had before. Rows without a key match nothing and are spread as well.
    """
    hot = F.broadcast(hot_keys(rows, on, share).withColumn("__hot", F.lit(True)))
    placed = rows.withColumn("__place", F.pmod(F.spark_partition_id(), F.lit(salts)))
    no_key = reduce(lambda a, b: a | b, [col(k).isNull() for k in on])
    salt = F.when(F.col("__hot") | no_key, F.col("__place")).otherwise(0)
    left = placed.join(hot, on, "left").withColumn("__salt", salt).drop("__hot", "__place")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
    repeated = F.explode(copies.otherwise(F.array(F.lit(0))))
    right = table.join(hot, on, "left").withColumn("__salt", repeated).drop("__hot")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "inner",
    max_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """Join ``rows`` to a table with few rows per key.

    The table is broadcast when a count shows that it is small; else the join is
    shuffled with salted keys. ``how`` is ``inner`` or ``left``.
    """
    if fits_broadcast(table, max_cells):
        return rows.join(F.broadcast(table), on, how)
    return salted_join(rows, table, on, how)
