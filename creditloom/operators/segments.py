"""k-means whose clusters do not depend on the layout of the rows.

z-scores are rounded to a fine grid, so that sums are exact in any order, and entries move to
the floor of their members' mean. Seeds are spread over a sample that is chosen by the hash
of the rows' content. An iteration is one pass that adds up k rows; nothing but those and
the sample reaches the driver.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.columns import col
from creditloom.operators.features import standardize
from creditloom.staging import stage

#: Steps of the grid per standard deviation.
GRID = 1 << 16
ROWS_PER_TASK = 25_000
#: Rows from which the seeds are chosen.
SEED_ROWS = 10_000


def _seeds(sample: np.ndarray, k: int, seed: int) -> list[list[int]]:
    """Rows far from each other: each next one is drawn by its squared distance."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    chosen = [sample[rng.integers(len(sample))]]
    away = ((sample - chosen[0]).astype(float) ** 2).sum(axis=1)
    while len(chosen) < k and away.sum() > 0:
        chosen.append(sample[rng.choice(len(sample), p=away / away.sum())])
        away = np.minimum(away, ((sample - chosen[-1]).astype(float) ** 2).sum(axis=1))
    return [[int(v) for v in row] for row in chosen]


def _nearest(names: list[str], centres: list[list[int]]) -> Column:
    """Number of the nearest centre; of equally near ones the first."""
    away = []
    for centre in centres:
        total = F.lit(0.0)
        for name, value in zip(names, centre):
            gap = F.col(name).cast("double") - F.lit(float(value))
            total = total + gap * gap
        away.append(total)
    listed = F.array(*away)
    return (F.array_position(listed, F.array_min(listed)) - 1).cast("int")


def _sums(rows: DataFrame, names: list[str], centres: list[list[int]]) -> list[list[int]]:
    """Component sums and number of the rows nearest to each centre."""
    at = np.array(centres, dtype=np.int64)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(at), len(names) + 1), dtype=np.int64)
        for part in parts:
            x = np.column_stack([part.column(g).to_numpy() for g in names])
            # In the order of ``_nearest``, so that both agree to the last bit.
            away = np.zeros((len(x), len(at)))
            for j in range(len(names)):
                gap = x[:, j, None].astype(float) - at[None, :, j].astype(float)
                away += gap * gap
            ones = np.ones((len(x), 1), dtype=np.int64)
            np.add.at(sums, away.argmin(axis=1), np.hstack([x, ones]))
        c, place = np.nonzero(sums)
        columns = [pa.array(v.astype(np.int64)) for v in (c, place, sums[c, place])]
        yield pa.RecordBatch.from_arrays(columns, names=["c", "place", "total"])

    parts = rows.select(*names).mapInArrow(batches, "c long, place long, total long")
    found = parts.groupBy("c", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [[0] * (len(names) + 1) for _ in centres]
    for r in found.collect():
        out[r["c"]][r["place"]] = int(r["total"])
    return out


def cluster(
    df: DataFrame,
    features: list[str],
    k: int = 5,
    seed: int = 42,
    max_iter: int = 20,
    number: str = "cluster",
) -> DataFrame:
    """``df``, whose ``features`` are finite doubles, with the number of each row's cluster.

    There are fewer clusters than ``k`` when fewer rows differ. Columns stay as they are.
    """
    names = [f"__g{i}" for i in range(len(features))]
    copies = df.withColumns({g: col(name) for g, name in zip(names, features)})
    scaled = standardize(copies, names, population=False)
    # The last digits of a mean follow the order of addition; the grid hides them.
    rounded = {g: F.rint(F.col(g) * GRID).cast("long") for g in names}
    rows = stage(scaled.withColumns(rounded), "segments")
    n = rows.count()
    if not n:
        return df.withColumn(number, F.lit(None).cast("int"))
    ticket = F.pmod(F.xxhash64(F.lit(seed), *[F.col(g) for g in names]), F.lit(1 << 40))
    drawn = rows.where(ticket <= int(min(1.0, SEED_ROWS / n) * (1 << 40))).select(*names).distinct()
    if drawn.isEmpty():
        drawn = rows.select(*names).distinct().orderBy(*names).limit(SEED_ROWS)
    # Distinct contents by hash: about SEED_ROWS of them, fewer when rows repeat.
    centres = _seeds(np.array([list(r) for r in drawn.collect()], dtype=np.int64), k, seed)
    # A pass over few rows costs less than the tasks that do it.
    few = rows.coalesce(max(1, -(-n // ROWS_PER_TASK)))
    for _ in range(max_iter):
        sums = _sums(few, names, centres)
        moved = [
            [v // total[-1] for v in total[:-1]] if total[-1] else list(centre)
            for total, centre in zip(sums, centres)
        ]
        if moved == centres:
            break
        centres = moved
    return rows.withColumn(number, _nearest(names, centres)).drop(*names)
