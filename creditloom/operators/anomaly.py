"""Isolation forest (Liu, Ting and Zhou, 2008) and lists of anomalies.

Each tree is grown from at most ``SAMPLE_ROWS`` rows, all trees at once in parallel
groups; scoring is one pass with the forest as arrays of bounded size. The splits do not
depend on the scale of a feature, so the features are not standardised.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.catalog import ENTITY, YEAR
from creditloom.functions.columns import col, is_finite, numeric
from creditloom.operators.quantiles import exact_quantiles
from creditloom.staging import stage

KEYS = (ENTITY, YEAR)

SAMPLE_ROWS = 256
POOL_FACTOR = 10
#: Equal rows that are numbered in one piece.
COPIES = 10_000
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, path double"
)


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(rows: np.ndarray, seed: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, path) of one isolation tree.

    A leaf has feature -1, points to itself and holds its depth plus the mean depth of
    the rows left in it.
    """
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(rows), 2)))
    nodes: list[tuple] = []
    todo = [(0, rows, 0)]
    used = 1
    while todo:
        node, part, depth = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(varying) == 0:
            nodes.append((node, -1, 0.0, node, node, depth + mean_path(len(part))))
            continue
        feature = int(rng.choice(varying))
        threshold = float(rng.uniform(low[feature], high[feature]))
        threshold = min(threshold, float(np.nextafter(high[feature], -np.inf)))
        goes_left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, used, used + 1, 0.0))
        todo.append((used, part[goes_left], depth + 1))
        todo.append((used + 1, part[~goes_left], depth + 1))
        used += 2
    return nodes


def path_lengths(forest: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Mean path length of each row over the trees."""
    tree = np.arange(forest["feature"].shape[0])
    at = np.zeros((len(rows), len(tree)), dtype=np.int32)
    line = np.arange(len(rows))[:, None]
    for _ in range(forest["levels"]):
        feature = forest["feature"][tree, at]
        value = rows[line, np.maximum(feature, 0)]
        left = value <= forest["threshold"][tree, at]
        at = np.where(left, forest["left"][tree, at], forest["right"][tree, at])
    return forest["path"][tree, at].mean(axis=1)


@dataclass
class IsolationForest:
    features: list[str]
    forest: dict[str, np.ndarray]
    sample_rows: int
    offset: float = -0.5

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score_samples`` (low = abnormal), ``decision`` and ``is_anomaly`` to the
        rows in which all features are finite."""
        usable = df
        for name in self.features:
            usable = usable.where(is_finite(numeric(df, name)))
        shared = df.sparkSession.sparkContext.broadcast(self.forest)
        unit = mean_path(self.sample_rows) or 1.0

        @F.pandas_udf("double")
        def score_samples(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                yield pd.Series(-np.exp2(-path_lengths(shared.value, rows) / unit))

        inputs = [numeric(df, name) for name in self.features]
        scored = usable.withColumn("score_samples", score_samples(*inputs))
        decision = F.col("score_samples") - F.lit(self.offset)
        return scored.withColumn("decision", decision).withColumn("is_anomaly", decision < 0)


def _ticket(seed: int, *columns) -> Column:
    """Uniform in [0, 1), by the columns."""
    word = F.xxhash64(F.lit(seed), *columns)
    return F.pmod(word, F.lit(1 << 52)).cast("double") / float(1 << 52)


def _pool(df: DataFrame, features: list[str], wanted: int, seed: int) -> tuple[DataFrame, int]:
    """Staged rows to draw from, and the number of complete rows of ``df``.

    All rows when they are few, else a uniform sample of bounded size. Equal rows are counted
    and numbered, so that they are drawn one by one; a row is taken by a hash of its content
    and number, so the layout does not matter.
    """
    rows = df.select(*[numeric(df, name).alias(f"f{i}") for i, name in enumerate(features)])
    names = rows.columns
    for name in names:
        rows = rows.where(is_finite(F.col(name)))
    n = rows.count()
    share = wanted / n if n > 2 * wanted else 1.0
    counted = rows.groupBy(*names).agg(F.count("*").alias("copies"))
    # Numbers of frequent content are dealt over the tasks, so many at a time.
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(COPIES).cast("long")))
    parts = counted.select(*names, "copies", first.alias("first"))
    last = F.least(F.col("copies"), F.col("first") + (COPIES - 1))
    taken = F.filter(
        F.sequence(F.col("first"), last),
        lambda c: _ticket(seed, F.lit("pool"), *[F.col(x) for x in names], c) < share,
    )
    dealt = parts.repartition(*names, "first")
    return stage(dealt.select(*names, F.explode(taken).alias("copy")), "isolation-pool"), n


def _drawn(pool: DataFrame, n_pool: int, trees: int, psi: int, seed: int) -> DataFrame:
    """(tree, features) with ``psi`` rows of the pool per tree, without replacement.

    Each row draws its trees by hash; about 1.3 psi rows per tree are emitted, of which
    the lowest hashes stay.
    """
    share = min(1.0, (1.3 * psi + 50) / max(n_pool, 1))
    names = [name for name in pool.columns if name.startswith("f")]

    def ticket(tree: Column) -> Column:
        return _ticket(seed, tree, *[F.col(x) for x in names], F.col("copy"))

    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: ticket(t) < share)
    emitted = pool.withColumn("tree", F.explode(chosen)).withColumn("ticket", ticket(F.col("tree")))
    by_ticket = Window.partitionBy("tree").orderBy("ticket")
    ranked = emitted.withColumn("place", F.row_number().over(by_ticket))
    return ranked.where(F.col("place") <= psi).select("tree", "ticket", *names)


def _as_arrays(nodes: pd.DataFrame, trees: int) -> dict[str, np.ndarray]:
    width = int(nodes["node"].max()) + 1
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    arrays = {}
    for name, kind in [
        ("feature", np.int32),
        ("threshold", float),
        ("left", np.int32),
        ("right", np.int32),
        ("path", float),
    ]:
        arrays[name] = np.zeros((trees, width), dtype=kind)
        arrays[name][at] = nodes[name].to_numpy()
    return arrays


def fit_isolation_forest(
    df: DataFrame,
    features: list[str],
    trees: int = 400,
    contamination: float | str = 0.03,
    seed: int = 42,
    min_rows: int | None = None,
) -> IsolationForest | None:
    """Forest over the complete rows of ``df``; None when there are fewer than
    ``min_rows`` (50 or three per feature unless given).

    With a number as ``contamination`` the offset is that quantile of the scores of the
    training rows, so that this share of them is flagged; with ``auto`` it is -0.5.
    """
    if not features:
        return None
    least = max(50, 3 * len(features)) if min_rows is None else min_rows
    pool, n = _pool(df, features, POOL_FACTOR * trees * SAMPLE_ROWS, seed)
    if n < max(least, 1):
        return None
    psi = min(SAMPLE_ROWS, n)
    drawn = _drawn(pool, pool.count(), trees, psi, seed)
    names = [f"f{i}" for i in range(len(features))]

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rows = group.sort_values("ticket")[names].to_numpy(dtype=float)
        nodes = grow_tree(rows, seed * 1_000_003 + tree)
        columns = ["node", "feature", "threshold", "left", "right", "path"]
        grown = pd.DataFrame(nodes, columns=columns)
        grown.insert(0, "tree", tree)
        return grown

    # At most trees x (2 psi - 1) nodes reach the driver.
    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    forest = _as_arrays(nodes, trees)
    forest["levels"] = math.ceil(math.log2(max(psi, 2)))
    model = IsolationForest(features, forest, psi)
    if contamination != "auto":
        scores = stage(model.score(df).select("score_samples"), "isolation-scores")
        found = exact_quantiles(scores, {"s": F.col("score_samples")}, [float(contamination)])
        model.offset = found["s"][0]
    return model


def top_anomalies(
    scored: DataFrame, n: int = 20, score: str = "score", keys=KEYS, meta: list[str] | None = None
) -> DataFrame:
    """The ``n`` rows with the highest score (high = abnormal)."""
    order = [col(k) for k in keys if k in scored.columns]
    shown = [name for name in (meta or keys) if name in scored.columns]
    ranked = scored.select(*[col(name) for name in shown], col(score).alias("score"))
    return ranked.orderBy(F.col("score").desc(), *order).limit(n)


def flagged_anomalies(
    scored: DataFrame,
    n: int = 10,
    score: str = "decision",
    flag: str = "is_anomaly",
    keys=KEYS,
    show: list[str] | None = None,
) -> DataFrame:
    """The ``n`` most abnormal flagged rows (low = abnormal)."""
    order = [col(k) for k in keys]
    kept = scored.where(col(flag)).orderBy(col(score), *order).limit(n)
    return kept.select(*order, col(score).alias("score"), *[col(name) for name in show or []])


def lowest_scores(
    scored: DataFrame, n: int = 10, score: str = "score_samples", keys=KEYS
) -> DataFrame:
    """The ``n`` rows with the lowest raw score."""
    order = [col(k) for k in keys]
    return scored.orderBy(col(score), *order).limit(n)


def _empty(df: DataFrame, keys, extra: list[str]) -> DataFrame:
    nothing = F.lit(None).cast("double").alias("score")
    return df.select(*[col(k) for k in keys], nothing, *[col(x) for x in extra]).limit(0)


def isoforest_fit_rank(
    train: DataFrame,
    df: DataFrame,
    features: list[str],
    contamination: float = 0.03,
    n: int = 20,
    trees: int = 400,
    keys=KEYS,
) -> DataFrame:
    """Fit on the model rows ``train``, rank all rows of ``df`` with complete features."""
    model = fit_isolation_forest(stage(train, "isolation-train"), features, trees, contamination)
    if model is None:
        return _empty(df, keys, [])
    scored = model.score(df).withColumn("score", -F.col("decision"))
    return top_anomalies(scored, n, keys=keys)


def isoforest_flags(
    df: DataFrame,
    features: list[str],
    contamination: float = 0.05,
    n: int = 10,
    trees: int = 100,
    keys=KEYS,
) -> DataFrame:
    """The most abnormal flagged company-years with their features."""
    lean = stage(df.select(*[col(k) for k in keys], *[col(f) for f in features]), "isolation-rows")
    model = fit_isolation_forest(lean, features, trees, contamination, min_rows=1)
    if model is None:
        return _empty(df, keys, features)
    return flagged_anomalies(model.score(lean), n, keys=keys, show=features)


def isoforest_raw(
    df: DataFrame,
    features: list[str],
    n: int = 10,
    trees: int = 300,
    seed: int = 42,
    keys=KEYS,
) -> DataFrame:
    """The rows with the lowest raw scores."""
    lean = stage(df, "isolation-rows")
    model = fit_isolation_forest(lean, features, trees, "auto", seed, min_rows=1)
    if model is None:
        return _empty(df, keys, features)
    ranked = lowest_scores(model.score(lean), n, keys=keys)
    return ranked.select(
        *[col(k) for k in keys], F.col("score_samples").alias("score"), *[col(f) for f in features]
    )
