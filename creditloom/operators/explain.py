"""Explanations of a classifier: permutation importance, partial dependence and
attributions of a forest's score to the features."""

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.catalog import ENTITY, YEAR
from creditloom.functions.columns import col, is_finite, key_hash, key_hash52, numeric
from creditloom.operators import forest
from creditloom.operators.models import ForestClassifier
from creditloom.operators.quantiles import order_statistics
from creditloom.staging import stage

KEYS = (ENTITY, YEAR)

BUCKET_ROWS = 20_000
GRID_POINTS = 100
BLOCK_NODES = 2_000_000
CELLS = 2_000_000
# Copies of one row that are made in one go.
COPIES = 10_000
TABLE_TESTS = 6
# Numbers in the tables of a block of leaves, and cells of a table.
TABLE_CELLS = 16_000_000
RUN_CELLS = 256
# Rows that are attributed together.
STEP_ROWS = 10_000

Predict = Callable[[DataFrame], DataFrame]


def permutation_importance(
    df: DataFrame,
    features: list[str],
    predict: Predict,
    label: str = "label",
    repeats: int = 10,
    seed: int = 42,
    row_id: Column | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Loss of accuracy when one feature is shuffled: mean and deviation over repeats.

    Rows go to random buckets once, and in each repeat a row takes the feature of the
    next row in a random order of its bucket (the last one that of the first), so each
    repeat permutes every feature's values. All features and repeats are scored in one
    job. ``row_id`` must be unique; by default it is the hash of the row's content and a
    number among equal rows, so the layout does not matter.
    """
    names = [f"x{i}" for i in range(len(features))]
    lean = df.select(
        (F.lit(None) if row_id is None else row_id).alias("id"),
        col(label).cast("int").alias("label"),
        *[numeric(df, f).alias(x) for f, x in zip(features, names)],
    )
    rows = stage(lean if row_id is not None else _numbered(lean, ["label", *names]), "permutation")
    buckets = max(1, rows.count() // bucket_rows)
    placed = rows.withColumn("bucket", key_hash(F.col("id"), F.lit("bucket")) % buckets)
    donors = {}
    for r in range(repeats):
        order = key_hash52(F.col("id"), F.lit(seed + r))
        ring = Window.partitionBy("bucket").orderBy(order, "id")
        values = F.struct(*names)
        donors[f"donor{r}"] = F.coalesce(F.lead(values).over(ring), F.first(values).over(ring))
    linked = placed.withColumns(donors)
    unchanged = len(features)
    which = F.when(F.col("repeat") == 0, F.sequence(F.lit(0), F.lit(unchanged))).otherwise(
        F.sequence(F.lit(0), F.lit(unchanged - 1))
    )
    trials = (
        linked.select(
            "label",
            *names,
            F.posexplode(F.array(*[F.col(d) for d in donors])).alias("repeat", "donor"),
        )
        .withColumn("swapped", F.explode(which))
        .select(
            "repeat",
            "swapped",
            F.col("label").alias("true_label"),
            *[
                F.when(F.col("swapped") == i, F.col(f"donor.{x}")).otherwise(F.col(x)).alias(f)
                for i, (f, x) in enumerate(zip(features, names))
            ],
        )
    )
    hit = (F.col("prediction").cast("int") == F.col("true_label")).cast("int")
    accuracy = predict(trials).groupBy("swapped", "repeat").agg(F.avg(hit).alias("accuracy"))
    # features x repeats + 1 rows from here on.
    whole = Window.partitionBy()
    base = F.max(F.when(F.col("swapped") == unchanged, F.col("accuracy"))).over(whole)
    drops = accuracy.withColumn("drop", base - F.col("accuracy")).where(
        F.col("swapped") < unchanged
    )
    name = F.element_at(F.array(*map(F.lit, features)), F.col("swapped") + 1)
    return drops.groupBy(name.alias("feature")).agg(
        F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("importance_std")
    )


def _numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """``id`` from the content and a number among equal rows.

    Equal rows are counted on the map side and made again from the count, in pieces, so any
    number of them is spread over the tasks.
    """
    counted = df.groupBy(*columns).agg(F.count("*").alias("copies"))
    pieces = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))
    dealt = counted.withColumn("start", F.explode(pieces)).repartition(*columns, "start")
    last = F.least(F.col("start") + COPIES, F.col("copies")) - 1
    made = dealt.withColumn("copy", F.explode(F.sequence("start", last)))
    content = F.xxhash64(*columns).cast("string")
    return made.select(F.concat_ws("|", content, F.col("copy").cast("string")).alias("id"), *columns)


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def _plotting_position(values: dict[int, float], n: int, p: float) -> float:
    """Quantile with plotting position 0.4 on both sides."""
    at = n * p + 0.4 + 0.2 * p
    k = min(max(math.floor(at), 1), n - 1) if n > 1 else 1
    share = min(max(at - k, 0.0), 1.0)
    low, high = values[k - 1], values[min(k, n - 1)]
    return (1 - share) * low + share * high


def dependence_grids(
    df: DataFrame,
    features: list[str],
    points: int = GRID_POINTS,
    span: tuple[float, float] = (0.05, 0.95),
) -> dict[str, list[float]]:
    """Values per feature: evenly spaced between the ``span`` quantiles, or the distinct
    values where there are fewer than ``points`` of them."""
    grids = {}
    exprs = {name: numeric(df, name) for name in features}

    def ranks(n: int) -> list[int]:
        places = [math.floor(n * p + 0.4 + 0.2 * p) for p in span]
        around = [k for place in places for k in (place - 1, place)]
        return [min(max(k, 0), n - 1) for k in around] + [0, n - 1]

    found = order_statistics(df, exprs, ranks)
    counts = df.agg(*[F.approx_count_distinct(exprs[f]).alias(f"d{i}") for i, f in enumerate(features)])
    for name, about in zip(features, counts.first()):
        n, values = found[name]
        if n == 0:
            grids[name] = []
            continue
        # Only a column that may have few values is reduced to them.
        few = _distinct_values(df, exprs[name], points) if about < 2 * points else None
        if few is not None:
            grids[name] = few
        else:
            low, high = (_plotting_position(values, n, p) for p in span)
            grids[name] = [low + (high - low) * i / (points - 1) for i in range(points)]
    return grids


def _distinct_values(df: DataFrame, x: Column, limit: int) -> list[float] | None:
    """Sorted distinct values, or None when there are ``limit`` or more of them."""
    rows = df.select(x.alias("x")).dropna().distinct().limit(limit).collect()
    return sorted(row["x"] for row in rows) if len(rows) < limit else None


def partial_dependence(
    df: DataFrame,
    features: list[str],
    predict: Predict,
    shown: list[str] | None = None,
    points: int = GRID_POINTS,
    grids: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Mean P(IG) over all rows when one feature is set to each value of its grid.

    The grids are literals of bounded size; the scores are averaged on the map side.
    """
    shown = shown or features
    grids = grids or dependence_grids(df, shown, points)
    settings = [
        F.struct(F.lit(features.index(name)).alias("i"), F.lit(float(v)).alias("v"))
        for name in shown
        for v in grids[name]
    ]
    names = [f"x{i}" for i in range(len(features))]
    lean = df.select(*[numeric(df, f).alias(x) for f, x in zip(features, names)])
    trials = lean.select(*names, F.explode(F.array(*settings)).alias("set")).select(
        F.col("set.i").alias("set_feature"),
        F.col("set.v").alias("grid_value"),
        *[
            F.when(F.col("set.i") == i, F.col("set.v")).otherwise(F.col(x)).alias(f)
            for i, (f, x) in enumerate(zip(features, names))
        ],
    )
    scored = predict(trials).groupBy("set_feature", "grid_value").agg(
        F.avg("p_ig").alias("mean_p_ig")
    )
    name = F.element_at(F.array(*map(F.lit, features)), F.col("set_feature") + 1)
    return scored.select(name.alias("feature"), "grid_value", "mean_p_ig")


def forest_dependence(
    fitted: ForestClassifier,
    df: DataFrame,
    shown: list[str] | None = None,
    points: int = GRID_POINTS,
    grids: dict[str, list[float]] | None = None,
) -> DataFrame:
    """``partial_dependence`` of a forest: each row goes once down the trees per feature,
    whatever the number of grid values. Rows with a feature that is not finite are left out."""
    shown = shown or fitted.features
    grids = grids or dependence_grids(df, shown, points)
    places = {fitted.features.index(name): name for name in shown if grids[name]}
    rows = df.select(fitted.vector(df).alias("x"))
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & is_finite(v)))
    settings = [
        F.struct(F.lit(i).cast("long").alias("feature"), F.lit(name).alias("name"), F.lit(k).cast("long").alias("point"), F.lit(float(v)).alias("grid_value"))
        for i, name in places.items()
        for k, v in enumerate(sorted(grids[name]))
    ]
    result = "feature string, grid_value double, mean_p_ig double"
    if not settings:
        return df.sparkSession.createDataFrame([], result)
    values = df.sparkSession.range(1).select(F.inline(F.array(*settings)))
    means = fitted.forest.dependence(rows, {i: sorted(grids[name]) for i, name in places.items()})
    joined = means.join(F.broadcast(values), ["feature", "point"])
    return joined.select(
        F.col("name").alias("feature"), "grid_value", F.col("mean").alias("mean_p_ig")
    )


@dataclass
class _Leaves:
    """Leaves of a forest whose paths test the same number of features.

    ``table`` holds the attribution of each tested feature for every pattern of passed
    tests, where there are few patterns.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    table: np.ndarray | None = None


LEAF = (
    "tree long, value double, weight double, size int, feature array<int>, low array<double>, "
    "high array<double>, share array<double>"
)


def _tree_leaves(table: pa.Table) -> pa.Table:
    """Leaves of one tree: for each feature that its path tests the interval in which the
    feature has to lie, and the part of the rows that takes this side of its splits.

    ``weight`` is the part of the tree's mean score that comes from the leaf.
    """
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    nodes = {i: k for k, i in enumerate(columns["id"])}
    left, right, cover = columns["left"], columns["right"], columns["cover"]
    rows = []
    todo: list[tuple[int, dict]] = [(nodes[0], {})]
    while todo:
        node, path = todo.pop()
        if left[node] < 0:
            tests = list(path.values())
            value = columns["value"][node]
            rows.append(
                {
                    "tree": columns["tree"][node],
                    "value": value,
                    "weight": value * math.prod(t[2] for t in tests),
                    "size": len(path),
                    "feature": list(path),
                    "low": [t[0] for t in tests],
                    "high": [t[1] for t in tests],
                    "share": [t[2] for t in tests],
                }
            )
            continue
        f, t = columns["feature"][node], columns["threshold"][node]
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, bounds in (
            (nodes[left[node]], (low, min(high, t))),
            (nodes[right[node]], (max(low, t), high)),
        ):
            part = share * cover[child] / cover[node] if cover[node] else 0.0
            todo.append((child, {**path, f: (*bounds, part)}))
    lists = {"feature": pa.int32(), "low": pa.float64(), "high": pa.float64(), "share": pa.float64()}
    kinds = {"tree": pa.int64(), "value": pa.float64(), "weight": pa.float64(), "size": pa.int32()}
    kinds |= {c: pa.list_(k) for c, k in lists.items()}
    return pa.Table.from_pylist(rows, schema=pa.schema(list(kinds.items())))


def _effects(through: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values (rows x leaves x tests) of each leaf's game.

    In that game a known feature lets the row through if its value lies in the interval,
    an unknown one lets ``share`` of it through. The sum over coalitions is read from the
    coefficients of the product of (share + through * y) over the other features.
    """
    size = share.shape[1]
    weights = [
        math.factorial(k) * math.factorial(size - k - 1) / math.factorial(size)
        for k in range(size)
    ]
    effects = np.empty(through.shape)
    for j in range(size):
        coefficients = [np.ones(through.shape[:2])]
        for k in range(size):
            if k == j:
                continue
            grown = [c * share[:, k] for c in coefficients]
            grown.append(np.zeros(through.shape[:2]))
            for i, c in enumerate(coefficients):
                grown[i + 1] = grown[i + 1] + c * through[:, :, k]
            coefficients = grown
        total = sum(w * c for w, c in zip(weights, coefficients))
        effects[:, :, j] = (through[:, :, j] - share[:, j]) * total * value
    return effects


def _pattern_table(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    size = share.shape[1]
    patterns = (np.arange(2**size)[:, None] >> np.arange(size)) & 1
    through = np.broadcast_to(patterns[:, None, :], (2**size, *share.shape)).astype(float)
    return _effects(through, share, value).transpose(1, 0, 2)


def _group_leaves(block: pa.Table, trees: int) -> list[_Leaves]:
    """Leaves by path size, with values divided by the number of trees."""
    groups = []
    for size in sorted(set(block.column("size").to_pylist()) - {0}):
        own = block.filter(pc.equal(block.column("size"), size))
        flat = lambda c: forest.matrix(own, c)  # noqa: B023, E731
        group = _Leaves(
            feature=flat("feature"),
            low=flat("low"),
            high=flat("high"),
            share=flat("share"),
            value=own.column("value").to_numpy() / trees,
        )
        if size <= TABLE_TESTS:
            group.table = _pattern_table(group.share, group.value)
        groups.append(group)
    return groups


def _leaf_effects(rows: np.ndarray, leaves: _Leaves) -> np.ndarray:
    size = leaves.feature.shape[1]
    passed = []
    for j in range(size):
        x = rows[:, leaves.feature[:, j]]
        passed.append((x > leaves.low[:, j]) & (x <= leaves.high[:, j]))
    if leaves.table is None:
        return _effects(np.stack(passed, axis=2).astype(float), leaves.share, leaves.value)
    pattern = np.zeros(passed[0].shape, dtype=np.int64)
    for j, bit in enumerate(passed):
        pattern |= bit.astype(np.int64) << j
    return leaves.table[np.arange(len(leaves.value)), pattern]


def _table_groups(bounds: np.ndarray, cells: int) -> list[tuple[slice, list[np.ndarray]]]:
    """Runs of leaves with the cuts per feature that bound them; a run goes on as long as its
    cuts part the values of all features into at most ``cells`` cells. ``bounds`` (leaves x
    features x 2) are the ends of the intervals."""
    found, start, held = [], 0, None
    for i, own in enumerate(bounds.tolist()):
        ends = [{v for v in pair if math.isfinite(v)} for pair in own]
        both = ends if held is None else [h | e for h, e in zip(held, ends)]
        if held is not None and math.prod(len(c) + 1 for c in both) > cells:
            found.append((slice(start, i), held))
            start, both = i, ends
        held = both
    if held is not None:
        found.append((slice(start, len(bounds)), held))
    return [(run, [np.array(sorted(c)) for c in cuts]) for run, cuts in found]


@dataclass
class _TreeTable:
    """Leaves of one tree (those of them in a block) over few features, in runs.

    The ``cuts`` of a feature part its values; ``places`` has per feature, for each part, what
    it adds to the number of a run's cell. ``tables`` has for each run the attributions of all
    of its leaves together in each cell.
    """

    cuts: list[np.ndarray]
    places: list[np.ndarray]
    tables: list[np.ndarray]

    def add_to(self, out: np.ndarray, x: np.ndarray) -> None:
        """``x`` has a row per feature."""
        parts = [np.searchsorted(cuts, x[f]) for f, cuts in enumerate(self.cuts)]
        for i, table in enumerate(self.tables):
            cell = self.places[0][i].take(parts[0])
            for f in range(1, len(parts)):
                cell += self.places[f][i].take(parts[f])
            out += table.take(cell, axis=0)


def _tree_table(low: np.ndarray, high: np.ndarray, tested: np.ndarray, effects: np.ndarray) -> _TreeTable:
    width = low.shape[1]
    runs = _table_groups(np.stack([low, high], axis=2), RUN_CELLS)
    cuts = [np.unique(np.concatenate([own[f] for _, own in runs])) for f in range(width)]
    places, tables = [np.empty((len(runs), len(c) + 1), dtype=np.int64) for c in cuts], []
    for i, (run, own) in enumerate(runs):
        shape = [len(c) + 1 for c in own]
        pattern = np.zeros((run.stop - run.start, 1), dtype=np.int64)
        for f in range(width):
            stride = math.prod(shape[f + 1 :])
            # Part k of a feature has the values above cut k - 1 and up to cut k.
            places[f][i] = np.searchsorted(own[f], np.append(cuts[f], np.inf)) * stride
            above = np.append(-np.inf, own[f]) >= low[run, f, None]
            upto = np.append(own[f], np.inf) <= high[run, f, None]
            passes = np.where(above & upto | ~tested[run, f, None], 1 << f, 0)
            pattern = (pattern[:, :, None] + passes[:, None, :]).reshape(len(pattern), -1)
        table = np.zeros((pattern.shape[1], width))
        for leaf, cells in zip(effects[run], pattern):
            table += leaf.take(cells, axis=0)
        tables.append(table)
    return _TreeTable(cuts, places, tables)


class LeafTables:
    """A block of leaves; the tables are made where they are used, once per process."""

    def __init__(self, block: pa.Table, trees: int, width: int):
        self.block, self.trees, self.width = block, trees, width

    @cached_property
    def tables(self) -> list[_TreeTable]:
        block, width = self.block, self.width
        n = block.num_rows
        tests = np.diff(block.column("feature").combine_chunks().offsets.to_numpy())
        leaf = np.repeat(np.arange(n), tests)
        flat = {c: pc.list_flatten(block.column(c)).to_numpy() for c in ("feature", "low", "high", "share")}
        low, high = np.full((n, width), -np.inf), np.full((n, width), np.inf)
        low[leaf, flat["feature"]], high[leaf, flat["feature"]] = flat["low"], flat["high"]
        share, tested = np.ones((n, width)), np.zeros((n, width), dtype=bool)
        share[leaf, flat["feature"]], tested[leaf, flat["feature"]] = flat["share"], True
        value = block.column("value").to_numpy() / self.trees
        found = []
        tree = block.column("tree").to_numpy()
        order = np.argsort(tree, kind="stable")
        starts = np.flatnonzero(np.append(True, tree[order][1:] != tree[order][:-1])) if n else []
        for own in np.split(order, starts[1:]) if n else []:
            # An untested feature always passes and has the share 1, so its effect is 0.
            effects = _pattern_table(share[own], value[own])
            found.append(_tree_table(low[own], high[own], tested[own], effects))
        return found

    def attribute(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(rows.shape)
        for start in range(0, len(rows), STEP_ROWS):
            piece = slice(start, start + STEP_ROWS)
            x = np.ascontiguousarray(rows[piece].T)
            for table in self.tables:
                table.add_to(out[piece], x)
        return out


class LeafGroups:
    """A block of leaves over many features, by the number of features that they test."""

    def __init__(self, block: pa.Table, trees: int, width: int):
        self.block, self.trees = block, trees

    @cached_property
    def groups(self) -> list[_Leaves]:
        return _group_leaves(self.block, self.trees)

    def attribute(self, rows: np.ndarray) -> np.ndarray:
        return attribute_rows(rows, self.groups)


def attribute_rows(rows: np.ndarray, groups: list[_Leaves]) -> np.ndarray:
    """Attributions (rows x features), in pieces of bounded size."""
    out = np.zeros(rows.shape)
    for leaves in groups:
        step = max(1, CELLS // leaves.feature.size)
        owners = [
            np.equal.outer(leaves.feature[:, j], np.arange(rows.shape[1])).astype(float)
            for j in range(leaves.feature.shape[1])
        ]
        for start in range(0, len(rows), step):
            piece = slice(start, start + step)
            effects = _leaf_effects(rows[piece], leaves)
            for j, owner in enumerate(owners):
                out[piece] += effects[:, :, j] @ owner
    return out


def forest_leaves(grown: forest.Forest) -> tuple[DataFrame, int]:
    """Staged leaves of all trees, and the number of blocks of at most about ``BLOCK_NODES``
    nodes that they are dealt into.

    The leaves of a tree are made in one task, where its nodes meet; a block may hold any
    part of a tree.
    """
    leaves = grown.nodes.groupBy("tree").applyInArrow(_tree_leaves, LEAF)
    tables = grown.width << grown.width if grown.width <= TABLE_TESTS else 1
    limit = max(1, min(BLOCK_NODES // 2, TABLE_CELLS // tables))
    # A tree has one leaf more than inner nodes.
    blocks = max(1, -(-grown.nodes.count() // (2 * limit)))
    block = F.pmod(F.xxhash64("tree", "feature", "low", "high"), F.lit(blocks))
    dealt = leaves.withColumn("block", block).repartition(blocks, "block")
    return stage(dealt, "leaves"), blocks


def _attributed(
    fitted: ForestClassifier, df: DataFrame, keys
) -> tuple[DataFrame, list[Column], float]:
    """Rows with one value column per feature, those columns as (feature, value) structs,
    and the base value. Rows with a feature that is not finite are left out.

    Each block of leaves is added to the value columns in a pass over the batches
    of a task; no row is shuffled, and rows with the same key stay apart.
    """
    names = fitted.features
    spark, trees = df.sparkSession, fitted.forest.trees
    inputs = [f"x{i}" for i in range(len(names))]
    outputs = [f"v{i}" for i in range(len(names))]
    rows = df.select(
        *[col(k) for k in keys],
        *[numeric(df, f).alias(x) for f, x in zip(names, inputs)],
        *[F.lit(0.0).alias(v) for v in outputs],
    )
    for x in inputs:
        rows = rows.where(is_finite(F.col(x)))
    schema = rows.schema
    leaves, blocks = forest_leaves(fitted.forest)
    base = leaves.agg(F.sum("weight")).first()[0] / trees
    kind = LeafTables if len(names) <= TABLE_TESTS else LeafGroups
    for block in range(blocks):
        own = leaves.where(F.col("block") == block).drop("block").toArrow()
        shared = spark.sparkContext.broadcast(kind(own, trees, len(names)))

        def add_block(batches, shared=shared):
            for batch in batches:
                batch[outputs] += shared.value.attribute(batch[inputs].to_numpy(dtype=float))
                yield batch

        rows = rows.mapInPandas(add_block, schema)
    pairs = [
        F.struct(F.lit(f).alias("feature"), F.col(v).alias("value"))
        for f, v in zip(names, outputs)
    ]
    return rows, pairs, base


def tree_attributions(fitted: ForestClassifier, df: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, feature, value, base_value) for every row with finite features.

    The values of a row and the base value add up to the forest's P(IG).
    """
    rows, pairs, base = _attributed(fitted, df, keys)
    long = rows.select(*[col(k) for k in keys], F.inline(F.array(*pairs)))
    return long.withColumn("base_value", F.lit(base))


def shap_global(fitted: ForestClassifier, keys=KEYS) -> DataFrame:
    """Mean absolute attribution per feature over all training rows."""
    values = tree_attributions(fitted, fitted.train, keys)
    return values.groupBy("feature").agg(
        F.avg(F.abs("value")).alias("mean_abs_value"), F.count(F.lit(1)).alias("n_rows")
    )


def top_attributions(
    attributions: DataFrame, n: int = 12, keys=KEYS, value: str = "value"
) -> DataFrame:
    """Per row the ``n`` features with the largest absolute value."""
    by_size = Window.partitionBy(*[col(k) for k in keys]).orderBy(
        F.abs(col(value)).desc(), "feature"
    )
    ranked = attributions.withColumn("rank", F.row_number().over(by_size))
    return ranked.where(F.col("rank") <= n)


def shap_row(fitted: ForestClassifier, df: DataFrame, keys=KEYS, n: int = 12) -> DataFrame:
    """The strongest attributions of each row of ``df``, ranked inside the row."""
    rows, pairs, base = _attributed(fitted, df, keys)
    ranked = [
        F.struct((-F.abs(p["value"])).alias("order"), p["feature"].alias("feature"), p["value"].alias("value"))
        for p in pairs
    ]
    strongest = F.slice(F.array_sort(F.array(*ranked)), 1, n)
    long = rows.select(*[col(k) for k in keys], F.posexplode(strongest).alias("place", "a"))
    return long.select(
        *[col(k) for k in keys],
        F.col("a.feature").alias("feature"),
        F.col("a.value").alias("value"),
        F.lit(base).alias("base_value"),
        (F.col("place") + 1).alias("rank"),
    )
