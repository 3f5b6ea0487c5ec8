import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.functions.columns import col
from creditloom.operators import explain, features, models, peers

NAMES = ["ROA", "ROE", "Quick Ratio", "Current Ratio"]
SCHEMA = "`Company Code` bigint, Year int, label int, " + ", ".join(f"`{n}` double" for n in NAMES)


def rows(n=600, noise=0.3, seed=5):
    rng = random.Random(seed)
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in NAMES]
        yield (i, 2010 + i % 5, int(x[0] + 2 * x[1] + rng.gauss(0, noise) > 0), *x)


@pytest.fixture(scope="module")
def separable(spark):
    return spark.createDataFrame(list(rows()), SCHEMA).cache()


@pytest.fixture(scope="module")
def forest(separable):
    return models.train_rf(separable, NAMES, trees=8, max_depth=5)


def test_prepare(spark):
    raw = spark.createDataFrame(
        [
            (1, 2010, "AAA", "1.5", 1.0),
            (2, 2010, " n/r", "2", 1.0),
            (3, 2010, None, "2", 1.0),
            (4, 2010, "B", "x", 1.0),
            (5, 2010, "B", "1", float("nan")),
        ],
        "`Company Code` bigint, Year int, Rating string, ROA string, ROE double",
    )
    base = features.prepare_ml(raw)
    assert sorted((r[0], r["label"], r["ROA"]) for r in base.collect()) == [(1, 1, 1.5), (2, 0, 2.0)]
    chosen = features.build_ml(raw, ["ROE", "Quick Ratio"])
    assert chosen.columns == ["Company Code", "Year", "label", "ROE"]
    assert chosen.count() == 2


def test_split_shares(separable):
    parts = features.split_80_20(separable)
    share = parts.agg(F.avg(col("is_train").cast("int"))).first()[0]
    assert 0.75 < share < 0.85
    by_label = features.split_stratified(separable).groupBy("label").agg(
        F.count_if(~F.col("is_train")).alias("test"), F.count(F.lit(1)).alias("n")
    )
    for r in by_label.collect():
        assert r["test"] == math.ceil(r["n"] * 0.2)


def test_stratified_split_keeps_copies_together(spark):
    copies = spark.range(500).select(
        F.lit(1).alias("Company Code"), F.lit(2010).alias("Year"), F.lit(1).alias("label")
    )
    parts = features.split_stratified(copies)
    assert parts.select("is_train").distinct().count() == 1
    assert parts.count() == 500


def test_impute_and_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (4.0, 5.0), (float("nan"), 5.0)], "a double, c double")
    assert [r["a"] for r in features.impute_median(df, ["a"]).collect()] == [1.0, 2.5, 4.0, 2.5]
    scaled = features.standardize(df, ["a", "c"]).collect()
    assert [r["a"] for r in scaled] == [-1.0, None, 1.0, None]
    assert [r["c"] for r in scaled] == [0.0] * 4
    sample = features.standardize(df, ["a"], population=False).first()["a"]
    assert sample == pytest.approx(-1 / math.sqrt(2))


def test_logistic_regression(separable):
    fitted = models.train_lr(separable, NAMES)
    metrics = fitted.metrics().first()
    assert metrics["auc_roc"] > 0.95 and metrics["accuracy"] > 0.85
    gaps = separable.withColumn("ROE", F.lit(None).cast("double"))
    scored = models.score_ig(fitted, gaps)
    assert scored.where("p_ig is null").count() == 0
    assert scored.columns == ["Company Code", "Year", "p_ig"]


def test_shuffled_labels_give_no_skill(spark):
    rng = random.Random(1)
    mixed = [(*r[:2], rng.randrange(2), *r[3:]) for r in rows(2000)]
    fitted = models.train_lr(spark.createDataFrame(mixed, SCHEMA), NAMES)
    assert abs(fitted.metrics().first()["auc_roc"] - 0.5) < 0.1


def test_too_few_rows(separable):
    assert models.train_lr(separable.limit(199), NAMES) is None
    assert models.train_lr(separable.where("label = 1"), NAMES) is None
    assert models.train_rf(separable.where("label = 1"), NAMES, trees=2) is None
    empty = models.metrics_or_empty(None, separable)
    assert (empty.count(), empty.columns) == (0, ["auc_roc", "average_precision", "accuracy"])
    assert models.score_ig(None, separable).count() == 0


def test_cross_validation(separable):
    found = models.cv_lr(separable, NAMES, elastic_nets=(0.0, 1.0), max_iter=20).collect()
    assert len(found) == 6
    assert sum(r["is_best"] for r in found) == 1
    best = max(found, key=lambda r: r["mean_auc"])
    assert best["is_best"] and best["mean_auc"] > 0.95
    plain = [r["mean_auc"] for r in found if r["reg_param"] == 0.0]
    assert plain[0] == plain[1]


def test_grid_of_regressions(spark):
    """Every fit is at its optimum, areas are exact, passes do not follow the settings."""
    from creditloom.operators import lr_grid

    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 3)) * [1.0, 4.0, 0.1]
    label = (x[:, 0] + x[:, 1] / 4 + rng.normal(size=900) > 0).astype(float)
    gap = np.where(rng.random(900) < 0.1, np.nan, x[:, 2])
    rows = [
        (float(y), i % 3, float(a), float(b), None if np.isnan(c) else float(c))
        for i, (y, (a, b, _), c) in enumerate(zip(label, x, gap))
    ]
    df = spark.createDataFrame(rows, "label double, fold int, f0 double, f1 double, f2 double").repartition(5)
    medians = np.array([np.nanmedian(np.column_stack([x[:, :2], gap])[np.arange(900) % 3 != k], axis=0) for k in range(3)])
    passes = []
    plain = lr_grid._sums
    lr_grid._sums = lambda *a: passes.append(1) or plain(*a)
    try:
        data = lr_grid.Folds(df, ["f0", "f1", "f2"], 3, medians)
        settings = [(0.0, 0.0), (0.01, 0.5), (0.1, 1.0), (0.1, 0.0), (5.0, 1.0)]
        fits = lr_grid.fit_grid(df, data, settings)
    finally:
        lr_grid._sums = plain
    assert len(passes) < 15
    areas = lr_grid.grid_areas(df, data, fits)
    for (k, s), w in fits.items():
        reg, share = settings[s]
        own = np.arange(900) % 3 != k
        full = np.column_stack([x[:, :2], np.where(np.isnan(gap), medians[k, 2], gap)])
        z = (full - full[own].mean(axis=0)) / full[own].std(axis=0, ddof=1)
        z = np.column_stack([np.ones(900), z])
        slope = z[own].T @ (1 / (1 + np.exp(-z[own] @ w)) - label[own]) / own.sum()
        slope[1:] += reg * (1 - share) * w[1:]
        for j, g in enumerate(slope):
            bound = reg * share if j else 0.0
            at = abs(g) - bound if j and w[j] == 0 else abs(g + bound * np.sign(w[j]))
            assert at < 1e-6
        score = z[~own] @ w
        up, down = score[label[~own] == 1], score[label[~own] == 0]
        area = ((up[:, None] > down).sum() + (up[:, None] == down).sum() / 2) / len(up) / len(down)
        assert areas[k, s] == pytest.approx(area, abs=1e-9)
    assert not fits[0, 4][1:].any()


def test_clusters(spark):
    rng = random.Random(2)
    made = []
    for i in range(300):
        centre = 20.0 * (i % 5)
        x = [centre + rng.gauss(0, 0.1) for _ in NAMES]
        made.append((i, 2010 + i % 5, 0, *x))
    made.append((999, 2010, 0, None, 1.0, 1.0, 1.0))
    found = models.kmeans_segments(spark.createDataFrame(made, SCHEMA), NAMES)
    pairs = {(r["Year"], r["cluster"]) for r in found.collect()}
    assert found.count() == 300
    assert len(pairs) == 5 and len({c for _, c in pairs}) == 5


def test_clusters_are_a_fixed_point(spark):
    """Each row is nearest to the mean of its own cluster; fewer rows make fewer clusters."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 2)) * [3.0, 0.1]
    rows = [(i, 2010, 0, *map(float, v), 0.0, 0.0) for i, v in enumerate(x)]
    found = models.kmeans_segments(spark.createDataFrame(rows, SCHEMA), NAMES[:2], k=4)
    own = np.array([r["cluster"] for r in sorted(found.collect())])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    means = np.array([z[own == c].mean(axis=0) for c in range(4)])
    away = ((z[:, None] - means[None]) ** 2).sum(axis=2)
    # After the last of 20 rounds a few rows at the borders may still move.
    assert (away.argmin(axis=1) == own).mean() > 0.98
    same = models.kmeans_segments(spark.createDataFrame([rows[0]] * 5 + [rows[1]], SCHEMA), NAMES[:2])
    assert len({r["cluster"] for r in same.collect()}) == 2
    assert models.kmeans_segments(spark.createDataFrame([], SCHEMA), NAMES).collect() == []


def test_medians_of_a_model_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, 2010, i % 2, rng.gauss(i % 2, 1) if i % 3 else None, 0.0, 0.0, 0.0) for i in range(901)]
    fitted = models.train_lr(spark.createDataFrame(rows, SCHEMA), ["ROA", "ROE"])
    known = [r["ROA"] for r in fitted.train.collect() if r["ROA"] is not None]
    filled = fitted.model.transform(models.with_inputs(fitted.train, ["ROA", "ROE"]))
    assert {r["f0_filled"] for r in filled.where("f0 IS NULL").collect()} == {float(np.median(known))}


def test_forest(forest, separable):
    assert forest.metrics().first()["auc_roc"] > 0.9
    some = separable.withColumn("ROA", F.when(F.col("Year") == 2010, F.col("ROA")))
    assert models.rf_score_ig(forest, some).count() == separable.where("Year = 2010").count()


def shapley(predict, size):
    """Attributions from all coalitions; ``predict`` gives the value of a coalition."""
    values = np.zeros(size)
    for j in range(size):
        for mask in range(2**size):
            if mask >> j & 1:
                continue
            known = bin(mask).count("1")
            weight = math.factorial(known) * math.factorial(size - known - 1) / math.factorial(size)
            values[j] += weight * (predict(mask | 1 << j) - predict(mask))
    return values


def coalition_value(nodes, row, mask):
    """Expected score when only the features of ``mask`` are known."""

    def walk(i):
        node = nodes[i]
        if node["left"] < 0:
            return node["value"]
        left, right = nodes[node["left"]], nodes[node["right"]]
        if mask >> node["feature"] & 1:
            return walk(node["left"] if row[node["feature"]] <= node["threshold"] else node["right"])
        share = left["cover"] / node["cover"]
        return share * walk(node["left"]) + (1 - share) * walk(node["right"])

    return walk(0)


@pytest.mark.parametrize("table_tests", [6, 0])
def test_attributions_are_shapley_values(spark, forest, monkeypatch, table_tests):
    monkeypatch.setattr(explain, "TABLE_TESTS", table_tests)
    few = forest.holdout.orderBy("Company Code").limit(6)
    found = {}
    for r in explain.tree_attributions(forest, few).collect():
        found.setdefault(r["Company Code"], {})[r["feature"]] = r["value"]
    trees = {}
    for r in forest.forest.nodes.collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r.asDict()
    for r in few.collect():
        x = [r[n] for n in NAMES]
        wanted = np.mean(
            [shapley(lambda m, t=t: coalition_value(t, x, m), len(NAMES)) for t in trees.values()],
            axis=0,
        )
        assert [found[r["Company Code"]][n] for n in NAMES] == pytest.approx(wanted.tolist(), abs=1e-12)


def test_attributions_add_up_in_blocks_smaller_than_a_tree(forest, monkeypatch):
    monkeypatch.setattr(explain, "BLOCK_NODES", 40)
    summed = explain.tree_attributions(forest, forest.holdout).groupBy("Company Code").agg(
        (F.sum("value") + F.max("base_value")).alias("total"), F.max("base_value").alias("base")
    )
    joined = summed.join(forest.holdout, "Company Code")
    assert joined.agg(F.max(F.abs(F.col("total") - F.col("p_ig")))).first()[0] < 1e-12
    assert 0.3 < joined.first()["base"] < 0.7


def test_global_and_row_attributions(forest):
    order = explain.shap_global(forest).orderBy(F.desc("mean_abs_value")).collect()
    assert order[0]["feature"] == "ROE"
    assert order[0]["n_rows"] == forest.train.count()
    rows_found = explain.shap_row(forest, forest.holdout.limit(3), n=2).collect()
    assert len(rows_found) == 6
    assert {r["rank"] for r in rows_found} == {1, 2}


def rule(df):
    score = col("ROA") + 2 * col("ROE")
    return df.withColumns({"prediction": (score > 0).cast("double"), "p_ig": 0.5 + 0.1 * score})


@pytest.mark.parametrize("bucket_rows", [20_000, 50])
def test_permutation_importance(separable, bucket_rows):
    found = explain.permutation_importance(separable, NAMES, rule, repeats=4, bucket_rows=bucket_rows)
    values = {r["feature"]: r["importance"] for r in found.collect()}
    assert values["Quick Ratio"] == 0.0 and values["Current Ratio"] == 0.0
    assert values["ROE"] > values["ROA"] > 0.05
    assert explain.top_features(found, 1).first()["feature"] == "ROE"


def test_permutation_keeps_the_values_of_a_feature(separable):
    """The rows that are scored for one feature and repeat hold its values once each."""
    seen = []

    def record(df):
        seen.append(df)
        return rule(df)

    explain.permutation_importance(separable, NAMES, record, repeats=2, bucket_rows=100)
    swapped = seen[0].where("swapped = 1 and repeat = 1")
    values = sorted(r["ROE"] for r in swapped.select("ROE").collect())
    assert values == sorted(r["ROE"] for r in separable.select("ROE").collect())


def test_partial_dependence(separable):
    found = explain.partial_dependence(separable, NAMES, rule, shown=["ROE"], points=11)
    points = sorted((r["grid_value"], r["mean_p_ig"]) for r in found.collect())
    assert len(points) == 11
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(points, points[1:])]
    assert slopes == pytest.approx([0.2] * 10)


def test_grid_of_few_values(spark):
    df = spark.createDataFrame([(float(i % 3), float(i)) for i in range(200)], "a double, b double")
    grids = explain.dependence_grids(df, ["a", "b"], points=10)
    assert grids["a"] == [0.0, 1.0, 2.0]
    assert len(grids["b"]) == 10
    n = 200
    at = n * 0.05 + 0.4 + 0.2 * 0.05
    low = (1 - at % 1) * (math.floor(at) - 1) + (at % 1) * math.floor(at)
    assert grids["b"][0] == pytest.approx(low)


def test_peers(spark):
    made = [(1, 2010, 0.0, 5.0), (2, 2010, 0.0, 5.0), (3, 2010, 3.0, 5.0), (1, 2011, 1.0, 5.0)]
    made += [(4, 2010, None, 5.0), (None, 2010, 0.0, 5.0)]
    df = spark.createDataFrame(made, "`Company Code` bigint, Year int, ROA double, ROE double")
    found = peers.nearest_peers(df, 1, 2010, ["ROA", "ROE", "absent"]).collect()
    assert [(r[0], r[1]) for r in found] == [(2, 2010), (1, 2011), (3, 2010)]
    spread = float(np.std([0.0, 0.0, 3.0, 1.0]))
    assert [r["distance"] for r in found] == pytest.approx([0.0, 1 / spread, 3 / spread])
    assert peers.nearest_peers(df, 9, 2010, ["ROA"]).count() == 0
    assert len(peers.nearest_peers(df, "1", 2010, ["ROA"], n=1).collect()) == 1


def test_records_of_one_key_are_explained_apart(forest):
    twice = forest.holdout.limit(1).withColumn("ROE", F.explode(F.array(F.lit(-2.0), F.lit(2.0))))
    found = explain.shap_row(forest, twice, n=4)
    totals = found.groupBy("Company Code", "rank").count()
    assert {r["count"] for r in totals.collect()} == {2}
    values = explain.tree_attributions(forest, twice).where("feature = 'ROE'").collect()
    assert len(values) == 2 and values[0]["value"] != values[1]["value"]


def test_prediction_keeps_the_callers_columns(spark):
    rows = [(i, 2010, i % 2, float(i % 2) + (i % 7) / 20) for i in range(400)]
    df = spark.createDataFrame(rows, "`Company Code` long, `Year` int, label int, ROA double")
    fitted = models.train_lr(df, ["ROA"])
    own = {"F1": "a", "vector": "b", "probability": "c", "rawPrediction": "d", "f0_filled": "e", "f0": "f"}
    wide = df.withColumns({name: F.lit(v) for name, v in own.items()})
    found = fitted.predict(wide)
    assert found.columns == [*wide.columns, "p_ig", "prediction"]
    row = found.first()
    assert {name: row[name] for name in own} == own and 0 <= row["p_ig"] <= 1


def plain_peers(data, n):
    """(key, rank, peer key, distance) with every distance taken."""
    z = np.array([x for _, _, *x in data])
    spread = z.std(axis=0)
    z = (z - z.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
    keys = [(e, y) for e, y, *_ in data]
    found = []
    for i, own in enumerate(keys):
        far = np.round(np.sqrt(((z - z[i]) ** 2).sum(axis=1)), 9)
        ranked = sorted((d, k) for d, k in zip(far.tolist(), keys) if k != own)[:n]
        found += [(*own, r + 1, *k, round(d, 6)) for r, (d, k) in enumerate(ranked)]
    return sorted(found)


@pytest.mark.parametrize(("block", "tasks"), [(40, 1), (40, 9), (4000, 3)])
def test_peers_of_all(spark, block, tasks):
    rng = random.Random(11)
    data = [(i, 2010 + i % 3, *[round(rng.gauss(0, 1), 2) for _ in range(3)]) for i in range(500)]
    # Ties, many equal company-years, far ones, and a group beyond any block.
    data += [(1000 + i, 2010, 1.0, 1.0, 1.0) for i in range(90)]
    data += [(2000 + i, 2011, 50.0 + i, -40.0, 3.0) for i in range(5)]
    schema = "`Company Code` long, `Year` int, ROA double, ROE double, `Quick Ratio` double"
    df = spark.createDataFrame(data, schema).repartition(tasks)
    found = peers.all_peers(df, ["ROA", "ROE", "Quick Ratio"], n=4, block_points=block)
    assert sorted((*r[:5], round(r[5], 6)) for r in found.collect()) == plain_peers(data, 4)


def test_peers_of_all_odd_rows(spark):
    schema = "`Company Code` string, `Year` int, ROA double, ROE double"
    odd = [("a", 1, 0.0, 1.0), ("a", 1, 5.0, 1.0), ("b", 1, 0.0, 1.0), ("c", 1, None, 1.0)]
    odd += [(None, 1, 0.0, 1.0), ("d", None, 0.0, 1.0)]
    found = peers.all_peers(spark.createDataFrame(odd, schema), ["ROA", "ROE", "absent"])
    assert sorted(tuple(r) for r in found.collect()) == [
        ("a", 1, 1, "b", 1, 0.0), ("b", 1, 1, "a", 1, 0.0)
    ]
    assert peers.all_peers(spark.createDataFrame([], schema), ["ROA"]).collect() == []


def test_blocks_are_skipped(spark):
    from creditloom.operators import neighbours

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    splits = neighbours._tree(x, 5)
    block = neighbours._block_of(x, splits)
    assert np.bincount(block).max() < 2 * 4000 / 32
    edges = [
        {"block": b, "n": int((block == b).sum()), "reach": 0.2}
        | {f"low{i}": x[block == b, i].min() for i in range(2)}
        | {f"high{i}": x[block == b, i].max() for i in range(2)}
        for b in range(32)
    ]
    boxes = neighbours._Boxes(edges, 2)
    assert sum(len(boxes.targets(i, 5)) for i in range(32)) < 0.5 * 32 * 32


def plain_tree(nodes, x):
    node = nodes[0]
    while node["left"] >= 0:
        node = nodes[node["left"] if x[node["feature"]] <= node["threshold"] else node["right"]]
    return node["value"]


def trees_of(grown):
    trees = {}
    for r in grown.nodes.collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r.asDict()
    return trees


@pytest.mark.parametrize("finish", [100_000, 60])
def test_forest_of_either_phase(separable, finish):
    """All nodes grown in tasks, and the upper ones from histograms."""
    fitted = models.train_rf(separable, NAMES, trees=30, finish=finish)
    assert fitted.metrics().first()["auc_roc"] > 0.93
    trees = trees_of(fitted.forest)
    assert len(trees) == 30
    for nodes in trees.values():
        for i, node in nodes.items():
            if node["left"] < 0:
                assert 2 * i + 1 not in nodes and 2 * i + 2 not in nodes
                continue
            left, right = nodes[node["left"]], nodes[node["right"]]
            assert (node["left"], node["right"]) == (2 * i + 1, 2 * i + 2)
            assert left["cover"] + right["cover"] == pytest.approx(node["cover"])
            both = left["cover"] * left["value"] + right["cover"] * right["value"]
            assert both == pytest.approx(node["cover"] * node["value"])
    assert max(math.log2(i + 1) for nodes in trees.values() for i in nodes) > 5
    for r in fitted.holdout.limit(20).collect():
        x = [r[n] for n in NAMES]
        assert r["p_ig"] == pytest.approx(np.mean([plain_tree(t, x) for t in trees.values()]))


@pytest.mark.parametrize("finish", [100_000, 100])
def test_forest_does_not_depend_on_the_layout(separable, finish):
    def nodes(df):
        grown = models.train_rf(df, NAMES, trees=5, finish=finish).forest
        return sorted(tuple(r) for r in grown.nodes.fillna(-9.0).collect())

    first = nodes(separable.repartition(1))
    assert len(first) > 100
    assert nodes(separable.repartition(17)) == first


def test_splits_are_the_best_ones():
    from creditloom.operators.forest import Plan, grow

    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    label = (x[:, 0] + rng.normal(0, 3, 300) > 6).astype(np.int64)
    weight = rng.integers(1, 4, 300)
    copies = rng.integers(1, 3, 300)
    plan = Plan(seed=1, tried=3, max_depth=30, min_leaf=4, weights=(1.5, 0.75))
    found = grow(x, label, weight, copies, 0, 0, plan)
    rows = {0: np.arange(300)}
    gini = lambda p, n: (p * p + n * n) / (p + n)
    for i, f, t in zip(found["id"].tolist(), found["feature"].tolist(), found["threshold"].tolist()):
        own = rows[i]
        best = None
        for g in range(3):
            for cut in np.unique(x[own, g])[:-1]:
                sides = [own[x[own, g] <= cut], own[x[own, g] > cut]]
                if min(np.minimum(weight, copies)[s].sum() for s in sides) < 4:
                    continue
                sums = [((weight * label)[s].sum() * 0.75, (weight * (1 - label))[s].sum() * 1.5) for s in sides]
                score = sum(gini(*s) for s in sums)
                best = max(best or score, score)
        pure = len(set(label[own].tolist())) == 1
        assert (f < 0) == (best is None or pure)
        if f >= 0:
            sides = [own[x[own, f] <= t], own[x[own, f] > t]]
            sums = [((weight * label)[s].sum() * 0.75, (weight * (1 - label))[s].sum() * 1.5) for s in sides]
            assert sum(gini(*s) for s in sums) == pytest.approx(best)
            rows[2 * i + 1], rows[2 * i + 2] = sides


def test_draws_are_poisson():
    from creditloom.operators.forest import draws

    content = np.arange(40_000).astype(np.int64) * 7919
    for copies in (1, 5, 32, 400):
        n = draws(content, np.full(40_000, copies), 3, 42)
        assert n.mean() == pytest.approx(copies, rel=0.02) and n.var() == pytest.approx(copies, rel=0.05)
    assert (draws(content, np.ones(40_000, np.int64), 4, 42) != draws(content, np.ones(40_000, np.int64), 3, 42)).any()


def test_copies_weigh_and_few_values_split(spark):
    rows = [(i, 2010 + i % 4, i % 2 if i % 10 else 1 - i % 2, float(i % 2), 0.0) for i in range(600)]
    df = spark.createDataFrame(rows, "`Company Code` long, `Year` int, label int, ROA double, ROE double")
    fitted = models.train_rf(df, ["ROA", "ROE"], trees=20)
    p = {r["ROA"]: r["p_ig"] for r in fitted.holdout.collect()}
    assert p[0.0] < 0.3 < 0.7 < p[1.0]


def test_dependence_of_a_forest_is_that_of_all_trials(forest):
    grids = {"ROE": [-2.0, -0.5, 0.0, 0.1, 3.0], "ROA": [0.0, 1.0]}
    shown = list(grids)
    fast = explain.forest_dependence(forest, forest.train, shown, grids=grids)
    slow = explain.partial_dependence(forest.train, NAMES, forest.predict, shown, grids=grids)
    key = lambda df: {(r["feature"], r["grid_value"]): r["mean_p_ig"] for r in df.collect()}
    expected = key(slow)
    found = key(fast)
    assert set(found) == set(expected) and len(found) == 7
    assert all(found[k] == pytest.approx(v, abs=1e-9) for k, v in expected.items())


def test_default_row_numbers_do_not_depend_on_the_layout(separable):
    def drops(df):
        found = explain.permutation_importance(df, NAMES, rule, repeats=3, bucket_rows=100)
        return sorted((r["feature"], round(r["importance"], 12)) for r in found.collect())

    twice = separable.union(separable.limit(50))
    assert drops(twice.repartition(1)) == drops(twice.repartition(17))


def test_forest_in_groups_of_trees_and_passes(separable, forest, monkeypatch):
    """Neither the trees that are grown at a time nor the blocks of a pass change a forest."""
    from creditloom.operators import forest as module

    whole = models.train_rf(separable, NAMES, trees=6)
    groups, finished = [], module._finished

    def noted(data, trees, *rest):
        groups.append(list(trees))
        return finished(data, trees, *rest)

    monkeypatch.setattr(module, "_finished", noted)
    monkeypatch.setattr(module, "GROUP_ROWS", 2 * whole.train.distinct().count())
    monkeypatch.setattr(module, "BLOCK_NODES", 50)
    monkeypatch.setattr(module, "PASS_BLOCKS", 2)
    parts = models.train_rf(separable, NAMES, trees=6)
    assert sum(groups, []) == list(range(6)) and max(map(len, groups)) < 6
    assert trees_of(parts.forest) == trees_of(whole.forest)
    assert len(list(parts.forest.blocks())) > 4
    order = ["Company Code", "Year"]
    assert parts.holdout.orderBy(order).collect() == whole.holdout.orderBy(order).collect()


def test_peers_are_found_in_rounds(spark, monkeypatch):
    """A round moves about as many points as it may, and the rounds do not change the peers."""
    from creditloom.operators import neighbours

    rng = random.Random(5)
    data = [(i, 2010, *[round(rng.gauss(0, 1), 2) for _ in range(3)]) for i in range(400)]
    schema = "`Company Code` long, `Year` int, ROA double, ROE double, `Quick Ratio` double"
    df = spark.createDataFrame(data, schema)
    sizes, lists = [], neighbours._lists

    def noted(rows, k):
        sizes.append(rows.where("turn > 0").count())
        return lists(rows, k)

    monkeypatch.setattr(neighbours, "_lists", noted)
    monkeypatch.setattr(neighbours, "ROUND_ROWS", 1)
    monkeypatch.setattr(neighbours, "TARGETS_PER_TASK", 3)
    found = peers.all_peers(df, ["ROA", "ROE", "Quick Ratio"], n=4, block_points=20)
    assert sorted((*r[:5], round(r[5], 6)) for r in found.collect()) == plain_peers(data, 4)
    assert len(sizes) > 1 and max(sizes) <= (neighbours.ROUND_SHARE + 1) * len(data)


def test_histograms_travel_as_one_value(separable, monkeypatch):
    """A task sends a value for each open node, whatever the number of cells in it."""
    from creditloom.operators import forest as module

    moved, chosen = [], module._chosen

    def noted(found, *rest):
        moved.append((found.count(), found.select("tree", "node").distinct().count()))
        return chosen(found, *rest)

    monkeypatch.setattr(module, "_chosen", noted)
    models.train_rf(separable, NAMES, trees=3, finish=100)
    cores = separable.sparkSession.sparkContext.defaultParallelism
    assert len(moved) > 2 and all(n <= 2 * cores * nodes for n, nodes in moved)


def test_histogram_sums_of_many_draws():
    from creditloom.operators.forest import CUTS, FIELD, _Sums

    rng = np.random.default_rng(3)
    expected, sums = np.zeros((2, CUTS + 1, 3)), _Sums(2, 1)
    for most in (3, 3, 1 << FIELD, 40_000, 40_000):
        cell, label = rng.integers(0, 2 * (CUTS + 1), 50), rng.integers(0, 2, 50)
        weight = rng.integers(1, most, 50)
        count = np.minimum(weight, 2)
        sums.add(cell, label, weight, count)
        for i, v in enumerate((weight * label, weight, count)):
            expected[:, :, i] += np.bincount(cell, v, 2 * (CUTS + 1)).reshape(2, -1)
    assert (sums.of_nodes()[:, 0] == expected).all()


def test_leaves_share_tables():
    """The attributions of neighbouring leaves come from one table, as from each leaf's own."""
    from creditloom.operators.explain import _pattern_table, _tree_table

    rng = np.random.default_rng(8)
    leaves, width = 40, 4
    ends = np.sort(rng.integers(0, 12, (leaves, width, 2)).astype(float), axis=2)
    ends[:, :, 1] += 1
    tested = rng.random((leaves, width)) < 0.7
    low = np.where(tested & (rng.random((leaves, width)) < 0.7), ends[:, :, 0], -np.inf)
    high = np.where(tested, ends[:, :, 1], np.inf)
    effects = _pattern_table(np.where(tested, rng.random((leaves, width)), 1.0), rng.random(leaves))
    x = rng.integers(-1, 15, (200, width)).astype(float)
    inside = (x[:, None] > low) & (x[:, None] <= high) | ~tested
    patterns = (inside * (1 << np.arange(width))).sum(axis=2)
    expected = effects[np.arange(leaves), patterns].sum(axis=1)
    table, found = _tree_table(low, high, tested, effects), np.zeros(x.shape)
    table.add_to(found, np.ascontiguousarray(x.T))
    assert np.allclose(found, expected)
    assert len(table.tables) < leaves


def test_visits_by_masks_are_those_of_the_walk(forest):
    from creditloom.operators.forest import TreeBlock, matrix

    table = forest.forest.nodes.toArrow()
    by_masks, walked = TreeBlock(table), TreeBlock(table)
    walked.masks = None
    assert by_masks.masks
    x = matrix(forest.holdout.select(forest.vector(forest.holdout).alias("x")).toArrow()).copy()
    ends = by_masks.threshold[~by_masks.leaf]
    x[:20] = np.resize(ends, (20, x.shape[1]))
    for f in range(x.shape[1]):
        assert (by_masks.visits(x, f) == walked.visits(x, f)).all()


def test_a_far_point_does_not_widen_the_search_of_its_block():
    from creditloom.operators.neighbours import _Boxes, _pairs_within

    rows = [{"block": 7 + i, "n": 50, "reach": 30.0, "low0": 10.0 * i, "high0": 10.0 * i + 9} for i in range(6)]
    boxes = _Boxes(rows, 1)
    assert len(boxes.targets(0, 3)[0]) == 4
    x, reach = np.array([[0.0], [5.0], [8.5]]), np.array([1.0, 1.0, 2.0])
    assert boxes.needed(7, x, reach, 3)[0].tolist() == [0, 1]
    assert boxes.needed(7, x, np.array([30.0, 1.0, 1.0]), 3)[0].tolist() == [0, 1, 2, 3]

    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, (30, 3)) + 1e6, rng.normal(0, 1, (40, 3)) + 1e6
    every = np.round(np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)), 9)
    bound = np.sort(every, axis=1)[:, 4]
    i, j, distance = _pairs_within(a, b, bound)
    assert len(i) == 150 and np.allclose(distance, every[i, j], atol=1e-8)
