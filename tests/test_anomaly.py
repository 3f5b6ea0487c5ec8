import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.operators import anomaly

NAMES = ["ROA", "ROE", "Quick Ratio"]
SCHEMA = "`Company Code` bigint, Year int, " + ", ".join(f"`{n}` double" for n in NAMES)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    rows = [(i, 2010, *[rng.gauss(0, 1) for _ in NAMES]) for i in range(500)]
    rows += [(1000 + i, 2011, *[9.0 + i * (-1) ** k for k in range(3)]) for i in range(5)]
    rows += [(2000, 2012, None, 1.0, 1.0), (2001, 2012, float("inf"), 1.0, 1.0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def depth_of(nodes, row):
    table = {n[0]: n for n in nodes}
    node = table[0]
    while node[1] >= 0:
        node = table[node[3] if row[node[1]] <= node[2] else node[4]]
    return node[5]


def test_small_tree():
    rows = np.array([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0], [3.0, 1.0], [50.0, 1.0]])
    nodes = anomaly.grow_tree(rows, 7)
    assert all(n[1] in (-1, 0) for n in nodes)
    assert sum(n[1] < 0 for n in nodes) == sum(n[1] >= 0 for n in nodes) + 1
    arrays = {
        "levels": 3,
        **{
            name: np.array([[dict((n[0], n[i]) for n in nodes)[k] for k in range(len(nodes))]])
            for i, name in enumerate(["node", "feature", "threshold", "left", "right", "path"])
        },
    }
    found = anomaly.path_lengths(arrays, rows)
    assert found.tolist() == pytest.approx([depth_of(nodes, r) for r in rows])


def test_tree_of_copies():
    nodes = anomaly.grow_tree(np.ones((10, 2)), 1)
    assert nodes == [(0, -1, 0.0, 0, 0, anomaly.mean_path(10))]


def test_mean_path():
    assert [anomaly.mean_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert anomaly.mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_planted_rows_come_first(planted):
    found = anomaly.isoforest_fit_rank(planted.where("Year < 2012"), planted, NAMES, n=5, trees=60)
    rows = found.collect()
    assert {r["Year"] for r in rows} == {2011}
    assert all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:]))
    assert found.columns == ["Company Code", "Year", "score"]


def test_share_of_flags(planted):
    model = anomaly.fit_isolation_forest(planted, NAMES, 60, contamination=0.05)
    scored = model.score(planted)
    assert scored.count() == 505
    flagged = scored.where("is_anomaly").count()
    assert abs(flagged - 0.05 * 505) <= 1
    low, high = scored.agg(F.min("score_samples"), F.max("score_samples")).first()
    assert -1 < low < high < 0


def test_flag_list_and_raw_list(planted):
    flags = anomaly.isoforest_flags(planted, NAMES, n=5, trees=60)
    assert {r["Year"] for r in flags.collect()} == {2011}
    assert flags.columns == ["Company Code", "Year", "score", *NAMES]
    raw = anomaly.isoforest_raw(planted, NAMES, n=5, trees=60)
    assert {r["Year"] for r in raw.collect()} == {2011}
    assert anomaly.fit_isolation_forest(planted, NAMES, 5, "auto").offset == -0.5


def test_same_result_again_and_for_other_partitions(planted):
    first = anomaly.isoforest_raw(planted, NAMES, trees=20).collect()
    assert anomaly.isoforest_raw(planted.repartition(5), NAMES, trees=20).collect() == first


def test_sample_sizes(planted, monkeypatch):
    pool, n = anomaly._pool(planted, NAMES, 10_000, 42)
    assert (n, pool.count()) == (505, 505)
    sizes = anomaly._drawn(pool, n, 12, 256, 42).groupBy("tree").count().collect()
    assert [r["count"] for r in sizes] == [256] * 12
    small, n = anomaly._pool(planted, NAMES, 100, 42)
    assert n == 505 and 50 < small.count() < 160


def test_copies_are_drawn_one_by_one(spark):
    same = spark.range(1000).select(*[F.lit(1.0).alias(n) for n in NAMES])
    pool, n = anomaly._pool(same, NAMES, 10_000, 1)
    sizes = anomaly._drawn(pool, n, 8, 256, 1).groupBy("tree").count().collect()
    assert [r["count"] for r in sizes] == [256] * 8
    assert anomaly.fit_isolation_forest(same, NAMES, 8, 0.1).score(same).count() == 1000


def test_too_few_rows(planted):
    assert anomaly.fit_isolation_forest(planted.limit(20), NAMES, 5) is None
    assert anomaly.fit_isolation_forest(planted, [], 5) is None
    few = planted.limit(20)
    assert anomaly.isoforest_fit_rank(few, few, NAMES).count() == 0
    assert anomaly.isoforest_flags(planted.limit(0), NAMES).columns == ["Company Code", "Year", "score", *NAMES]


def test_lists_break_ties_by_key(spark):
    df = spark.createDataFrame([(3, 2010, 1.0), (1, 2010, 1.0), (2, 2010, 2.0)], "`Company Code` bigint, Year int, s double")
    assert [r[0] for r in anomaly.top_anomalies(df, 2, score="s").collect()] == [2, 1]
    assert [r[0] for r in anomaly.lowest_scores(df, 2, score="s").collect()] == [1, 3]


def test_pool_does_not_depend_on_the_layout(planted, monkeypatch):
    df = planted.select(*NAMES).union(planted.sparkSession.range(700).select(*[F.lit(1.0)] * 3))
    key = lambda pool: sorted(tuple(r) for r in pool.collect())
    pools = [key(anomaly._pool(df.repartition(n), NAMES, 200, 42)[0]) for n in (1, 7)]
    assert pools[0] == pools[1] and 120 < len(pools[0]) < 280
    monkeypatch.setattr(anomaly, "POOL_FACTOR", 0.02)
    ranked = [anomaly.isoforest_raw(planted.repartition(n), NAMES, trees=20).collect() for n in (1, 7)]
    assert ranked[0] == ranked[1]


def test_copies_are_numbered_in_pieces(planted, monkeypatch):
    monkeypatch.setattr(anomaly, "COPIES", 30)
    same = planted.sparkSession.range(1000).select(*[F.lit(1.0).alias(n) for n in NAMES])
    pool, n = anomaly._pool(same, NAMES, 10_000, 1)
    assert n == 1000 and sorted(r["copy"] for r in pool.collect()) == list(range(1, 1001))
