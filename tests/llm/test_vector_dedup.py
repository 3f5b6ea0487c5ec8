import numpy as np
import pytest

from creditloom.llm import vector_dedup
from creditloom.llm.vector_dedup import Codes, layout, unit

SCHEMA = "vec_id long, label string, embedding array<double>"


def plain(rows, threshold=0.93):
    """{place: (links, smallest id reached)} of (id, label, vector) rows."""
    good = []
    for i, (_, label, v) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = [0] * len(rows)
    for k, i in enumerate(good):
        for j in good[:k]:
            if rows[i][1] != rows[j][1] or len(rows[i][2]) != len(rows[j][2]):
                continue
            x, y = np.array(rows[i][2]), np.array(rows[j][2])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    first = {}
    for i, (name, _, _) in enumerate(rows):
        known = [n for n in (first.get(find(i)), name) if n is not None]
        first[find(i)] = min(known, default=None)
    return [(n, links[i], first[find(i)]) for i, (n, _, _) in enumerate(rows)]


def rows_of(found):
    return sorted(
        ((r["row"]["vec_id"], r["n_links"], r["component"]) for r in found.collect()), key=repr
    )


def near(rng, centre, cosine):
    """Vector with the given cosine to a unit vector."""
    other = rng.normal(size=len(centre))
    other -= (other @ centre) * centre
    return cosine * centre + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(8)
    rows = [(f"{i % 3}", rng.normal(size=32)) for i in range(500)]
    hot = unit(rng.normal(size=(1, 32)))[0]
    rows += [("0", near(rng, hot, 0.985)) for _ in range(150)]
    for k in range(40):
        base = unit(rows[k][1][None])[0]
        rows.append((rows[k][0], 7.0 * near(rng, base, [0.95, 0.97, 0.99, 0.999][k % 4])))
        rows.append(("1", rows[k][1]))
    step = unit(rng.normal(size=(1, 32)))[0]
    for _ in range(10):  # a chain
        rows.append(("2", step))
        step = near(rng, step, 0.96)
    rows += [("0", rows[0][1])] * 20
    ids = rng.permutation(len(rows))
    return [(int(i), label, v.tolist()) for i, (label, v) in zip(ids, rows, strict=True)]


def test_all_links_without_tables(spark, planted):
    frame = spark.createDataFrame(planted, SCHEMA)
    found = vector_dedup.near_duplicates(frame, bucket=4096, block=50)
    assert rows_of(found) == sorted(plain(planted), key=repr)
    kept = found.where("kept").select("row.vec_id").collect()
    assert {r[0] for r in kept} == {c for _, _, c in plain(planted)}


@pytest.mark.parametrize("tasks", [1, 6])
def test_recall_with_tables(spark, planted, tasks):
    frame = spark.createDataFrame(planted, SCHEMA).repartition(tasks)
    found = dict((i, n) for i, n, _ in rows_of(vector_dedup.near_duplicates(frame, bucket=16, block=40)))
    expected = {i: n for i, n, _ in plain(planted)}
    assert all(found[i] <= n for i, n in expected.items())
    assert sum(found.values()) >= 0.98 * sum(expected.values())


def test_layout_keeps_recall_at_every_size():
    last = 0
    for n in (1, 256, 10_000, 10**6, 10**9):
        bits, tables = layout(n, 0.93, 0.99, 256)
        meet = 1 - np.arccos(0.93) / np.pi
        assert 1 - (1 - meet**bits) ** tables >= 0.99 and n / 2**bits <= 256
        assert bits >= last
        last = bits


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    width, errors, outside = 64, [], 0
    x = unit(rng.normal(size=(600, width)))
    for i in range(0, 300, 2):
        x[i + 1] = near(rng, x[i], rng.uniform(0, 0.98))
    estimate, bound = Codes.of(x, 64).estimates()
    true = x @ x.T
    off = ~np.eye(600, dtype=bool)
    errors = (estimate - true)[off]
    outside = (np.abs(estimate - true) > bound)[off].mean()
    assert abs(errors.mean()) < 0.002 and outside < 0.06
    assert np.abs(errors).max() < 0.7
    # Pairs at the threshold keep far inside the bound.
    close = off & (true > 0.9)
    assert ((estimate + bound)[close] >= true[close]).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "a", [1.0, 0.0]),
        (1, "a", [1.0, 0.0]),
        (2, "a", [1e200, 1e199]),
        (None, "a", [2.0, 0.0]),
        (3, "b", [1.0, 0.0]),
        (4, None, [1.0, 0.0]),
        (5, "a", [0.0, 0.0]),
        (6, "a", [nan, 1.0]),
        (7, "a", [inf, 1.0]),
        (8, "a", [None, 1.0]),
        (9, "a", None),
        (10, "a", []),
        (11, "a", [1.0, 0.0, 0.0]),
        (None, "c", [1.0, 1.0]),
        (12, "a", [-1.0, 0.0]),
        (13, "d", [5.0]),
        (14, "d", [7.0]),
        (15, "d", [-7.0]),
    ]
    clash = [(*r, "x", 1, 2) for r in rows]
    frame = spark.createDataFrame(clash, SCHEMA + ", row string, node long, n_links int")
    found = vector_dedup.near_duplicates(frame)
    # Squares of 1e200 leave the range of a double; the operator scales first.
    tame = [(i, g, [1.0, 0.1] if i == 2 else v) for i, g, v in rows]
    assert rows_of(found) == sorted(plain(tame), key=repr)
    names = found.select("row.row", "row.node", "kept", "component", "row.vec_id").collect()
    assert all(r[0] == "x" and r[1] == 1 and r["kept"] == (r["component"] == r["vec_id"]) for r in names)


def test_no_rows_and_text_ids(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("b", 1, [1.0, 2.0]), ("a", 1, [1.0, 2.1]), ("c", 2, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id string, label int, embedding array<float>")
    assert rows_of(vector_dedup.near_duplicates(frame)) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]
