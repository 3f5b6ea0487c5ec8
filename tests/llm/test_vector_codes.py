import math

import numpy as np
import pytest

from creditloom.llm import vector_codes
from creditloom.llm.vector_codes import nearest_entries


def plain(rows, parts, entries, rounds, scale):
    """(codes and errors by place in ``rows``, codebooks), every distance taken."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(scale * x) for x in v] for _, v in rows]
    width = len(ints[0])
    ends = [i * width // parts for i in range(parts + 1)]
    out, books = [[[], 0] for _ in rows], []
    for a, b in zip(ends, ends[1:], strict=False):
        xs = [v[a:b] for v in ints]
        book = [list(x) for x in xs[:entries]]
        away = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c, strict=True))
        pick = lambda x: min(range(len(book)), key=lambda e: (away(x, book[e]), e))  # noqa: B023, E731
        for _ in range(rounds):
            took = [pick(x) for x in xs]
            for e in range(len(book)):
                own = [x for x, t in zip(xs, took, strict=True) if t == e]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        for i, x in enumerate(xs):
            e = pick(x)
            out[i][0].append(e)
            out[i][1] += away(x, book[e])
        books.append(book)
    return [((r[0], tuple(c)), e) for r, (c, e) in zip(rows, out, strict=True)], books


@pytest.mark.parametrize("kind", ["coarse", "fine"])
def test_rings_leave_out_no_nearest_entry(kind):
    rng = np.random.default_rng(3)
    for _ in range(60):
        # Few distinct values make many ties, also between equal entries.
        top = 3 if kind == "coarse" else 10_000
        x = rng.integers(-top, top, (200, 3))
        before = rng.integers(-top, top, (9, 3))
        gaps = ((x[:, None] - before) ** 2).sum(2)
        own = gaps.argmin(1)
        book, moved = before.copy(), rng.random(9) < 0.4
        book[moved] += rng.integers(-1, 2, (int(moved.sum()), 3))
        gaps = ((x[:, None] - book) ** 2).sum(2)
        found, away = nearest_entries(x, book, moved, own.astype(np.uint8))
        assert (found == gaps.argmin(1)).all() and (away == gaps.min(1)).all()
        found, away = nearest_entries(x, book, np.ones(9, bool), np.zeros(200, np.uint8))
        assert (found == gaps.argmin(1)).all() and (away == gaps.min(1)).all()


@pytest.mark.parametrize("tasks", [1, 7])
def test_same_as_brute_force(spark, tasks):
    rng = np.random.default_rng(1)
    data = [(int(i), rng.normal(0, 0.2, 10).tolist()) for i in rng.permutation(150)]
    data += [(i + 200, data[0][1]) for i in range(30)] + [(300 + i, [0.0] * 10) for i in range(9)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(tasks)
    found = vector_codes.compress(frame, parts=4, entries=5, rounds=4, scale=64)
    expected, books = plain(data, 4, 5, 4, 64)
    rows = [((r["row"]["vec_id"], tuple(r["code"])), r["error"]) for r in found.rows.collect()]
    assert sorted(rows) == sorted(expected)
    assert [b.tolist() for b in found.codebooks] == books


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [0.5, -0.5], "a", "b"),
        (1, [0.5, -0.5], "a", "b"),
        (None, [0.1, 0.2], "c", None),
        (2, [nan, 0.1], "x", "x"),
        (3, [inf, 0.1], "x", "x"),
        (4, [None, 0.1], "x", "x"),
        (5, None, "x", "x"),
        (6, [], "x", "x"),
        (7, [1e300, 0.0], "x", "x"),
        (8, [0.1, 0.2, 0.3], "x", "x"),
    ]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, code string, cells string")
    found = vector_codes.compress(frame, parts=2, entries=16, rounds=3)
    rows = found.rows.select("row.vec_id", "row.code", "row.cells", found.rows["code"], "error")
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == sorted(
        [
            (1, "a", "b", bytearray([0, 0]), 0),
            (1, "a", "b", bytearray([0, 0]), 0),
            (None, "c", None, bytearray([2, 2]), 0),
        ],
        key=repr,
    )
    restored = {r["row"]["vec_id"]: r["vector"] for r in found.restored(4096).collect()}
    assert restored[1] == [0.5, -0.5]


def test_no_rows(spark):
    for data in ([], [(1, None, 1)]):
        frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
        found = vector_codes.compress(frame)
        assert found.rows.collect() == [] and found.digest() == vector_codes.hashlib.sha256().hexdigest()
