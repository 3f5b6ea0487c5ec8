import re
from collections import Counter, defaultdict

import pytest

from creditloom.llm import mixing


def plain_targets(sizes, most=3, weights=(5, 2, 1)):
    """Excess over the bounds is shared again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, words = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        left = words - sum(target.values())
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_and_taken_words(frame, corpus):
    rows = frame(corpus, source=True)
    found = mixing.mix(rows).collect()
    sizes, of = defaultdict(int), {}
    for r in rows.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += n
        of[r["doc_id"]] = (r["source"], n)
    target = plain_targets(sizes)
    taken, unused, largest = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in found:
        source, n = of[r["id"]]
        assert (r["size"], r["source_size"]) == (n, sizes[source])
        assert r["target"] == pytest.approx(target[source])
        assert r["taken"] == n * r["copies"] <= 3 * n and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[source] += r["taken"]
        largest[source] = max(largest[source], n)
        # A copy more of these would have been allowed.
        if n and r["copies"] <= target[source] // sizes[source] and r["copies"] < 3:
            unused[source].append(n)
    for s, t in target.items():
        # With all documents used the last one may have gone beyond the target.
        last = largest[s] if taken[s] > t else 0
        assert abs(taken[s] - t) <= min(unused[s], default=last) / 2 + 1e-6


def _near_targets(found):
    taken = defaultdict(int)
    for r in found:
        taken[r["target"]] += r["taken"]
    return max(abs(n - t) for t, n in taken.items())


@pytest.mark.parametrize("long_id", [-1, 3, 77, 1000])
def test_one_document_of_half_the_words(spark, long_id):
    """Wherever it lies in the order, small documents fill the gap before it."""
    rows = [(i, "w " * 50, "a") for i in range(200)] + [(long_id * 7 + 1000, "v " * 10_000, "a")]
    rows += [(5000 + i, "u " * 40, "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert _near_targets(mixing.mix(docs).collect()) <= 25


def test_rows_without_an_id_and_of_one_id_are_spread(spark):
    rows = [(None if i % 2 else 7, f"only {i}", "a") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs)
    assert found.count() == 4000
    # 64 buckets: every tenth of the order holds about a tenth of the rows.
    tenth = Counter(int(r["positions"][0] * 10) for r in found.collect() if r["positions"])
    assert len(tenth) == 10 and max(tenth.values()) < 800


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 7)
    rows = [(None, None, "a")] * 40 + [(1, "x y z", "a")] * 50 + [(2, "x", "a")] * 9
    rows += [(i, "p q " * (i % 9), "b") for i in range(10, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert Counter((r["id"], r["size"]) for r in found) == Counter(
        (i, len((t or "").split())) for i, t, _ in rows
    )
    assert _near_targets(found) <= 9
    copies = sum(r["copies"] for r in found)
    assert mixing.training_order(docs).count() == copies


def test_map_columns(spark):
    rows = [(i % 3, "x y", "a", {"k": i % 2}) for i in range(6)] + [(9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>")
    doubled = docs.union(docs)
    ordered = mixing.training_order(doubled)
    assert ordered.columns == [*docs.columns, "copy_position"]
    assert ordered.count() == sum(r["copies"] for r in mixing.mix(doubled).collect())


def test_reruns_and_partitionings_agree(frame, corpus):
    rows = frame(corpus, source=True)
    key = lambda f: sorted((r["id"], r["copies"], r["positions"]) for r in f.collect())
    assert key(mixing.mix(rows.repartition(1))) == key(mixing.mix(rows.repartition(11)))


def test_position_inverts_the_schedule(spark):
    schedule = ((0.0, 2.0), (0.25, 0.0), (0.5, 1.0), (1.0, 3.0))
    shares = spark.range(0, 101).selectExpr("id / 100 AS share")
    from pyspark.sql import functions as F

    found = shares.select("share", mixing.position(F.col("share"), mixing._segments(schedule)).alias("t"))
    area = [0.25, 0.125, 1.0]
    for share, t in found.collect():
        if t <= 0.25:
            done = 2 * t - 4 * t * t
        elif t <= 0.5:
            done = area[0] + 2 * (t - 0.25) ** 2
        else:
            done = area[0] + area[1] + (t - 0.5) + 2 * (t - 0.5) ** 2
        assert done / sum(area) == pytest.approx(share, abs=1e-9)


def test_order_and_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows, clashing=True, source=True)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(odd_rows) and sum(r["size"] == 0 for r in mixed) == 4
    ordered = mixing.training_order(docs)
    assert ordered.columns == [*docs.columns, "copy_position"]
    rows = ordered.collect()
    assert [r["copy_position"] for r in rows] == sorted(r["copy_position"] for r in rows)
    copies = Counter()
    for r in mixed:
        copies[(r["id"], r["size"])] += r["copies"]
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in rows)
    assert got == +copies


def test_empty_table_and_texts(frame):
    assert mixing.mix(frame([], source=True)).collect() == []
    assert mixing.training_order(frame([], source=True)).collect() == []
    nothing = mixing.mix(frame([(1, ""), (2, None)], source=True)).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in nothing)
