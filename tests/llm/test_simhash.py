import re

import numpy as np
import pytest
import xxhash

from creditloom.llm import simhash
from creditloom.llm.graph import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_groups(prints, max_bits=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("compared", [64, 2])
def test_same_as_brute_force(frame, corpus, compared):
    found = simhash.near_duplicates(frame(corpus), compared=compared).collect()
    prints = {i: plain_fingerprint(t) for i, t in corpus}
    ids = list(prints)
    groups = plain_groups([prints[i] for i in ids])
    first = {}
    for i, g in zip(ids, groups, strict=True):
        first[g] = min(first.get(g, i), i)
    expected = {i: (signed(prints[i]), first[g]) for i, g in zip(ids, groups, strict=True)}
    assert {r["row"]["doc_id"]: (r["fingerprint"], r["component"]) for r in found} == expected


@pytest.mark.parametrize("max_bits", [1, 2])
@pytest.mark.parametrize("compared", [64, 1])
def test_links_of_planted_fingerprints(spark, max_bits, compared):
    rng = np.random.default_rng(max_bits)
    prints = set()
    for _ in range(12):
        base = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        prints.add(base)
        for _ in range(6):
            bits = rng.choice(64, size=rng.integers(0, 5), replace=False)
            prints.add(base ^ sum(1 << int(b) for b in bits))
    prints = sorted(prints)
    if compared == 1:
        prints = prints[:20]
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    roots = dict(connected_components(simhash.links(nodes, max_bits, compared)).collect())
    groups = plain_groups(prints, max_bits)
    found = [roots.get(signed(p), signed(p)) for p in prints]
    for i in range(len(prints)):
        for j in range(i):
            assert (found[i] == found[j]) == (groups[i] == groups[j])


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99)], "a long, b long")
    roots = dict(connected_components(edges).collect())
    assert roots == {**{i: 0 for i in range(1, 61)}, 100: 99}


def test_odd_rows(frame, odd_rows):
    found = simhash.near_duplicates(frame(odd_rows, clashing=True)).collect()
    assert len(found) == len(odd_rows)
    by = {}
    for r in found:
        by.setdefault(r["row"]["doc_id"], set()).add((r["fingerprint"], r["component"]))
    assert by[4] == by[3] == {(0, 3)} and by[2] < by[1]
    assert {c for _, c in by[None]} == {1, 3}


def test_keep_one(frame, odd_rows):
    docs = frame(odd_rows, clashing=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted((i, len(t or "")) for i, t in rows) == sorted(
        [(1, len(odd_rows[0][1])), (1, len(odd_rows[2][1])), (3, 0), (5, len(odd_rows[9][1]))]
    )


def test_group_without_ids(frame):
    docs = frame([(None, "a b c d e"), (None, "a b c d e"), (None, "zz yy xx")])
    assert simhash.keep_one(docs).count() == 2


def test_empty_table(frame):
    assert simhash.near_duplicates(frame([])).collect() == []
    assert simhash.keep_one(frame([])).collect() == []


def test_keep_one_with_a_map_column(spark):
    rows = [(i % 2, "a b c d e f g", {"k": 1}) for i in range(4)] + [(5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 5]


def staged_plans(monkeypatch):
    """Plans of what simhash stages, by name."""
    plans, stage = {}, simhash.stage

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(simhash, "stage", noted)
    return plans


def test_index_of_signatures_is_not_broadcast(spark, monkeypatch):
    # The index has 34 rows a fingerprint, but Spark takes it to be as small as these.
    plans = staged_plans(monkeypatch)
    nodes = spark.range(1000).select(simhash.F.xxhash64("id").alias("fingerprint"))
    simhash.links(nodes).collect()
    assert "SortMergeJoin" in plans["signatures"] and "Broadcast" not in plans["signatures"]


def test_keep_one_broadcasts_no_index(spark, monkeypatch):
    plans = staged_plans(monkeypatch)
    docs = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', id, id * 7, id * 13, id * 29) AS text")
    assert simhash.keep_one(docs, shingle=3, max_bits=2).count() == 300
    assert "Broadcast" not in plans["signatures"]
