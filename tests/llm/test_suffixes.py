import re
from collections import Counter, defaultdict

import pytest

from creditloom.llm import suffixes


def plain(rows, length):
    places, sizes = defaultdict(set), {}
    for n, (_, text) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sizes[n] = len(words)
        for a in range(len(words) - length + 1):
            places[tuple(words[a : a + length])].add((n, a))
    covered = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for n, a in found:
                covered[n].update(range(a, a + length))
    return Counter((rows[n][0], sizes[n], len(covered[n])) for n in range(len(rows)))


def got(found):
    return Counter((r["id"], r["n_words"], r["n_repeated"]) for r in found.collect())


@pytest.mark.parametrize("length,span,group", [(50, 28, 6), (12, 5, 3)])
def test_same_as_brute_force(frame, corpus, length, span, group):
    found = suffixes.repeated_passages(frame(corpus), length=length, span=span, group=group)
    assert got(found) == plain(corpus, length)


def test_passage_that_all_texts_share(frame):
    passage = " ".join(f"hot{i}" for i in range(55))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(400)]
    found = suffixes.repeated_passages(frame(rows).repartition(13)).collect()
    assert all(r["n_repeated"] == 55 and r["spans"] == [(2, 56)] and r["others"] for r in found)


def test_borders_between_tasks(frame, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 3)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}"] + passage[: 50 + i % 7] + [f"z{i}"])) for i in range(30)]
    rows.append((99, "nothing of it"))
    assert got(suffixes.repeated_passages(frame(rows))) == plain(rows, 50)


def test_odd_rows(frame, odd_rows):
    found = suffixes.repeated_passages(frame(odd_rows, clashing=True))
    assert len(found.collect()) == len(odd_rows)
    by = defaultdict(set)
    for r in found.collect():
        by[r["id"]].add((r["n_words"], r["n_repeated"]))
    assert by[2] == {(80, 80)} and by[4] == {(0, 0)} and by[5] == {(30_000, 30_000)}
    assert by[6] == {(30_001, 30_000)} and by[None] == {(80, 80), (0, 0)}


def test_empty_table(frame):
    assert suffixes.repeated_passages(frame([])).collect() == []


@pytest.mark.parametrize("together", [1_000, 8])
def test_frequent_line_with_other_passages_around_it(spark, frame, monkeypatch, together):
    """Only two texts share the words before (or after) a line that all texts have."""
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    line = [f"hot{i}" for i in range(40)]
    rows = []
    for i in range(1500):
        before = [f"b{i % 750}w{j}" for j in range(10)] if i % 3 == 0 else [f"b{i}x{j}" for j in range(10)]
        after = [f"a{i}y{j}" for j in range(27)]
        rows.append((i, " ".join(before + line + after)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = got(suffixes.repeated_passages(frame(rows)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found == plain(rows, 50)


def test_equal_rows_with_a_frequent_head(frame, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 2)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(None, passage)] * 9 + [(1, passage + " end"), (2, None)]
    assert got(suffixes.repeated_passages(frame(rows))) == plain(rows, 50)


@pytest.mark.parametrize("together", [1_000, 1])
def test_words_that_differ_in_a_few_bits_only(frame, monkeypatch, together):
    """The hashes of these two words agree in the 24 bits that once stood for a word."""
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    passage = [f"p{i}" for i in range(49)]
    rows = [(i, " ".join([f"a{i}", *passage, word])) for i, word in enumerate(["c17992", "c23170"])]
    rows += [(i + 2, " ".join([word, *passage, f"z{i}"])) for i, word in enumerate(["c17992", "c23170"])]
    found = got(suffixes.repeated_passages(frame(rows)))
    assert found == plain(rows, 50) and not sum(n for _, _, n in found)


def whole(found):
    rows = [(r["id"], r["n_words"], r["n_repeated"], r["spans"], r["others"]) for r in found.collect()]
    return sorted(rows, key=repr)


def test_rows_do_not_depend_on_how_frequent_a_head_is(frame, corpus, odd_rows, monkeypatch):
    passage = [f"p{i}" for i in range(70)]
    extra = [(1000 + i, " ".join([f"a{i}", *passage[i % 5 :], f"z{i % 3}"])) for i in range(40)]
    rows = [*corpus, *odd_rows, *extra]
    found = []
    for together, parts in ((10_000, 1), (10_000, 7), (1, 7), (3, 2)):
        monkeypatch.setattr(suffixes, "TOGETHER", together)
        found.append(whole(suffixes.repeated_passages(frame(rows).repartition(parts))))
    assert all(f == found[0] for f in found)


@pytest.mark.parametrize("together", [1_000, 2])
def test_others_are_the_first_place_and_the_last(frame, monkeypatch, together):
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} {passage} z{i}") for i in range(6)]
    found = suffixes.repeated_passages(frame(rows)).collect()
    assert {r["id"]: r["others"] for r in found} == {0: [5], **{i: [0] for i in range(1, 6)}}
