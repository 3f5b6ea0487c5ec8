import hashlib
import random

import numpy as np
import pytest

from creditloom.llm import trie
from creditloom.llm.parens import Parens, range_min


def plain(convs):
    """Rows of the trie by prefix, from {id: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(own) - 1) * (len(p[-1][1]) if p else 0)
    rows = []
    for p, own in members.items():
        text = ",".join(map(str, sorted(ends.get(p, []))))
        above = min(members[p[:-1]]) if p else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        rows.append((min(own), len(p), above, len(own), children[p], leaves[p], saved[p], sha))
    return sorted(rows, key=repr)


def rows_of(nodes):
    columns = ["first", "depth", "parent_first", "n_convs", "n_children", "n_leaves"]
    found = nodes.select(*columns, "saved_tokens", "ends_sha256").collect()
    return sorted((tuple(r) for r in found), key=repr)


def frame(spark, convs, kind="long"):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string")


@pytest.fixture(scope="module")
def convs():
    rng = random.Random(2)
    pool = [(r, "é" * rng.randrange(1, 9)) for r in ("user", "assistant") for _ in range(4)]
    out = {i: [rng.choice(pool) for _ in range(rng.randrange(1, 6))] for i in range(300)}
    out |= {1000 + i: [("system", "same")] * 3 for i in range(100)}
    out |= {2000 + i: [("system", "same")] * 3 + [("user", str(i))] for i in range(60)}
    out[5000] = [("user", f"{i % 7}") for i in range(700)]
    return out


@pytest.mark.parametrize(("limit", "least", "tasks"), [(1 << 18, 16, 1), (40, 4, 5)])
def test_same_as_brute_force(spark, convs, limit, least, tasks):
    turns = trie.gather_turns(frame(spark, convs).repartition(tasks))
    assert rows_of(trie.prefix_trie(turns, limit, least)) == plain(convs)


def test_copies_travel_in_pieces(spark, monkeypatch):
    convs = {i: [("user", "a"), ("assistant", "b")] for i in range(500)} | {900: [("user", "a")]}
    turns = trie.gather_turns(frame(spark, convs))
    assert rows_of(trie.prefix_trie(turns)) == plain(convs)
    paths = trie.stage(trie._paths(turns, "bigint"), "paths")
    monkeypatch.setattr(trie, "PIECE_CHARS", 20)
    found = trie._distinct_paths(paths, "bigint").collect()
    assert sorted(r["n"] for r in found) == [1, 500]
    text = ",".join(map(str, range(500)))
    assert hashlib.sha256(text.encode()).hexdigest() in {r["ends"] for r in found}


def test_odd_rows(spark):
    rows = [
        ("b", 2, "user", "x", 1),
        ("b", None, None, None, 2),
        ("b", None, None, None, 2),
        ("a", 1, "us", "erx", 3),
        ("a", 1, "us", "erx", 3),
        ("c", 1, "user", "x", 4),
        (None, 1, "user", "x", 5),
    ]
    schema = "conv_id string, turn long, role string, text string, path int"
    odd = spark.createDataFrame(rows, schema).withColumnRenamed("path", "key")
    expected = {
        "b": [("", ""), ("", ""), ("user", "x")],
        "a": [("us", "erx")] * 2,
        "c": [("user", "x")],
    }
    assert rows_of(trie.prefix_trie(trie.gather_turns(odd))) == plain(expected)


def test_long_texts_and_long_conversations(spark):
    convs = {1: [("user", "x" * 300_000)] * 2, 2: [("user", "x" * 300_000)], 3: [("u", "t")] * 20_000}
    found = trie.prefix_trie(trie.gather_turns(frame(spark, convs)), shard_nodes=1000, shard_paths=2)
    root = found.where("depth = 0").first()
    assert (root["n_convs"], root["n_leaves"], root["saved_tokens"]) == (3, 2, 300_000)
    assert found.count() == 1 + 2 + 20_000


def test_turnless_and_no_conversations(spark):
    schema = "id long, turns array<struct<hash: binary, len: int>>"
    bare = spark.createDataFrame([(3, []), (2, None), (5, [(b"h" * 16, 4)])], schema)
    rows = rows_of(trie.prefix_trie(bare))
    both, last = (hashlib.sha256(t).hexdigest() for t in (b"2,3", b"5"))
    assert rows == sorted([(2, 0, None, 3, 1, 1, 0, both), (5, 1, 2, 1, 0, 1, 0, last)], key=repr)
    assert trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []


def test_close_of_every_parenthesis():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 700, 5000):
        # A path, then random opens and closes above it.
        bits, depth = [], 0
        while len(bits) < n:
            up = depth <= 1 or rng.random() < (0.9 if len(bits) < n // 3 else 0.5)
            bits.append(up)
            depth += 1 if up else -1
        bits += [False] * depth
        stack, close = [], {}
        for i, up in enumerate(bits):
            if up:
                stack.append(i)
            else:
                close[stack.pop()] = i
        tree = Parens(np.array(bits))
        at = np.flatnonzero(bits)
        assert tree.find_close(at).tolist() == [close[i] for i in at.tolist()]
        leaves = tree.leaf_pairs(at, tree.find_close(at)).tolist()
        text = "".join("()"[not b] for b in bits)
        assert leaves == [text[i : close[i] + 1].count("()") for i in at.tolist()]


def test_range_minimum():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1000, 300)
    start = rng.integers(0, 300, 500)
    end = np.minimum(300, start + rng.integers(1, 300, 500))
    found = range_min(values, start, end)
    assert found.tolist() == [values[a:b].min() for a, b in zip(start, end, strict=True)]
