"""Kneser-Ney scores and the quality classifier."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import kneser_ney, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def plain_model(texts):
    pairs, count = Counter(), Counter()
    for t in texts:
        w = tokens(t)
        count.update(w)
        pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
    followers, before = defaultdict(list), Counter()
    for (v, w), n in pairs.items():
        followers[v].append(n)
        before[w] += 1
    cut = lambda values: kneser_ney.discounts([sum(x == k for x in values) for k in (1, 2, 3, 4)])
    pair_cut, word_cut = cut(pairs.values()), cut(before.values())
    types, total = len(count), max(len(pairs), 1)
    floor = sum(word_cut[min(n, 3)] for n in before.values()) / total if pairs else 1.0

    def single(w):
        return (before[w] - word_cut[min(before[w], 3)]) / total * (before[w] > 0) + floor / (types + 1)

    def probability(v, w):
        f = followers.get(v)
        if not f:
            return single(w)
        n = pairs.get((v, w), 0)
        left = sum(pair_cut[min(x, 3)] for x in f) / sum(f)
        return (n - pair_cut[min(n, 3)]) / sum(f) * (n > 0) + left * single(w)

    return probability, count, types


@pytest.mark.parametrize("train_to", [40, 0])
def test_scores_same_as_brute_force(frame, corpus, train_to):
    docs = frame(corpus)
    model = kneser_ney.train(docs.where(F.col("doc_id") < train_to))
    probability, count, types = plain_model([t for i, t in corpus if i < train_to])
    tokens_all = sum(count.values())
    assert (model.tokens, model.types) == (tokens_all, types)
    texts = dict(corpus)
    for r in kneser_ney.score(docs, model).collect():
        w = tokens(texts[r["row"]["doc_id"]])
        expected = sum(math.log10(probability(v, x)) for v, x in zip(["<s>", *w[:-1]], w, strict=True))
        base = sum(math.log10((count[x] + 1) / (tokens_all + types + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(count[x] > 0 for x in w))
        assert r["score"] == pytest.approx(expected, rel=1e-9, abs=1e-9)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)


def test_frequent_bigrams(frame):
    rows = [(1, "a b " * 700 + "c"), (2, "a b a c")]
    docs = frame(rows)
    probability, _, _ = plain_model([t for _, t in rows])
    for r in kneser_ney.score(docs, kneser_ney.train(docs)).collect():
        w = tokens(dict(rows)[r["row"]["doc_id"]])
        expected = sum(math.log10(probability(v, x)) for v, x in zip(["<s>", *w[:-1]], w, strict=True))
        assert r["score"] == pytest.approx(expected, rel=1e-9)


def test_probabilities_sum_to_one(corpus):
    probability, count, _ = plain_model([t for _, t in corpus])
    for v in ["<s>", "w1", "never"]:
        assert sum(probability(v, w) for w in [*count, "unknown word"]) == pytest.approx(1.0)


def test_scores_of_odd_rows(frame, odd_rows):
    docs = frame(odd_rows, clashing=True)
    found = kneser_ney.score(docs, kneser_ney.train(docs)).collect()
    assert len(found) == len(odd_rows)
    assert all(r["n_tokens"] == 1 for r in found if r["row"]["doc_id"] in (3, 4))
    assert kneser_ney.score(frame([]), kneser_ney.train(frame([]))).collect() == []


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    rows, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [f"word{rng.integers(0, 500)}" for _ in range(rng.integers(30, 200))]
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else words[:10] * 15
        rows.append((i, " ".join(words)))
        marks.append((i, int(good)))
    return rows, marks


def test_held_out_accuracy(spark, frame):
    rows, marks = labelled(600, 1)
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, quality int")
    docs = frame([*rows, (None, None), (9000, "")], clashing=True)
    found = quality.classify(docs, labels, learn=F.col("doc_id") % 4 != 2).collect()
    assert len(found) == 602 and all(0 <= r["score"] <= 1 for r in found)
    truth = dict(marks)
    held = [r for r in found if r["row"]["doc_id"] is not None and r["row"]["doc_id"] % 4 == 2]
    right = sum((r["score"] >= 0.7) == bool(truth[r["row"]["doc_id"]]) for r in held)
    assert right / len(held) > 0.97


def test_without_labels(spark, frame, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(frame(corpus), none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(frame(corpus), ones).collect()} == {1.0}
    assert quality.classify(frame([]), ones).collect() == []


def test_normal_equations_are_partition_sums(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    rows = [(x[i].tolist(), float(i % 2), i % 3) for i in range(300)]
    project = quality.Projection.draw(x.mean(0), x.std(0), 16, 1)
    data = spark.createDataFrame(rows, "ratios array<double>, label double, fold long").repartition(7)
    sums = quality.normal_equations(data, project)
    for f in range(3):
        z = project(x[f::3])
        assert np.allclose(sums[f][0], z.T @ z) and np.allclose(sums[f][1], z.T @ (np.arange(f, 300, 3) % 2))


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(4)
    x, y = np.arange(40.0), rng.random(40)
    _, means = quality.isotonic(x, y, np.ones(40))
    assert np.all(np.diff(means) > 0)
    # Min-max form of the monotone fit.
    fit = [min(max(y[i : k + 1].mean() for i in range(j + 1)) for k in range(j, 40)) for j in range(40)]
    assert sorted({round(v, 9) for v in fit}) == sorted({round(v, 9) for v in means})
