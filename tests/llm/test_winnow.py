import re
from collections import Counter, defaultdict

import pytest

from creditloom.llm import winnow

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, width=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(width, len(w))
        for a in range(len(w) - k + 1) if w else ():
            windows[tuple(w[a : a + k])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.fixture(scope="module")
def benchmark_rows(corpus):
    rows = []
    for n, (_, text) in enumerate(corpus[:40]):
        w = (text or "").split()
        rows.append((n, " ".join(w[3 : 3 + [40, 13, 12, 7, 1][n % 5]]).upper()))
    return [*rows, (90, rows[0][1]), (91, ""), (92, None), (93, "a a a a a a a a a a a a a a"), (0, "xx yy")]


@pytest.mark.parametrize("most", [winnow.BROADCAST_HASHES, 3])
def test_same_as_brute_force(spark, frame, corpus, benchmark_rows, most):
    docs = [*corpus, (1000, "A a, a a a a a a a a a a a a a b"), (1001, "xx;YY zz")]
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    found = winnow.benchmark_hits(frame(docs), items, broadcast_hashes=most).collect()
    got = Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found)
    assert got == plain(docs, benchmark_rows)


def test_odd_rows_and_drop(spark, frame, odd_rows):
    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string")
    docs = frame(odd_rows, clashing=True)
    found = winnow.benchmark_hits(docs, items).collect()
    got = Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found)
    assert got == plain(odd_rows, [(1, " ".join(f"q{i}" for i in range(20)))])
    kept = winnow.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == len(odd_rows) - 4


def test_empty_tables(spark, frame, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.benchmark_hits(frame([]), none).collect() == []
    assert all(r["n_hit"] == 0 for r in winnow.benchmark_hits(frame(corpus[:5]), none).collect())
