import random
import re
from collections import Counter

import numpy as np

from creditloom.llm import repetition


def plain(text, least):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def covered(k):
        n = Counter(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
        out = set()
        for a in range(len(w) - k + 1):
            if n[tuple(w[a : a + k])] > 1:
                out.update(range(a, a + k))
        return len(out)

    longest = max((k for k in range(1, len(w)) if covered(k)), default=0) if len(w) < 400 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        covered(3),
        covered(least),
        longest,
    )


def test_same_as_brute_force(frame, corpus):
    rules = repetition.Rules()
    for r in repetition.judge_texts(frame(corpus, clashing=True)).collect():
        expected = plain(r["text"], rules.least)
        got = [r[c] for c in repetition.STATS if c != "n_maximal_repeats"]
        assert got[:-1] == list(expected[:-1])
        assert expected[-1] is None or got[-1] == expected[-1]
        n = r["n_words"]
        failed = n < 50 or 100 * r["n_repeat_words"] > 50 * n
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and 10 * got[-2] <= 3 * n and got[-1] <= 100)


def test_suffix_arrays_and_maximal_repeats():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 25))] for _ in range(3)]
        flat = [x for t in texts for x in t]
        sizes = [len(t) for t in texts]
        ends = np.repeat(np.cumsum(sizes), sizes)
        owner = np.repeat(np.arange(3), sizes)
        words = np.array(flat, dtype=np.int64)
        sa, rounds = repetition.suffix_order(owner * 10 + words, ends)
        suffix = [(int(owner[i]), flat[i : ends[i]]) for i in range(len(flat))]
        assert sa.tolist() == sorted(range(len(flat)), key=lambda i: suffix[i])
        lcp = repetition.common_prefixes(sa, rounds)
        for j in range(1, len(flat)):
            a, b = suffix[sa[j - 1]], suffix[sa[j]]
            same = next((k for k, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
            assert lcp[j] == (same if a[0] == b[0] else 0)
        firsts = np.zeros(len(flat), dtype=bool)
        at = 0
        for n in sizes:
            if n:
                firsts[at] = True
            at += n
        found = Counter()
        for length, first, last in repetition.maximal_repeats(sa, lcp, words, firsts, 2):
            i = sa[first]
            found[(int(owner[i]), tuple(flat[i : i + length]), last - first + 1)] += 1
        expected = Counter()
        for d, t in enumerate(texts):
            subs = {tuple(t[a:b]) for a in range(len(t)) for b in range(a + 2, len(t) + 1)}
            for s in subs:
                places = [a for a in range(len(t) - len(s) + 1) if tuple(t[a : a + len(s)]) == s]
                before = {t[a - 1] if a else ("start", a) for a in places}
                after = {t[a + len(s)] if a + len(s) < len(t) else ("end", a) for a in places}
                if len(places) > 1 and len(before) > 1 and len(after) > 1:
                    expected[(d, s, len(places))] += 1
        assert found == expected


def test_odd_rows_and_keep(frame, odd_rows):
    docs = frame(odd_rows, clashing=True)
    judged = repetition.judge_texts(docs, keep_text=False).collect()
    assert len(judged) == len(odd_rows)
    assert all(r["base_failed"] and not r["kept"] for r in judged if r["n_words"] == 0)
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "None"]


def test_empty_table(frame):
    assert repetition.judge_texts(frame([])).collect() == []
    assert repetition.keep_good(frame([])).collect() == []
