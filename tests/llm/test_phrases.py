import re
from collections import Counter

import pytest

from creditloom.llm import phrases


def plain(rows, width):
    """Removed counts and kept words per (id, text), rows of an id by text, null ids last."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    seen, out = set(), []
    for i, text in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for a in range(len(words) - width + 1):
            window = tuple(words[a : a + width])
            if window in seen:
                gone[a : a + width] = [True] * width
            seen.add(window)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return Counter(out)


def got(found):
    return Counter(
        (r["id"], r["n_words"], r["n_removed"], " ".join((r["kept_text"] or "").split()))
        for r in found.collect()
    )


@pytest.mark.parametrize("width", [20, 8])
def test_same_as_brute_force(frame, corpus, width):
    found = phrases.remove_repeats(frame(corpus), width=width)
    assert got(found) == plain(corpus, width)


def test_partitionings_agree(frame, corpus):
    docs = frame(corpus)
    assert got(phrases.remove_repeats(docs.repartition(1))) == got(phrases.remove_repeats(docs.repartition(17)))


def test_texts_keep_their_spacing(frame):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = frame([(1, passage), (2, f"first\n\nline {passage}\tlast  word\n"), (3, "as  it\nis ")])
    kept = {r["id"]: r["kept_text"] for r in phrases.remove_repeats(docs).collect()}
    assert kept == {1: passage, 2: "first\n\nline last  word\n", 3: "as  it\nis "}


def test_passage_that_all_texts_share(frame):
    passage = " ".join(f"hot{i}" for i in range(24))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(500)]
    found = {r["id"]: r["n_removed"] for r in phrases.remove_repeats(frame(rows)).collect()}
    assert found == {i: 0 if i == 0 else 24 for i in range(500)}


def test_odd_rows(frame, odd_rows):
    found = phrases.remove_repeats(frame(odd_rows, clashing=True))
    assert got(found) == plain(odd_rows, 20)
    missing = [r for r in found.collect() if r["kept_text"] is None]
    assert len(missing) == 3 and all(r["n_words"] == 0 for r in missing)
    assert "n_words" in found.schema["row"].dataType.names


def test_empty_table(frame):
    assert phrases.remove_repeats(frame([])).collect() == []
