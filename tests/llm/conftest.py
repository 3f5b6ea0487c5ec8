import random

import pytest

SPACE = r"[^\x20\x09-\x0D]+"
#: Names that the operators use inside.
CLASHING = ["row", "id", "n_words", "kept", "bucket", "fingerprint", "text_hash", "size", "score", "at"]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, repeats inside, shared passages and odd texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["É", "naïve", "THE", "#x|", "a,b"]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passage, line = fresh(70), fresh(25)
    docs = []
    for i in range(60):
        body = fresh(rng.choice([1, 2, 3, 12, 60, 150, 300]))
        if i % 6 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[: rng.choice([30, 50, 70])]
        if i % 4 == 0:
            body += line
        if i % 9 == 0:
            body += body[:40] * 3
        docs.append(body)
    for i in range(12):
        near = list(docs[i * 3])
        if i % 2 and len(near) > 20:
            near[rng.randrange(len(near))] = "changed"
        docs.append(near)
    gaps = [" ", " ", " ", "\n", "\t", "  "]
    texts = ["".join(w + rng.choice(gaps) for w in body) for body in docs]
    texts += [None, "", " \n\t ", "one", "two words", "x " * 3000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, null texts, repeated rows, repeated ids with other texts, ties."""
    long = " ".join(f"v{i % 977}" for i in range(30_000))
    same = " ".join(f"q{i}" for i in range(80))
    return [
        (1, same),
        (1, same),
        (1, "another text of the same id " * 12),
        (2, same),
        (None, same),
        (None, None),
        (3, None),
        (3, None),
        (4, ""),
        (5, long),
        (6, long + " end"),
    ]


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, clashing=False, source=False):
        schema = "doc_id long, text string"
        data = [tuple(r) for r in rows]
        if source:
            schema += ", source string"
            data = [(*r, [None, "a", "b", "é"][i % 4]) for i, r in enumerate(data)]
        if clashing:
            schema += "".join(f", {c} string" for c in CLASHING)
            data = [(*r, *[None if i % 2 else c for c in CLASHING]) for i, r in enumerate(data)]
        return spark.createDataFrame(data, schema)

    return make
