"""Quality rules on repetition inside a text, from suffix arrays.

The suffixes of all texts of a slice are sorted together by prefix doubling: labels by the
first 1, 2, 4, ... words, where only suffixes that still share a label are sorted again.
The labels of all rounds give the longest common prefixes of neighbours. Intervals of
neighbours with a common prefix are the repeated substrings; those that no word before
them prolongs are maximal. A text is rejected when repeats of ``least`` words and more
cover too large a part of it, or when one is too long.

Nulls and empty texts have no words: all counts are zero and they are rejected by the
base rule on length. Rows are judged one by one, so repeated rows get equal results.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.words import Words, split_words, starts_within, text_slices


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict."""

    shortest_text: int = 50
    #: Share of words in windows of ``window`` words that occur twice or more.
    window: int = 3
    window_share: float = 0.5
    #: Repeats of so many words or more count for the two limits below.
    least: int = 10
    covered_share: float = 0.3
    longest: int = 100


STATS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_maximal_repeats",
    "n_covered_words",
    "longest_repeat",
]

_symbol = np.zeros(256, dtype=bool)
_symbol[list(b"#*$%&|<>")] = True


def suffix_order(labels: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array and the labels of every round.

    ``labels`` are numbers per word that differ between texts, ``ends`` the end of the
    text that each word belongs to. A label is the first place of its suffixes in the order.
    """
    n = len(labels)
    order = np.argsort(labels, kind="stable")
    ordered = labels[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    label = np.empty(n, dtype=np.int64)
    label[order] = place
    rounds = [label]
    width = 1
    while True:
        shared = np.bincount(label, minlength=n)[label] > 1
        active = np.flatnonzero(shared)
        if not len(active):
            break
        after = active + width
        inside = after < ends[active]
        then = np.zeros(len(active), dtype=np.int64)
        then[inside] = label[after[inside]] + 1
        own = label[active]
        by = np.lexsort((then, own))
        active, own, then = active[by], own[by], then[by]
        at = np.arange(len(active))
        new_group = np.ones(len(active), dtype=bool)
        new_group[1:] = own[1:] != own[:-1]
        new_part = new_group.copy()
        new_part[1:] |= then[1:] != then[:-1]
        group = np.maximum.accumulate(np.where(new_group, at, 0))
        part = np.maximum.accumulate(np.where(new_part, at, 0))
        label = label.copy()
        label[active] = own + part - group
        rounds.append(label)
        width *= 2
    sa = np.empty(n, dtype=np.int64)
    sa[label] = np.arange(n)
    return sa, rounds


def common_prefixes(sa: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Number of words that each suffix shares with the one before it in the order."""
    n = len(sa)
    lcp = np.zeros(n, dtype=np.int64)
    if n < 2:
        return lcp
    left, right = sa[:-1], sa[1:]
    pairs = np.flatnonzero(rounds[0][left] == rounds[0][right])
    a, b, length = left[pairs].copy(), right[pairs].copy(), np.zeros(len(pairs), dtype=np.int64)
    for i in range(len(rounds) - 1, -1, -1):
        # The place behind the last word equals nothing.
        padded = np.append(rounds[i], -1)
        step = (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
        move = step.astype(np.int64) << i
        a, b, length = a + move, b + move, length + move
    lcp[pairs + 1] = length
    return lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the order that share ``least`` words or more."""
    found, stack = [], []
    before = -1
    for j in np.flatnonzero(lcp >= least).tolist() + [len(lcp)]:
        if j != before + 1:
            # The run of neighbours with long common prefixes has ended.
            found += [(length, start, before) for length, start in reversed(stack)]
            stack = []
        if j == len(lcp):
            break
        start, here = j - 1, int(lcp[j])
        while stack and stack[-1][0] > here:
            length, start = stack.pop()
            found.append((length, start, j - 1))
        if not stack or stack[-1][0] < here:
            stack.append((here, start))
        before = j
    found += [(length, start, before) for length, start in reversed(stack)]
    return found


def maximal_repeats(
    sa: np.ndarray, lcp: np.ndarray, words: np.ndarray, firsts: np.ndarray, least: int
) -> list[tuple[int, int, int]]:
    """The intervals whose members do not all follow the same word.

    ``firsts`` marks words that begin a text.
    """
    if not len(sa):
        return []
    before = words[np.maximum(sa - 1, 0)]
    differs = np.ones(len(sa), dtype=np.int64)
    differs[1:] = (before[1:] != before[:-1]) | firsts[sa[1:]] | firsts[sa[:-1]]
    changes = np.cumsum(differs)
    return [x for x in lcp_intervals(lcp, least) if changes[x[2]] > changes[x[1]]]


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` words lies in one of the spans."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:n]) > 0


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def text_stats(w: Words, rules: Rules) -> dict[str, np.ndarray]:
    """The columns of ``STATS`` for the texts of a slice."""
    n, owner = len(w.starts), w.owner
    hashes = w.hashes()
    _, word = np.unique(hashes, return_inverse=True)
    _, labels = np.unique(owner * (n + 1) + word, return_inverse=True)
    sa, rounds = suffix_order(labels, w.bounds[1:][owner])
    lcp = common_prefixes(sa, rounds)
    # The longest repeat that starts at a word is the longer prefix shared with a neighbour.
    longest = np.zeros(n, dtype=np.int64)
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0)[:n])
    windows = np.flatnonzero((longest >= rules.window) & starts_within(w.bounds, n, rules.window))
    repeated = _covered(windows, np.full(len(windows), rules.window), n)
    long = np.flatnonzero(longest >= rules.least)
    covered = _covered(long, longest[long], n)
    top = np.zeros(len(w.counts), dtype=np.int64)
    np.maximum.at(top, owner, longest)
    firsts = np.zeros(n, dtype=bool)
    firsts[w.bounds[:-1][w.counts > 0]] = True
    maximal = np.zeros(len(w.counts), dtype=np.int64)
    for _, start, _ in maximal_repeats(sa, lcp, word, firsts, rules.least):
        maximal[owner[sa[start]]] += 1
    data, bounds = w.data.tobytes(), w.text_bounds.tolist()
    lead = (w.data & 0xC0) != 0x80
    gaps = np.isin(w.data, np.frombuffer(b"\t\n\v\f\r ", dtype=np.uint8))
    return {
        "n_words": w.counts,
        "word_chars": _sums(lead & ~gaps, w.text_bounds),
        "n_symbols": _sums(_symbol[w.data], w.text_bounds),
        "n_dup_lines": np.array(
            [_dup_lines(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], dtype=np.int64
        ),
        "n_repeat_words": _sums(repeated, w.bounds),
        "n_maximal_repeats": maximal,
        "n_covered_words": _sums(covered, w.bounds),
        "longest_repeat": top,
    }


def judge_texts(
    docs: DataFrame, text: str = "text", rules: Rules | None = None, keep_text: bool = True
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of the other columns), ``text`` if
    wanted, the columns of ``STATS``, ``base_failed`` and ``kept``."""
    rules = rules or Rules()
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"))
    same = ["row", "text"] if keep_text else ["row"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, texts in text_slices(part.column("text")):
                stats = text_stats(split_words(texts), rules)
                rows = part.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in same], *[pa.array(stats[c].astype(np.int64)) for c in STATS]],
                    names=[*same, *STATS],
                )

    kind = packed.schema["row"].dataType.simpleString()
    columns = [f"row {kind}", *["text string"] * keep_text, *[f"{c} long" for c in STATS]]
    judged = packed.mapInArrow(batches, ", ".join(columns))
    n = F.col("n_words")
    base_failed = (n < rules.shortest_text) | (
        100 * F.col("n_repeat_words") > F.lit(100 * rules.window_share) * n
    )
    fine = (F.col("n_covered_words") <= F.lit(rules.covered_share) * n) & (
        F.col("longest_repeat") <= rules.longest
    )
    return judged.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & fine)


def keep_good(docs: DataFrame, text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that pass the rules, with their columns."""
    judged = judge_texts(docs, text, rules).where("kept")
    columns = [
        F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c)
        for c in docs.columns
    ]
    return judged.select(*columns)
