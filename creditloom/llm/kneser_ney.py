"""Scores of texts under an interpolated modified Kneser-Ney bigram model.

Tokens are the words of a text with A-Z lower-cased, then one end. Bigrams (a begin mark
stands before the first token) are counted in tasks, dealt by the hash of the pair and
merged, so the followers of a frequent word are spread over all shards. Merged shards are
written as sorted hash arrays. Sums by word (its count, the number of its predecessors, and
the number of its followers with count 1, 2 and more) are merged the same way.

P(w | v) = (c(v w) - D(c)) / c(v .) + g(v) P(w); P(w) is built from the numbers of different
predecessors in the same way and mixed with 1 / (V + 1), so unknown words share the mass of
one more type. Discounts come from the counts of counts of the level. Without training
texts every token has probability 1 / (V + 1) = 1.

Tasks map the arrays and look up what their texts need. Nulls and empty texts have one
token, the end. Words are known by 64-bit hashes.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.arrays import SortedShards
from creditloom.llm.words import WORD_STEP, Words, mix, split_words, text_slices
from creditloom.staging import staging_path

BEGIN, END = mix(np.array([1, 2], dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
#: Tokens that a task counts before it sends them on, and bytes scored together.
FLUSH = 2_000_000
SCORED_BYTES = 2 << 20

#: Counts of bigrams take a byte; those from 255 on are in an array of their own.
LARGE = 255
BIGRAM = np.dtype([("count", "u1")])
FREQUENT = np.dtype([("count", "<u8")])
WORD = np.dtype(
    [("count", "<u8"), ("before", "<u4"), ("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")]
)
PAIRS = "shard int, first binary, second binary, counts binary"
SUMS = "shard int, words binary, sums binary, levels array<long>"
SUMMARY = (
    "types long, tokens long, bigrams long, word_levels array<long>, bigram_levels array<long>"
)


def tokens_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts, the token before each, and the bounds per text."""
    bounds = w.bounds + np.arange(len(w.bounds))
    tokens = np.full(bounds[-1], END, dtype=np.uint64)
    tokens[np.arange(len(w.starts)) + w.owner] = w.hashes()
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = BEGIN
    return tokens, before, bounds


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * WORD_STEP + second)


def _levels(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(levels: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more; half of a count where data are missing."""
    n1, n2, n3, n4 = levels
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        out[1] = 1 - 2 * y * n2 / n1
        out[2] = 2 - 3 * y * n3 / n2
        if n3:
            out[3] = 3 - 4 * y * n4 / n3
    # A discount stays above 0, so that seen contexts leave mass, and below its count.
    return np.clip(out, [0.0, 0.05, 0.05, 0.05], [0.0, 0.95, 1.95, 2.95])


def _pair_rows(shards: int) -> Callable:
    def merged(kept: list) -> Iterator[pa.RecordBatch]:
        first, second = (np.concatenate(x) for x in zip(*kept, strict=True))
        keys, at, counts = np.unique(pair_hashes(first, second), return_index=True, return_counts=True)
        first, second = first[at], second[at]
        shard = (keys % np.uint64(shards)).astype(np.int64)
        # By first word: equal words lie together and compress.
        order = np.lexsort((first, shard))
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(i, order[cuts[i] : cuts[i + 1]]) for i in range(shards) if cuts[i] < cuts[i + 1]]
        columns = [
            pa.array([i for i, _ in rows], pa.int32()),
            *[
                pa.array([x[part].tobytes() for _, part in rows], pa.binary())
                for x in (first, second, counts.astype("<u4"))
            ],
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "first", "second", "counts"])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for part in parts:
            for _, texts in text_slices(part.column("text")):
                tokens, before, _ = tokens_of(split_words(texts, lower=True))
                kept.append((before, tokens))
                n += len(tokens)
                if n >= FLUSH:
                    yield from merged(kept)
                    kept, n = [], 0
        if n:
            yield from merged(kept)

    return rows


def _flat(column: pa.ChunkedArray, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and the first place of each key in that order."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    return order, np.flatnonzero(fresh)


def _add(values: np.ndarray, order: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order].astype(np.int64), firsts) if len(firsts) else values[:0]


def _merge_pairs(folder: str, shards: int) -> Callable:
    def rows(key: tuple, table: pa.Table) -> pa.Table:
        first, second = _flat(table["first"], np.uint64), _flat(table["second"], np.uint64)
        counts = _flat(table["counts"], "<u4")
        keys = pair_hashes(first, second)
        order, firsts = _groups(keys)
        total = _add(counts, order, firsts)
        first, second, keys = first[order][firsts], second[order][firsts], keys[order][firsts]
        shard, large = key[0].as_py(), total >= LARGE
        SortedShards.write(folder, "bigrams", shard, keys, np.minimum(total, LARGE).astype("u1"))
        SortedShards.write(folder, "frequent", shard, keys[large], total[large].astype("<u8"))
        sums = np.zeros(2 * len(keys), dtype=WORD)
        half = len(keys)
        sums["count"][:half], sums["before"][:half] = total, 1
        sums["total"][half:] = total
        sums["n1"][half:], sums["n2"][half:], sums["n3"][half:] = total == 1, total == 2, total > 2
        words, sums = _merged_words(np.concatenate([second, first]), sums)
        shard = (words % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(shards + 1))
        parts = [(i, by[cuts[i] : cuts[i + 1]]) for i in range(shards) if cuts[i] < cuts[i + 1]]
        none: list[list[int] | None] = [None] * len(parts)
        if parts:
            none[0] = _levels(total)
        # Column by column: small numbers side by side compress.
        packed = [b"".join(sums[c][p].tobytes() for c in WORD.names) for _, p in parts]
        return pa.table(
            {
                "shard": pa.array([i for i, _ in parts], pa.int32()),
                "words": pa.array([words[p].tobytes() for _, p in parts], pa.binary()),
                "sums": pa.array(packed, pa.binary()),
                "levels": pa.array(none, pa.list_(pa.int64())),
            }
        )

    return rows


def _merged_words(words: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, firsts = _groups(words)
    out = np.zeros(len(firsts), dtype=WORD)
    for c in WORD.names:
        out[c] = _add(sums[c], order, firsts)
    return words[order][firsts], out


def _unpacked(words: bytes, packed: bytes) -> np.ndarray:
    n = len(words) // 8
    out, at = np.zeros(n, dtype=WORD), 0
    for c in WORD.names:
        size = n * WORD[c].itemsize
        out[c] = np.frombuffer(packed[at : at + size], dtype=WORD[c])
        at += size
    return out


def _merge_words(folder: str) -> Callable:
    def rows(key: tuple, table: pa.Table) -> pa.Table:
        pairs = list(zip(table["words"].to_pylist(), table["sums"].to_pylist(), strict=True))
        words = np.concatenate([np.frombuffer(w, np.uint64) for w, _ in pairs])
        words, sums = _merged_words(words, np.concatenate([_unpacked(*x) for x in pairs]))
        SortedShards.write(folder, "words", key[0].as_py(), words, sums)
        levels = np.zeros(4, dtype=np.int64)
        for x in table["levels"].to_pylist():
            levels += np.array(x if x is not None else [0] * 4)
        return pa.table(
            {
                "types": [int((sums["count"] > 0).sum())],
                "tokens": [int(sums["count"].sum())],
                "bigrams": [int(sums["before"].sum())],
                "word_levels": pa.array([_levels(sums["before"])], pa.list_(pa.int64())),
                "bigram_levels": pa.array([levels.tolist()], pa.list_(pa.int64())),
            }
        )

    return rows


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals of the training texts."""

    folder: str
    shards: int
    types: int
    tokens: int
    bigrams: int
    word_levels: tuple[int, ...]
    bigram_levels: tuple[int, ...]


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count the texts of ``docs`` and write the model to the shared folder."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = staging_path(spark, "ngrams")
    summary = (
        docs.select(F.col(f"`{text}`").alias("text"))
        .mapInArrow(_pair_rows(shards), PAIRS)
        .groupBy("shard")
        .applyInArrow(_merge_pairs(folder, shards), SUMS)
        .groupBy("shard")
        .applyInArrow(_merge_words(folder), SUMMARY)
    )
    parts = summary.collect()  # one row per shard
    levels = {
        c: tuple(sum(p[c][i] for p in parts) for i in range(4)) for c in ("word_levels", "bigram_levels")
    }
    totals = {c: sum(p[c] for p in parts) for c in ("types", "tokens", "bigrams")}
    return Model(folder, shards, **totals, **levels)


class Scorer:
    """Looks up what some texts need; lives in one task."""

    def __init__(self, model: Model):
        self.model = model
        self.words = SortedShards(model.folder, "words", model.shards, WORD)
        self.pairs = SortedShards(model.folder, "bigrams", model.shards, BIGRAM)
        self.frequent = SortedShards(model.folder, "frequent", model.shards, FREQUENT)
        self.word_cut = discounts(list(model.word_levels))
        self.pair_cut = discounts(list(model.bigram_levels))
        n1, n2 = model.word_levels[:2]
        rest = model.types - n1 - n2  # every type has a predecessor
        self.floor_mass = (
            float(self.word_cut[1:] @ [n1, n2, rest]) / model.bigrams if model.bigrams else 1.0
        )

    def token_scores(self, w: Words) -> dict[str, np.ndarray]:
        """Per token: log10 of the model's and the base's probability, and whether it is known."""
        model = self.model
        tokens, before, bounds = tokens_of(w)
        every, place = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        info = self.words.find(every)
        token, context = place[: len(tokens)], place[len(tokens) :]
        unknown = self.floor_mass / (model.types + 1)
        seen = info["before"].astype(np.float64)
        single = unknown + np.where(
            seen > 0, (seen - self.word_cut[np.minimum(info["before"], 3)]) / max(model.bigrams, 1), 0
        )
        total = info["total"].astype(np.float64)
        left = info["n1"] * self.pair_cut[1] + info["n2"] * self.pair_cut[2] + info["n3"] * self.pair_cut[3]
        back = np.where(total > 0, left / np.maximum(total, 1), 1.0)
        pairs, at = np.unique(pair_hashes(before, tokens), return_inverse=True)
        count = self.pairs.find(pairs)["count"].astype(np.int64)
        large = np.flatnonzero(count == LARGE)
        count[large] = self.frequent.find(pairs[large])["count"]
        count = count[at]
        cut = count - self.pair_cut[np.minimum(count, 3)]
        direct = np.where(count > 0, cut / np.maximum(total[context], 1), 0.0)
        known = info["count"][token]
        base = (known + 1.0) / (model.tokens + 1.0 * (model.types + 1))
        return {
            "score": np.log10(direct + back[context] * single[token]),
            "base_score": np.log10(base),
            "known": known > 0,
            "bounds": bounds,
        }


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of ``keep``, or of all columns but the
    text), n_tokens, n_known, base_score, score and perplexity."""
    keep = keep or [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*keep).alias("row"), F.col(f"`{text}`").alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in parts:
            for at, texts in text_slices(part.column("text"), SCORED_BYTES):
                found = scorer.token_scores(split_words(texts, lower=True))
                bounds = found["bounds"]
                sums = {
                    c: np.add.reduceat(found[c].astype(t), bounds[:-1])
                    for c, t in (("score", float), ("base_score", float), ("known", np.int64))
                }
                n = np.diff(bounds)
                columns = [
                    part.column("row").slice(at, len(texts)),
                    pa.array(n),
                    pa.array(sums["known"]),
                    pa.array(sums["base_score"]),
                    pa.array(sums["score"]),
                    pa.array(10.0 ** np.minimum(-sums["score"] / n, 300)),
                ]
                names = ["row", "n_tokens", "n_known", "base_score", "score", "perplexity"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(
        batches,
        f"row {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double",
    )
