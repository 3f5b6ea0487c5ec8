"""Quality classifier: ridge regression on random Fourier features, isotonic calibration.

A text is described by ratios over its whole length (lengths, cases, symbols, repeats). The
standardised ratios go through cosines of random projections, whose inner products
approximate a Gaussian kernel. Every partition sums its own normal equations; partial sums
are added up in two steps, and a system of ``features`` + 1 unknowns is solved on the
driver. Rows of a fold are scored by the fit to the other folds; on those scores, rounded
to a grid, labels are made monotone by pooling adjacent violators.

Null and empty texts have all ratios zero and get the score of that point. Labels that are
missing are ignored; of several labels for one id all count. Without labels, or with
labels of one kind, every score is the share of label 1 (0.5 without any). Rows without an
id are scored and never learnt from.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.words import Words, split_words, starts_within, text_slices, window_hashes
from creditloom.staging import stage

FEATURES = 256
RIDGE = 1.0
FOLDS = 3
GRID = 10_000
#: Standardised ratios are cut at this distance from the mean.
FAR = 4.0
#: Share of the uncalibrated score; it orders the texts inside a calibrated step.
ORDER_SHARE = 0.001
PARTIALS = 64

_classes = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "symbols": b"#*$%&|<>",
    "calls": b"!?",
    "points": b".,;:",
    "others": b"@/\\()[]{}_-+=~^\"'`",
    "newlines": b"\n",
}
_tables = {k: np.isin(np.arange(256), list(v)) for k, v in _classes.items()}
STATS = (
    "words",
    "word_bytes",
    *_classes,
    "beyond_ascii",
    "types",
    "top_word",
    "adjacent",
    "repeated_grams",
    "lines",
)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different hashes per text, and how often the most frequent one occurs."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    fresh = np.ones(len(o), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    firsts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(firsts, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[firsts], sizes)
    return np.bincount(o[firsts], minlength=n).astype(np.float64), top


def text_ratios(w: Words) -> np.ndarray:
    """Matrix of texts x ``STATS``."""
    n, owner, hashes = len(w.counts), w.owner, w.hashes()
    words = w.counts.astype(np.float64)
    per_word, chars = np.maximum(words, 1), np.maximum(np.diff(w.text_bounds), 1).astype(np.float64)
    cols = [np.log1p(words), _per_text_words(w) / per_word]
    sums = {k: _per_text(t[w.data], w.text_bounds) for k, t in _tables.items()}
    cols += [np.sqrt(sums[k] / chars) for k in _classes]
    cols.append(_per_text(w.data >= 0xC0, w.text_bounds) / chars)
    types, top = _distinct(owner, hashes, n)
    cols += [types / per_word, np.sqrt(top / per_word)]
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    cols.append(np.sqrt(_per_text(same, w.bounds) / per_word))
    grams = window_hashes(hashes, 3)
    inside = starts_within(w.bounds, len(hashes), 3)[: len(grams)]
    whole = np.bincount(owner[: len(grams)][inside], minlength=n).astype(np.float64)
    different, _ = _distinct(owner[: len(grams)][inside], grams[inside], n)
    cols.append(np.sqrt(1 - (different + 1e-9) / np.maximum(whole, 1e-9)) * (whole > 0))
    cols.append(np.log1p(sums["newlines"]))
    out = np.stack(cols, axis=1)
    out[words == 0] = 0.0
    return np.nan_to_num(out)


def _per_text_words(w: Words) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(w.ends - w.starts)))
    return (total[w.bounds[1:]] - total[w.bounds[:-1]]).astype(np.float64)


def with_ratios(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``row`` (struct of ``keep``, or of all columns but the text) and ``ratios``."""
    keep = keep or [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*keep).alias("row"), F.col(f"`{text}`").alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, texts in text_slices(part.column("text")):
                x = text_ratios(split_words(texts))
                flat = pa.ListArray.from_arrays(
                    np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").slice(at, len(texts)), flat], names=["row", "ratios"]
                )

    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(batches, f"row {kind}, ratios array<double>")


@dataclass(frozen=True)
class Projection:
    """Standardisation and random Fourier features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, features: int, seed: int) -> "Projection":
        rng = np.random.default_rng(seed)
        # Width of the kernel: the typical distance of standardised rows.
        width = np.sqrt(len(mean))
        weights = rng.normal(0.0, 1.0 / width, (len(mean), features))
        return cls(mean, scale, weights, rng.uniform(0.0, 2 * np.pi, features))

    def __call__(self, ratios: np.ndarray) -> np.ndarray:
        x = np.clip((ratios - self.mean) / self.scale, -FAR, FAR)
        z = np.sqrt(2.0 / self.weights.shape[1]) * np.cos(x @ self.weights + self.phase)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def normal_equations(labelled: DataFrame, project: Projection) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold, the sums of z z' and z y over (ratios, label, fold)."""
    size = project.weights.shape[1] + 1
    upper = np.triu_indices(size)

    def partials(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            z, y = project(_matrix(part.column("ratios"))), np.asarray(part.column("label"))
            folds = np.asarray(part.column("fold"))
            for fold in np.unique(folds).tolist():
                own = z[folds == fold]
                both = np.concatenate([(own.T @ own)[upper], own.T @ y[folds == fold]])
                sums[fold] = sums.get(fold, 0.0) + both
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                names=["fold", "sums"],
            )

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), dtype=np.float64) for x in table["sums"])
        return pa.table({"fold": table["fold"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    rows = labelled.select("ratios", "label", "fold").mapInArrow(partials, "fold long, sums binary")
    some = rows.withColumn("part", F.spark_partition_id() % PARTIALS)
    few = some.groupBy("fold", "part").applyInArrow(added, "fold long, sums binary")
    out = {}
    for r in few.groupBy("fold").applyInArrow(added, "fold long, sums binary").collect():
        flat = np.frombuffer(r["sums"], dtype=np.float64)
        square = np.zeros((size, size))
        square[upper] = flat[: len(upper[0])]
        out[r["fold"]] = (square + np.triu(square, 1).T, flat[len(upper[0]) :])
    return out


def ridge(sums: list[tuple[np.ndarray, np.ndarray]], penalty: float) -> np.ndarray:
    square, right = sum(s for s, _ in sums), sum(r for _, r in sums)
    weight = np.full(len(right), penalty)
    weight[-1] = 1e-9  # the constant is free
    return np.linalg.solve(square + np.diag(weight), right)


def isotonic(x: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the pooled blocks; ``x`` ascending, label sums and counts per x."""
    blocks: list[list[float]] = []
    for at, total, n in zip(x.tolist(), labels.tolist(), counts.tolist(), strict=True):
        blocks.append([at * n, total, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return (
        np.array([b[0] / b[2] for b in blocks]),
        np.array([b[1] / b[2] for b in blocks]),
    )


@dataclass(frozen=True)
class Classifier:
    project: Projection | None
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]
    constant: float

    def scores(self, ratios: np.ndarray) -> np.ndarray:
        if self.project is None:
            return np.full(len(ratios), self.constant)
        raw = self.project(ratios) @ self.weights
        sure = np.interp(raw, *self.steps)
        return (1 - ORDER_SHARE) * sure + ORDER_SHARE * np.clip((raw + 1) / 3, 0, 1)


def fit(
    labelled: DataFrame,
    features: int = FEATURES,
    penalty: float = RIDGE,
    seed: int = 7,
) -> Classifier:
    """Fit to all rows of ``labelled`` (ratios, label 0 or 1, fold from 0 to FOLDS - 1)."""
    n = len(STATS)
    x = [F.get("ratios", F.lit(i)) for i in range(n)]
    row = labelled.agg(
        F.count("*").alias("n"),
        F.avg("label").alias("share"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)],
    ).first()
    share = 0.5 if row["share"] is None else float(row["share"])
    nothing = (np.zeros(1), np.zeros(1))
    if not row["n"] or share in (0.0, 1.0):
        return Classifier(None, np.zeros(0), nothing, share)
    mean = np.array([row[f"m{i}"] for i in range(n)])
    scale = np.array([row[f"s{i}"] for i in range(n)])
    project = Projection.draw(mean, np.where(scale > 1e-9, scale, 1.0), features, seed)
    sums = normal_equations(labelled, project)
    weights = ridge(list(sums.values()), penalty)
    # A lone fold has no other rows to learn from.
    apart = {
        f: ridge([s for g, s in sums.items() if g != f] or list(sums.values()), penalty) for f in sums
    }

    def raw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            z, folds = project(_matrix(part.column("ratios"))), np.asarray(part.column("fold"))
            found = np.zeros(len(z))
            for f, own in apart.items():
                found[folds == f] = z[folds == f] @ own
            cells = np.rint(np.clip(found, -1, 2) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), part.column("label")], names=["cell", "label"]
            )

    # At most 3 x GRID + 1 rows, whatever the input.
    cells = (
        labelled.select("ratios", "label", "fold")
        .mapInArrow(raw, "cell long, label double")
        .groupBy("cell")
        .agg(F.sum("label").alias("labels"), F.count("*").alias("n"))
        .orderBy("cell")
        .collect()
    )
    at, labels, counts = (np.array([c[k] for c in cells], dtype=float) for k in ("cell", "labels", "n"))
    return Classifier(project, weights, isotonic(at / GRID, labels, counts), share)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    label: str = "quality",
    learn: Column | None = None,
    **settings,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all columns but the text) and ``score``.

    ``learn`` is a condition on the id column of ``labels``; only rows that meet it are
    learnt from.
    """
    described = stage(with_ratios(docs, text), "ratios")
    marks = labels if learn is None else labels.where(learn)
    marks = marks.select(
        F.col(f"`{label_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("double").alias("label")
    ).dropna()
    identity = F.col("row").getField(doc_id).cast("long").alias("id")
    labelled = described.select(identity, "ratios").join(marks, "id")
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS))
    labelled = stage(labelled.select("ratios", "label", fold.alias("fold")), "labelled")
    model = fit(labelled, **settings)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = model.scores(_matrix(part.column("ratios"))) if part.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(scores)], names=["row", "score"]
            )

    kind = described.schema["row"].dataType.simpleString()
    return described.mapInArrow(batches, f"row {kind}, score double")
