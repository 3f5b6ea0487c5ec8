"""Logistic regressions for all folds and penalties of a grid at once.

Every pass over the rows adds up the loss, the slope and the curvature of all fits that are
still moving; a proximal Newton step on the driver takes each of them on. So the number of
passes is that of the slowest fit, whatever the number of settings. The areas of all fits on
their held-out rows come from one job too.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.running import running_sums
from creditloom.staging import stage

TOLERANCE = 1e-8
SWEEPS = 1_000


class Folds:
    """What the training part of each fold gives: values for gaps, means and deviations.
    Rows have ``label``, ``fold`` and the inputs ``names``."""

    def __init__(self, rows: DataFrame, names: list[str], folds: int, medians: np.ndarray):
        self.names, self.folds, self.medians = names, folds, medians
        aggregates = [F.count_if(F.col("fold") != k).alias(f"n{k}") for k in range(folds)]
        for k in range(folds):
            for j, name in enumerate(names):
                filled = F.coalesce(F.col(name), F.lit(float(medians[k, j])))
                x = F.when(F.col("fold") != k, filled)
                aggregates += [F.avg(x).alias(f"m{k}_{j}"), F.stddev_samp(x).alias(f"s{k}_{j}")]
        found = rows.agg(*aggregates).first()
        table = lambda c: np.array(
            [[found[f"{c}{k}_{j}"] or 0.0 for j in range(len(names))] for k in range(folds)]
        )
        self.sizes = [found[f"n{k}"] for k in range(folds)]
        self.means, spread = table("m"), table("s")
        self.scales = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)

    def inputs(self, part: pa.RecordBatch, k: int, rows: np.ndarray) -> np.ndarray:
        """Standardised inputs of some rows as fold ``k`` sees them, after a column of ones."""
        columns = [part.column(c).to_numpy(zero_copy_only=False)[rows] for c in self.names]
        x = np.column_stack(columns).astype(float)
        x = np.where(np.isnan(x), self.medians[k], x)
        return np.column_stack([np.ones(len(x)), (x - self.means[k]) * self.scales[k]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _sums(
    rows: DataFrame, data: Folds, moving: dict[tuple[int, int], np.ndarray]
) -> dict[tuple[int, int], np.ndarray]:
    """Loss, slope and curvature of the moving fits (fold, setting), in one pass."""
    width = len(data.names) + 1

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {fit: np.zeros(1 + width + width * width) for fit in moving}
        for part in parts:
            fold, label = part.column("fold").to_numpy(), part.column("label").to_numpy()
            for k in {k for k, _ in moving}:
                own = np.flatnonzero(fold != k)
                x, y = data.inputs(part, k, own), label[own]
                for fit in (f for f in moving if f[0] == k):
                    margin = x @ moving[fit]
                    p = _sigmoid(margin)
                    totals[fit][0] += (np.logaddexp(0, margin) - y * margin).sum()
                    totals[fit][1 : 1 + width] += x.T @ (p - y)
                    totals[fit][1 + width :] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        for (k, s), total in totals.items():
            columns = [np.full(len(total), k), np.full(len(total), s), np.arange(len(total)), total]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["k", "s", "place", "total"]
    parts = rows.mapInArrow(batches, "k long, s long, place long, total double")
    # Fits x (inputs + 1) squared rows.
    found = parts.groupBy("k", "s", "place").agg(F.sum("total").alias("total")).collect()
    out = {fit: np.zeros(1 + width + width * width) for fit in moving}
    for r in found:
        out[r["k"], r["s"]][r["place"]] = r["total"]
    return out


def _penalty(w: np.ndarray, reg: float, share: float) -> float:
    return reg * (share * np.abs(w[1:]).sum() + (1 - share) / 2 * (w[1:] ** 2).sum())


def _target(w: np.ndarray, slope: np.ndarray, curve: np.ndarray, reg: float, share: float) -> np.ndarray:
    """Minimum of the penalised quadratic around ``w``, coordinate by coordinate."""
    curve = curve + 1e-10 * np.eye(len(w))
    if reg * share == 0:
        ridge = np.diag([0.0] + [reg] * (len(w) - 1))
        return w - np.linalg.solve(curve + ridge, slope + ridge @ w)
    v = w.copy()
    for _ in range(SWEEPS):
        last = v.copy()
        for j in range(len(v)):
            rest = slope[j] + curve[j] @ (v - w) - curve[j, j] * v[j]
            if j == 0:
                v[j] = -rest / curve[j, j]
            else:
                size = max(abs(rest) - reg * share, 0.0)
                v[j] = -np.sign(rest) * size / (curve[j, j] + reg * (1 - share))
        if np.abs(v - last).max() < TOLERANCE / 10:
            break
    return v


def fit_grid(
    rows: DataFrame, data: Folds, settings: list[tuple[float, float]], max_iter: int = 100
) -> dict:
    """(fold, setting) -> intercept and coefficients of the standardised inputs."""
    fits = {(k, s): np.zeros(len(data.names) + 1) for k in range(data.folds) for s in range(len(settings))}
    moving, before = dict(fits), {}
    for _ in range(max_iter):
        sums = _sums(rows, data, moving)
        following = {}
        for (k, s), total in sums.items():
            w, (reg, share), n, width = moving[k, s], settings[s], data.sizes[k], len(data.names) + 1
            loss = total[0] / n + _penalty(w, reg, share)
            if (k, s) in before and not loss <= before[k, s][0] + 1e-12:
                # Too far: half of the last step.
                last = before[k, s][1]
                if np.abs(w - last).max() > TOLERANCE:
                    following[k, s] = last + (w - last) / 2
                continue
            before[k, s] = (loss, w)
            fits[k, s] = w
            slope, curve = total[1 : 1 + width] / n, total[1 + width :].reshape(width, width) / n
            target = _target(w, slope, curve, reg, share)
            if np.isfinite(target).all() and np.abs(target - w).max() > TOLERANCE:
                following[k, s] = target
        moving = following
        if not moving:
            break
    return fits


def grid_areas(rows: DataFrame, data: Folds, fits: dict) -> dict[tuple[int, int], float]:
    """(fold, setting) -> exact ROC area on the rows of the fold, all from one job.

    Fits are put one after the other on one axis, on which the running sums are taken.
    """
    number = {fit: i for i, fit in enumerate(sorted(fits))}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fold, label = part.column("fold").to_numpy(), part.column("label").to_numpy()
            for (k, s), w in fits.items():
                own = np.flatnonzero(fold == k)
                score = _sigmoid(data.inputs(part, k, own) @ w)
                columns = [np.full(len(own), number[k, s]), 2.0 * number[k, s] + score, label[own]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["fit", "at", "label"]
                )

    scored = rows.mapInArrow(batches, "fit long, at double, label double")
    points = scored.groupBy("fit", "at").agg(
        F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg")
    )
    points = stage(points, "grid-scores")
    added = running_sums(points, "at", ["pos"])
    # Positives above a point's middle, times its negatives; other fits' positives go off below.
    above = (F.col("cum_pos") - F.col("pos") / 2) * F.col("neg")
    found = added.groupBy("fit").agg(
        F.sum(above).alias("above"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.max("cum_pos").alias("last"),
    )
    areas = {}
    by_number = {i: fit for fit, i in number.items()}
    for r in found.collect():
        others = r["last"] - r["pos"]
        pairs = r["pos"] * r["neg"]
        areas[by_number[r["fit"]]] = (r["above"] - others * r["neg"]) / pairs if pairs else 0.0
    return areas
