"""Exact order statistics of whole columns in two scans, without gathering a column.

The first scan counts the values and makes a mergeable sketch, whose values at evenly spaced
shares bracket each wanted rank. The second scan counts the values on one side of each
bracket and, by value, those inside; only these few are shuffled. The rank of a bracket's
edge is thus known exactly, and the value is found in the counts. A value that a large part
of the rows shares is one count.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.staging import stage

SKETCH_ACCURACY = 10_000
#: Evenly spaced shares at which the sketch is read.
SHARES = 500
#: Counted values that the driver takes at a time; more are written and searched first.
FINAL_VALUES = 100_000


@dataclass
class _Target:
    """The value of ``rank`` (0-based) among ``n`` values lies in ``low`` to ``high``, and
    about ``size`` values are in there at most."""

    name: str
    rank: int
    n: int
    low: float
    high: float
    size: float
    sure: bool = False

    @property
    def bracket(self) -> tuple[str, float, float]:
        return self.name, self.low, self.high

    @property
    def upper(self) -> bool:
        """Whether fewer values lie above the bracket than below."""
        return 2 * self.rank > self.n


def _sketch(x: Column | str) -> Column:
    """Values at the shares. One expression for all of them: a literal each takes longer to
    send to the JVM than a small table takes to read."""
    shares = ", ".join(f"{i / SHARES!r}D" for i in range(1, SHARES))
    return F.percentile_approx(x, F.expr(f"array({shares})"), SKETCH_ACCURACY)


def _targets(name: str, ranks: list[int], totals: list) -> list[_Target]:
    n, low, high, grid = totals
    edges, margin = [low, *grid, high], 2.0 / SKETCH_ACCURACY
    found = []
    for rank in ranks:
        share = (rank + 0.5) / n
        first = max(0, math.floor((share - margin) * SHARES))
        last = min(SHARES, math.ceil((share + margin) * SHARES))
        size = 1 if edges[first] == edges[last] else min(n, ((last - first) / SHARES + 2 * margin) * n)
        whole = first == 0 and last == SHARES
        found.append(_Target(name, rank, n, edges[first], edges[last], size, whole))
    return found


def _counted(df: DataFrame, exprs: dict[str, Column], brackets: dict) -> DataFrame:
    """(b, x, n): values inside each bracket with their numbers, and with NULL for x the
    number of values beyond it, on the side where they are few."""
    marks = []
    for (name, low, high, upper), b in brackets.items():
        x = exprs[name]
        inside = F.struct(F.lit(b).alias("b"), x.alias("x"))
        beyond = F.struct(F.lit(b).alias("b"), F.lit(None).cast("double").alias("x"))
        side = x > F.lit(high) if upper else x < F.lit(low)
        marks.append(F.when(x.between(F.lit(low), F.lit(high)), inside).when(side, beyond))
    rows = df.select(F.inline(F.array_compact(F.array(*marks))))
    return rows.groupBy("b", "x").agg(F.count("*").alias("n"))


def _narrowed(counts: DataFrame, b: int, rank: int, distinct: int) -> list[tuple[float, int]]:
    """Values around the one of ``rank`` inside a bracket, with ``rank`` taken on to them."""
    rows = counts.where((F.col("b") == b) & F.col("x").isNotNull())
    below = 0
    while distinct > FINAL_VALUES:
        cuts = sorted(set(rows.agg(_sketch("x")).first()[0]))
        cell = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("x")))
        found = rows.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("d"))
        for r in sorted(found.collect()):
            if rank < below + r["n"]:
                break
            below += r["n"]
        if r["cell"] > 0:
            rows = rows.where(F.col("x") > F.lit(cuts[r["cell"] - 1]))
        if r["cell"] < len(cuts):
            rows = rows.where(F.col("x") <= F.lit(cuts[r["cell"]]))
        distinct = r["d"]
    return [(-math.inf, below)] * (below > 0) + [(r["x"], r["n"]) for r in rows.collect()]


def _at_rank(values: list[tuple[float, int]], rank: int) -> float:
    for x, n in sorted(values):
        if rank < n:
            return x
        rank -= n
    raise AssertionError("the rank lies inside the bracket")


def _settle(df: DataFrame, exprs: dict[str, Column], targets: list[_Target], result: dict) -> None:
    """Fill in the values of ``targets``; those that miss their bracket get the whole range."""
    brackets: dict[tuple, int] = {}
    for t in targets:
        brackets.setdefault((*t.bracket, t.upper), len(brackets))
    counts = _counted(df, exprs, brackets)
    sizes = {(*t.bracket, t.upper): t.size for t in targets}
    few = sum(sizes.values()) <= FINAL_VALUES
    lists: dict[int, list[tuple[float, int]]] = {b: [] for b in brackets.values()}
    beyond, inside, distinct = ({b: 0 for b in lists} for _ in range(3))
    if few:
        for r in counts.collect():
            if r["x"] is None:
                beyond[r["b"]] += r["n"]
            else:
                lists[r["b"]].append((r["x"], r["n"]))
                inside[r["b"]] += r["n"]
    else:
        counts = stage(counts, "brackets")
        known = F.col("x").isNotNull()
        totals = counts.groupBy("b").agg(
            F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("beyond"),
            F.sum(F.when(known, F.col("n")).otherwise(0)).alias("inside"),
            F.count("x").alias("distinct"),
        )
        for r in totals.collect():
            beyond[r["b"]], inside[r["b"]], distinct[r["b"]] = r["beyond"], r["inside"], r["distinct"]
    missed = []
    for t in targets:
        b = brackets[(*t.bracket, t.upper)]
        below = t.n - beyond[b] - inside[b] if t.upper else beyond[b]
        if not below <= t.rank < below + inside[b]:
            if t.sure:
                raise AssertionError(f"{t.name}: the rows changed between two scans")
            missed.append(t)
            continue
        values = lists[b] if few else _narrowed(counts, b, t.rank - below, distinct[b])
        result[t.name][1][t.rank] = _at_rank(values, t.rank - below)
    if missed:
        ends = [F.min(exprs[t.name]) for t in missed] + [F.max(exprs[t.name]) for t in missed]
        found = _one_row(df, ends)
        for i, t in enumerate(missed):
            t.low, t.high, t.size, t.sure = found[i], found[i + len(missed)], t.n, True
        _settle(df, exprs, missed, result)


def _one_row(df: DataFrame, exprs: list[Column]) -> list:
    return list(df.agg(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first())


def order_statistics(
    df: DataFrame, exprs: dict[str, Column], ranks: Callable[[int], list[int]]
) -> dict[str, tuple[int, dict[int, float]]]:
    """For each expression its non-null count n and the values at the ranks ``ranks(n)``.

    Expressions are doubles without NaN. All of them share both scans of ``df``.
    """
    names = list(exprs)
    totals = []
    for x in exprs.values():
        totals += [F.count(x), F.min(x), F.max(x), _sketch(x)]
    found = _one_row(df, totals)
    result: dict[str, tuple[int, dict[int, float]]] = {}
    targets: list[_Target] = []
    for i, name in enumerate(names):
        own = found[4 * i : 4 * i + 4]
        result[name] = (own[0], {})
        if own[0]:
            targets += _targets(name, sorted(set(ranks(own[0]))), own)
    if targets:
        _settle(df, exprs, targets, result)
    return result


def exact_quantiles(
    df: DataFrame, exprs: dict[str, Column], probs: list[float]
) -> dict[str, list[float] | None]:
    """Quantiles with linear interpolation; None for an expression without values."""

    def ranks(n: int) -> list[int]:
        at = [p * (n - 1) for p in probs]
        return [r for x in at for r in (math.floor(x), math.ceil(x))]

    result: dict[str, list[float] | None] = {}
    for name, (n, values) in order_statistics(df, exprs, ranks).items():
        if not n:
            result[name] = None
            continue
        result[name] = []
        for p in probs:
            at = p * (n - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            gap = (high - low) * (at - math.floor(at)) if high != low else 0.0
            result[name].append(low + gap)
    return result
