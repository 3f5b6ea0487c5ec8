"""Vector codes: product quantisation with codebooks fitted by ball k-means.

A vector is scaled to integers and cut into consecutive parts; each part position has a
codebook of a few entries, and a part's code is the index of its nearest entry. All
arithmetic is on integers, so results do not depend on the layout and ties are exact: of
entries at one distance the one with the lowest index is nearest.

A round assigns every part and moves each entry to the floor of its parts' mean. Parts keep
the code of the round before, so assignment works on balls: the parts of one entry inside a
task, and the largest of their distances as radius. Only entries nearer than twice the
radius are neighbours. A part nearer to its entry than half the way to the nearest neighbour
is in the stable core and is done; the others lie in rings, and a part in the n-th ring is
compared with the n nearest neighbours only. Entries that did not move are no candidates
for the parts of another one that did not move. Tests are strict, so an entry at the same
distance with a lower index is always compared.

Balls are those of a task's batch: they need no radius from elsewhere and prune at least as
much. The codebooks (parts x entries x width numbers) are all that goes to the tasks; what
comes back is one sum per entry and component, of those parts only that changed their entry.
Every round is written to the shared folder and replaces the one before.

Rows are left out whose vector is null or empty, holds a null, a NaN, an infinity or a
component whose integer is 2**29 or more (so that distances fit 64 bits), or has another
length than the first kept vector. Rows that repeat count each time. Without rows the
result is empty, and so are the codebooks.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.staging import remove_path, stage_at

LARGEST = 1 << 29


@dataclass
class Compressed:
    """``rows``: ``row`` (all columns but the vector), ``code`` (binary, one byte a part) and
    ``error`` (squared distances summed over the parts). ``codebooks``: per part position an
    array of entries x width."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, comma-joined."""
        numbers = [str(x) for book in self.codebooks for x in book.ravel().tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def restored(self, scale: int) -> DataFrame:
        """``row`` and the ``vector`` that the code stands for."""
        books = self.codebooks

        def batches(batch: pa.RecordBatch) -> list:
            codes = _codes(batch.column("code"), len(books))
            found = np.hstack([b[codes[:, p]] for p, b in enumerate(books)]) / scale
            return [pa.array(list(found), pa.list_(pa.float64()))]

        kind = self.rows.schema["row"].dataType.simpleString()
        return _mapped(self.rows, ["row"], batches, f"row {kind}, vector array<double>")


def _mapped(rows: DataFrame, keep: list[str], made, schema: str) -> DataFrame:
    """``mapInArrow`` that keeps some columns and adds those that ``made`` returns."""
    names = [part.split()[0] for part in schema.split(", ")][len(keep) :]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                columns = [part.column(c) for c in keep] + made(part)
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return rows.mapInArrow(batches, schema)


def _cells(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, parts)


def _packed(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def nearest_entries(
    x: np.ndarray, book: np.ndarray, moved: np.ndarray, own: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row of ``x``, and its squared distance.

    ``own`` is the nearest entry in the book before; ``moved`` marks the entries that
    changed since. With all entries marked, ``own`` may be any index.
    """
    best = _distance(x, book[own])
    nearest = own.astype(np.int64).copy()
    gaps = np.einsum("ijk,ijk->ij", d := book[:, None] - book[None], d)
    no_rival = ~(moved[:, None] | moved[None])
    np.fill_diagonal(no_rival, True)
    # The radius of each ball, and its neighbours by distance; an entry is one when its
    # distance is at most twice the radius.
    radius = np.full(len(book), -1, dtype=np.int64)
    np.maximum.at(radius, nearest, best)
    far = np.iinfo(np.int64).max
    gaps = np.where(no_rival | (gaps > 4 * radius[:, None]), far, gaps)
    order = np.argsort(gaps, axis=1, kind="stable")
    gaps = np.take_along_axis(gaps, order, axis=1)
    reach = 4 * best
    # Ring after ring: who is not within half the way to the next neighbour goes on.
    left = np.arange(len(x))
    for ring in range(len(book) - 1):
        left = left[gaps[own[left], ring] <= reach[left]]
        if not len(left):
            break
        rival = order[own[left], ring]
        found = _distance(x[left], book[rival])
        wins = (found < best[left]) | ((found == best[left]) & (rival < nearest[left]))
        won = left[wins]
        best[won], nearest[won] = found[wins], rival[wins]
    return nearest, best


def _cuts(width: int, parts: int) -> list[slice]:
    """Consecutive parts; equal ones when ``parts`` divides ``width``."""
    ends = [i * width // parts for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _assigned(rows: DataFrame, books: list, moved: list, cuts: list[slice]) -> DataFrame:
    """Rows with new codes in ``code``, the codes so far in ``before``, and ``error``."""

    def made(batch: pa.RecordBatch) -> list:
        x, old = _cells(batch.column("cells")), _codes(batch.column("code"), len(cuts))
        new, error = np.zeros_like(old), np.zeros(len(x), dtype=np.int64)
        for p, cut in enumerate(cuts):
            new[:, p], away = nearest_entries(x[:, cut], books[p], moved[p], old[:, p])
            error += away
        return [batch.column("code"), _packed(new), pa.array(error)]

    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, cells array<int>, before binary, code binary, error long"
    return _mapped(rows, ["row", "cells"], made, schema)


def _changes(rows: DataFrame, cuts: list[slice], entries: int, first: bool) -> dict:
    """(part, entry) -> component sums and count that the last assignment added.

    Parts that kept their entry add nothing, but in the first round all parts are new.
    """

    def totals(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((entries, c.stop - c.start + 1), dtype=np.int64) for c in cuts]
        for batch in parts:
            if not batch.num_rows:
                continue
            x = _cells(batch.column("cells"))
            old, new = (_codes(batch.column(c), len(cuts)) for c in ("before", "code"))
            for p, cut in enumerate(cuts):
                went = np.arange(len(x)) if first else np.flatnonzero(old[:, p] != new[:, p])
                part = np.hstack([x[went, cut], np.ones((len(went), 1), dtype=np.int64)])
                np.add.at(sums[p], new[went, p], part)
                if not first:
                    np.subtract.at(sums[p], old[went, p], part)
        for p, total in enumerate(sums):
            entry, place = np.nonzero(total)
            columns = [np.full(len(entry), p), entry, place, total[entry, place]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int64)) for c in columns],
                names=["part", "entry", "place", "total"],
            )

    partial = rows.select("cells", "before", "code").mapInArrow(
        totals, "part long, entry long, place long, total long"
    )
    summed = partial.groupBy("part", "entry", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    # At most parts x entries x (width + 1) rows.
    return {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in summed.collect()}


def _integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def _usable(vector: Column, scale: int) -> Column:
    limit = float(LARGEST)
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < limit)
    return vector.isNotNull() & (F.size(vector) > 0) & fits


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> Compressed:
    """Codes of all usable rows of ``vectors``, after ``rounds`` rounds of k-means.

    The codebooks start as the parts of the vectors with the ``entries`` smallest ids (rows
    without an id come last, rows of one id in the order of their integers; with fewer rows
    there are fewer entries).
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: entries must be 1 to 256")
    spark = vectors.sparkSession
    source = F.col(f"`{vector}`")
    others = [F.col(f"`{c}`") for c in vectors.columns if c != vector]
    usable = vectors.where(F.coalesce(_usable(source, scale), F.lit(False))).select(
        F.struct(*others).alias("row"), _integers(source, scale).alias("cells")
    )
    order = (F.col("row").getField(vec_id).asc_nulls_last(), F.col("cells").asc())
    first = usable.orderBy(*order).select(F.size("cells").alias("width")).first()
    width = first["width"] if first else 0
    usable = usable.where(F.size("cells") == width)
    start = usable.orderBy(*order).select("cells").limit(entries).collect()
    cuts = _cuts(width, parts)
    began = np.array([r["cells"] for r in start], dtype=np.int64).reshape(len(start), width)
    books = [began[:, c].copy() for c in cuts]
    none = F.lit(bytes(parts))
    rows, path = stage_at(usable.withColumn("code", none), "cells")
    moved = [np.ones(len(start), dtype=bool) for _ in cuts]
    sums = [[[0] * (c.stop - c.start + 1) for _ in start] for c in cuts]
    for i in range(rounds + 1):
        last = path
        rows, path = stage_at(_assigned(rows, books, moved, cuts), "codes")
        remove_path(spark, last)
        if i == rounds or not start:
            break
        for (p, e, place), total in _changes(rows, cuts, len(start), first=not i).items():
            sums[p][e][place] += total
        for p, book in enumerate(books):
            new = book.copy()
            for e, (*components, count) in enumerate(sums[p]):
                if count:
                    new[e] = [c // count for c in components]
            moved[p] = (new != book).any(axis=1)
            books[p] = new
    return Compressed(rows.select("row", "code", "error"), books)
