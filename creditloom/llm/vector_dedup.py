"""Near-duplicate vectors from randomised-rotation binary codes with correction factors.

Vectors are compared inside their label by cosine. A unit vector is turned by random
orthogonal matrices; the signs are its code, and the correction factor is the inner product
of the vector with its own code (the signs divided by the root of the length). The inner
product of one vector's code with another vector, divided by the factor, is an unbiased
estimate of their cosine, and the factor and the length bound its error. A pair is computed
exactly, from the vectors in double precision, if both of its estimates reach the threshold
within their bounds; no other pair is, and no pair links without it.

Candidates are rows that agree in one of several runs of code bits ("tables"). The length of
a run follows the number of vectors of the largest label, so that buckets keep their size,
and the number of tables follows from the length, so that a pair at the threshold meets in
one of them with probability ``recall`` at any size of the input (pairs above it with more).
A pair counts in the first table in which it meets. A large bucket is dealt into blocks and
every pair of blocks is a cell of bounded size; cells return a row per vector, with its
number of links and the root of its links, and never a pair.

Only codes with vectors of one byte a component go through the tables. Exact vectors are
fetched for the rows of a cell that have a pair to compute.

Equal vectors of a label (by 64-bit hash) are one node and link with each other. Vectors that
are null or empty, are zero, or hold a null, a NaN or an infinity link with nothing, as do
rows without a label and vectors of different lengths. Ids may be of any type that sorts;
rows without an id take part and never name a component that has an id. Rows that repeat
link with each other.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.graph import connected_components
from creditloom.operators.joins import lookup_join
from creditloom.staging import stage

SEED = 42
#: Vectors in a bucket that chance alone fills.
BUCKET = 256
#: Vectors in a block of a larger bucket.
BLOCK = 512
RECALL = 0.99
#: Width of the confidence bound, in standard errors of the widest case.
SURE = 1.9
#: Pairs whose vectors are multiplied at a time.
PAIRS_AT_ONCE = 1 << 16

_turns: dict[tuple[int, int], np.ndarray] = {}


def rotation(width: int, number: int) -> np.ndarray:
    """Random orthogonal matrix; the same on every executor."""
    if (width, number) not in _turns:
        rng = np.random.default_rng([SEED, width, number])
        q, r = np.linalg.qr(rng.normal(size=(width, width)))
        _turns[width, number] = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    return _turns[width, number]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is taken out first, so squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Codes of some unit vectors: ``signs`` (of all rotations), the correction ``factor``
    of the first one, and the vectors turned by it in steps of one byte."""

    def __init__(self, signs, factor, low, step, levels):
        self.signs, self.factor, self.low, self.step, self.levels = signs, factor, low, step, levels

    @classmethod
    def of(cls, vectors: np.ndarray, bits: int) -> "Codes":
        n, width = vectors.shape
        turned = vectors @ rotation(width, 0)
        signs = [turned >= 0]
        for i in range(1, max(1, -(-bits // width))):
            signs.append(vectors @ rotation(width, i) >= 0)
        factor = np.abs(turned).sum(axis=1) / math.sqrt(width)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / 254, 1e-12)
        # Rounded up or down by chance, so that the steps add no bias.
        chance = np.random.default_rng([SEED, width]).random(width)
        levels = np.floor((turned - low[:, None]) / step[:, None] + chance).astype(np.uint8)
        return cls(np.hstack(signs), factor, low, step, levels)

    def estimates(self) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosine of every pair, by the code of the row's vector, and the bound of
        its error."""
        width = self.levels.shape[1]
        turned = self.low[:, None] + self.step[:, None] * self.levels
        code = np.where(self.signs[:, :width], 1.0, -1.0) / math.sqrt(width)
        factor = np.maximum(self.factor, 1e-9)
        estimate = (code @ turned.T) / factor[:, None]
        spread = np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(width - 1, 1e-9))
        rounding = math.sqrt(width) * self.step[None] / factor[:, None]
        return estimate, SURE * spread[:, None] + rounding


def open_pairs(
    codes: Codes, side: np.ndarray, across: bool, table: int, bits: int, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell that its codes cannot rule out and that no earlier table has.

    ``side`` is the block of each row; a cell of two blocks compares ``across`` only.
    """
    estimate, bound = codes.estimates()
    maybe = estimate + bound >= threshold
    maybe &= maybe.T
    if across:
        maybe &= side[:, None] != side[None]
    a, b = np.nonzero(np.triu(maybe, 1))
    if not table or not len(a):
        return a, b
    keep = []
    for i in range(0, len(a), PAIRS_AT_ONCE):
        rows, others = a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]
        met = np.zeros(len(rows), dtype=bool)
        for t in range(table):
            run = slice(t * bits, (t + 1) * bits)
            met |= (codes.signs[rows, run] == codes.signs[others, run]).all(axis=1)
        keep.append(~met)
    keep = np.concatenate(keep)
    return a[keep], b[keep]


def _cosines(vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parts = [
        np.einsum("ij,ij->i", vectors[a[i : i + PAIRS_AT_ONCE]], vectors[b[i : i + PAIRS_AT_ONCE]])
        for i in range(0, len(a), PAIRS_AT_ONCE)
    ]
    return np.concatenate(parts) if parts else np.zeros(0)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each of ``n`` places is linked with over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _cells(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each cell; the rows come sorted by cell."""
    names = ("bucket", "i", "j")
    held, key = [], None
    for part in parts:
        if not part.num_rows:
            continue
        columns = [part.column(c).to_numpy() for c in names]
        change = np.zeros(part.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), part.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            own = tuple(int(c[start]) for c in columns)
            if key is not None and own != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(part.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1)


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _coded(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Per node its codes and the key in each table; rows of one length have one layout."""
    need = max(1, bits * tables)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = part.column("vector")
            widths = np.diff(vectors.offsets.to_numpy())
            for width in np.unique(widths):
                at = pa.array(np.flatnonzero(widths == width))
                codes = Codes.of(unit(_vectors(vectors.take(at))), need)
                weight = 1 << np.arange(bits, dtype=np.int64)
                runs = codes.signs[:, : bits * tables].reshape(len(at), tables, bits)
                keys = (runs @ weight) if bits else np.zeros((len(at), tables), dtype=np.int64)
                packed = np.packbits(codes.signs, axis=1)
                columns = [
                    part.column("node").take(at),
                    part.column("label").take(at),
                    pa.array(np.full(len(at), width, dtype=np.int32)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), keys.ravel()
                    ),
                    pa.array([r.tobytes() for r in packed], pa.binary()),
                    pa.array(codes.factor),
                    pa.array(codes.low),
                    pa.array(codes.step),
                    pa.array([r.tobytes() for r in codes.levels], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["node", "label", "width", "keys", "signs", "factor", "low", "step", "levels"]
    return nodes.select("node", "label", "vector").mapInArrow(
        batches,
        "node long, label string, width int, keys array<long>, signs binary, factor double, "
        "low double, step double, levels binary",
    )


def _dealt(coded: DataFrame, block: int) -> DataFrame:
    """Rows by cell: ``bucket`` and the two blocks ``i`` <= ``j``; ``side`` is the own block."""
    rows = coded.select("*", F.posexplode("keys").alias("table", "key")).drop("keys")
    rows = rows.withColumn("bucket", F.xxhash64("table", "label", "width", "key"))
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = stage(large, "large-buckets")
    rows = lookup_join(rows.drop("label", "width", "key"), large, ["bucket"], "left")
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int")
    side = F.pmod(F.xxhash64("node", "table"), blocks).cast("int")
    rows = rows.withColumns({"blocks": blocks, "side": side})
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least("side", k).alias("i"), F.greatest("side", k).alias("j")),
    )
    return rows.select("*", F.explode(cells).alias("cell")).select(
        "bucket", "cell.i", "cell.j", "table", "side", "node", "signs", "factor", "low", "step", "levels"
    )


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")


def _asked(cells: DataFrame, bits: int, threshold: float) -> DataFrame:
    """Rows of cells that have a pair to compute."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, i, j), cell in _cells(parts):
            if cell.num_rows < 2:
                continue
            levels = _matrix(cell.column("levels"), np.uint8)
            signs = np.unpackbits(_matrix(cell.column("signs"), np.uint8), axis=1).astype(bool)
            numbers = [cell.column(c).to_numpy() for c in ("factor", "low", "step")]
            side, table = cell.column("side").to_numpy(), int(cell.column("table")[0].as_py())
            a, b = open_pairs(Codes(signs, *numbers, levels), side, i != j, table, bits, threshold)
            rows = np.unique(np.concatenate([a, b]))
            if len(rows):
                same = [np.full(len(rows), v) for v in (bucket, i, j, table)]
                own = [side[rows], cell.column("node").to_numpy()[rows]]
                columns = [pa.array(c.astype(t)) for c, t in zip(same + own, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["bucket", "i", "j", "table", "side", "node"]
    kinds = [np.int64, np.int32, np.int32, np.int32, np.int32, np.int64]
    return _by_cell(cells).mapInArrow(
        batches, "bucket long, i int, j int, table int, side int, node long"
    )


def _linked(asked: DataFrame, nodes: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """(node, links, root) per cell: number of vectors linked with, smallest node linked."""
    need = max(1, bits * tables)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), cell in _cells(parts):
            vectors = unit(_vectors(cell.column("vector")))
            side, table = cell.column("side").to_numpy(), int(cell.column("table")[0].as_py())
            a, b = open_pairs(Codes.of(vectors, need), side, i != j, table, bits, threshold)
            near = _cosines(vectors, a, b) >= threshold
            a, b = a[near], b[near]
            if not len(a):
                continue
            node, copies = cell.column("node").to_numpy(), cell.column("copies").to_numpy()
            links = np.zeros(len(node), dtype=np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            rows = np.flatnonzero(links)
            root = node[_roots(len(node), a, b)]  # rows are sorted by node
            columns = [pa.array(c[rows]) for c in (node, links, root)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "links", "root"])

    exact = asked.join(nodes.select("node", "copies", "vector"), "node")
    return _by_cell(exact).mapInArrow(batches, "node long, links long, root long")


def layout(largest: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """Bits in a run, and number of runs: buckets keep their size, pairs their chance."""
    bits = max(0, math.ceil(math.log2(largest / bucket))) if largest else 0
    if not bits:
        return 0, 1
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    recall: float = RECALL,
    bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: ``row`` (all columns but the vector), ``n_links``,
    ``component`` (smallest id that links reach) and ``kept`` (the row bears that id)."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    source, group = F.col(f"`{vector}`"), F.col(f"`{label}`")
    usable = F.coalesce(_usable(source), F.lit(False)) & group.isNotNull()
    doubles = F.transform(source, lambda x: x.cast("double"))
    others = [F.col(f"`{c}`") for c in vectors.columns if c != vector]
    rows = vectors.select(
        F.struct(*others).alias("row"),
        F.when(usable, F.xxhash64(group.cast("string"), source)).alias("node"),
        F.when(usable, group.cast("string")).alias("label"),
        F.when(usable, doubles).alias("vector"),
    )
    name = F.col("row").getField(vec_id)
    nodes = rows.where("node IS NOT NULL").groupBy("node")
    nodes = nodes.agg(
        F.first("label").alias("label"),
        F.first("vector").alias("vector"),
        F.min(name).alias("first"),
        F.count("*").alias("copies"),
    )
    nodes = stage(nodes, "vectors")
    largest = nodes.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"]
    bits, tables = layout(largest or 0, threshold, recall, bucket)
    coded = stage(_coded(nodes, bits, tables), "codes")
    asked = stage(_asked(_dealt(coded, block), bits, threshold), "asked")
    linked = stage(_linked(asked, nodes, bits, tables, threshold), "linked")
    edges = linked.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = connected_components(edges.distinct())
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    # Only nodes with copies or links need more than their own row.
    several = nodes.select("node", "first", "copies").join(links, "node", "left")
    several = several.where("copies > 1 OR links > 0").join(roots, "node", "left")
    several = stage(several.withColumn("root", F.coalesce("root", "node")), "linked-nodes")
    names = several.groupBy("root").agg(F.min("first").alias("component"))
    found = lookup_join(several, names, ["root"]).select(
        "node", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = lookup_join(rows.select("row", "node"), stage(found, "components"), ["node"], "left")
    component = F.when(F.col("n_links").isNull(), name).otherwise(F.col("component"))
    return out.select(
        "row",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component"),
        name.eqNullSafe(component).alias("kept"),
    )
