"""Random forest as a table of nodes, grown in two phases.

Large nodes are split from histograms that are summed over the cluster, level by level.
As soon as a node has few enough rows, its rows go to one task, which grows the rest of the
tree from exact values. Small inputs skip the first phase.

Rows that are equal in label and features are one row with a number of copies. Each tree
weighs a row by a Poisson number of draws; draws and the features that a node tries come
from hashes of the row's content, the tree and the node. Class counts are whole numbers,
and class weights are applied to the sums, so a forest does not depend on the layout. The
least number of rows in a leaf counts each copy once, however often it is drawn.

A node has the id 0 at the root and 2 i + 1, 2 i + 2 below node i. The table has for each
node ``left`` and ``right`` (-1 in a leaf), the feature and threshold of its split (rows up
to the threshold go left), its weight ``cover`` and its share ``value`` of label 1.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.staging import remove_path, shuffles_removed, stage, stage_at, staging_path

#: Rows of a node that one task finishes.
FINISH_ROWS = 100_000
#: Cut values per feature in the histograms, and rows of the sample that places them.
CUTS = 255
SAMPLE_ROWS = 100_000
#: Numbers in the histograms of one task at a time.
HISTOGRAM_CELLS = 4_000_000
#: Rows times trees whose samples are on their way to the tasks at a time, and how many times
#: ``FINISH_ROWS`` one task takes.
GROUP_ROWS = 36_000_000
TASK_NODES = 3
#: Rows that a task works on at a time, and the bits of a sum that shares a number with others.
CHUNK_ROWS = 32_000
FIELD = 17
#: Nodes that go to the tasks at a time, and blocks of them in one pass over scored rows.
BLOCK_NODES = 2_000_000
PASS_BLOCKS = 4
#: Up to this many copies, draws come from the exact distribution.
EXACT_COPIES = 32
#: Visits of trees with at most so many leaves come from masks of leaves, for so many rows at a
#: time; and leaves of the trees whose masks are looked up by the same places.
MASK_LEAVES = 256
MASK_ROWS = 4_000
MASK_GROUP = 12_000
#: Ids of deeper nodes and a tree number do not fit 64 bits.
DEEPEST = 34

#: As staged: the other columns follow from these.
NODE = "tree long, id long, feature int, threshold double, pos long, neg long"


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash(first: np.ndarray, *others) -> np.ndarray:
    return _hash_on(_mix(np.atleast_1d(first).astype(np.uint64) + _STEP), *others)


def _hash_on(out: np.ndarray, *others) -> np.ndarray:
    """The hash that began as ``out``, with more numbers."""
    for other in others:
        out = _mix(out ^ (np.atleast_1d(other).astype(np.uint64) + _STEP))
    return out


def _unit(hashed: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1."""
    return ((hashed >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _reached_alone() -> list[float]:
    """Chance of at most 0, 1, 2 ... draws of a row without copies, up to 1."""
    few = np.ones(1)
    part = np.exp(-few)
    reached = [part]
    for k in range(1, 4 * EXACT_COPIES):
        part = part * few / k
        reached.append(reached[-1] + part)
    return [float(r[0]) for r in reached]


_ALONE = _reached_alone()


def _draws_alone(u: np.ndarray) -> np.ndarray:
    """As ``_draws_of`` for rows without copies."""
    found = np.zeros(len(u), dtype=np.int8)
    for reached in _ALONE[:-1]:
        more = u > reached
        if not more.any():
            break
        found += more.view(np.int8)
    return found.astype(np.int64)


def _draws_of(hashed: np.ndarray, u: np.ndarray, copies: np.ndarray) -> np.ndarray:
    few = np.minimum(copies, EXACT_COPIES).astype(np.float64)
    part = np.exp(-few)
    reached, found = part.copy(), np.zeros(len(u), dtype=np.int64)
    for k in range(1, 4 * EXACT_COPIES):
        more = u > reached
        if not more.any():
            break
        found += more
        part = part * few / k
        reached = reached + part
    many = copies > EXACT_COPIES
    if many.any():
        angle = 2 * np.pi * _unit(_hash(hashed, 1))
        normal = np.sqrt(-2 * np.log(u)) * np.cos(angle)
        near = np.rint(copies + np.sqrt(copies) * normal).astype(np.int64)
        found = np.where(many, np.maximum(near, 0), found)
    return found


class Draws:
    """How often the trees' samples hold some rows: Poisson numbers with mean ``copies``."""

    def __init__(self, content: np.ndarray, copies: np.ndarray):
        self.copies, self.begun = copies, _hash_on(_mix(content.astype(np.uint64) + _STEP))
        self.several = np.flatnonzero(copies != 1)

    def of(self, tree: int, seed: int) -> np.ndarray:
        hashed = _hash_on(self.begun, tree, seed)
        u = _unit(hashed)
        if len(self.several) == len(u):
            return _draws_of(hashed, u, self.copies)
        found = _draws_alone(u)
        own = self.several
        if len(own):
            found[own] = _draws_of(hashed[own], u[own], self.copies[own])
        return found


def draws(content: np.ndarray, copies: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's sample holds each row."""
    return Draws(content, copies).of(tree, seed)


@dataclass(frozen=True)
class Plan:
    """What all nodes of a forest have in common."""

    seed: int
    tried: int
    max_depth: int
    min_leaf: int
    weights: tuple[float, float]

    def order(self, tree, ids: np.ndarray, features: int) -> np.ndarray:
        """Features of each node in the order in which it tries them."""
        keys = _hash(ids[:, None], np.broadcast_to(tree, ids.shape)[:, None], self.seed, np.arange(features)[None])
        return np.argsort(keys, axis=1, kind="stable")

    def purity(self, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        """Grows as the Gini impurity of the parts falls, weighted by their size."""
        pos, neg = pos * self.weights[1], neg * self.weights[0]
        return (pos * pos + neg * neg) / np.maximum(pos + neg, 1e-300)


class _Sorted:
    """Rows in the order of (node, value of the feature that the node tries).

    A row's node, rank and number make up one key, so that sorting numbers sorts the rows.
    """

    def __init__(self, ranks: np.ndarray, rows: np.ndarray, node: np.ndarray, shift: np.ndarray, held: np.ndarray):
        width, m = ranks.shape
        self.row_bits, self.rank_bits = (m - 1).bit_length(), int(ranks.max()).bit_length()
        rank = ranks.ravel().take(shift.take(node) + rows)
        if self.row_bits + self.rank_bits + len(held).bit_length() < 63:
            key = ((node << self.rank_bits) | rank) << self.row_bits
            key |= rows
            key.sort()
            self.rows = key & ((1 << self.row_bits) - 1)
            key >>= self.row_bits
        else:
            key = node * (int(ranks.max()) + 1) + rank
            order = np.argsort(key, kind="stable")
            self.rows, key = rows[order], key[order]
        # Whether a row differs from the next one.
        self.parts = np.empty(len(key), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=self.parts[:-1])
        self.held, self.ends = held, np.cumsum(held)
        self.starts = self.ends - held
        self.parts[self.ends - 1] = False

    def spread(self, of_node: np.ndarray) -> np.ndarray:
        return np.repeat(of_node, self.held)

    def before(self, of_row: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums up to each row inside its node, and what is left of the node's total."""
        sums = np.cumsum(of_row.take(self.rows))
        first = sums[self.ends - 1] - total
        left = sums - self.spread(first)
        return left, self.spread(total) - left

    def before_one(self) -> tuple[np.ndarray, np.ndarray]:
        """As ``before`` where each row counts once."""
        place = np.arange(1, len(self.rows) + 1)
        return place - self.spread(self.starts), self.spread(self.ends) - place


def grow(
    x: np.ndarray,
    label: np.ndarray,
    weight: np.ndarray,
    copies: np.ndarray,
    tree: int,
    root: int,
    plan: Plan,
) -> dict:
    """Nodes of the subtree at ``root`` from the rows that reach it, level by level."""
    m, width = x.shape
    ranks, values = np.empty((width, m), dtype=np.int64), []
    for f in range(width):
        found, ranks[f] = np.unique(np.ascontiguousarray(x[:, f]), return_inverse=True)
        values.append(found)
    flat, first_value = ranks.ravel(), np.cumsum([0, *map(len, values[:-1])])
    values = np.concatenate(values)
    pos, neg, count = weight * label, weight * (1 - label), np.minimum(weight, copies)
    out: dict[str, list] = {c: [] for c in ("id", "feature", "threshold", "pos", "neg")}
    ids = np.array([root], dtype=np.int64)
    depth = (root + 1).bit_length() - 1
    once = bool((count == 1).all())
    # Sums of each node of a level, and the number of its rows.
    sums = [np.array([v.sum()]) for v in (pos, neg, count)]
    held = np.array([m])

    def splittable(sums: list, depth: int) -> np.ndarray:
        if depth >= plan.max_depth:
            return np.zeros(len(sums[0]), dtype=bool)
        return (sums[2] >= 2 * plan.min_leaf) & (sums[0] > 0) & (sums[1] > 0)

    may = splittable(sums, depth)
    rows, node = np.arange(m), np.zeros(m, dtype=np.int64)
    while len(ids):
        feature, threshold = np.full(len(ids), -1), np.full(len(ids), np.nan)
        for c, v in (("id", ids), ("feature", feature), ("threshold", threshold), ("pos", sums[0]), ("neg", sums[1])):
            out[c].append(v)
        # Only the rows of nodes that may be split are held; ``node`` counts these nodes.
        own = np.flatnonzero(may)
        if not len(own):
            break
        total, held = [v[own] for v in sums], held[own]
        gain, tries = np.full(len(own), -np.inf), plan.order(tree, ids[own], width)
        best_f, best_rank = np.full(len(own), -1), np.zeros(len(own), dtype=np.int64)
        left_sums, left_held = [np.zeros_like(v) for v in total], np.zeros_like(held)
        for turn in range(width):
            # Nodes whose first features do not part their rows go on to the others.
            some = np.flatnonzero(best_f < 0) if turn >= plan.tried else np.arange(len(own))
            if not len(some):
                break
            mine_rows, mine = rows, node
            if len(some) < len(own):
                number = np.full(len(own), -1)
                number[some] = np.arange(len(some))
                mine = number.take(node)
                keep = mine >= 0
                mine_rows, mine = rows[keep], mine[keep]
            f = tries[some, turn]
            by = _Sorted(ranks, mine_rows, mine, f * m, held[some])
            numbers = [by.before(v, t[some]) for v, t in zip((pos, neg), total)]
            numbers.append(by.before_one() if once else by.before(count, total[2][some]))
            left, right = zip(*numbers)
            fits = by.parts & (left[2] >= plan.min_leaf) & (right[2] >= plan.min_leaf)
            found = plan.purity(left[0], left[1])
            found += plan.purity(right[0], right[1])
            found[~fits] = -np.inf
            top = np.maximum.reduceat(found, by.starts)
            better = top > gain[some]
            at = np.flatnonzero(found == by.spread(np.where(better, top, np.nan)))
            if not len(at):
                continue
            # The first best place of each node.
            place = np.searchsorted(by.ends, at, "right")
            at = at[np.concatenate(([True], place[1:] != place[:-1]))]
            here = np.flatnonzero(better)
            nodes = some[here]
            gain[nodes], best_f[nodes] = top[here], f[here]
            best_rank[nodes] = flat[f[here] * m + by.rows[at]]
            left_held[nodes] = at + 1 - by.starts[here]
            for have, v in zip(left_sums, left):
                have[nodes] = v[at]
            low = values[first_value[f[here]] + best_rank[nodes]]
            high = values[first_value[f[here]] + flat[f[here] * m + by.rows[at + 1]]]
            middle = low + (high - low) / 2
            feature[own[nodes]] = f[here]
            threshold[own[nodes]] = np.where(middle < high, middle, low)
        split = np.flatnonzero(best_f >= 0)
        if not len(split):
            break
        both = lambda a, b: np.stack([a, b], axis=1).ravel()
        sums = [both(v[split], t[split] - v[split]) for v, t in zip(left_sums, total)]
        held = both(left_held[split], held[split] - left_held[split])
        ids = both(2 * ids[own[split]] + 1, 2 * ids[own[split]] + 2)
        depth += 1
        may = splittable(sums, depth)
        # Number of the children among those that may be split, -1 for the others.
        number = np.where(may, np.cumsum(may) - 1, -1)
        child = np.full(2 * len(best_f), -1)
        child[2 * split], child[2 * split + 1] = number[::2], number[1::2]
        right = flat.take((best_f * m).take(node) + rows) > best_rank.take(node)
        node = child.take(2 * node + right)
        keep = node >= 0
        rows, node = rows[keep], node[keep]
    return {c: np.concatenate(v) for c, v in out.items()}


def _node_batch(tree: np.ndarray, found: dict) -> pa.RecordBatch:
    columns = [
        pa.array(tree.astype(np.int64)),
        pa.array(found["id"]),
        pa.array(found["feature"].astype(np.int32)),
        pa.array(found["threshold"], mask=found["feature"] < 0),
        pa.array(found["pos"].astype(np.int64)),
        pa.array(found["neg"].astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODE.split(", ")])


def _whole_nodes(staged: DataFrame, plan: Plan) -> DataFrame:
    leaf = F.col("feature") < 0
    child = lambda k: F.when(leaf, F.lit(-1)).otherwise(2 * F.col("id") + k).cast("long")
    pos = F.col("pos") * F.lit(float(plan.weights[1]))
    cover = pos + F.col("neg") * F.lit(float(plan.weights[0]))
    return staged.select(
        "tree",
        "id",
        child(1).alias("left"),
        child(2).alias("right"),
        "feature",
        "threshold",
        cover.alias("cover"),
        (pos / F.greatest(cover, F.lit(1e-300))).alias("value"),
    )


def matrix(part: pa.RecordBatch | pa.Table, name: str = "x") -> np.ndarray:
    """Rows of an array column of one length."""
    column = part.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def array_column(x: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel()))


class _Upper:
    """Splits of the large nodes: per tree, ids with feature and place of the cut."""

    def __init__(self, cuts: list[np.ndarray] = ()):
        self.cuts = cuts
        self.splits: dict[int, dict[int, tuple[int, int]]] = {}

    def add(self, tree: int, node: int, feature: int, cut: int) -> None:
        self.splits.setdefault(tree, {})[node] = (feature, cut)

    def walk(self, tree: int) -> "_Walk":
        return _Walk(self.splits.get(tree, {}))


class _Walk:
    """The large nodes of one tree and the nodes below them (the ends) as arrays."""

    def __init__(self, splits: dict[int, tuple[int, int]]):
        inner = sorted(splits)
        below = {c for i in inner for c in (2 * i + 1, 2 * i + 2)} or {0}
        self.ids = np.array(sorted({*inner, *below}), dtype=np.int64)
        place = {i: k for k, i in enumerate(self.ids.tolist())}
        self.feature, self.cut = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int16)
        # An end is its own child.
        self.child = np.repeat(np.arange(len(place)), 2)
        self.depth = 0
        for i in inner:
            k = place[i]
            self.feature[k], self.cut[k] = splits[i]
            self.child[2 * k], self.child[2 * k + 1] = place[2 * i + 2], place[2 * i + 1]
            self.depth = max(self.depth, (i + 1).bit_length())

    def ends(self, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Place among ``ids`` of the end that each of the rows reaches."""
        node = np.zeros(len(rows), dtype=np.int64)
        flat, shift = codes.ravel(), self.feature * codes.shape[1]
        for _ in range(self.depth):
            low = flat.take(shift.take(node) + rows) <= self.cut.take(node)
            node = self.child.take(2 * node + low)
        return node


class _Chunk:
    """Rows that a task works on together. ``codes`` has for each feature the number of cuts
    below the row's value."""

    def __init__(self, parts: list[pa.RecordBatch], cuts: list[np.ndarray]):
        table = pa.Table.from_batches(parts)
        self.x, self.label = matrix(table), table.column("label").to_numpy()
        self.copies = table.column("copies").to_numpy()
        self.draws = Draws(table.column("content").to_numpy(), self.copies)
        self.codes = np.empty((len(cuts), len(self.x)), dtype=np.uint8)
        for f, cut in enumerate(cuts):
            self.codes[f] = np.searchsorted(cut, self.x[:, f])


def _chunks(parts: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[_Chunk]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= CHUNK_ROWS:
            yield _Chunk(held, cuts)
            held, n = [], 0
    if n:
        yield _Chunk(held, cuts)


class _Sums:
    """Histograms (node, turn, bin, sum) of a tree's open nodes; the sums are those of the
    label-1 draws, of all draws, and of the rows."""

    def __init__(self, nodes: int, turns: int):
        self.shape = (nodes, turns, CUTS + 1, 3)
        self.cells = nodes * turns * (CUTS + 1)
        self.total = np.zeros((self.cells, 3), dtype=np.int64)
        self.together, self.held = np.zeros(self.cells), 0

    def add(self, cell: np.ndarray, label: np.ndarray, weight: np.ndarray, count: np.ndarray) -> None:
        most = int(weight.sum())
        if most >> FIELD:
            for i, v in enumerate((weight * label, weight, count)):
                self.total[:, i] += np.bincount(cell, v, self.cells).astype(np.int64)
            return
        if self.held + most >> FIELD:
            self._part()
        # Three whole numbers share one, which 53 bits hold exactly.
        value = (((weight * label) << FIELD) + weight << FIELD) + count
        self.together += np.bincount(cell, value, self.cells)
        self.held += most

    def _part(self) -> None:
        together, mask = self.together.astype(np.int64), (1 << FIELD) - 1
        for i in range(3):
            self.total[:, i] += (together >> FIELD * (2 - i)) & mask
        self.together, self.held = np.zeros(self.cells), 0

    def of_nodes(self) -> np.ndarray:
        self._part()
        return self.total.reshape(self.shape)


def _histograms(data: DataFrame, open_nodes: dict, upper: _Upper, turns: int, plan: Plan) -> DataFrame:
    """(tree, node, sums) of the rows in the open nodes of some trees, for the first features
    that a node tries; a row per node and task."""
    width = len(upper.cuts)
    walks = {t: upper.walk(t) for t in open_nodes}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {t: _Sums(len(ids), turns) for t, ids in open_nodes.items()}
        tries = {t: plan.order(t, ids, width) for t, ids in open_nodes.items()}
        for chunk in _chunks(parts, upper.cuts):
            flat, size = chunk.codes.ravel(), len(chunk.x)
            for tree, ids in open_nodes.items():
                weight = chunk.draws.of(tree, plan.seed)
                rows = np.flatnonzero(weight)
                walk = walks[tree]
                place = np.full(len(walk.ids), -1)
                place[np.searchsorted(walk.ids, ids)] = np.arange(len(ids))
                node = place.take(walk.ends(chunk.codes, rows))
                if len(ids) < len(walk.ids):
                    inside = np.flatnonzero(node >= 0)
                    rows, node = rows[inside], node[inside]
                weight = weight[rows]
                numbers = (chunk.label[rows], weight, np.minimum(weight, chunk.copies[rows]))
                for turn in range(turns):
                    code = flat.take((tries[tree][:, turn] * size).take(node) + rows)
                    total[tree].add((node * turns + turn) * (CUTS + 1) + code, *numbers)
        for tree, sums in total.items():
            found = sums.of_nodes()
            kept = np.flatnonzero(found[:, 0, :, 2].any(axis=1))
            columns = [np.full(len(kept), tree), open_nodes[tree][kept]]
            blobs = pa.array([found[k].tobytes() for k in kept], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c.astype(np.int64)) for c in columns], blobs], names=["tree", "node", "sums"]
            )

    return data.mapInArrow(batches, "tree long, node long, sums binary")


def _chosen(histograms: DataFrame, cuts: list, turns: int, plan: Plan) -> DataFrame:
    """Best split of each open node, with the class counts and the rows of both sides."""
    width = len(cuts)

    def choose(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        cells = sum(np.frombuffer(b, dtype=np.int64) for b in table.column("sums").to_pylist())
        sums = np.cumsum(cells.reshape(turns, CUTS + 1, 3), axis=1).transpose(2, 0, 1).astype(float)
        sums[1] -= sums[0]
        pos, neg, n = sums[:, 0, -1]
        best = None
        for turn, f in enumerate(plan.order(tree, np.array([node]), width)[0, :turns].tolist()):
            if turn >= plan.tried and best:
                break
            left = sums[:, turn, : len(cuts[f])]
            fits = (left[2] >= plan.min_leaf) & (n - left[2] >= plan.min_leaf)
            if fits.any() and pos and neg:
                gain = plan.purity(left[0], left[1]) + plan.purity(pos - left[0], neg - left[1])
                at = int(np.argmax(np.where(fits, gain, -np.inf)))
                if not best or gain[at] > best[0]:
                    best = (gain[at], f, at, int(left[2, at]))
        f, at, n_left = best[1:] if best else (-1, 0, 0)
        row = {"tree": tree, "node": node, "feature": f, "cut": at}
        row |= {"pos": int(pos), "neg": int(neg), "n_left": n_left, "n_right": int(n) - n_left}
        return pa.Table.from_pylist([row], schema=schema)

    names = ("tree", "node", "feature", "cut", "pos", "neg", "n_left", "n_right")
    schema = pa.schema([(c, pa.int64()) for c in names])
    return histograms.groupBy("tree", "node").applyInArrow(choose, ", ".join(f"{c} long" for c in names))


def _upper_levels(data: DataFrame, trees: int, n: int, width: int, plan: Plan, finish: int) -> tuple:
    """Splits of all nodes with more than ``finish`` rows, and those nodes."""
    made = []
    open_nodes = {t: [0] for t in range(trees)} if n > finish else {}
    if not open_nodes:
        return _Upper(), made
    # A sample of about ``SAMPLE_ROWS`` rows, by content, places the cuts; all rows are counted.
    ticket = F.pmod(F.xxhash64("content"), F.lit(1 << 40))
    sample = data.where(ticket < int(min(1.0, SAMPLE_ROWS / n) * (1 << 40))).select("x")
    rows = np.array([r["x"] for r in sample.collect()]).reshape(-1, width)
    shares = np.arange(1, CUTS + 1) / (CUTS + 1)
    cuts = [np.unique(np.quantile(rows[:, f], shares, method="lower")) for f in range(width)]
    upper, depth = _Upper(cuts), 0

    def chosen(nodes: dict[int, list], turns: int) -> list:
        found = []
        for group in _tree_groups(nodes, turns):
            ids = {t: np.array(sorted(nodes[t]), dtype=np.int64) for t in group}
            # One row per open node: at most about trees x rows / finish.
            with shuffles_removed(data.sparkSession):
                found += _chosen(_histograms(data, ids, upper, turns, plan), cuts, turns, plan).collect()
        return found

    while open_nodes and depth < plan.max_depth:
        following: dict[int, list] = {}
        tried = min(plan.tried, width)
        splits = chosen(open_nodes, tried)
        if tried < width:
            # Nodes whose first features do not part their rows go on to the others.
            whole: dict[int, list] = {}
            for r in splits:
                if r["feature"] < 0 and r["pos"] and r["neg"]:
                    whole.setdefault(r["tree"], []).append(r["node"])
            splits += chosen(whole, width)
        for r in splits:
            if r["feature"] < 0:
                continue
            threshold = float(cuts[r["feature"]][r["cut"]])
            upper.add(r["tree"], r["node"], r["feature"], r["cut"])
            made.append((r["tree"], r["node"], r["feature"], threshold, r["pos"], r["neg"]))
            for child, size in ((1, r["n_left"]), (2, r["n_right"])):
                if size > finish:
                    following.setdefault(r["tree"], []).append(2 * r["node"] + child)
        open_nodes, depth = following, depth + 1
    return upper, made


def _tree_groups(open_nodes: dict, turns: int) -> Iterator[list[int]]:
    group, cells = [], 0
    for tree, ids in sorted(open_nodes.items()):
        size = 4 * len(ids) * turns * (CUTS + 1)
        if group and cells + size > HISTOGRAM_CELLS:
            yield group
            group, cells = [], 0
        group.append(tree)
        cells += size
    if group:
        yield group


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive rows of numbers as one binary value for each of the sizes."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    ends = np.concatenate(([0], np.cumsum(sizes) * width)).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), data])


def _smallest(values: np.ndarray) -> np.ndarray:
    """As bytes where they fit."""
    return values.astype(np.uint8 if values.max() < 256 else np.int64)


def _unpacked(table: pa.Table, name: str) -> np.ndarray:
    """Numbers of ``_smallest`` from binary values; those of one chunk have one type."""
    parts = zip(table.column("rows").to_pylist(), table.column(name).to_pylist())
    kinds = {1: np.uint8, 8: np.int64}
    return np.concatenate([np.frombuffer(b, dtype=kinds[len(b) // n]).astype(np.int64) for n, b in parts])


def _finished(data: DataFrame, trees: range, n: int, upper: _Upper, plan: Plan, finish: int) -> DataFrame:
    """Nodes of ``trees`` below the upper ones: the rows of each such node meet in one task.

    The rows of a node travel as one value for each chunk that they come from.
    """
    walks = {t: upper.walk(t) for t in trees}

    def sampled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(parts, upper.cuts):
            for tree in trees:
                weight = chunk.draws.of(tree, plan.seed)
                rows = np.flatnonzero(weight)
                if not len(rows):
                    continue
                walk = walks[tree]
                end = walk.ends(chunk.codes, rows)
                if len(walk.ids) > 1:
                    # Small numbers are sorted faster.
                    small = end.astype(np.int16) if len(walk.ids) < 1 << 15 else end
                    order = np.argsort(small, kind="stable")
                    rows, end = rows[order], end[order]
                sizes = np.bincount(end, minlength=len(walk.ids))
                own = np.flatnonzero(sizes)
                columns = [
                    pa.array(np.full(len(own), tree)),
                    pa.array(walk.ids[own]),
                    pa.array(sizes[own]),
                    _packed(_smallest(chunk.label[rows]), sizes[own]),
                    _packed(_smallest(weight[rows]), sizes[own]),
                    _packed(_smallest(chunk.copies[rows]), sizes[own]),
                    _packed(chunk.x[rows], sizes[own]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def finish_tree(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        numbers = [_unpacked(table, c) for c in ("label", "weight", "copies")]
        x = np.frombuffer(b"".join(table.column("x").to_pylist())).reshape(len(numbers[0]), -1)
        found = grow(x, *numbers, tree, node, plan)
        return pa.Table.from_batches([_node_batch(np.full(len(found["id"]), tree), found)])

    spark = data.sparkSession
    cores = spark.sparkContext.defaultParallelism
    names = ["tree", "node", "rows", "label", "weight", "copies", "x"]
    kinds = [*[f"{c} long" for c in names[:3]], *[f"{c} binary" for c in names[3:]]]
    rows = data.mapInArrow(sampled, ", ".join(kinds))
    # The work follows the trees, not the bytes that adaptive execution goes by.
    tasks = max(min(len(trees), 4 * cores), n * len(trees) // max(TASK_NODES * finish, 1))
    return rows.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(finish_tree, NODE)


@dataclass
class Forest:
    """Staged nodes of ``trees`` trees over ``width`` features."""

    nodes: DataFrame
    trees: int
    width: int

    def tree_sizes(self) -> list[tuple[int, int]]:
        rows = self.nodes.groupBy("tree").count().orderBy("tree").collect()
        return [(r["tree"], r["count"]) for r in rows]

    def blocks(self, nodes: int | None = None) -> Iterator["TreeBlock"]:
        """Whole trees, about ``nodes`` nodes at a time."""
        limit = nodes or BLOCK_NODES
        first, held = None, 0
        last = None
        for tree, size in self.tree_sizes():
            if first is not None and held + size > limit:
                yield self._block(first, last)
                first, held = None, 0
            first = tree if first is None else first
            last, held = tree, held + size
        if first is not None:
            yield self._block(first, last)

    def _block(self, first: int, last: int) -> "TreeBlock":
        return TreeBlock(self.nodes.where(F.col("tree").between(first, last)).toArrow())

    def dependence(self, rows: DataFrame, grids: dict[int, list[float]], x: str = "x") -> DataFrame:
        """(feature, point, mean): mean score over ``rows`` with one feature at a grid value.

        For each feature a row goes down both sides of the feature's own splits, once. What
        it adds to a leaf counts for the grid values of the leaf's interval, so a task
        returns one number per grid value, whatever its rows.
        """
        spark, trees = rows.sparkSession, self.trees
        found = None
        for block in self.blocks():
            shared = spark.sparkContext.broadcast(block)

            def batches(parts, shared=shared):
                trees_here = shared.value
                steps = {f: np.zeros(len(grid) + 1) for f, grid in grids.items()}
                n = 0
                for part in parts:
                    values = matrix(part, x)
                    n += len(values)
                    for f, grid in grids.items():
                        visits = trees_here.visits(values, f)
                        low, high = trees_here.intervals(f)
                        leaf = np.flatnonzero(visits)
                        weight = trees_here.value[leaf] * visits[leaf]
                        np.add.at(steps[f], np.searchsorted(grid, low[leaf], "right"), weight)
                        np.subtract.at(steps[f], np.searchsorted(grid, high[leaf], "right"), weight)
                for f, step in steps.items():
                    columns = [np.full(len(step) - 1, f), np.arange(len(step) - 1)]
                    columns += [np.cumsum(step)[:-1], np.full(len(step) - 1, n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in columns], names=["feature", "point", "total", "n"]
                    )

            part = rows.select(x).mapInArrow(batches, "feature long, point long, total double, n long")
            part = part.groupBy("feature", "point").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
            found = part if found is None else found.unionByName(part)
        summed = found.groupBy("feature", "point").agg(F.sum("total").alias("total"), F.max("n").alias("n"))
        mean = F.col("total") / (F.col("n") * trees)
        return summed.where("n > 0").select("feature", "point", mean.alias("mean"))

    def add_scores(self, rows: DataFrame, x: str = "x", score: str = "score") -> DataFrame:
        """``rows`` with the mean value of the leaves that each row falls into.

        Blocks of trees are added one after the other, up to ``PASS_BLOCKS`` of them in the
        same pass over the rows; what is sent at a time is bounded by ``BLOCK_NODES``. Rows
        are staged between two passes, and the blocks of a pass that is done are dropped.
        """
        spark, trees = rows.sparkSession, self.trees
        out = rows.withColumn(score, F.lit(0.0))
        schema, names = out.schema, out.columns
        sent, last = [], None
        for block in self.blocks():
            if len(sent) == PASS_BLOCKS:
                out, path = stage_at(out, "scores")
                for done in sent:
                    done.destroy()
                if last:
                    remove_path(spark, last)
                sent, last = [], path
            shared = spark.sparkContext.broadcast(block)
            sent.append(shared)

            def batches(parts, shared=shared):
                for part in parts:
                    if part.num_rows:
                        sums = shared.value.sums(matrix(part, x)) / trees
                        sums = part.column(score).to_numpy() + sums
                        columns = [part.column(c) if c != score else pa.array(sums) for c in names]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

            out = out.mapInArrow(batches, schema)
        return out


class TreeBlock:
    """Some whole trees as arrays; a leaf is its own child."""

    def __init__(self, table: pa.Table):
        tree, ids = table.column("tree").to_numpy(), table.column("id").to_numpy()
        key = (tree << DEEPEST) + ids
        order = np.argsort(key)
        key, tree, ids = key[order], tree[order], ids[order]
        left = table.column("left").to_numpy()[order]
        right = table.column("right").to_numpy()[order]
        self.leaf = left < 0
        own = np.arange(len(key))
        find = lambda child: np.searchsorted(key, (tree << DEEPEST) + np.maximum(child, 0))
        self.left = np.where(self.leaf, own, find(left)).astype(np.int32)
        self.right = np.where(self.leaf, own, find(right)).astype(np.int32)
        self.child = np.stack([self.right, self.left], axis=1).ravel().astype(np.int64)
        self.feature = np.where(self.leaf, 0, table.column("feature").to_numpy()[order]).astype(np.int32)
        threshold = table.column("threshold").to_numpy(zero_copy_only=False)[order]
        self.threshold = np.where(self.leaf, np.inf, threshold)
        self.value = table.column("value").to_numpy()[order]
        self.roots = np.flatnonzero(ids == 0)

    def intervals(self, feature: int) -> tuple[np.ndarray, np.ndarray]:
        """Per node the values of ``feature`` that reach it: above ``low``, up to ``high``."""
        low, high = np.full(len(self.leaf), -np.inf), np.full(len(self.leaf), np.inf)
        level = self.roots[~self.leaf[self.roots]]
        while len(level):
            left, right, cut = self.left[level], self.right[level], self.threshold[level]
            own = self.feature[level] == feature
            low[left], high[right] = low[level], high[level]
            high[left] = np.where(own, np.minimum(high[level], cut), high[level])
            low[right] = np.where(own, np.maximum(low[level], cut), low[level])
            level = np.concatenate([left, right])
            level = level[~self.leaf[level]]
        return low, high

    @cached_property
    def masks(self) -> "list[_LeafMasks] | None":
        """Masks of the leaves, some trees at a time; none if a tree has many leaves."""
        ends = np.append(self.roots[1:], len(self.leaf))
        sizes = np.add.reduceat(self.leaf.astype(np.int64), self.roots) if len(self.roots) else []
        if not len(sizes) or max(sizes) > MASK_LEAVES:
            return None
        groups = (np.cumsum(sizes) - sizes) // MASK_GROUP
        leaves = [root + np.flatnonzero(self.leaf[root:end]) for root, end in zip(self.roots, ends)]
        bounds = [self.intervals(f) for f in range(int(self.feature.max()) + 1)]
        return [_LeafMasks([leaves[t] for t in np.flatnonzero(groups == g)], bounds) for g in np.unique(groups)]

    def visits(self, x: np.ndarray, feature: int) -> np.ndarray:
        """Per node the number of rows that reach it for some value of ``feature``; of inner
        nodes it may be 0."""
        out = np.zeros(len(self.leaf), dtype=np.int64)
        if self.masks is not None:
            for group in self.masks:
                group.count(out, x, feature)
            return out
        every = np.arange(len(x))
        for root in self.roots.tolist():
            rows, node = every, np.full(len(x), root, dtype=np.int32)
            while len(rows):
                done = self.leaf[node]
                if done.any():
                    np.add.at(out, node[done], 1)
                    rows, node = rows[~done], node[~done]
                both = self.feature[node] == feature
                left = both | (x[rows, self.feature[node]] <= self.threshold[node])
                right = both | ~left
                rows = np.concatenate([rows[left], rows[right]])
                node = np.concatenate([self.left[node[left]], self.right[node[right]]])
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees of the value that each row gets, tree by tree in order. A value
        that is not a number goes right."""
        out = np.zeros(len(x))
        flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
        every = np.arange(len(x)) * width
        for root in self.roots.tolist():
            end = np.full(len(x), root, dtype=np.int64)
            rows, base, node = None, every, end
            while True:
                low = flat.take(base + self.feature.take(node)) <= self.threshold.take(node)
                node = self.child.take(2 * node + low)
                inner = ~self.leaf.take(node)
                left = np.count_nonzero(inner)
                # Rows in leaves stay where they are; half of them at a time are put aside.
                if 2 * left <= len(node):
                    if rows is None:
                        end = node
                        rows = np.flatnonzero(inner)
                    else:
                        end[rows] = node
                        rows = rows[inner]
                    if not left:
                        break
                    base, node = base[inner], node[inner]
            out += self.value.take(end)
        return out


class _LeafMasks:
    """Some trees with few leaves. The cuts of a feature part its values; for each part a mask
    says which leaves of a tree a row may still reach."""

    def __init__(self, leaves: list[np.ndarray], bounds: list[tuple[np.ndarray, np.ndarray]]):
        every = np.concatenate(leaves)
        finite = lambda v: np.unique(v[np.isfinite(v)])
        self.cuts = [finite(np.concatenate([low[every], high[every]])) for low, high in bounds]
        self.trees = []
        for own in leaves:
            features = []
            for f, (low, high) in enumerate(bounds):
                cuts = finite(np.concatenate([low[own], high[own]]))
                # Place of each part of all trees' cuts among the cuts of this tree.
                place = np.concatenate(([0], np.searchsorted(cuts, self.cuts[f], "right"))).astype(np.int16)
                above = np.append(-np.inf, cuts)[:, None] >= low[own]
                upto = np.append(cuts, np.inf)[:, None] <= high[own]
                if len(cuts):
                    features.append((f, place, above & upto))
            self.trees.append((own, features))

    def _pieces(self, x: np.ndarray) -> Iterator[tuple[slice, list[np.ndarray]]]:
        for start in range(0, len(x), MASK_ROWS):
            piece = slice(start, start + MASK_ROWS)
            yield piece, [np.searchsorted(c, x[piece, f]) for f, c in enumerate(self.cuts)]

    @staticmethod
    def _reached(features: list, parts: list[np.ndarray], without: int) -> np.ndarray | None:
        """Rows x leaves: the leaves that a row may reach whatever the feature ``without``."""
        found = None
        for f, place, masks in features:
            if f != without:
                mask = masks.take(place.take(parts[f]), axis=0)
                found = mask if found is None else np.logical_and(found, mask, out=found)
        return found

    def count(self, out: np.ndarray, x: np.ndarray, feature: int) -> None:
        for piece, parts in self._pieces(x):
            for leaves, features in self.trees:
                found = self._reached(features, parts, feature)
                if found is None:
                    out[leaves] += len(x[piece])
                    continue
                # Sums of bytes do not overflow in 255 rows.
                steps = range(0, len(found), 255)
                bytes_ = found.view(np.uint8)
                out[leaves] += sum(np.add.reduce(bytes_[i : i + 255], axis=0, dtype=np.uint8).astype(np.int64) for i in steps)


def grow_forest(
    rows: DataFrame,
    trees: int = 400,
    max_depth: int = 30,
    min_leaf: int = 2,
    tried: int | None = None,
    seed: int = 42,
    finish: int = FINISH_ROWS,
) -> Forest:
    """Forest over ``rows`` (``label``: 0 or 1, ``x``: finite numbers of one length), which
    hold both labels. The classes weigh the same in all. ``tried`` features are tried per
    node, the root of their number by default."""
    if not 0 < max_depth <= DEEPEST - 2:
        raise ValueError(f"max_depth must be 1 to {DEEPEST - 2}")
    spark: SparkSession = rows.sparkSession
    counted = rows.groupBy(F.col("label").cast("long").alias("label"), "x").agg(
        F.count("*").alias("copies")
    )
    # 0.0 and -0.0 are one value.
    content = F.xxhash64("label", F.transform("x", lambda v: v + F.lit(0.0)))
    cores = spark.sparkContext.defaultParallelism
    spread = counted.withColumn("content", content).repartition(
        max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), "content"
    )
    data = stage(spread, "forest-rows")
    found = data.groupBy("label").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    by_label = {r["label"]: r for r in found.collect()}
    width = data.select(F.size("x")).first()[0]
    total = sum(r["copies"] for r in by_label.values())
    weights = tuple(total / (2 * by_label[k]["copies"]) for k in (0, 1))
    plan = Plan(seed, tried or max(1, int(width**0.5)), max_depth, min_leaf, weights)
    n = sum(r["n"] for r in by_label.values())
    upper, made = _upper_levels(data, trees, n, width, plan, finish)
    # A sample of all rows per tree is far more than the input, so only the samples of some
    # trees are on disk at a time.
    at_once = max(1, GROUP_ROWS // n)
    paths = []

    def write(nodes: DataFrame) -> None:
        paths.append(staging_path(spark, "forest"))
        with shuffles_removed(spark):
            nodes.write.option("compression", "zstd").parquet(paths[-1])

    for first in range(0, trees, at_once):
        group = range(first, min(first + at_once, trees))
        write(_finished(data, group, n, upper, plan, finish))
    if made:
        columns = ("tree", "id", "feature", "threshold", "pos", "neg")
        parts = dict(zip(columns, map(np.array, zip(*made))))
        batch = _node_batch(parts.pop("tree"), parts)
        write(spark.createDataFrame(batch.to_pandas(), NODE))
    nodes = spark.read.schema(NODE).parquet(*paths)
    return Forest(_whole_nodes(nodes, plan), trees, width)
