"""Prefix trie of conversations, as balanced parentheses per shard.

A node is a distinct sequence of first turns; its members are the conversations that start
with it. A conversation becomes a path: one 16-byte hash for each number of first turns.
Equal paths are counted first, so copies cost nothing further. The paths are sorted and cut
into shards of bounded size. In a shard each path closes what it does not share with the
path before and opens what is new: that sequence of parentheses is the shard's trie. The
close of a node delimits its subtree; the rank of ``()`` counts leaves, running sums give
members and savings, and a range minimum the smallest member.

Nodes on the first and the last path of a shard (its spines) may go on in another shard, all
others are complete. A spine node keeps what hangs off it inside the shard, and the spines
are paths again, two a shard: they are sorted, cut and joined in the same way until one
shard is left, so no task holds more than a shard.

The first ids of a node's ends are hashed as a list. Ids are sorted over the cluster, joined
in pieces of bounded size, and the pieces of a node are hashed in order.

Rows without a conversation id belong to no conversation. Turns are sorted by their number,
nulls first, and turns of one number by hash; repeated rows are turns like any others. A
null role or text is empty. A conversation is one value of 20 bytes a turn, so the hashes
(not the texts) of one conversation meet in one task. An empty table has no nodes.
"""

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.parens import Parens, range_min
from creditloom.operators.joins import lookup_join
from creditloom.staging import stage

DIGEST = 16
#: Nodes of the paths that a shard takes in, and paths that it has at least.
SHARD_NODES = 1 << 18
SHARD_PATHS = 16
#: Characters of joined ids that travel as one piece.
PIECE_CHARS = 1 << 14
NO_MEMBER = np.iinfo(np.int64).max

NODE = (
    "key binary, parent_key binary, depth long, first {id}, parent_first {id}, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
OWN = "len long, convs long, first {id}, children long, leaves long, saved long, ends string"


def turn_hash(role: Column, text: Column) -> Column:
    """Hash of a turn; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def gather_turns(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(id, turns): per conversation its turns in order, each as ``hash`` and ``len``."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv, turn, role, text))
    one = F.struct(
        turn.alias("turn"),
        F.unhex(turn_hash(role, text)).alias("hash"),
        F.coalesce(F.length(text), F.lit(0)).alias("len"),
    )
    found = rows.where(conv.isNotNull()).select(conv.alias("id"), one.alias("one"))
    ordered = F.sort_array(F.collect_list("one"))
    slim = F.transform(ordered, lambda t: F.struct(t["hash"].alias("hash"), t["len"].alias("len")))
    return found.groupBy("id").agg(slim.alias("turns"))


def _paths(convs: DataFrame, id_type: str) -> DataFrame:
    """(id, digest, path, lens): a path starts with the root, whose hash is all zero."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for part in parts:
            turns = part.column("turns")
            bounds = turns.offsets.to_pylist()
            turns = turns.values
            hashes, lens = turns.field("hash").to_pylist(), turns.field("len").to_pylist()
            digests, paths, sizes = [], [], []
            for start, end in pairwise(bounds):
                chain = [bytes(DIGEST)]
                for h in hashes[start:end]:
                    chain.append(md5(chain[-1] + h).digest())
                digests.append(chain[-1])
                paths.append(b"".join(chain))
                sizes.append([0, *lens[start:end]])
            columns = [
                part.column("id"),
                pa.array(digests, pa.binary()),
                pa.array(paths, pa.binary()),
                pa.array(sizes, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "path", "lens"])

    filled = convs.select("id", F.coalesce("turns", F.array()).alias("turns"))
    return filled.mapInArrow(
        batches, f"id {id_type}, digest binary, path binary, lens array<int>"
    )


def _distinct_paths(paths: DataFrame, id_type: str) -> DataFrame:
    """(path, lens, n, first, ends): each path once, with the number, the smallest and the
    hash of the ids that end there."""

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            digests = part.column("digest").to_pylist()
            ids, names = part.column("id"), part.column("name").to_pylist()
            starts, n, chars, texts = [], [], 0, []
            for i, digest in enumerate(digests):
                if not i or digest != digests[i - 1] or chars > PIECE_CHARS:
                    starts.append(i)
                    chars = 0
                chars += len(names[i])
            for start, end in pairwise([*starts, len(digests)]):
                texts.append(",".join(names[start:end]))
                n.append(end - start)
            at = pa.array(starts, pa.int64())
            columns = [part.column("digest").take(at), ids.take(at), pa.array(n, pa.int64())]
            columns += [pa.array(texts, pa.string())]
            columns += [part.column("path").take(at), part.column("lens").take(at)]
            yield pa.RecordBatch.from_arrays(
                columns, names=["digest", "id", "n", "text", "path", "lens"]
            )

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        last, row, n, sha = None, None, 0, None
        for part in parts:
            done = []
            digests, counts = part.column("digest").to_pylist(), part.column("n").to_pylist()
            texts = part.column("text").to_pylist()
            for i, digest in enumerate(digests):
                if digest != last:
                    if last is not None:
                        done.append((row, n, sha.hexdigest()))
                    row = part.select(["path", "lens", "id"]).slice(i, 1)
                    last, n, sha = digest, 0, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(texts[i].encode())
                n += counts[i]
            schema = part.schema
            if done:
                yield whole(done)
            if row is not None:  # do not keep the whole batch for one row of it
                row = row.take(pa.array([0]))
        if schema is not None and last is not None:
            yield whole([(row, n, sha.hexdigest())])

    def whole(done: list) -> pa.RecordBatch:
        table = pa.Table.from_batches([d[0] for d in done]).combine_chunks()
        columns = [table.column(c).chunk(0) for c in ("path", "lens", "id")]
        columns += [pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done])]
        return pa.RecordBatch.from_arrays(columns, names=["path", "lens", "first", "n", "ends"])

    piece = f"digest binary, id {id_type}, n long, text string, path binary, lens array<int>"
    cut = (
        paths.withColumn("name", F.col("id").cast("string"))
        .repartitionByRange("digest", "id")
        .sortWithinPartitions("digest", "id")
        .select("digest", "id", "name", "path", "lens")
        .mapInArrow(pieces, piece)
    )
    return (
        cut.repartition("digest")
        .sortWithinPartitions("digest", "id")
        .mapInArrow(hashed, f"path binary, lens array<int>, first {id_type}, n long, ends string")
    )


class _Shard:
    """Trie of some sorted paths. ``own``: per element of a path what it adds to its node."""

    def __init__(self, table: pa.Table):
        path = table.column("path").combine_chunks()
        path = path.chunk(0) if isinstance(path, pa.ChunkedArray) else path
        offsets = np.frombuffer(path.buffers()[1], dtype=np.int32)
        offsets = offsets[path.offset : path.offset + len(path) + 1].astype(np.int64)
        data = np.frombuffer(path.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.bounds = (offsets - offsets[0]) // DIGEST
        self.digests = data.view(f"V{DIGEST}")
        words = data.view("<u8").reshape(-1, 2)
        size = np.diff(self.bounds)
        depth = np.arange(len(words)) - np.repeat(self.bounds[:-1], size)
        # An element is known if the path before has the same one at its depth.
        other = np.arange(len(words)) - np.repeat(np.concatenate(([0], size[:-1])), size)
        known = depth < np.repeat(np.concatenate(([0], size[:-1])), size)
        known[known] = (words[known] == words[other[known]]).all(axis=1)
        self.new = np.flatnonzero(~known)
        self.depth = depth[self.new]
        # The node of an element is the last new one of its depth.
        order = np.lexsort((np.arange(len(words)), depth))
        rank = np.cumsum(~known) - 1
        latest = np.maximum.accumulate(np.where(known[order], 0, np.arange(len(words))))
        self.node = np.empty(len(words), dtype=np.int64)
        self.node[order] = rank[order[latest]]
        self.parent = np.where(self.depth > 0, self.node[np.maximum(self.new - 1, 0)], -1)
        opened = np.bincount(np.searchsorted(self.bounds, self.new, "right") - 1, minlength=len(size))
        closed = np.concatenate(([0], size[:-1] - (size - opened)[1:], size[-1:]))
        runs = np.stack([closed, np.append(opened, 0)], axis=1).ravel()
        self.parens = Parens(np.repeat(np.tile([False, True], len(size) + 1), runs))

    def load(self, own: dict[str, np.ndarray], first: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.new)
        self.own = {}
        for name in ("convs", "children", "leaves", "saved"):
            self.own[name] = np.zeros(n, dtype=np.int64)
            np.add.at(self.own[name], self.node, own[name])
        self.own["first"] = np.full(n, NO_MEMBER)
        np.minimum.at(self.own["first"], self.node, first)
        self.ends = np.full(n, -1)
        np.maximum.at(self.ends, self.node, ends)
        self.len = own["len"][self.new]

    def totals(self) -> dict[str, np.ndarray]:
        """Values over the whole subtree of each node, from cumulative arrays."""
        at = np.flatnonzero(self.parens.opens)
        close = self.parens.find_close(at)
        start = np.arange(len(at))
        end = start + (close - at + 1) // 2

        def over(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(values)))
            return sums[end] - sums[start]

        convs = over(self.own["convs"])
        # ``()`` is a leaf unless children hang off it that are not in this trie.
        childless = (close == at + 1) & (self.own["children"] > 0)
        leaves = self.parens.leaf_pairs(at, close) - over(childless) + over(self.own["leaves"])
        children = self.own["children"] + np.bincount(
            self.parent[self.parent >= 0], minlength=len(at)
        )
        saved = over((convs - 1) * self.len + self.own["saved"])
        first = range_min(self.own["first"], start, end)
        return {"convs": convs, "children": children, "leaves": leaves, "saved": saved, "first": first}

    def spine(self) -> np.ndarray:
        """Marks the nodes on the first and the last path."""
        marks = np.zeros(len(self.new), dtype=bool)
        marks[self.node[self.bounds[0] : self.bounds[1]]] = True
        marks[self.node[self.bounds[-2] : self.bounds[-1]]] = True
        return marks


def _binary(values: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(np.arange(len(values) + 1, dtype=np.int32) * DIGEST)
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(values), [None, offsets, data])


def _ranked(ids: list) -> tuple[list, np.ndarray]:
    """Sorted distinct ids, and the place of each id; None gets ``NO_MEMBER``."""
    names = sorted({i for i in ids if i is not None})
    place = {name: k for k, name in enumerate(names)}
    ranks = np.fromiter((place.get(i, NO_MEMBER) for i in ids), np.int64, len(ids))
    return names, ranks


def _loaded(table: pa.Table) -> tuple[_Shard, list, list]:
    """Shard with its values, the ids by rank and the hashes of ends."""
    shard = _Shard(table)
    n = int(shard.bounds[-1])
    if "own" in table.column_names:
        values = table.column("own").combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        values = values.flatten()
        number = lambda c: values.field(c).to_numpy(zero_copy_only=False)
        own = {c: number(c) for c in ("len", "convs", "children", "leaves", "saved")}
        ids, first = _ranked(values.field("first").to_pylist())
        hashes = values.field("ends").to_pylist()
        ends = np.fromiter((i if h else -1 for i, h in enumerate(hashes)), np.int64, n)
    else:
        last = shard.bounds[1:] - 1
        own = {c: np.zeros(n, dtype=np.int64) for c in ("convs", "children", "leaves", "saved")}
        own["convs"][last] = table.column("n").to_numpy()
        lens = table.column("lens").combine_chunks()
        lens = lens.chunk(0) if isinstance(lens, pa.ChunkedArray) else lens
        own["len"] = lens.flatten().to_numpy().astype(np.int64)
        ids, ranks = _ranked(table.column("first").to_pylist())
        first, ends = np.full(n, NO_MEMBER), np.full(n, -1)
        first[last], ends[last] = ranks, np.arange(len(last))
        hashes = table.column("ends").to_pylist()
    shard.load(own, first, ends)
    return shard, ids, hashes


def _nodes(shard: _Shard, total: dict, keep: np.ndarray, whole: np.ndarray, ids, hashes, kind):
    """Complete nodes as a struct array; ``whole`` marks the nodes that are complete."""
    digests = shard.digests[shard.new]
    parent = shard.parent[keep]
    has = parent >= 0
    known = has & whole[np.maximum(parent, 0)]
    keys = _binary(digests[keep])
    parents = _binary(digests[np.maximum(parent, 0)])
    names = [*ids, None]
    first = lambda rows: pa.array([names[i] for i in np.minimum(total["first"][rows], len(ids))], kind)
    none = pa.scalar(None)
    empty = hashlib.sha256().hexdigest()
    chosen = shard.ends[keep].tolist()
    fields = {
        "key": keys,
        "parent_key": pc.if_else(pa.array(has), parents, none.cast(pa.binary())),
        "depth": pa.array(shard.depth[keep]),
        "first": first(keep),
        "parent_first": pc.if_else(
            pa.array(known), first(np.maximum(parent, 0)), none.cast(kind)
        ),
        "n_convs": pa.array(total["convs"][keep]),
        "n_children": pa.array(total["children"][keep]),
        "n_leaves": pa.array(total["leaves"][keep]),
        "saved_tokens": pa.array(total["saved"][keep]),
        "ends_sha256": pa.array([hashes[i] if i >= 0 else empty for i in chosen], pa.string()),
    }
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


def _spines(shard: _Shard, total: dict, marks: np.ndarray, ids, hashes, kind) -> tuple:
    """Paths of the two spines, and what each of their nodes has of its own.

    A node of both spines counts once: the second path has zeros there.
    """
    own = {c: v.copy() for c, v in shard.own.items()}
    inside = np.flatnonzero(~marks & marks[np.maximum(shard.parent, 0)])
    above = shard.parent[inside]
    for c in ("convs", "leaves", "saved"):
        np.add.at(own[c], above, total[c][inside])
    np.add.at(own["children"], above, 1)
    np.minimum.at(own["first"], above, total["first"][inside])
    seen = np.zeros(len(marks), dtype=bool)
    paths, values = [], []
    for i in sorted({0, len(shard.bounds) - 2}):
        rows = slice(shard.bounds[i], shard.bounds[i + 1])
        paths.append(shard.digests[rows].tobytes())
        nodes = shard.node[rows]
        fresh = ~seen[nodes]
        seen[nodes] = True
        number = lambda c: np.where(fresh, own[c][nodes], 0)  # noqa: B023, E731
        first = [
            ids[k] if f and k < NO_MEMBER else None
            for f, k in zip(fresh.tolist(), own["first"][nodes].tolist(), strict=True)
        ]
        ends = [
            hashes[k] if f and k >= 0 else None
            for f, k in zip(fresh.tolist(), shard.ends[nodes].tolist(), strict=True)
        ]
        fields = {
            "len": pa.array(shard.len[nodes]),
            "convs": pa.array(number("convs")),
            "first": pa.array(first, kind),
            "children": pa.array(number("children")),
            "leaves": pa.array(number("leaves")),
            "saved": pa.array(number("saved")),
            "ends": pa.array(ends, pa.string()),
        }
        values.append(pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
    return paths, values


def _shards(limit: int, least: int) -> Callable:
    """Cuts sorted batches into tables with about ``limit`` nodes in their paths."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, nodes, rows = [], 0, 0
        for part in parts:
            start = 0
            sizes = np.asarray(pc.binary_length(part.column("path"))) // DIGEST
            for i, size in enumerate(sizes.tolist()):
                if rows >= least and nodes + size > limit:
                    held.append(part.slice(start, i - start))
                    yield pa.Table.from_batches(held)
                    held, nodes, rows, start = [], 0, 0, i
                nodes, rows = nodes + size, rows + 1
            held.append(part.slice(start))
        if rows:
            yield pa.Table.from_batches(held)

    return cut


def _joined(paths: DataFrame, id_type: str, limit: int, least: int, last: bool) -> DataFrame:
    """Shards of sorted ``paths``: complete nodes in ``node``, spines in ``spine``."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _shards(np.iinfo(np.int64).max if last else limit, least)
        for table in cut(parts):
            kind = table.schema.field("first").type if "first" in table.column_names else None
            kind = kind or table.schema.field("own").type.value_type.field("first").type
            shard, ids, hashes = _loaded(table)
            total = shard.totals()
            marks = np.zeros(len(shard.new), dtype=bool) if last else shard.spine()
            node = _nodes(shard, total, np.flatnonzero(~marks), ~marks, ids, hashes, kind)
            paths, own = ([], []) if last else _spines(shard, total, marks, ids, hashes, kind)
            spine = [
                pa.array([None] * len(node) + paths, pa.binary()),
                pa.array([None] * len(node) + [o.to_pylist() for o in own], _own_type(kind)),
            ]
            node = pa.concat_arrays([node, pa.nulls(len(paths), node.type)])
            for i in range(0, len(node), 1 << 15):
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, 1 << 15) for c in (node, *spine)], names=["node", "path", "own"]
                )

    node, own = NODE.format(id=id_type), OWN.format(id=id_type)
    typed = lambda spec: ", ".join(p.replace(" ", ": ", 1) for p in spec.split(", "))
    schema = f"node struct<{typed(node)}>, path binary, own array<struct<{typed(own)}>>"
    return paths.sortWithinPartitions("path").mapInArrow(batches, schema)


def _own_type(kind: pa.DataType) -> pa.DataType:
    long = pa.int64()
    names = ("len", "convs", "first", "children", "leaves", "saved", "ends")
    kinds = (long, long, kind, long, long, long, pa.string())
    return pa.list_(pa.struct(list(zip(names, kinds, strict=True))))


def prefix_trie(
    convs: DataFrame, shard_nodes: int = SHARD_NODES, shard_paths: int = SHARD_PATHS
) -> DataFrame:
    """One row per node of the trie of ``convs`` (id, turns; ids are distinct).

    ``key`` and ``parent_key`` name nodes; ``first`` and ``parent_first`` are the smallest
    members of the node and of its parent; ``n_leaves`` and ``saved_tokens`` are over the
    subtree; ``ends_sha256`` hashes the ids that end at the node, ascending, comma-joined.
    """
    id_type = convs.schema["id"].dataType.simpleString()
    paths = stage(_paths(convs, id_type), "paths")
    level = stage(_distinct_paths(paths, id_type), "distinct-paths")
    done, spine_nodes, before = None, None, None
    shards = level.repartitionByRange("path")
    while True:
        out = stage(_joined(shards, id_type, shard_nodes, shard_paths, last=False), "trie")
        nodes = out.where("node IS NOT NULL").select("node.*")
        if done is None:
            done = nodes
        else:  # these were on a spine one level below
            spine_nodes = nodes if spine_nodes is None else spine_nodes.unionByName(nodes)
        spines = out.where("path IS NOT NULL").select("path", "own")
        size = spines.agg(F.count("*").alias("n"), F.sum(F.size("own")).alias("nodes")).first()
        parts = min(-(-(size["nodes"] or 0) // shard_nodes), size["n"] // (2 * shard_paths))
        # Each shard takes in ``shard_paths`` paths at least and leaves two.
        if parts <= 1 or (before is not None and size["n"] > 0.75 * before):
            break
        before = size["n"]
        shards = spines.repartitionByRange(parts, "path")
    top = stage(_joined(spines.coalesce(1), id_type, shard_nodes, shard_paths, last=True), "top")
    top = top.select("node.*")
    if spine_nodes is not None:
        top = top.unionByName(spine_nodes)
    # Children of nodes that were on a spine learn their parent's smallest member now.
    names = top.select(F.col("key").alias("parent_key"), F.col("first").alias("name"))
    every = done.unionByName(top)
    open_end = F.col("parent_first").isNull() & F.col("parent_key").isNotNull()
    late = lookup_join(every.where(open_end), names, ["parent_key"])
    late = late.withColumn("parent_first", F.col("name")).select(*top.columns)
    return every.where(~open_end).unionByName(late)
