"""SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint of 64 bits sums the signs of the hashes of a text's word shingles. Two
fingerprints link when at most ``max_bits`` bits differ. The fingerprint is cut into so
few segments that one of them differs by at most one bit; each segment is indexed as it
is and once per bit with that bit taken out, and the index is joined on equal keys.

Equal fingerprints are one node from the start, so copies cost nothing further. Small
buckets are compared inside; in a large bucket the rest of the fingerprint is indexed
with its differing bits taken out, which leaves groups of at most 2 ** max_bits values.
Work is linear in the number of fingerprints however large a bucket is.

Nulls and empty texts have fingerprint zero and link like any other. Rows without an id
take part; they never give their group its name unless the whole group has no id (then
the name is null). Repeated ids are allowed: each row has its own fingerprint.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.graph import connected_components
from creditloom.llm.rows import row_hash
from creditloom.llm.words import split_words, text_slices
from creditloom.staging import stage

BITS = 64
SEED = 42
#: Buckets up to this many fingerprints are compared inside; larger ones are indexed again.
COMPARED = 64


def _signs() -> np.ndarray:
    """For each value of a byte, its bits from the lowest up."""
    return (np.arange(256)[:, None] >> np.arange(8)) & 1


_BYTE_BITS = _signs()
_BYTE_PLACE = (np.arange(8) * 256)[None, :]


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Fingerprint of one text as a signed 64-bit number."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1 :]
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), last.tolist(), strict=True)
    hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
    cells = hashes.view(np.uint8).reshape(n, 8) + _BYTE_PLACE
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = np.packbits((2 * counts.ravel() > n), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str, shingle: int = 3) -> DataFrame:
    """All columns of ``docs`` but the text, as struct ``row``, and its ``fingerprint``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.zeros(part.num_rows, dtype=np.int64)
            for at, texts in text_slices(part.column("text")):
                w = split_words(texts, lower=True)
                data, bounds = w.data.tobytes(), w.text_bounds.tolist()
                for i in range(len(texts)):
                    words = data[bounds[i] : bounds[i + 1]].split()
                    found[at + i] = fingerprint(words, shingle)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(found)], names=["row", "fingerprint"]
            )

    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(batches, f"row {kind}, fingerprint long")


def _bit_mask(bits) -> int:
    """Signed 64-bit number with the given bits set."""
    mask = sum(1 << b for b in bits)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _segments(max_bits: int) -> list[range]:
    n = max_bits // 2 + 1
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [range(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _variants(max_bits: int) -> list[tuple[int, int, int]]:
    """(number, mask of the bits kept, bits taken out) of each signature.

    With an even ``max_bits`` two segments differ by at most one bit unless one does not
    differ at all, so one segment needs no variants with a bit taken out.
    """
    out: list[tuple[int, int]] = []
    parts = _segments(max_bits)
    for i, part in enumerate(parts):
        out.append((_bit_mask(part), 0))
        if max_bits > 0 and (i < len(parts) - 1 or max_bits % 2):
            out += [(_bit_mask(b for b in part if b != gone), 1) for gone in part]
    return [(i, mask, gone) for i, (mask, gone) in enumerate(out)]


def _index(nodes: DataFrame, max_bits: int) -> DataFrame:
    """One row per fingerprint and signature: (tag, key, fingerprint)."""
    made = [
        F.struct(F.lit(i).alias("tag"), F.col("fingerprint").bitwiseAND(F.lit(mask)).alias("key"))
        for i, mask, _ in _variants(max_bits)
    ]
    return nodes.select("fingerprint", F.explode(F.array(*made)).alias("s")).select(
        "s.tag", "s.key", "fingerprint"
    )


def _pairs_inside(members: Column, max_bits: int) -> Column:
    """Links among the members of a small bucket."""

    def partners(x: Column) -> Column:
        near = F.filter(
            members, lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= F.lit(max_bits))
        )
        return F.transform(near, lambda y: F.struct(x.alias("a"), y.alias("b")))

    return F.flatten(F.transform(members, partners))


def _links_of_large(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links in large buckets: the bits outside of the signature are taken out in turn."""
    found = None
    for i, mask, gone in _variants(max_bits):
        inside = {b for b in range(BITS) if mask >> b & 1}
        wild = set(_segment_of(inside, max_bits)) - inside
        others = sorted(set(range(BITS)) - inside - wild)
        masks = [_bit_mask({*c, *wild}) for c in combinations(others, max_bits - gone)]
        keys = F.explode(F.array(*[F.lit(m) for m in masks])).alias("free")
        part = rows.where(F.col("tag") == i).select("tag", "key", "fingerprint", keys)
        found = part if found is None else found.union(part)
    rest = F.col("fingerprint").bitwiseAND(F.bitwise_not("free"))
    # A group shares all bits but the max_bits that are free: it is bounded.
    groups = (
        found.withColumn("rest", rest)
        .groupBy("tag", "key", "free", "rest")
        .agg(F.collect_set("fingerprint").alias("members"))
        .where(F.size("members") > 1)
    )
    return groups.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where(
        "a != b"
    )


def _segment_of(inside: set[int], max_bits: int) -> range:
    return next(part for part in _segments(max_bits) if inside & set(part))


def _shared_signatures(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Rows of the index whose signature others have too, with the number ``n`` of these."""
    index = _index(nodes, max_bits)
    sizes = index.groupBy("tag", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the index to be no larger than ``nodes`` and would broadcast it.
    return index.hint("merge").join(sizes, ["tag", "key"])


def links(nodes: DataFrame, max_bits: int = 2, compared: int = COMPARED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    shared = stage(_shared_signatures(nodes, max_bits), "signatures")
    small = (
        shared.where(F.col("n") <= compared)
        .groupBy("tag", "key")
        .agg(F.collect_list("fingerprint").alias("members"))
        .select(F.explode(_pairs_inside(F.col("members"), max_bits)).alias("e"))
        .select("e.a", "e.b")
    )
    large = shared.where(F.col("n") > compared)
    if large.isEmpty():
        return small
    return small.union(_links_of_large(large, max_bits))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
    compared: int = COMPARED,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all columns but the text), ``fingerprint``,
    ``root`` (a fingerprint that stands for the group) and ``component``, the smallest id
    of the group that the row belongs to."""
    marked = stage(with_fingerprint(docs, text, shingle), "fingerprints")
    name = F.col("row").getField(doc_id)
    nodes = stage(marked.groupBy("fingerprint").agg(F.min(name).alias("first")), "nodes")
    roots = connected_components(links(nodes.select("fingerprint"), max_bits, compared))
    rooted = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = stage(rooted, "roots")
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(names, "root").select("fingerprint", "root", "component")
    return marked.join(named, "fingerprint").select("row", "fingerprint", "root", "component")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings
) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near-duplicates.

    The row with the smallest id stays (rows without an id come last), among rows of one
    id the one whose content has the smallest hash; of equal rows one.
    """
    content = row_hash(docs)
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("id"), content.alias("content"), F.col(f"`{text}`").alias("text")
    )
    found = stage(near_duplicates(slim, "id", "text", **settings), "groups").select(
        F.col("row.id").alias("id"), F.col("row.content").alias("content"), "root"
    )
    order = F.struct(F.col("id").isNull().alias("none"), "id", "content")
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    best = stage(best.select("best.id", "best.content"), "keepers")
    kept = (
        docs.withColumn("__content", content)
        .alias("d")
        .join(
            best.alias("k"),
            F.col(f"d.`{doc_id}`").eqNullSafe(F.col("k.id"))
            & (F.col("d.__content") == F.col("k.content")),
            "left_semi",
        )
    )
    twice = found.groupBy("id", "content").count().where("count > 1")
    keeper_twice = twice.join(
        best.alias("k"),
        twice["id"].eqNullSafe(F.col("k.id")) & (twice["content"] == F.col("k.content")),
        "left_semi",
    )
    if not keeper_twice.isEmpty():
        kept = kept.dropDuplicates([doc_id, "__content"])
    return kept.drop("__content")
