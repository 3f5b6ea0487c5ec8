"""Repeated passages from a sparse suffix array.

Of all suffixes (by words) of all texts those are retained that start at a minimiser: of the
first ``span`` word groups of a passage of ``length`` words, the leftmost one with the
smallest hash. It depends on the passage alone, so two texts that share a passage have
suffixes that agree in the ``length - span + 1`` words (the head) after it. A retained suffix
carries the hashes of the passages that it stands for, which lie up to ``span - 1`` words to
the left of it and reach as far to the right. Suffixes are sorted over the cluster by head;
those that agree are extended to both sides by the hashes of their passages. Longer passages
are put together from the matches at their several minimisers.

All suffixes of a head meet in one task if they are at most ``TOGETHER``. Of more frequent
heads, suffixes with the same passages become one class with a count and its first and last
place, and the passages of the classes are counted by their hash. So a passage in a third of
all texts is spread over many tasks and costs as much as one copy of it, and every match is
by the 64-bit hash of the whole passage. Both ways give the same rows.

All places of a repeated passage are reported. Each names the document of the first place of
the passage (by id, text hash and word), and the first place that of the last one. Nulls and empty texts have
none. Rows with the same id count as parts of one document, placed by a hash of their text;
equal rows repeat each other. Rows without an id take part like others.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.words import split_words, starts_within, text_slices, window_hashes
from creditloom.staging import stage

LENGTH = 50
SPAN = 28
GROUP = 6
#: Suffixes of one head that meet in one task; those of more frequent heads are spread.
TOGETHER = 1_000
#: Frequent heads that are broadcast. If there are more, the least frequent of them meet in
#: one task each; such a head has at most this share of the suffixes.
BROADCAST_HEADS = 1_000_000
SUFFIX = "head long, id long, part long, first int, windows binary"
MATCH = "id long, part long, first int, last int, other long"
PLACE = "id: bigint, part: bigint, at: int"
PASSAGE = f"key long, class long, number int, n long, low struct<{PLACE}>, high struct<{PLACE}>"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (of equals the leftmost) of each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        at = better(at[:-span], at[span:])
        span *= 2
    return better(at[:n], at[width - span : width - span + n])


def retained(
    hashes: np.ndarray, bounds: np.ndarray, length: int, span: int, group: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all passages, and of each retained suffix the start and the number of its
    first passage. The passages of a suffix follow each other."""
    lowest = leftmost_smallest(window_hashes(hashes, group), span)
    starts = np.flatnonzero(starts_within(bounds, len(hashes), length)[: len(lowest)])
    places = lowest[starts]
    fresh = np.ones(len(places), dtype=bool)
    fresh[1:] = places[1:] != places[:-1]
    numbers = np.flatnonzero(fresh)
    return starts, places[numbers], numbers


def _head_counts(length: int, span: int, group: int) -> Callable:
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, texts in text_slices(part.column("text")):
                w = split_words(texts)
                hashes = w.hashes()
                _, places, _ = retained(hashes, w.bounds, length, span, group)
                heads = window_hashes(hashes, length - span + 1)[places]
                heads, counts = np.unique(heads, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(heads.view(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["head", "n"],
                )

    return rows


def _suffix_rows(length: int, span: int, group: int) -> Callable:
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, texts in text_slices(part.column("text")):
                w = split_words(texts)
                hashes = w.hashes()
                starts, places, numbers = retained(hashes, w.bounds, length, span, group)
                windows = window_hashes(hashes, length)[starts]
                ends = (np.append(numbers, len(starts)) * 8).astype(np.int32)
                blobs = [None, pa.py_buffer(ends), pa.py_buffer(windows)]
                firsts = starts[numbers]
                owner = w.owner[firsts]
                docs = pa.array(at + owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(window_hashes(hashes, length - span + 1)[places].view(np.int64)),
                        part.column("id").take(docs),
                        part.column("part").take(docs),
                        pa.array((firsts - w.bounds[:-1][owner]).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(numbers), blobs),
                    ],
                    names=_names(SUFFIX),
                )

    return rows


def _windows(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every passage of some suffixes, its suffix and its number there."""
    blobs = rows.column("windows").to_pylist()
    keys = np.frombuffer(b"".join(blobs), dtype=np.uint64)
    counts = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 8
    before = np.cumsum(counts) - counts
    return keys, np.repeat(np.arange(len(blobs)), counts), np.arange(len(keys)) - np.repeat(before, counts)


def _passages(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Repeated passages around the suffixes of a batch with whole heads, sorted by head.

    The passages of a suffix all hold its head, so they overlap: of those that are found again
    the one furthest to the left and the one furthest to the right make up the match.
    """
    heads = np.asarray(batch.column("head"))
    close = np.zeros(len(heads), dtype=bool)
    close[1:] |= heads[1:] == heads[:-1]
    close[:-1] |= heads[1:] == heads[:-1]
    mine = batch.filter(pa.array(close))
    keys, row, number = _windows(mine)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]])[: len(keys)])
    sizes = np.diff(np.append(starts, len(keys)))
    several = np.repeat(sizes > 1, sizes)
    one = order[several]
    low = np.repeat(order[starts], sizes)[several]
    high = np.repeat(order[starts + sizes - 1], sizes)[several]
    # Equal rows have one place.
    place = _place_numbers(mine)
    two = np.where(place[row[one]] == place[row[low]], high, low)
    by_place = np.lexsort((number[one], row[one]))
    one, two = one[by_place], two[by_place]
    fresh = np.ones(len(one), dtype=bool)
    fresh[1:] = row[one[1:]] != row[one[:-1]]
    left = np.flatnonzero(fresh)
    right = np.append(left[1:], len(one))[: len(left)] - 1
    found, others = row[one[left]], (row[two[left]], row[two[right]])
    # A second row where the two ends were found with different texts.
    again = np.flatnonzero(others[0] != others[1])
    at = np.asarray(mine.column("first"))
    first, last = at[found] + number[one[left]], at[found] + number[one[right]] + length - 1
    both = np.concatenate([np.arange(len(found)), again])
    ids, rows = mine.column("id"), pa.array(found[both])
    return pa.RecordBatch.from_arrays(
        [
            ids.take(rows),
            mine.column("part").take(rows),
            pa.array(first[both].astype(np.int32)),
            pa.array(last[both].astype(np.int32)),
            ids.take(pa.array(np.concatenate([others[0], others[1][again]]))),
        ],
        names=_names(MATCH),
    )


def _place_numbers(rows: pa.RecordBatch) -> np.ndarray:
    """Number of the place of each row; equal rows, which follow each other, share it."""
    fresh = np.zeros(rows.num_rows, dtype=bool)
    for name in ("id", "part", "first"):
        column = rows.column(name)
        for values in (pc.fill_null(column, 0), column.is_null()):
            values = values.to_numpy(zero_copy_only=False)
            fresh[1:] |= values[1:] != values[:-1]
    return np.cumsum(fresh)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _sweep(length: int) -> Callable:
    """Matches among a task's sorted suffixes; those of one head are looked at together."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            heads = np.asarray(part.column("head"))
            done = int(np.searchsorted(heads, heads[-1]))
            if open_ and (done or open_[-1].column("head")[0].as_py() != heads[0]):
                yield _passages(_joined([*open_, part.slice(0, done)]), length)
                open_ = []
            elif done:
                yield _passages(part.slice(0, done), length)
            open_.append(part.slice(done))
        if open_:
            yield _passages(_joined(open_), length)

    return rows


def _class_passages(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PASSAGE``: each passage of the classes, at the class's first and last place."""
    for part in parts:
        for start in range(0, part.num_rows, 1000):
            some = part.slice(start, 1000)
            keys, row, number = _windows(some)
            rows, number = pa.array(row), pa.array(number.astype(np.int32))
            columns = [pa.array(keys.view(np.int64)), some.column("class").take(rows), number]
            columns.append(some.column("n").take(rows))
            for edge in ("low", "high"):
                place = some.column(edge)
                at = pc.add(place.field("first").take(rows), number)
                ends = [place.field("id").take(rows), place.field("part").take(rows), at]
                columns.append(pa.StructArray.from_arrays(ends, names=["id", "part", "at"]))
            yield pa.RecordBatch.from_arrays(
                columns, names=["key", "class", "number", "n", "low", "high"]
            )


def _frequent_matches(suffixes: DataFrame, length: int) -> DataFrame:
    """Matches of suffixes with frequent heads, class by class."""
    place = F.struct("id", "part", "first")
    same = F.xxhash64("head", "windows").alias("class")
    members = stage(suffixes.select("id", "part", "first", same, "windows"), "frequent")
    classes = members.groupBy("class").agg(
        F.first("windows").alias("windows"),
        F.count("*").alias("n"),
        F.min(place).alias("low"),
        F.max(place).alias("high"),
    )
    passages = stage(classes, "classes").mapInArrow(_class_passages, PASSAGE)
    shared = passages.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    # Written, so that both sides of a join are read by key and a hot one can be split.
    shared = stage(shared.where("n > 1").drop("n"), "shared-passages")
    found = passages.select("key", "class", "number").join(shared, "key")
    end = F.struct("number", "low", "high")
    ends = found.groupBy("class").agg(F.min(end).alias("left"), F.max(end).alias("right"))
    rows = members.drop("windows").join(stage(ends, "class-ends"), "class")

    def word(end: str) -> Column:
        return (F.col("first") + F.col(f"{end}.number")).cast("int")

    def other(end: str) -> Column:
        own = F.struct("id", "part", word(end).alias("at"))
        first = own.eqNullSafe(F.col(f"{end}.low"))
        return F.when(first, F.col(f"{end}.high.id")).otherwise(F.col(f"{end}.low.id"))

    others = F.explode(F.array_distinct(F.array(other("left"), other("right")))).alias("other")
    last = (word("right") + F.lit(length - 1)).cast("int").alias("last")
    return rows.select("id", "part", word("left").alias("first"), last, others)


def passage_matches(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    span: int = SPAN,
    group: int = GROUP,
) -> DataFrame:
    """(id, part, first, last, other): words of a text that the text of ``other`` shares."""
    body = F.col(f"`{text}`")
    packed = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(body).alias("part"), body.alias("text")
    )
    suffixes = packed.mapInArrow(_suffix_rows(length, span, group), SUFFIX)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = packed.select("text").mapInArrow(_head_counts(length, span, group), "head long, n long")
    frequent = counts.groupBy("head").agg(F.sum("n").alias("n")).where(F.col("n") > TOGETHER)
    frequent = stage(frequent, "frequent-heads")
    [(heads, rows)] = frequent.agg(F.count("*"), F.sum("n")).collect()
    if heads > BROADCAST_HEADS:
        frequent = frequent.where(F.col("n") > rows // BROADCAST_HEADS)
    frequent = F.broadcast(frequent.select("head"))
    rare = suffixes.join(frequent, "head", "left_anti") if heads else suffixes
    rare = rare.repartition(partitions, "head").sortWithinPartitions("head", "id", "part", "first")
    found = rare.mapInArrow(_sweep(length), MATCH)
    if not heads:
        return found
    hot = suffixes.join(frequent, "head", "left_semi")
    return found.unionByName(_frequent_matches(hot, length))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row per row of ``docs``: id, part, n_words, n_repeated, ``spans`` (first and last
    word of each stretch of repeated passages) and ``others`` (ids that share them)."""
    found = passage_matches(docs, doc_id, text, **settings)
    merged = (
        found.groupBy("id", "part")
        .agg(
            F.sort_array(F.collect_set(F.struct("first", "last"))).alias("found"),
            # At most two per suffix of the text.
            F.sort_array(F.collect_set("other")).alias("others"),
        )
        .withColumn("spans", _union("found"))
        .select("id", "part", "spans", "others")
    )
    body = F.col(f"`{text}`")
    words = F.size(F.filter(F.split(F.coalesce(body, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"),
        F.xxhash64(body).alias("part"),
        words.cast("long").alias("n_words"),
    )
    same = F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.part") == F.col("m.part"))
    covered = F.aggregate("m.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return (
        rows.alias("d")
        .join(merged.alias("m"), same, "left")
        .select(
            "d.id",
            "d.part",
            "d.n_words",
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeated"),
            F.coalesce("m.spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
            F.coalesce("m.others", F.array().cast("array<bigint>")).alias("others"),
        )
    )


def _union(name: str) -> Column:
    """Sorted spans with those that overlap or touch put together."""

    def add(done: Column, s: Column) -> Column:
        top = F.try_element_at(done, F.lit(-1))
        longer = F.struct(
            top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last")
        )
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        joins = (F.size(done) > 0) & (s["first"] <= top["last"] + 1)
        return F.when(joins, F.concat(rest, F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(name, F.array().cast("array<struct<first:int,last:int>>"), add)
