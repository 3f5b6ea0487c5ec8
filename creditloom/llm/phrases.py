"""Substring dedup with repeated-phrase automata.

A window is ``width`` consecutive words of one text. Every word covered by a window whose
words also start earlier (in a smaller id, or earlier in the same document) is removed.

1. Each window holds a phrase of ``phrase`` words that its content selects: the one with
   the smallest hash. The selected phrases of all texts are counted; those found once
   cannot lie in a recurring window.
2. Texts are dealt into buckets by id. A bucket's automaton is compiled from the confirmed
   phrases of its own texts, so it stays as small as the bucket, and all texts of the
   bucket are streamed through it. Its hits mark the windows that can recur.
3. A bucket sends each of those windows once, with the smallest id that it has there. For
   every window all buckets but the one with its first place get it back.
4. A bucket removes the windows that it got back and its own later repeats.

So a passage that a third of all texts share costs a bucket one row, and nothing is
gathered by passage. Windows are known by 64-bit hashes.

Nulls and empty texts have no words and stay as they are. Rows of one id count as one
document whose parts are ordered by text; rows without an id come after all others. Texts
keep the space between the words that stay.
"""

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.words import (
    Words,
    sliding,
    split_words,
    starts_within,
    text_slices,
    window_hashes,
)

PHRASE = 5
#: Phrases that a task gathers before it sends them on.
FLUSH = 500_000
#: Buckets of texts per shuffle partition. There is one shard of hashes per partition, since
#: up to shards x buckets rows go back.
BUCKETS_PER_PARTITION = 2
NO_ID = np.iinfo(np.int64).max
KEYS = "shard int, hashes binary, tags binary"


def selected_phrases(hashes: np.ndarray, bounds: np.ndarray, width: int, phrase: int) -> np.ndarray:
    """Positions of the phrases with the smallest hash of some window."""
    grams = window_hashes(hashes, phrase)
    span = width - phrase + 1
    fits = starts_within(bounds, len(hashes), width)
    lowest = sliding(grams, span, np.minimum)
    lowest = np.where(fits[: len(lowest)], lowest, np.uint64(0))
    if not len(lowest):
        return np.zeros(0, dtype=np.int64)
    pad = np.zeros(span - 1, dtype=np.uint64)
    # A phrase is selected if the largest of the minima over it is its own hash.
    highest = sliding(np.concatenate([pad, lowest, pad]), span, np.maximum)
    return np.flatnonzero((highest == grams) & (highest > 0))


def _shards(hashes: np.ndarray, tags: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``KEYS``: hashes and their tags (int64), a row per shard."""
    place = (hashes % np.uint64(shards)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    place, hashes, tags = place[order], hashes[order], tags[order]
    cuts = np.flatnonzero(np.diff(place)) + 1
    firsts = np.concatenate(([0], cuts)) if len(place) else []
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(place[firsts] if len(place) else [], type=pa.int32()),
            pa.array([x.tobytes() for x in np.split(hashes, cuts)][: len(firsts)], pa.binary()),
            pa.array([x.tobytes() for x in np.split(tags, cuts)][: len(firsts)], pa.binary()),
        ],
        names=["shard", "hashes", "tags"],
    )


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def _phrase_rows(width: int, phrase: int, shards: int) -> Callable:
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for part in parts:
            bucket = np.asarray(part.column("bucket"), dtype=np.int64)
            for at, texts in text_slices(part.column("text")):
                w = split_words(texts)
                hashes = w.hashes()
                places = selected_phrases(hashes, w.bounds, width, phrase)
                kept.append((window_hashes(hashes, phrase)[places], bucket[at + w.owner[places]]))
                n += len(places)
                if n >= FLUSH:
                    yield from _shards(*map(np.concatenate, zip(*kept, strict=True)), shards)
                    kept, n = [], 0
        if n:
            yield from _shards(*map(np.concatenate, zip(*kept, strict=True)), shards)

    return rows


def _back_to_buckets(hashes: np.ndarray, buckets: np.ndarray) -> pa.Table:
    """Rows (bucket, hashes)."""
    order = np.argsort(buckets, kind="stable")
    hashes, buckets = hashes[order], buckets[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    firsts = np.concatenate(([0], cuts)) if len(buckets) else []
    blobs = [x.tobytes() for x in np.split(hashes, cuts)][: len(firsts)]
    places = buckets[firsts] if len(buckets) else []
    return pa.table({"bucket": pa.array(places, pa.int32()), "hashes": pa.array(blobs, pa.binary())})


def _recurring(table: pa.Table) -> pa.Table:
    """Of one shard: phrases found twice or more, for each bucket that has them."""
    hashes = _joined(table["hashes"], np.uint64)
    buckets = _joined(table["tags"], np.int64)
    order = np.lexsort((buckets, hashes))
    hashes, buckets = hashes[order], buckets[order]
    same = hashes[1:] == hashes[:-1]
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = ~same | (buckets[1:] != buckets[:-1])
    return _back_to_buckets(hashes[again & first], buckets[again & first])


def _later(table: pa.Table) -> pa.Table:
    """Of one shard: windows for each bucket but the one with the smallest id."""
    hashes = _joined(table["hashes"], np.uint64)
    tags = _joined(table["tags"], np.int64).reshape(-1, 2)
    order = np.lexsort((tags[:, 1], tags[:, 0], hashes))
    hashes, buckets = hashes[order], tags[order, 1]
    later = np.zeros(len(hashes), dtype=bool)
    later[1:] = hashes[1:] == hashes[:-1]
    return _back_to_buckets(hashes[later], buckets[later])


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending"), ("text", "ascending")])


def _slices(table: pa.Table) -> Iterator[tuple[int, Words]]:
    for at, texts in text_slices(table["text"]):
        yield at, split_words(texts)


def _spaced(w: Words) -> tuple[str, np.ndarray]:
    """The words with one space on each side and a mark between texts, a character per
    byte, and the place of the space after each word."""
    data, bounds = w.data.tobytes(), w.text_bounds.tolist()
    parts = [b" "]
    for i, n in enumerate(w.counts.tolist()):
        if n:
            parts += [b" ".join(data[bounds[i] : bounds[i + 1]].split()), b" "]
        parts.append(b"\n ")
    places = np.cumsum(w.ends - w.starts + 1) + 2 * w.owner
    return b"".join(parts).decode("latin-1"), places


def automaton(slices: list[Words], confirmed: np.ndarray, width: int, phrase: int):
    """Automaton of the confirmed phrases of some texts, or None if they have none."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in slices:
        hashes = w.hashes()
        places = selected_phrases(hashes, w.bounds, width, phrase)
        grams = window_hashes(hashes, phrase)[places]
        _, at = np.unique(grams, return_index=True)
        chosen = places[at[np.isin(grams[at], confirmed)]]
        data = w.data.tobytes()
        for lo, hi in zip(w.starts[chosen].tolist(), w.ends[chosen + phrase - 1].tolist(), strict=True):
            words = b" ".join(data[lo:hi].split())
            machine.add_word(f" {words.decode('latin-1')} ")
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def occurrences(machine, w: Words, phrase: int) -> np.ndarray:
    """First word of every occurrence of the automaton's phrases."""
    text, places = _spaced(w)
    ends = np.fromiter((end for end, _ in machine.iter(text)), dtype=np.int64)
    return np.searchsorted(places, ends) - phrase + 1


def _window_rows(width: int, phrase: int, shards: int) -> Callable:
    def rows(key: tuple, docs: pa.Table, phrases: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        docs = _ordered(docs.select(["id", "text"]))
        confirmed = np.unique(_joined(phrases["hashes"], np.uint64))
        slices = list(_slices(docs))
        machine = automaton([w for _, w in slices], confirmed, width, phrase) if len(confirmed) else None
        ids = docs["id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, w in slices if machine is not None else ():
            n = len(w.starts)
            found = occurrences(machine, w, phrase)
            edges = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edges, np.maximum(found - (width - phrase), 0), 1)
            np.add.at(edges, found + 1, -1)
            marked = (np.cumsum(edges[:n]) > 0) & starts_within(w.bounds, n, width)
            starts = np.flatnonzero(marked)
            hashes.append(window_hashes(w.hashes(), width)[starts])
            owners.append(ids[at + w.owner[starts]])
        unique, first = np.unique(np.concatenate(hashes), return_index=True)
        tags = np.empty((len(unique), 2), dtype=np.int64)
        tags[:, 0], tags[:, 1] = np.concatenate(owners)[first], bucket
        return pa.Table.from_batches(_shards(unique, tags, shards))

    return rows


def _without(w: Words, removed: np.ndarray) -> Iterator[bytes]:
    """Texts without the removed words and the space after each of them."""
    data, bounds = w.data.tobytes(), w.text_bounds.tolist()
    for i, (lo, hi) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        gone = removed[lo:hi]
        if not gone.any():
            yield data[bounds[i] : bounds[i + 1]]
            continue
        starts = w.starts[lo:hi]
        after = np.append(starts[1:], bounds[i + 1])
        change = np.diff(np.concatenate(([1], (~gone).astype(np.int8), [1])))
        # Runs of removed words, from the first one's start to the start of the next word kept.
        begins = starts[np.flatnonzero(change == -1)]
        stops = after[np.flatnonzero(change == 1) - 1]
        cuts = [bounds[i], *np.stack([begins, stops], axis=1).ravel().tolist(), bounds[i + 1]]
        yield b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _cleaned(width: int) -> Callable:
    def rows(docs: pa.Table, windows: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        returned = np.unique(_joined(windows["hashes"], np.uint64))
        slices = list(_slices(docs))
        hashes, starts = [np.zeros(0, np.uint64)], []
        for _, w in slices:
            at = np.flatnonzero(starts_within(w.bounds, len(w.starts), width))
            starts.append(at)
            hashes.append(window_hashes(w.hashes(), width)[at])
        every = np.concatenate(hashes)
        _, first = np.unique(every, return_index=True)
        later = np.ones(len(every), dtype=bool)
        later[first] = False
        later |= np.isin(every, returned)
        texts, removed_counts, counts, done = [], [], [], 0
        for (_, w), at in zip(slices, starts, strict=True):
            hit = at[later[done : done + len(at)]]
            done += len(at)
            edges = np.zeros(len(w.starts) + 1, dtype=np.int64)
            edges[hit] += 1
            np.add.at(edges, hit + width, -1)
            removed = np.cumsum(edges[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(removed)))
            removed_counts.append(total[w.bounds[1:]] - total[w.bounds[:-1]])
            counts.append(w.counts)
            texts += _without(w, removed)
        missing = docs["text"].is_null().combine_chunks()
        kept = pa.array(texts, pa.binary()).cast(pa.string())
        nothing = np.zeros(0, dtype=np.int64)
        return pa.table(
            {
                "row": docs["row"],
                "id": docs["id"],
                "kept_text": pc.if_else(missing, pa.scalar(None, pa.string()), kept),
                "n_words": pa.array(np.concatenate([nothing, *counts])),
                "n_removed": pa.array(np.concatenate([nothing, *removed_counts])),
            }
        )

    return rows


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 20,
    phrase: int = PHRASE,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of the other columns), ``id``,
    ``kept_text``, ``n_words`` and ``n_removed``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, buckets = partitions, BUCKETS_PER_PARTITION * partitions
    identity = F.col(f"`{doc_id}`")
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    packed = docs.select(
        row.alias("row"),
        identity.cast("long").alias("id"),
        F.col(f"`{text}`").alias("text"),
        F.pmod(F.xxhash64(identity), F.lit(buckets)).cast("int").alias("bucket"),
    )
    kind = packed.schema["row"].dataType.simpleString()
    back = "bucket int, hashes binary"
    confirmed = (
        packed.select("bucket", "text")
        .mapInArrow(_phrase_rows(width, phrase, shards), KEYS)
        .groupBy("shard")
        .applyInArrow(_recurring, back)
    )
    dealt = packed.groupBy("bucket")
    later = (
        dealt.cogroup(confirmed.groupBy("bucket"))
        .applyInArrow(_window_rows(width, phrase, shards), KEYS)
        .groupBy("shard")
        .applyInArrow(_later, back)
    )
    return dealt.cogroup(later.groupBy("bucket")).applyInArrow(
        _cleaned(width),
        f"row {kind}, id long, kept_text string, n_words long, n_removed long",
    )
