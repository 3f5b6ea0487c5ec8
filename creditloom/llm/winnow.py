"""Benchmark decontamination by winnowing.

Words are runs of digits, lower-cased letters a-z and characters beyond ASCII. A window is
``width`` consecutive words of a benchmark item; an item with fewer words is one window.
Document and item keep, of every ``width - gram + 1`` consecutive hashes of ``gram``
words, the smallest. Equal windows keep equal hashes at equal places, so every shared
window shares a kept hash. Kept hashes are joined and each match is extended word by word
to both sides, no further than a window can reach; runs that hold a window are hits.

An item shorter than a window keeps the word with the smallest hash instead, and is
matched with the distinct places of that word, read only if such items exist.

Nulls and texts without words have no hits. Rows are known by id and text, so repeated ids
and missing ids are allowed, and equal rows get equal results. Items of equal words are
matched once; an item id that occurs with several texts counts once.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.staging import stage

WIDTH = 13
GRAM = 6
#: Up to so many distinct 64-bit hashes of the benchmark (8 MB of keys) are broadcast.
BROADCAST_HASHES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, GAPS), lambda w: w != "")


def _positions(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _kept(df: DataFrame, width: int, gram: int) -> DataFrame:
    """Adds ``kept``: array of (at, hash) of the kept word groups of column ``words``."""
    span = width - gram + 1
    n = F.size("words")
    hashed = df.withColumn(
        "grams",
        F.transform(
            _positions(n - gram + 1),
            lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(gram)]),
        ),
    )
    lowest = hashed.withColumn(
        "lowest",
        F.transform(
            _positions(n - width + 1),
            lambda i: F.least(*[F.get("grams", i + j) for j in range(span)])
            if span > 1
            else F.get("grams", i),
        ),
    )

    def is_kept(i: Column) -> Column:
        # The largest of the minima of all windows over a group is its own hash.
        above = [F.get("lowest", i - j) for j in range(span)]
        return F.get("grams", i) == (F.greatest(*above) if span > 1 else above[0])

    places = F.filter(_positions(F.size("grams")), is_kept)
    kept = F.transform(
        places, lambda i: F.struct(i.alias("at"), F.get("grams", i).alias("hash"))
    )
    return lowest.withColumn("kept", kept).drop("grams", "lowest")


def _around(at: Column, length: int | Column, reach: int) -> list[Column]:
    """Words of the item at a match, before it (nearest first) and after it."""
    middle = F.slice("words", at + 1, length)
    before = F.reverse(F.slice("words", F.greatest(at + 1 - reach, F.lit(1)), F.least(at, F.lit(reach))))
    after = F.slice("words", at + 1 + length, F.lit(reach))
    return [middle.alias("middle"), before.alias("before"), after.alias("after")]


def item_fingerprints(items: DataFrame, width: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Of distinct items (item, words): kept hashes of the full ones and of the short ones."""
    # Written before it is exploded: the filter that Spark infers from an explode would move
    # below all steps of the hashing and repeat them inside each other.
    full = stage(_kept(items.where(F.size("words") >= width), width, gram), "item-groups")
    full = full.select("item", "words", F.explode("kept").alias("k"))
    full = full.select(
        "item",
        F.col("k.hash").alias("hash"),
        F.lit(width).alias("need"),
        *_around(F.col("k.at"), gram, width - gram),
    )
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    short = items.where(F.size("words") < width).withColumn("hashes", hashes)
    short = short.withColumn("hash", F.array_min("hashes"))
    short = short.select(
        "item",
        "hash",
        F.size("words").alias("need"),
        *_around(F.array_position("hashes", F.col("hash")).cast("int") - 1, 1, width),
    )
    return full, short


def _matching(rows: DataFrame, prints: DataFrame, most: int) -> DataFrame:
    """Rows whose hash is one of the benchmark's."""
    hashes = prints.select("hash").distinct()
    if hashes.limit(most + 1).count() <= most:
        hashes = F.broadcast(hashes)
    return rows.join(hashes, "hash", "left_semi")


def _reach(context: Column, word_at) -> Column:
    """Number of leading words of ``context`` that the document has in the same places."""
    equal = F.transform(context, lambda w, j: w.eqNullSafe(word_at(j)))
    first_other = F.array_position(equal, F.lit(False)).cast("int")
    return F.when(first_other == 0, F.size(context)).otherwise(first_other - 1)


def _runs(matches: Column) -> Column:
    """Extends each match; runs (first, last, item) that hold a whole window."""

    def run(m: Column) -> Column:
        at, length = m["at"], F.size(m["middle"])
        same = _reach(m["middle"], lambda j: F.get("words", at + j)) == length
        left = _reach(m["before"], lambda j: F.get("words", at - 1 - j))
        right = _reach(m["after"], lambda j: F.get("words", at + length + j))
        return F.struct(
            (at - left).alias("first"),
            (at + length - 1 + right).alias("last"),
            m["item"].alias("item"),
            (same & (left + length + right >= m["need"])).alias("whole"),
        )

    return F.filter(F.transform(matches, run), lambda r: r["whole"])


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, n_words, n_hit, items (sorted as text)."""
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    bench = items.select(F.col(f"`{item_id}`").alias("item_id"), words(F.col(f"`{item_text}`")).alias("words"))
    bench = bench.where(F.size("words") > 0).withColumn("item", F.xxhash64("words"))
    bench = stage(bench, "items")
    distinct_items = bench.select("item", "words").distinct()
    full, short = item_fingerprints(distinct_items, width, gram)
    full, short = stage(full, "item-prints"), stage(short, "short-prints")

    marked = _kept(texts.select("id", "text_hash", words(F.col("text")).alias("words")), width, gram)
    has_short = not short.isEmpty()
    if has_short:
        marked = marked.withColumn("each", F.transform("words", lambda w: F.xxhash64(w)))
    marked = marked.withColumn("n_words", F.size("words").cast("long")).drop("words")
    marked = stage(marked, "document-prints")

    key = ["id", "text_hash"]
    kept = marked.select(*key, F.explode("kept").alias("k")).select(*key, "k.at", "k.hash")
    found = _matching(kept, full, broadcast_hashes).join(full, "hash")
    if has_short:
        each = marked.select(*key, F.posexplode("each").alias("at", "hash"))
        found = found.unionByName(_matching(each, short, broadcast_hashes).join(short, "hash"))
    match = F.struct("at", "item", "need", "middle", "before", "after")
    # A document's matches are bounded by its own words.
    by_row = found.distinct().groupBy(*key).agg(F.collect_list(match).alias("matches"))
    same_row = _same_row("t", "m")
    extended = (
        texts.alias("t")
        .join(by_row.alias("m"), same_row)
        .select("t.id", "t.text_hash", "m.matches", words(F.col("t.text")).alias("words"))
        .withColumn("runs", _runs(F.col("matches")))
    )
    covered = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    # Written before it is filtered, for the same reason as the groups of the items.
    hits = stage(
        extended.select(
            *key,
            F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("runs", lambda r: r["item"])).alias("found"),
        ),
        "hits",
    )
    hits = hits.where("n_hit > 0").distinct()
    named = (
        hits.select(*key, F.explode("found").alias("item"))
        .join(bench.select("item", F.col("item_id").cast("string").alias("name")).distinct(), "item")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set("name")).alias("items"))
    )
    per_row = hits.alias("h").join(named.alias("n"), _same_row("h", "n"), "left")
    per_row = per_row.select("h.id", "h.text_hash", "h.n_hit", "n.items")
    empty = F.array().cast("array<string>")
    return (
        marked.alias("d")
        .join(per_row.alias("r"), _same_row("d", "r"), "left")
        .select(
            "d.id",
            "d.text_hash",
            "d.n_words",
            F.coalesce("r.n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("r.items", empty).alias("items"),
        )
    )


def _same_row(a: str, b: str) -> Column:
    parts = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("id", "text_hash")]
    return reduce(lambda x, y: x & y, parts)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more, and at least one."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    hits = benchmark_hits(docs, items, doc_id, text, **settings)
    bad = hits.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select("id", "text_hash")
    rows = docs.withColumn("__text_hash", F.xxhash64(F.col(f"`{text}`"))).alias("d")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("b.id")) & (
        F.col("d.__text_hash") == F.col("b.text_hash")
    )
    return rows.join(bad.alias("b"), same, "left_anti").drop("__text_hash")
