"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight and a schedule, a piecewise linear weight over training time
from 0 to 1. The sources share the words of all documents by weight, but no source gives
more than ``most`` times its own words; what that leaves is shared by weight among the
others. Inside a source documents come in the order of a hash of id and text, in whole
passes as long as the target holds them. Of a last pass it holds a part. First come its large
documents, those of more than a sixteenth of that part, in hash order up to the first that
does not fit; others fill what is left, in hash order up to the first that does not fit; the
gap then is closed by the smallest unused documents, as long as each brings the words nearer
to the target. So a source ends short of its target by at most half of its smallest unused
document (or uses all), or beyond it by at most half of the document that it took last, to
which every unused one is at least equal.

The words before a copy are a share of the source's target (documents of one size that close
the gap share their place); the inverse of the integrated schedule turns that share into the
copy's training position.

Sums along a source are taken in buckets of about the square root of its documents, so
neither a hot source nor its list of buckets meets in one task.

Null and empty texts have size 0 and are taken like others, with no words. Documents
without a source form one source, the last. Equal rows are counted and placed together, so
that no task holds a row for each of them; rows of one id, or without one, are told apart by
their texts. Reruns agree; equal rows share their results in any order.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.rows import row_hash
from creditloom.operators.joins import lookup_join
from creditloom.staging import stage

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of more than a sixteenth of the words that a last pass takes come first in it.
LARGE_PART = 16
#: Equal rows that one task numbers.
TOGETHER = 10_000
#: Weight over time, relative to its mean, of the sources with each of the weights.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)
#: Up to so many characters of source names are broadcast with their totals.
BROADCAST_CHARS = 1_000_000
GAPS = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), GAPS)
    # Only the first and the last part can be empty.
    ends = (F.element_at(parts, 1) == "").cast("long") + (F.element_at(parts, -1) == "").cast("long")
    return F.when(F.size(parts) == 1, 1 - (parts[0] == "").cast("long")).otherwise(
        F.size(parts).cast("long") - ends
    )


def _segments(schedule: tuple) -> Column:
    """Start, weight, slope and integral before of each piece, scaled to integral 1."""
    pieces = list(zip(schedule, schedule[1:], strict=False))
    total = sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in pieces)
    before, out = 0.0, []
    for (t0, w0), (t1, w1) in pieces:
        out.append(
            F.struct(
                F.lit(float(t0)).alias("start"),
                F.lit(w0 / total).alias("weight"),
                F.lit((w1 - w0) / (t1 - t0) / total).alias("slope"),
                F.lit(before).alias("before"),
            )
        )
        before += (w0 + w1) / 2 * (t1 - t0) / total
    return F.array(*out)


def position(share: Column, segments: Column) -> Column:
    """Time by which the schedule has asked for a share of its words."""
    piece = F.element_at(F.filter(segments, lambda s: s["before"] <= share), -1)
    rest = share - piece["before"]
    root = F.sqrt(piece["weight"] * piece["weight"] + 2 * piece["slope"] * rest)
    down = piece["weight"] + root
    return piece["start"] + F.when(down > 0, 2 * rest / down).otherwise(0.0)


def source_targets(
    sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, schedules: tuple = SCHEDULES
) -> DataFrame:
    """One row per source: rank, source, n_docs, source_size, target, segments.

    The windows without partitions run over one row per source.
    """
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("rank", rank)
    tier = F.col("rank") % len(weights)
    ranked = ranked.withColumns(
        {
            "weight": F.element_at(F.array(*[F.lit(w) for w in weights]), tier + 1).cast("long"),
            "bound": F.col("source_size") * most,
            "segments": F.element_at(
                F.array(*[_segments(s) for s in schedules]), F.col("rank") % len(schedules) + 1
            ),
        }
    )
    # Sources reach their bound in the order of bound / weight.
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    leveled = ranked.withColumns(
        {
            "full": F.coalesce(F.sum("bound").over(before), F.lit(0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "words": F.sum("source_size").over(everything),
            "turn": F.row_number().over(by_bound),
        }
    ).withColumn("level", (F.col("words") - F.col("full")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= F.col("bound")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("turn"))).over(everything)
    target = F.least(F.col("bound").cast("double"), level * F.col("weight"))
    return leveled.withColumn("target", target).select(
        "rank", "source", "n_docs", "source_size", "target", "segments"
    )


def _fitting(n: Column, size: Column, ahead: Column, room: Column) -> Column:
    """How many of ``n`` equal documents end within the room, each behind the one before."""
    guess = F.greatest(F.lit(0), F.least(n, F.floor((room - ahead) / size)))
    # The division may round: the sums decide.
    guess = guess - ((guess > 0) & (ahead + guess * size > room)).cast("long")
    guess = guess + ((guess < n) & (ahead + (guess + 1) * size <= room)).cast("long")
    return F.when(size > 0, guess).otherwise(F.when(ahead <= room, n).otherwise(0)).cast("long")


def _closing(n: Column, size: Column, ahead: Column, room: Column) -> Column:
    """How many of ``n`` equal documents bring the words nearer to the room."""

    def nearer(i: Column) -> Column:
        return 2 * (room - (ahead + i * size)) > size

    guess = F.greatest(F.lit(0), F.least(n, F.floor((room - ahead) / size + 0.5)))
    guess = guess - ((guess > 0) & ~nearer(guess - 1)).cast("long")
    guess = guess + ((guess < n) & nearer(guess)).cast("long")
    return F.when(size > 0, guess).otherwise(0).cast("long")


def _ahead(rows: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """Add the sums of some amounts over the rows of the source that come before in hash order."""
    names = {f"__{name}": name for name in amounts}
    rows = rows.withColumns({f"__{name}": amount for name, amount in amounts.items()})
    sums = rows.groupBy("rank", "bucket").agg(*[F.sum(c).alias(c) for c in names])
    over = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "rank", "bucket", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_offset") for c in names]
    )
    inside = Window.partitionBy("rank", "bucket").orderBy("draw", "id", "size", "row_hash")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    before = {
        name: F.col(f"{c}_offset") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, name in names.items()
    }
    rows = rows.join(offsets, ["rank", "bucket"]).withColumns(before)
    return rows.drop(*names, *[f"{c}_offset" for c in names])


def _filled(rows: DataFrame, ahead: str, taken: str, name: str) -> DataFrame:
    """One row per source: rank and the words up to the last document taken."""
    end = F.when(F.col(taken) > 0, F.col(ahead) + F.col(taken) * F.col("size")).otherwise(0)
    return stage(rows.groupBy("rank").agg(F.max(end).alias(name)), name)


def _fill(placed: DataFrame, most: int, small_table: Callable) -> DataFrame:
    """Add ``first``, ``second`` and ``third``, the copies that fill the rest of a target as
    large documents, as others and by size, and where each of the three starts
    (``first_ahead``, ``second_ahead``, ``third_ahead``).

    ``small_table`` marks a table with a row per source for a broadcast if that is bounded.
    """
    none = F.lit(0).cast("long")
    n, size = F.col("n"), F.col("size")
    open_ = F.col("passes") < most
    large = size * LARGE_PART > F.col("rest")
    first = _fitting(n, size, F.col("first_ahead"), F.col("rest"))
    rows = placed.withColumn("first", F.when(open_ & large, first).otherwise(none))
    filled = _filled(rows, "first_ahead", "first", "filled")
    rows = rows.join(small_table(filled), "rank").withColumn("gap", F.col("rest") - F.col("filled"))
    second = _fitting(n, size, F.col("second_ahead"), F.col("gap"))
    rows = rows.withColumn("second", F.when(open_ & ~large, second).otherwise(none))
    refilled = _filled(rows, "second_ahead", "second", "refilled")
    rows = rows.join(small_table(refilled), "rank").withColumns(
        {
            "gap": F.col("gap") - F.col("refilled"),
            "second_ahead": F.col("filled") + F.col("second_ahead"),
            "filled": F.col("filled") + F.col("refilled"),
            "left": n - F.col("first") - F.col("second"),
        }
    )
    # Sizes that can close what is left: their sum is bounded by the gap, and that by one text.
    can = open_ & (F.col("left") > 0) & (size > 0) & (size < 2 * F.col("gap"))
    sizes = rows.where(can).groupBy("rank", "size").agg(
        F.sum("left").alias("n_size"), F.first("gap").alias("gap")
    )
    smaller = Window.partitionBy("rank").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("n_size") * F.col("size")).over(smaller), F.lit(0))
    sizes = sizes.withColumn("before", before)
    n_closing = _closing(F.col("n_size"), F.col("size"), F.col("before"), F.col("gap"))
    sizes = sizes.withColumn("n_closing", n_closing).where("n_closing > 0")
    sizes = stage(sizes, "closing-sizes")
    rows = lookup_join(rows, sizes.drop("gap"), ["rank", "size"], how="left")
    whole = F.col("n_closing") == F.col("n_size")
    clear = rows.where(F.coalesce(whole, F.lit(True))).withColumn(
        "third", F.when(can & whole, F.col("left")).otherwise(0)
    )
    # One size per source is taken in part, in hash order.
    border = _ahead(rows.where(~whole), {"equal_ahead": F.when(can, F.col("left")).otherwise(0)})
    part = F.greatest(F.lit(0), F.least(F.col("left"), F.col("n_closing") - F.col("equal_ahead")))
    border = border.withColumn("third", F.when(can, part).otherwise(0)).drop("equal_ahead")
    return clear.unionByName(border).withColumns(
        {"third": F.col("third").cast("long"), "third_ahead": F.col("filled") + F.col("before")}
    )


def _each_copy(rows: DataFrame, repeated: bool) -> DataFrame:
    """A row for each of ``n`` equal rows, numbered in ``turn``; many of them over many tasks."""
    if not repeated:
        return rows.withColumn("turn", F.lit(0).cast("long"))
    last = F.col("n") - 1
    single = rows.where("n = 1").withColumn("turn", F.lit(0).cast("long"))
    start = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(TOGETHER).cast("long")))
    many = rows.where("n > 1").withColumn("start", start).repartition("row_hash", "start")
    turns = F.sequence("start", F.least(last, F.col("start") + (TOGETHER - 1)))
    return single.unionByName(many.withColumn("turn", F.explode(turns)).drop("start"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple = WEIGHTS,
    most: int = MOST,
    schedules: tuple = SCHEDULES,
) -> DataFrame:
    """One row per row of ``docs``: id, row_hash, size, source_size, target, copies, taken
    and ``positions``, the training position of each copy."""
    body = F.col(f"`{text}`")
    identity = F.col(f"`{doc_id}`")
    # Rows of one id and rows without an id are told apart by their texts.
    draw = F.md5(
        F.concat(F.coalesce(identity.cast("string"), F.lit("")), F.lit(":"), F.coalesce(body, F.lit("")))
    )
    sized = docs.select(
        identity.alias("id"),
        F.col(f"`{source}`").alias("source"),
        row_hash(docs).alias("row_hash"),
        draw.alias("draw"),
        n_words(body).alias("size"),
    )
    # Equal rows are one row with a count until the end.
    sized = sized.groupBy(*sized.columns).agg(F.count("*").alias("n"))
    sized = stage(sized, "sizes")
    words = sized.select("source", (F.col("size") * F.col("n")).alias("size"))
    sources = stage(source_targets(words, weights, most, schedules), "sources")
    chars = sources.agg(F.sum(F.coalesce(F.length("source"), F.lit(0)) + 100)).first()[0] or 0
    small = F.broadcast if chars <= BROADCAST_CHARS else lambda table: table
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    rows = sized.alias("d").join(small(sources).alias("s"), same).select(
        "d.id", "d.row_hash", "d.draw", "d.size", "d.n", "s.rank", "s.n_docs", "s.source_size", "s.target"
    )
    place = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    buckets = F.ceil(F.sqrt("n_docs")).cast("long")
    rows = rows.withColumn("bucket", F.shiftright(place * buckets, 32)).drop("n_docs")
    passes = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    rows = rows.withColumn("passes", passes)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    large = F.col("size") * LARGE_PART > F.col("rest")
    words = F.col("size") * F.col("n")
    placed = _ahead(
        rows.withColumn("rest", rest), {"ahead": words, "first_ahead": F.when(large, words).otherwise(0)}
    )
    placed = stage(placed.withColumn("second_ahead", F.col("ahead") - F.col("first_ahead")), "placed")
    filled = _fill(placed, most, small).join(small(sources.select("rank", "segments")), "rank")

    turn = F.col("turn")
    again = turn - F.col("first")
    extra = F.col("first") + F.col("second") + F.col("third")
    extra_ahead = (
        F.when(again < 0, F.col("first_ahead") + turn * F.col("size"))
        .when(again < F.col("second"), F.col("second_ahead") + again * F.col("size"))
        .otherwise(F.col("third_ahead"))
    )
    each = _each_copy(filled, not sized.where("n > 1").isEmpty()).withColumns(
        {
            "copies": (F.col("passes") + (turn < extra).cast("long")).cast("long"),
            "extra_ahead": extra_ahead,
            "ahead": F.col("ahead") + turn * F.col("size"),
        }
    )
    no_copies = F.array().cast("array<double>")

    def of_copy(i: Column) -> Column:
        inside = F.when(i < F.col("passes"), F.col("ahead")).otherwise(F.col("extra_ahead"))
        words = i * F.col("source_size") + inside
        share = F.when(F.col("target") > 0, F.least(words / F.col("target"), F.lit(1.0)))
        return position(F.coalesce(share, F.lit(0.0)), F.col("segments"))

    positions = F.when(
        F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), of_copy)
    ).otherwise(no_copies)
    return each.select(
        "id",
        "row_hash",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        positions.alias("positions"),
    )


def training_order(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings
) -> DataFrame:
    """A row per copy that the mix takes, range-sorted by position: the columns of ``docs``
    and ``copy_position`` (in place of a column of that name)."""
    copies = mix(docs, doc_id, text, source, **settings).select(
        "id", "row_hash", F.explode("positions").alias("copy_position")
    )
    copies = stage(copies, "copies")
    rows = docs.drop("copy_position").withColumn("__row_hash", row_hash(docs))
    # Equal rows: the copies of all of them are among ``copies``, so one row is enough.
    keys = rows.groupBy(F.col(f"`{doc_id}`"), "__row_hash").count().where("count > 1")
    if not keys.isEmpty():
        rows = rows.dropDuplicates([doc_id, "__row_hash"])
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("c.id")) & (
        F.col("d.__row_hash") == F.col("c.row_hash")
    )
    columns = [F.col(f"d.`{c}`") for c in docs.columns if c != "copy_position"]
    return (
        rows.alias("d")
        .join(copies.alias("c"), same)
        .select(*columns, "c.copy_position")
        .orderBy("copy_position", F.col(f"`{doc_id}`"))
    )
