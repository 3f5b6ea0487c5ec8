"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.staging import stage


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star over edges (a, b) with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    large = (
        both.join(lowest, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .distinct()
    )
    lowest = large.groupBy("a").agg(F.min("b").alias("low"))
    ends = F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low")))
    return (
        large.join(lowest, "a")
        .select(ends.alias("e"))
        .select(F.col("e.a").alias("a"), F.col("e.low").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum over them; equal for equal sets of edges."""
    part = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.sum(part % 1_000_000_007), F.bit_xor(part)).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node.

    Roots themselves are not among the rows. The number of rounds grows with the logarithm
    of the longest path; each round is written to the shared folder, so a lost executor
    costs its own tasks only.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = stage(edges.select(a, b).where("a != b").distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        current = stage(_stars(current), "stars")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
