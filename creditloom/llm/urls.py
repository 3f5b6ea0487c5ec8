"""URL rules by a sort-merge range join.

A rule is a host and a path, like ``example.net/en/``. It fits its host and all subdomains
if the url's path starts with the rule's path. The longest rule that fits decides (of rules
of one length the one with the longer host, then the smaller text); without one the default
verdict stands.

The host's labels are reversed, so that a rule's host and path become a prefix of a key and
the rule an interval of keys. A url has one key for each domain that holds its host and has no
more labels than the longest rule. Keys are cut
into ranges by a sample; a rule goes to every range that its interval meets. In each range
urls and rules are swept in the order of their keys with a stack of the rules that are
still open. Equal keys may fill several ranges: rows are then dealt among them.

Ids are whole numbers. A null url, or one without ``://``, has an empty host and path. Rows without an id are
judged like others; repeated rows are judged once each. An empty table of rules leaves the
default.
"""

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RANGES_PER_PARTITION = 2
#: Sampled urls per range; they place the cuts only.
SAMPLED = 20
KEYED = (
    "bucket int, key binary, kind int, id long, host string, path string, full boolean, "
    "rule string, verdict string"
)
NAMES = [c.split()[0] for c in KEYED.split(", ")]
SWEPT = "id long, host string, path string, full boolean, rule string, verdict string"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def domain_key(labels: list[str], path: str) -> bytes:
    """Key of a domain, given by its labels, and a path."""
    return ".".join(reversed(labels)).encode() + b"\x00" + path.encode()


def url_keys(host: str, path: str, most: int) -> list[bytes]:
    """Keys of the domains with up to ``most`` labels that hold the host, the longest first.

    No rule has more labels, so the last ``most`` stand for a longer host.
    """
    labels = host.rsplit(".", most)[-most:]
    return [domain_key(labels[i:], path) for i in range(len(labels))]


def rule_key(rule: str) -> bytes:
    host, _, path = rule.partition("/")
    return domain_key(host.translate(str.maketrans(UPPER, LOWER)).split("."), f"/{path}")


def _bucket(key: bytes, spread: bytes, cuts: list[bytes]) -> int:
    """Range of a key; where several cuts equal it, one of the ranges between them."""
    low, high = bisect_left(cuts, key), bisect_right(cuts, key)
    return low + (crc32(spread) % (high - low + 1) if high > low else 0)


def _keyed_urls(cuts: list[bytes], most: int) -> Callable:
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for i, host, path in zip(*(part.column(c).to_pylist() for c in ("id", "host", "path")), strict=True):
                spread = f"{i} {host} {path}".encode()
                for n, key in enumerate(url_keys(host, path, most)):
                    out.append((_bucket(key, spread, cuts), key, 1, i, host, path, n == 0, None, None))
            yield _batch(out)

    return rows


def _keyed_rules(cuts: list[bytes]) -> Callable:
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for rule, verdict in zip(part.column("rule").to_pylist(), part.column("verdict").to_pylist(), strict=True):
                key = rule_key(rule)
                # No key of a url holds the byte 255.
                for bucket in range(bisect_left(cuts, key), bisect_right(cuts, key + b"\xff") + 1):
                    out.append((bucket, key, 0, None, None, None, False, rule, verdict))
            yield _batch(out)

    return rows


KEYED_ARROW = pa.schema(
    [
        ("bucket", pa.int32()),
        ("key", pa.binary()),
        ("kind", pa.int32()),
        ("id", pa.int64()),
        ("host", pa.string()),
        ("path", pa.string()),
        ("full", pa.bool_()),
        ("rule", pa.string()),
        ("verdict", pa.string()),
    ]
)
SWEPT_ARROW = pa.schema([KEYED_ARROW.field(c) for c in NAMES[3:]])


def _batch(rows: list[tuple], schema: pa.Schema = KEYED_ARROW) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _sweep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (bucket, key, kind): urls with the innermost open rule."""
    bucket, stack = None, []
    for part in parts:
        out = []
        for row in zip(*(part.column(c).to_pylist() for c in NAMES), strict=True):
            at, key, kind, i, host, path, full, rule, verdict = row
            if at != bucket:
                bucket, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict))
            elif stack or full:
                top = stack[-1] if stack else (None, None, None)
                out.append((i, host, path, full, top[1], top[2]))
        yield _batch(out, SWEPT_ARROW)


def _cuts(urls: DataFrame, ranges: int, most: int) -> list[bytes]:
    n = urls.count()
    wanted = SAMPLED * ranges
    some = urls if n <= wanted else urls.sample(fraction=min(1.0, 1.2 * wanted / n), seed=11)
    keys = sorted(
        key for r in some.select("host", "path").limit(2 * wanted).collect() for key in url_keys(r[0], r[1], most)
    )
    return [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (or null) and verdict.

    ``rules`` has the columns rule and verdict.
    """
    body = F.col(f"`{url}`")
    urls = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("id"),
        F.coalesce(host_of(body), F.lit("")).alias("host"),
        F.coalesce(path_of(body), F.lit("")).alias("path"),
    )
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = rules.select("rule", "verdict").where("rule IS NOT NULL").distinct()
    labels = F.size(F.split(F.substring_index("rule", "/", 1), r"\."))
    most = clean.agg(F.max(labels)).first()[0] or 1
    cuts = _cuts(urls, RANGES_PER_PARTITION * partitions, most)
    keyed = urls.mapInArrow(_keyed_urls(cuts, most), KEYED).union(clean.mapInArrow(_keyed_rules(cuts), KEYED))
    swept = (
        keyed.repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "key", "kind", F.col("rule").desc())
        .mapInArrow(_sweep, SWEPT)
    )
    size = F.length("rule")
    host_size = F.instr("rule", "/")
    # Of equally long rules: the longer host, then the smaller text.
    rank = F.when(F.col("rule").isNotNull(), F.struct(size.alias("a"), host_size.alias("b")))
    best = swept.groupBy("id", "host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), rank).alias("best"),
        F.sum(F.col("full").cast("int")).alias("n"),
    )
    # Repeated rows were judged together.
    each = F.explode(F.array_repeat("best", F.col("n").cast("int"))).alias("one")
    return best.withColumn("best", F.coalesce("best", F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")))).select(
        "id", "host", "path", each
    ).select(
        "id", "host", "path", "one.rule", F.coalesce("one.verdict", F.lit(default)).alias("verdict")
    )
