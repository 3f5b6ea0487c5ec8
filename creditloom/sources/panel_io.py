"""Reading and writing panels, and bringing a raw table into panel form."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditloom.catalog import FIRST_YEAR, LAST_YEAR, YEAR
from creditloom.functions.columns import col, normalize_year
from creditloom.sources.resolve import detect_entity


def read_panel(
    spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "csv"
) -> DataFrame:
    """Scan of a panel file. Give the schema where it is known: inferring it reads the
    whole CSV one more time. A missing path is an AnalysisException."""
    if fmt != "csv":
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.format(fmt).load(path)
    if schema:
        return spark.read.schema(schema).csv(path, header=True)
    return spark.read.csv(path, header=True, inferSchema=True)


def write_panel(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    single_file: bool = False,
) -> None:
    """Overwrite ``path`` with the panel.

    Partitioned output is rebalanced on its keys first, so that a year with a large
    share of the rows is split over tasks and a small one gives one file.
    ``single_file`` moves all rows through one task; for small exports only.
    """
    if single_file:
        df = df.coalesce(1)
    elif partition_by:
        df = df.hint("rebalance", *[col(name) for name in partition_by])
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(
            path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    else:
        writer.format(fmt).save(path)


def panel_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def with_entity(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` and the name of its company column; an id is generated if there is none."""
    name = detect_entity(df.columns)
    if name is not None:
        return df, name
    return synthetic_entity_id(df), "Company"


def synthetic_entity_id(df: DataFrame, name: str = "Company") -> DataFrame:
    """Unique, not dense."""
    return df.withColumn(name, F.monotonically_increasing_id())


def one_row_per_entity(df: DataFrame, entity: str, order: list[str] | None = None) -> DataFrame:
    """The row of each company that is first by ``order`` and then by its other columns."""
    rest = [name for name in df.columns if name != entity]
    ranked = [*(order or []), *[name for name in rest if name not in (order or [])]]
    first = F.min(F.struct(*[col(name) for name in ranked])).alias("__first")
    kept = df.groupBy(col(entity)).agg(first)
    fields = [kept["__first"].getField(name).alias(name) for name in rest]
    columns = dict(zip(rest, fields))
    return kept.select(*[columns.get(name, col(name)) for name in df.columns])


def expand_years(
    df: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, year: str = YEAR
) -> DataFrame:
    """Every row once per year of the range."""
    return df.withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))


def to_panel(
    df: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, order: list[str] | None = None
) -> tuple[DataFrame, str]:
    """Raw table to panel: company column found or made, ``Year`` an int or generated."""
    named, entity = with_entity(df)
    if YEAR in named.columns:
        return named.withColumn(YEAR, normalize_year(col(YEAR))), entity
    # A generated id is unique already.
    rows = one_row_per_entity(named, entity, order) if entity in df.columns else named
    return expand_years(rows, first, last), entity


def read_and_expand(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    first: int = FIRST_YEAR,
    last: int = LAST_YEAR,
) -> tuple[DataFrame, str]:
    return to_panel(read_panel(spark, path, schema), first, last)


def export_expanded(
    spark: SparkSession, source: str, target: str, schema: StructType | None = None
) -> DataFrame:
    """Read, expand and write in one run; the result is a scan of the written CSV, so a
    count or a sample does not run the expansion again."""
    expanded, _ = read_and_expand(spark, source, schema)
    write_panel(expanded, target, fmt="csv")
    return read_panel(spark, target, expanded.schema)
