"""A company x year panel derived from the star-schema tables.

Customers stand in for companies and order years for fiscal years. Sums are taken in
DECIMAL, so they do not depend on the order of addition. The panel is written once per
application as a table partitioned by year, which the queries then scan with pruned
columns and years.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditloom.functions.columns import col
from creditloom.operators.joins import lookup_join
from creditloom.sources.panel_io import write_panel
from creditloom.staging import files_state, settings, shuffles_removed, staging_path

SOURCES = ("customer", "lineitem", "orders", "part")

#: A task sums the orders that it meets in wide decimals, so it is given few lines: bytes that
#: a task scans or takes from a shuffle, and lines per shuffle partition.
SCAN_BYTES = "8m"
SHUFFLE_BYTES = "16m"
TASK_LINES = 500_000

_tables: dict[tuple, tuple[str, StructType]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts per order: the map-side sums shrink a hot order before any shuffle."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_returnflag",
        "l_linestatus",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("ep"),
        F.col("l_discount").cast("decimal(4,2)").alias("rate_off"),
        F.col("l_tax").cast("decimal(4,2)").alias("rate_tax"),
        F.col("l_quantity").cast("decimal(9,2)").alias("qty"),
    )
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        lookup_join(lines, part, ["l_partkey"])
        .groupBy("l_orderkey")
        .agg(
            F.sum("ep").alias("ep"),
            F.sum(F.col("ep") * F.col("rate_off")).alias("disc"),
            F.sum(F.col("ep") * F.col("rate_tax")).alias("tax"),
            F.sum(F.col("qty") * F.col("price")).alias("cost"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("ep")).otherwise(zero)).alias("ret"),
            F.sum(F.when(F.col("l_linestatus") == "O", F.col("ep")).otherwise(zero)).alias("open"),
        )
    )


def dirty_rating(balance):
    """Ratings as they come in files: padded, mixed case, unknown words, NULL."""
    bands = [
        (9000, "AAA"),
        (8000, " aa"),
        (7000, "A "),
        (6000, "bbb"),
        (5000, "BB"),
        (4000, "B"),
        (3000, "ccc "),
        (2000, "CC"),
        (1000, "C"),
        (0, "D"),
        (-500, "N/R"),
    ]
    rating = F
    for floor, text in bands:
        rating = rating.when(balance >= floor, F.lit(text))
    return rating.otherwise(F.lit(None).cast("string"))


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_custkey",
        F.year("o_orderdate").cast("int").alias("Year"),
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal"
    )
    amounts = ["ep", "disc", "tax", "cost", "ret", "open"]
    yearly = (
        order_amounts(spark, sf_dir)
        .join(orders, "l_orderkey")
        .groupBy("o_custkey", "Year")
        .agg(*[F.sum(a).cast("double").alias(a) for a in amounts])
        .join(customer, "o_custkey")
    )
    ep, disc, tax, cost, ret, opened = (F.col(a) for a in amounts)
    balance = F.col("c_acctbal")
    return yearly.select(
        F.col("o_custkey").alias("Company Code"),
        "Year",
        dirty_rating(balance).alias("Rating"),
        (ep - disc).alias("Sales and Service Revenue"),
        (ep - disc - cost).alias("Gross Profit"),
        (ep - disc - cost - tax).alias("Net Income"),
        ep.alias("Total Assets"),
        ret.alias("Total Debt"),
        (ep - disc - opened).alias("Operating Cash Flow"),
        (100.0 * (ep - disc - cost) / (ep - disc)).alias("Gross Profit Margin"),
        (tax / ep).alias("ROA"),
        (ret / ep).alias("Debt-to-Assets Ratio"),
        F.when(opened != 0, ep / opened).alias("Current Ratio"),
        F.when(ret != 0, (balance + 1000.0) * 20 / ret).alias("Interest Coverage Ratio"),
        ((balance + 1000.0) / 11000.0).alias("Score"),
    )


def panel_key(spark: SparkSession, sf_dir: str) -> tuple:
    """Application, folder and state (names, sizes and times) of the files of the panel."""
    state = [files_state(spark, f"{sf_dir}/{name}.parquet") for name in SOURCES]
    return (spark.sparkContext.applicationId, sf_dir, *state)


def small_tasks(spark: SparkSession, lines: int) -> dict[str, str]:
    """Settings under which the work on one task does not grow with the number of lines."""
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines // TASK_LINES)
    return {
        "spark.sql.files.maxPartitionBytes": SCAN_BYTES,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLE_BYTES,
        "spark.sql.shuffle.partitions": str(partitions),
    }


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = panel_key(spark, sf_dir)
    if key not in _tables:
        path = staging_path(spark, "panel")
        tasks = small_tasks(spark, table(spark, sf_dir, "lineitem").count())
        with settings(spark, tasks), shuffles_removed(spark):
            rows = build_panel(spark, sf_dir)
            write_panel(rows, path, partition_by=["Year"])
        _tables[key] = (path, rows.schema)
    path, schema = _tables[key]
    return spark.read.schema(schema).parquet(path).select(*[col(name) for name in schema.names])


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of a company-year: several rows for one key."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("Company Code"),
        F.year("o_orderdate").cast("int").alias("Year"),
        F.col("o_orderkey").alias("record"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
