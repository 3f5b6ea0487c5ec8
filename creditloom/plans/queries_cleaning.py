"""Sources, column choice, cleaning and filters."""

from pyspark.sql import functions as F

from creditloom.catalog import METRIC_GROUPS
from creditloom.functions.columns import (
    coerce_numeric as coerce_columns,
    col,
    ig_label as label_of,
    normalize_rating as normalized,
    normalize_year as year_of,
    rating_ordinal as ordinal_of,
    rescale_score as rescaled,
)
from creditloom.functions.formatting import (
    format_magnitude as magnitude_text,
    format_metric as metric_text_of,
)
from creditloom.operators import clip, filters
from creditloom.plans import panel_sql as q
from creditloom.plans.panel import order_records, panel, table
from creditloom.plans.registry import query, rounded
from creditloom.sources import panel_io, resolve
from creditloom.staging import staging_path

KEYS = '"Company Code", "Year"'


@query(q.PANEL + "SELECT * FROM panel")
def read_panel(spark, sf_dir):
    rows = panel(spark, sf_dir)
    path = staging_path(spark, "panel-csv")
    panel_io.write_panel(rows, path, fmt="csv")
    return panel_io.read_panel(spark, path, rows.schema)


@query(q.PANEL + "SELECT * FROM panel")
def write_panel(spark, sf_dir):
    rows = panel(spark, sf_dir)
    path = staging_path(spark, "panel-by-year")
    panel_io.write_panel(rows, path, partition_by=["Year"])
    return panel_io.read_panel(spark, path, rows.schema, fmt="parquet")


@query(q.PANEL + "SELECT count(*) AS n_rows FROM panel")
def panel_counts(spark, sf_dir):
    return panel_io.panel_counts(panel(spark, sf_dir))


@query(q.PANEL + 'SELECT "Company Code" AS entity, "Year" FROM panel')
def detect_entity(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return rows.select(col(resolve.detect_entity(rows.columns)).alias("entity"), "Year")


@query(q.PANEL + f'SELECT {KEYS}, "Rating" AS rating FROM panel')
def detect_rating(spark, sf_dir):
    rows = panel(spark, sf_dir)
    found = resolve.detect_rating(rows.columns)
    return rows.select("Company Code", "Year", col(found).alias("rating"))


@query(
    q.PANEL
    + f"""SELECT {KEYS}, "Gross Profit Margin", "ROA", "Gross Profit", "Net Income",
       "Total Debt", "Debt-to-Assets Ratio" FROM panel"""
)
def resolve_metric_group(spark, sf_dir):
    rows = panel(spark, sf_dir)
    names = []
    for group in ("Profitability", "Leverage"):
        names += resolve.resolve_metric_group(rows.columns, METRIC_GROUPS[group], exact_only=True)
    return rows.select("Company Code", "Year", *[col(name) for name in names])


@query(
    q.PANEL
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(\"{f}\") AS n_values FROM panel" for f in q.FEATURES
    )
)
def usable_features(spark, sf_dir):
    return resolve.feature_counts(panel(spark, sf_dir))


FIRST_RECORDS = (
    q.RECORDS
    + """SELECT "Company Code", record, amount, priority, status FROM (
  SELECT *, row_number() OVER (PARTITION BY "Company Code" ORDER BY record) AS place
  FROM records) WHERE place = 1"""
)


@query(FIRST_RECORDS)
def one_row_per_entity(spark, sf_dir):
    raw = order_records(spark, sf_dir).drop("Year")
    return panel_io.one_row_per_entity(raw, "Company Code", ["record"])


@query(
    f'SELECT f.*, CAST(y.y AS INT) AS "Year" FROM ({FIRST_RECORDS}) f CROSS JOIN range(2010, 2025) y(y)'
)
def expand_years(spark, sf_dir):
    raw = order_records(spark, sf_dir).drop("Year")
    expanded, _ = panel_io.to_panel(raw, order=["record"])
    return expanded


@query("SELECT count(*) AS n_rows, count(*) AS n_ids FROM orders")
def synthetic_entity_id(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("Score"))
    named, entity = panel_io.with_entity(raw)
    return named.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(col(entity)).alias("n_ids")
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
       THEN CAST(year(o_orderdate) AS INT) END AS "Year" FROM orders"""
)
def normalize_year(spark, sf_dir):
    """Years written as whole numbers, as decimals, with letters, or not at all."""
    orders = table(spark, sf_dir, "orders")
    text = F.year("o_orderdate").cast("string")
    kind = F.col("o_orderpriority")
    written = F.when(kind == "1-URGENT", text).when(kind == "2-HIGH", F.concat(text, F.lit(".0")))
    written = written.when(kind == "3-MEDIUM", F.concat(F.lit("FY"), text))
    written = written.when(kind == "5-LOW", F.concat(text, F.lit("d")))
    return orders.select("o_orderkey", year_of(written).alias("Year"))


@query(q.PANEL + f"SELECT {KEYS}, {q.rating_norm('\"Rating\"')} AS rating FROM panel")
def normalize_rating(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return rows.select("Company Code", "Year", normalized(col("Rating")).alias("rating"))


@query(
    q.PANEL
    + f"""SELECT rating, {q.rating_ord('rating')} AS rating_ord, count(*) AS n
FROM (SELECT {q.rating_norm('"Rating"')} AS rating FROM panel) GROUP BY rating"""
)
def rating_ordinal(spark, sf_dir):
    rows = panel(spark, sf_dir).select(normalized(col("Rating")).alias("rating"))
    ranked = rows.withColumn("rating_ord", ordinal_of(F.col("rating")))
    counted = ranked.groupBy("rating", "rating_ord").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("rating_ord")


@query(q.PANEL + f"SELECT {KEYS}, {q.label('\"Rating\"')} AS label FROM panel")
def ig_label(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return rows.select("Company Code", "Year", label_of(col("Rating")).alias("label"))


@query(
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL WHEN p_size >= 40 THEN NULL
       ELSE CAST(substr(p_brand, 7) AS DOUBLE) END AS x FROM part"""
)
def coerce_numeric(spark, sf_dir):
    """Numbers in words, plain, padded, in scientific form and with a letter behind."""
    part = table(spark, sf_dir, "part")
    digits = F.substring("p_brand", 7, 10)
    size = F.col("p_size")
    written = F.when(size < 10, F.col("p_brand")).when(size < 20, digits)
    written = written.when(size < 30, F.concat(F.lit("\t "), digits, F.lit(" ")))
    written = written.when(size < 40, F.concat(digits, F.lit(".0e0")))
    written = written.otherwise(F.concat(digits, F.lit("d")))
    return coerce_columns(part.select("p_partkey", written.alias("x")), ["x"])


def _clipped_sql(names: list[str]) -> str:
    bounds = ", ".join(
        f'quantile_cont("{n}", 0.01) AS lo{i}, quantile_cont("{n}", 0.99) AS hi{i}'
        for i, n in enumerate(names)
    )
    values = ", ".join(
        f"""round(CASE WHEN "{n}" < lo{i} THEN lo{i} WHEN "{n}" > hi{i} THEN hi{i}
            ELSE "{n}" END, 6) AS "{n}" """
        for i, n in enumerate(names)
    )
    return f"{q.PANEL}, b AS (SELECT {bounds} FROM panel) SELECT {KEYS}, {values} FROM panel, b"


@query(_clipped_sql(["Current Ratio"]))
def winsorize(spark, sf_dir):
    rows = panel(spark, sf_dir).select("Company Code", "Year", "Current Ratio")
    return rounded(clip.winsorize(rows, "Current Ratio"), "Current Ratio")


@query(_clipped_sql(q.FEATURES))
def winsorize_all(spark, sf_dir):
    rows = panel(spark, sf_dir).select("Company Code", "Year", *q.FEATURES)
    return rounded(clip.winsorize_all(rows, [*q.FEATURES, "Quick Ratio"]), *q.FEATURES)


FORMATTED = ["Gross Profit Margin", "ROA", "Net Income"]


@query(
    q.PANEL
    + "SELECT "
    + KEYS
    + "".join(
        f", CASE WHEN \"{n}\" IS NULL THEN 'N/A' ELSE {q.metric_text(n, f'\"{n}\"')} END AS \"{n}\""
        for n in [*FORMATTED, "Current Ratio"]
    )
    + " FROM panel"
)
def format_metric(spark, sf_dir):
    rows = panel(spark, sf_dir)
    texts = [metric_text_of(F.lit(n), col(n)).alias(n) for n in [*FORMATTED, "Current Ratio"]]
    return rows.select("Company Code", "Year", *texts)


@query(
    q.PANEL
    + f"""SELECT {KEYS}, {q.magnitude('"Gross Profit"')} AS gross_profit,
{q.magnitude('("Total Assets" * 1000)')} AS total_assets,
{q.magnitude('"Interest Coverage Ratio"')} AS coverage FROM panel"""
)
def format_magnitude(spark, sf_dir):
    return panel(spark, sf_dir).select(
        "Company Code",
        "Year",
        magnitude_text(col("Gross Profit")).alias("gross_profit"),
        magnitude_text(col("Total Assets") * 1000).alias("total_assets"),
        magnitude_text(col("Interest Coverage Ratio")).alias("coverage"),
    )


@query(
    q.PANEL
    + f"""SELECT {KEYS}, CASE WHEN "Score" BETWEEN 0 AND 1 THEN "Score" * 100 ELSE "Score" END
AS score, CASE WHEN "Current Ratio" BETWEEN 0 AND 1 THEN "Current Ratio" * 100
ELSE "Current Ratio" END AS ratio FROM panel"""
)
def rescale_score(spark, sf_dir):
    return panel(spark, sf_dir).select(
        "Company Code",
        "Year",
        rescaled(col("Score")).alias("score"),
        rescaled(col("Current Ratio")).alias("ratio"),
    )


@query(q.PANEL + 'SELECT * FROM panel WHERE "Year" IN (1996, 1998, 2001)')
def filter_years(spark, sf_dir):
    return filters.filter_years(panel(spark, sf_dir), [1996, 1998, 2001])


@query(q.PANEL + 'SELECT * FROM panel WHERE "Year" >= (SELECT max("Year") - 3 FROM panel)')
def recent_years(spark, sf_dir):
    return filters.recent_years(panel(spark, sf_dir), back=3)


@query(
    q.PANEL
    + f"""SELECT {KEYS}, "Score" FROM (SELECT *, dense_rank() OVER (
PARTITION BY "Company Code" ORDER BY "Year" DESC) AS place FROM panel) WHERE place <= 3"""
)
def last_k_entity_years(spark, sf_dir):
    rows = panel(spark, sf_dir).select("Company Code", "Year", "Score")
    return filters.last_k_entity_years(rows, 3)


@query(
    q.PANEL
    + """SELECT * FROM panel WHERE CAST("Company Code" AS VARCHAR) =
(SELECT min(CAST("Company Code" AS VARCHAR)) FROM panel)"""
)
def entity_rows(spark, sf_dir):
    rows = panel(spark, sf_dir)
    first = rows.agg(F.min(F.col("Company Code").cast("string")).alias("first")).first()
    return filters.entity_rows(rows, first["first"])


@query(
    q.RECORDS
    + """SELECT "Company Code", "Year", record, amount, priority, status FROM (
  SELECT *, row_number() OVER (PARTITION BY "Company Code", "Year" ORDER BY record) AS place
  FROM records) WHERE place = 1"""
)
def first_records(spark, sf_dir):
    rows = order_records(spark, sf_dir)
    return filters.first_records(rows, ["Company Code", "Year"], ["record"])


@query(
    q.RECORDS
    + """, c AS (SELECT min(CAST("Company Code" AS VARCHAR)) AS code FROM records),
y AS (SELECT max("Year") AS latest FROM records, c WHERE CAST("Company Code" AS VARCHAR) = code)
SELECT "Company Code", "Year", record, amount, priority, status FROM (
  SELECT records.*, row_number() OVER (ORDER BY record) AS place FROM records, c, y
  WHERE CAST("Company Code" AS VARCHAR) = code AND "Year" = latest) WHERE place = 1"""
)
def entity_year_row(spark, sf_dir):
    """First record of the latest year of the company whose id is the first as text."""
    rows = order_records(spark, sf_dir)
    code = rows.agg(F.min(F.col("Company Code").cast("string"))).first()[0]
    latest = filters.entity_rows(rows, code).agg(F.max("Year")).first()[0]
    return filters.entity_year_row(rows, code, latest, ["record"])


@query(
    q.PANEL
    + f"SELECT {KEYS}, {q.quoted(q.FEATURES)} FROM panel WHERE "
    + " AND ".join(f'"{f}" IS NOT NULL' for f in q.FEATURES)
)
def complete_cases(spark, sf_dir):
    rows = panel(spark, sf_dir).select("Company Code", "Year", *q.FEATURES)
    return filters.complete_cases(rows, q.FEATURES)


@query(
    q.PANEL
    + f"""SELECT * FROM (SELECT {KEYS}, {q.rating_ord(q.rating_norm('"Rating"'))} - 1 AS label
FROM panel) WHERE label IN (0, 1)"""
)
def valid_labels(spark, sf_dir):
    place = ordinal_of(normalized(col("Rating"))) - 1
    rows = panel(spark, sf_dir).select("Company Code", "Year", place.alias("label"))
    return filters.valid_labels(rows)
