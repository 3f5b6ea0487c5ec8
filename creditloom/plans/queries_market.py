"""Market and company views."""

from pyspark.sql import functions as F

from creditloom.catalog import RATING_DOMAIN, TREND_METRICS
from creditloom.functions.columns import col
from creditloom.operators import company, market
from creditloom.plans import panel_sql as q
from creditloom.plans.panel import order_records, panel
from creditloom.plans.registry import query, rounded

KEYS = '"Company Code", "Year"'
# The order priorities that may occur, with one that does not.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@query(
    q.RECORDS
    + f""", domain AS (SELECT unnest([{q.texts(PRIORITIES)}]) AS priority),
years AS (SELECT DISTINCT "Year" FROM records),
counted AS (SELECT "Year", priority, count(*) AS n FROM records GROUP BY ALL)
SELECT y."Year", d.priority, coalesce(c.n, 0) AS n FROM years y CROSS JOIN domain d
LEFT JOIN counted c ON c."Year" = y."Year" AND c.priority = d.priority"""
)
def densify_domain(spark, sf_dir):
    counted = order_records(spark, sf_dir).groupBy("Year", "priority").agg(
        F.count(F.lit(1)).alias("n")
    )
    return market.densify_domain(counted, PRIORITIES, "priority", "n", by=["Year"])


@query(
    q.PANEL
    + """SELECT count(DISTINCT "Company Code") AS n_entities, count(*) AS n_rows,
round(avg("Score"), 6) AS mean_score FROM panel"""
)
def market_kpis(spark, sf_dir):
    return rounded(market.market_kpis(panel(spark, sf_dir)), "mean_score")


@query(q.PANEL + 'SELECT DISTINCT "Year" FROM panel')
def distinct_years(spark, sf_dir):
    return market.distinct_years(panel(spark, sf_dir))


@query(q.PANEL + 'SELECT DISTINCT CAST("Company Code" AS VARCHAR) AS "Company Code" FROM panel')
def distinct_entities(spark, sf_dir):
    return market.distinct_entities(panel(spark, sf_dir))


RATED = q.PANEL + f""", rated AS (SELECT "Year", {q.rating_norm('"Rating"')} AS rating FROM panel),
domain AS (SELECT unnest([{q.texts(RATING_DOMAIN)}]) AS rating)
"""


@query(
    RATED
    + f""", counted AS (SELECT rating, count(*) AS n FROM rated
  WHERE "Year" >= (SELECT max("Year") - 9 FROM rated) GROUP BY rating),
dense AS (SELECT d.rating, coalesce(c.n, 0) AS n FROM domain d LEFT JOIN counted c USING (rating))
SELECT rating, n, {q.rating_ord('rating')} AS rating_ord,
round_even(n * 100.0::DOUBLE / (SELECT sum(n) FROM dense), 2) AS share_pct FROM dense"""
)
def rating_distribution(spark, sf_dir):
    from creditloom.operators.filters import recent_years

    return market.rating_distribution(recent_years(panel(spark, sf_dir)))


@query(
    RATED
    + 'SELECT "Year", '
    + ", ".join(f"count(*) FILTER (WHERE rating = '{r}') AS \"{r}\"" for r in RATING_DOMAIN)
    + ' FROM rated GROUP BY "Year"'
)
def rating_by_year(spark, sf_dir):
    return market.rating_by_year(panel(spark, sf_dir))


@query(
    RATED
    + f""", years AS (SELECT DISTINCT "Year" FROM rated),
counted AS (SELECT "Year", rating, count(*) AS n FROM rated GROUP BY ALL)
SELECT y."Year", d.rating, coalesce(c.n, 0) AS n, {q.rating_ord('d.rating')} AS rating_ord
FROM years y CROSS JOIN domain d
LEFT JOIN counted c ON c."Year" = y."Year" AND c.rating = d.rating"""
)
def rating_distribution_by_year(spark, sf_dir):
    return market.rating_distribution_by_year(panel(spark, sf_dir))


@query(
    q.RECORDS
    + f"SELECT {KEYS}, round(avg(amount), 6) AS amount FROM records GROUP BY ALL"
)
def merge_records_mean(spark, sf_dir):
    merged = company.merge_records_mean(order_records(spark, sf_dir), cols=["amount"])
    return rounded(merged, "amount")


def _mode_sql(name: str) -> str:
    return f"""SELECT {KEYS}, {name} FROM (
  SELECT {KEYS}, {name}, row_number() OVER (
    PARTITION BY {KEYS} ORDER BY count(*) DESC, {name}) AS place
  FROM records GROUP BY {KEYS}, {name}) WHERE place = 1"""


MODES = f""", p AS ({_mode_sql("priority")}), s AS ({_mode_sql("status")})"""


@query(q.RECORDS + MODES + f"SELECT {KEYS}, priority, status FROM p JOIN s USING ({KEYS})")
def merge_records_mode(spark, sf_dir):
    return company.merge_records_mode(order_records(spark, sf_dir))


@query(
    q.RECORDS
    + MODES
    + f""", m AS (SELECT {KEYS}, round(avg(amount), 6) AS amount FROM records GROUP BY ALL)
SELECT {KEYS}, amount, priority, status FROM m JOIN p USING ({KEYS}) JOIN s USING ({KEYS})"""
)
def merge_records(spark, sf_dir):
    return rounded(company.merge_records(order_records(spark, sf_dir).drop("record")), "amount")


TRENDS = ["Score", "ROA", "Current Ratio", "Sales and Service Revenue", "Gross Profit"]
TRENDS += ["Net Income", "Total Assets", "Total Debt"]


@query(
    q.PANEL
    + f"SELECT {KEYS}, "
    + ", ".join(f'round(avg("{n}"), 6) AS "{n}"' for n in TRENDS)
    + f""" FROM (SELECT *, dense_rank() OVER (PARTITION BY "Company Code" ORDER BY "Year" DESC)
AS place FROM panel) WHERE place <= 3 GROUP BY {KEYS}"""
)
def yearly_trend(spark, sf_dir):
    from creditloom.operators.filters import last_k_entity_years

    means = company.yearly_trend(panel(spark, sf_dir), TREND_METRICS)
    return rounded(last_k_entity_years(means, 3), *TRENDS)


COMPARED = ["Gross Profit Margin", "ROA", "Gross Profit", "Net Income", "Current Ratio"]


@query(
    q.PANEL
    + f"SELECT {KEYS}, indicator, round(mean, 6) AS mean FROM ("
    + " UNION ALL ".join(
        f"SELECT {KEYS}, '{n}' AS indicator, avg(\"{n}\") AS mean FROM panel GROUP BY {KEYS}"
        for n in COMPARED
    )
    + ")"
)
def comparison_pivot(spark, sf_dir):
    return rounded(company.comparison_pivot(panel(spark, sf_dir), COMPARED), "mean")


def _growth_sql(name: str) -> str:
    last = f'last_value("{name}" IGNORE NULLS) OVER w'
    return f'{last} AS "{name}"'


GROWN = ["Sales and Service Revenue", "Gross Profit", "Current Ratio"]


@query(
    q.PANEL
    + f""", filled AS (SELECT {KEYS}, {", ".join(_growth_sql(n) for n in GROWN)} FROM panel
  WINDOW w AS (PARTITION BY "Company Code" ORDER BY "Year" ROWS UNBOUNDED PRECEDING))
SELECT {KEYS}, """
    + ", ".join(
        f"""round(CASE WHEN lag("{n}") OVER w = 0 THEN NULL ELSE
("{n}" - lag("{n}") OVER w) / lag("{n}") OVER w END * 100, 6) AS "{n} growth %" """
        for n in GROWN
    )
    + """ FROM filled WINDOW w AS (PARTITION BY "Company Code" ORDER BY "Year")"""
)
def growth_pct(spark, sf_dir):
    grown = company.growth_pct(panel(spark, sf_dir), GROWN)
    return rounded(grown, *[f"{n} growth %" for n in GROWN])


@query(
    q.PANEL
    + f""", own AS (SELECT {KEYS}, avg("Score") AS own FROM panel GROUP BY ALL),
market AS (SELECT "Year", avg("Score") AS market FROM panel GROUP BY ALL),
both_sides AS (SELECT {KEYS}, own, market,
  CASE WHEN own BETWEEN 0 AND 1 AND market BETWEEN 0 AND 1 THEN 100.0::DOUBLE
  ELSE 1.0::DOUBLE END AS k FROM own JOIN market USING ("Year"))
SELECT {KEYS}, round(own * k, 6) AS company_score, round(market * k, 6) AS market_score,
round((own - market) * k, 6) AS difference FROM both_sides"""
)
def score_vs_market(spark, sf_dir):
    compared = company.score_vs_market(panel(spark, sf_dir))
    return rounded(compared, "company_score", "market_score", "difference")


def _versus(name: str) -> str:
    return f"""SELECT {KEYS}, '{name}' AS metric, coalesce("{name}", 0) AS company_value,
avg("{name}") OVER (PARTITION BY "Year") AS market_value FROM panel"""


VERSUS = q.PANEL + f""", versus AS ({_versus("ROA")} UNION ALL {_versus("Current Ratio")})
"""


@query(
    VERSUS
    + f"""SELECT {KEYS}, metric, round(company_value, 6) AS company_value,
round(market_value, 6) AS market_value,
round(company_value - market_value, 6) AS difference FROM versus"""
)
def metrics_vs_market(spark, sf_dir):
    compared = company.metrics_vs_market(panel(spark, sf_dir))
    return rounded(compared, "company_value", "market_value", "difference")


@query(
    VERSUS
    + f"""SELECT {KEYS}, metric, 'company' AS side, round(company_value, 6) AS value FROM versus
UNION ALL SELECT {KEYS}, metric, 'market' AS side, round(market_value, 6) AS value FROM versus"""
)
def metrics_vs_market_long(spark, sf_dir):
    return rounded(company.metrics_vs_market_long(panel(spark, sf_dir)), "value")


CARDS = ["Total Assets", "Sales and Service Revenue", "Net Income", "Total Debt"]
CARDS += ["Operating Cash Flow"]


@query(
    q.PANEL
    + f"""SELECT {KEYS}, coalesce(upper("Rating"), 'NAN') AS "Rating",
{q.fixed2('(CASE WHEN "Score" BETWEEN 0 AND 1 THEN "Score" * 100 ELSE "Score" END)')} AS "Score", """
    + ", ".join(f'{q.magnitude(f"{chr(34)}{n}{chr(34)}")} AS "{n}"' for n in CARDS)
    + " FROM panel"
)
def metric_cards(spark, sf_dir):
    return company.metric_cards(company.merge_records(panel(spark, sf_dir)))


# What each display group finds among the columns of the panel; a short column name such
# as Rating is contained in longer metric names.
GROUPED = {
    "Profitability": [
        "Gross Profit Margin",
        "Rating",
        "ROA",
        "Gross Profit",
        "Net Income",
    ],
    "Liquidity": ["Current Ratio", "Operating Cash Flow"],
    "Leverage": ["Total Debt", "Debt-to-Assets Ratio"],
    "Coverage": ["Interest Coverage Ratio", "Total Debt"],
    "Cash flow": ["Operating Cash Flow", "Rating"],
}


def _group_sql(group: str, name: str) -> str:
    head = f"SELECT {KEYS}, '{group}' AS metric_group, '{name}' AS metric, "
    if name == "Rating":
        return head + 'CAST(NULL AS DOUBLE) AS value, "Rating" AS text FROM panel'
    column = f'"{name}"'
    return head + f"{column} AS value, {q.metric_text(name, column)} AS text FROM panel"


@query(
    q.PANEL
    + "SELECT * FROM ("
    + " UNION ALL ".join(_group_sql(g, n) for g, names in GROUPED.items() for n in names)
    + ") WHERE text IS NOT NULL"
)
def metric_group_long(spark, sf_dir):
    return company.metric_group_long(panel(spark, sf_dir))


@query(
    q.PANEL
    + """SELECT * FROM panel WHERE CAST("Company Code" AS VARCHAR) =
(SELECT min(CAST("Company Code" AS VARCHAR)) FROM panel)"""
)
def entity_detail(spark, sf_dir):
    rows = panel(spark, sf_dir)
    first = rows.agg(F.min(col("Company Code").cast("string")).alias("first")).first()
    return company.entity_detail(rows, first["first"], all_years=True)
