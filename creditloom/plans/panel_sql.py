"""The panel and recurring expressions in the SQL of the check engine."""

from creditloom.catalog import INVESTMENT_GRADE, RATING_DOMAIN, RATING_ORDER

PANEL = """
WITH li AS (
  SELECT o.o_custkey AS company_code, year(o.o_orderdate) AS yr, l.l_returnflag, l.l_linestatus,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS ep,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS disc,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(4,2)) AS tax,
         CAST(l.l_quantity AS DECIMAL(9,2)) * CAST(p.p_retailprice AS DECIMAL(12,2)) AS cost
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey),
agg AS (
  SELECT company_code, yr, CAST(SUM(ep) AS DOUBLE) ep, CAST(SUM(disc) AS DOUBLE) disc,
         CAST(SUM(tax) AS DOUBLE) tax, CAST(SUM(cost) AS DOUBLE) cost,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN ep ELSE 0 END) AS DOUBLE) ret,
         CAST(SUM(CASE WHEN l_linestatus = 'O' THEN ep ELSE 0 END) AS DOUBLE) open_amt
  FROM li GROUP BY company_code, yr),
panel AS (
  SELECT a.company_code AS "Company Code", CAST(a.yr AS INT) AS "Year",
    CASE WHEN c.c_acctbal >= 9000 THEN 'AAA' WHEN c.c_acctbal >= 8000 THEN ' aa'
         WHEN c.c_acctbal >= 7000 THEN 'A ' WHEN c.c_acctbal >= 6000 THEN 'bbb'
         WHEN c.c_acctbal >= 5000 THEN 'BB' WHEN c.c_acctbal >= 4000 THEN 'B'
         WHEN c.c_acctbal >= 3000 THEN 'ccc ' WHEN c.c_acctbal >= 2000 THEN 'CC'
         WHEN c.c_acctbal >= 1000 THEN 'C' WHEN c.c_acctbal >= 0 THEN 'D'
         WHEN c.c_acctbal >= -500 THEN 'N/R' ELSE NULL END AS "Rating",
    a.ep - a.disc AS "Sales and Service Revenue",
    a.ep - a.disc - a.cost AS "Gross Profit",
    a.ep - a.disc - a.cost - a.tax AS "Net Income",
    a.ep AS "Total Assets",
    a.ret AS "Total Debt",
    a.ep - a.disc - a.open_amt AS "Operating Cash Flow",
    100.0::DOUBLE * (a.ep - a.disc - a.cost) / (a.ep - a.disc) AS "Gross Profit Margin",
    a.tax / a.ep AS "ROA",
    a.ret / a.ep AS "Debt-to-Assets Ratio",
    CASE WHEN a.open_amt = 0 THEN NULL ELSE a.ep / a.open_amt END AS "Current Ratio",
    CASE WHEN a.ret = 0 THEN NULL ELSE (c.c_acctbal + 1000.0::DOUBLE) * 20 / a.ret END
      AS "Interest Coverage Ratio",
    (c.c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE AS "Score"
  FROM agg a JOIN customer c ON a.company_code = c.c_custkey)
"""

RECORDS = """
WITH records AS (
  SELECT o_custkey AS "Company Code", CAST(year(o_orderdate) AS INT) AS "Year",
         o_orderkey AS record, o_totalprice AS amount, o_orderpriority AS priority,
         o_orderstatus AS status
  FROM orders)
"""

FEATURES = [
    "Debt-to-Assets Ratio",
    "Current Ratio",
    "Interest Coverage Ratio",
    "Gross Profit Margin",
    "ROA",
]


def quoted(names: list[str]) -> str:
    return ", ".join(f'"{name}"' for name in names)


def texts(names: list[str]) -> str:
    return ", ".join("'" + name + "'" for name in names)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def rating_norm(x: str) -> str:
    word = f"upper({strip(x)})"
    return f"CASE WHEN {word} IN ({texts(RATING_ORDER)}) THEN {word} ELSE 'NAN' END"


def rating_ord(x: str) -> str:
    return f"CAST(list_position([{texts(RATING_DOMAIN)}], {x}) AS INT)"


def label(x: str) -> str:
    return f"CASE WHEN upper({strip(x)}) IN ({texts(INVESTMENT_GRADE)}) THEN 1 ELSE 0 END"


def hash32(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def hash52(*parts: str) -> str:
    return hash32(*parts).replace("1, 8)", "1, 13)")


def fixed2(x: str) -> str:
    return f"printf('%.2f', {x})"


def thousands2(x: str) -> str:
    return "format('{:,.2f}', " + x + ")"


def metric_text(name: str, x: str) -> str:
    """Text of one metric, by the form in which it is held."""
    from creditloom.catalog import FRACTION_METRICS, PERCENT_METRICS

    if name in PERCENT_METRICS:
        return f"{fixed2(x)} || '%'"
    if name in FRACTION_METRICS:
        return f"{fixed2(f'({x} * 100)')} || '%'"
    return thousands2(x)


def magnitude(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN 'N/A' "
        f"WHEN abs({x}) >= 1e9 THEN {fixed2(f'({x} / 1e9)')} || ' tỷ' "
        f"WHEN abs({x}) >= 1e6 THEN {fixed2(f'({x} / 1e6)')} || ' tr' "
        f"WHEN abs({x}) >= 1e3 THEN {fixed2(f'({x} / 1e3)')} || ' nghìn' "
        f"ELSE {fixed2(x)} END"
    )


# A score in [0, 1) that carries part of the rating, against the investment-grade label.
SCORED = (
    PANEL
    + f""", scored AS (
  SELECT "Company Code", "Year", {label('"Rating"')} AS label,
         "Interest Coverage Ratio" / (1 + "Interest Coverage Ratio") AS score
  FROM panel WHERE "Interest Coverage Ratio" IS NOT NULL)
"""
)

COMPLETE = (
    PANEL
    + f""", ml AS (
  SELECT "Company Code", "Year", {label('"Rating"')} AS label, {quoted(FEATURES)}
  FROM panel WHERE "Rating" IS NOT NULL AND {" AND ".join(f'"{f}" IS NOT NULL' for f in FEATURES)})
"""
)
