"""Column names and word lists a credit panel is read by.

All lists below are fixed values: results depend on their text and order.
"""

ENTITY = "Company Code"
YEAR = "Year"
RATING = "Rating"
SCORE = "Score"

# Entity columns in order of precedence, and the generated years.
ENTITY_CANDIDATES = ["Company Code", "Company"]
FIRST_YEAR = 2010
LAST_YEAR = 2024

# The rating scale, best first, and the bucket for anything else.
RATING_ORDER = ["AAA", "AA", "A", "BBB", "BB", "B", "CCC", "CC", "C", "D"]
UNRATED = "NAN"
RATING_DOMAIN = RATING_ORDER + [UNRATED]
INVESTMENT_GRADE = ["AAA", "AA", "A", "BBB"]

# Ratios used as model features.
RATIO_FEATURES = [
    "Debt-to-Assets Ratio",
    "Debt-to-Equity Ratio",
    "Debt-to-Capital Ratio",
    "Debt-to-EBITDA Ratio",
    "Asset-to-Equity Ratio",
    "Current Ratio",
    "Quick Ratio",
    "Interest Coverage Ratio",
    "EBITDA Interest Coverage",
    "Gross Profit Margin",
    "Net Profit Margin",
    "Operating Profit Margin",
    "ROA",
    "ROE",
    "Cash_Flow_to_Total_Debt",
    "Retained_Cash_Flow_to_Net_Debt",
]

# Names that can not be the entity column.
EXPECTED_METRICS = [
    "Gross Profit Margin",
    "Net Profit Margin",
    "General Profitability (Operating)",
    "EBITA_to_Assets",
    "Operating Profit Margin",
    "ROA",
    "ROE",
    "Cash_Flow_to_Total_Debt",
    "Retained_Cash_Flow_to_Net_Debt",
    "Score",
    "Rating",
]

# Metrics held as percent, and metrics held as a fraction.
PERCENT_METRICS = ["Gross Profit Margin", "Operating Profit Margin", "Net Profit Margin"]
FRACTION_METRICS = [
    "ROA",
    "ROE",
    "EBITA_to_Assets",
    "Cash_Flow_to_Total_Debt",
    "Retained_Cash_Flow_to_Net_Debt",
]

# Amounts shown per company-year.
CARD_AMOUNTS = [
    "Total Assets",
    "Owner's Equity",
    "Sales and Service Revenue",
    "Net Income",
    "EBITDA",
    "Total Debt",
    "Operating Cash Flow",
    "Cash and Cash Equivalents",
]
RATING_DESCRIPTION = "Rating_Description"

# Units of large amounts, largest first.
MAGNITUDES = [(1_000_000_000, "tỷ"), (1_000_000, "tr"), (1_000, "nghìn")]
MISSING_TEXT = "N/A"

# Display groups.
METRIC_GROUPS = {
    "Profitability": [
        "Gross Profit Margin",
        "Net Profit Margin",
        "General Profitability (Operating)",
        "EBITA_to_Assets",
        "Operating Profit Margin",
        "ROA",
        "ROE",
        "Gross Profit",
        "Operating Profit",
        "Net Income",
        "EBIT",
        "EBITDA",
    ],
    "Liquidity": [
        "Current Assets",
        "Current Liabilities",
        "Quick Assets",
        "Current Ratio",
        "Quick Ratio",
        "Cash and Cash Equivalents",
        "Cash",
        "Cash Equivalents",
    ],
    "Leverage": [
        "Total Debt",
        "Total Equity",
        "Debt-to-Assets Ratio",
        "Debt-to-Equity Ratio",
        "Debt-to-Capital Ratio",
        "Debt-to-EBITDA Ratio",
        "Total Capital",
        "Asset-to-Equity Ratio",
    ],
    "Coverage": [
        "Interest Coverage Ratio",
        "EBITDA Interest Coverage",
        "DSCR",
        "Cash Coverage Ratio",
        "Interest Expenses",
        "Total Debt Service",
    ],
    "Cash flow": [
        "Operating Cash Flow",
        "Retained Cash Flow",
        "Cash_Flow_to_Total_Debt",
        "Retained_Cash_Flow_to_Net_Debt",
        "Net Debt",
        "Cash Flow from Operating Activities",
        "Cash Flow from Investing Activities",
        "Cash Flow from Financing Activities",
    ],
}

# Metrics compared with the market, and the trend sets.
KEY_METRICS = [
    "ROA",
    "ROE",
    "Debt-to-Equity Ratio",
    "Current Ratio",
    "Net Profit Margin",
    "Operating Profit Margin",
]
REVENUE_METRICS = [
    "Sales and Service Revenue",
    "Gross Profit",
    "Operating Profit",
    "EBIT",
    "EBITDA",
    "Net Income",
]
CASH_FLOW_METRICS = [
    "Cash Flow from Operating Activities",
    "Cash Flow from Investing Activities",
    "Cash Flow from Financing Activities",
    "Net Cash Flow during the Period",
]
TREND_METRICS = (
    ["Score", "ROA", "ROE", "Debt-to-Equity Ratio", "Current Ratio", "Quick Ratio"]
    + REVENUE_METRICS
    + CASH_FLOW_METRICS
    + ["Total Assets", "Total Debt"]
)
