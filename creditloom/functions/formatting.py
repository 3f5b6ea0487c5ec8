"""Text forms of metrics and amounts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.catalog import FRACTION_METRICS, MAGNITUDES, MISSING_TEXT, PERCENT_METRICS


# From here on a double has more digits before the point than the formatter looks at.
_LONG = float(2**43)
_NO_FRACTION = float(2**53)


def _two_decimals(x: Column, pattern: str) -> Column:
    """Text of the exact binary value, rounded half to even at the second decimal."""
    fraction = F.pmod(x, F.lit(1.0))
    cents = F.rint(fraction * 100).cast("decimal(5,0)")
    exact = (x - fraction).cast("decimal(20,2)") + cents / F.lit(100).cast("decimal(3,0)")
    long = F.abs(x).between(_LONG, _NO_FRACTION)
    written = F.call_function("format_number", x, F.lit(pattern))
    # The branch guards the cast as well as the text.
    return F.when(long, F.call_function("format_number", exact, F.lit(pattern))).otherwise(written)


def fixed2(x: Column) -> Column:
    return _two_decimals(x, "0.00")


def thousands2(x: Column) -> Column:
    return _two_decimals(x, "#,##0.00")


def format_metric(name: Column, value: Column) -> Column:
    """``12.34%`` for percent and fraction metrics, ``1,234.56`` for the others."""
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(MISSING_TEXT))
        .when(name.isin(PERCENT_METRICS), F.concat(fixed2(value), F.lit("%")))
        .when(name.isin(FRACTION_METRICS), F.concat(fixed2(value * 100), F.lit("%")))
        .otherwise(thousands2(value))
    )


def format_magnitude(value: Column) -> Column:
    """Amount with two decimals in the largest unit it reaches."""
    size, unit = F, F
    for amount, name in MAGNITUDES:
        reached = F.abs(value) >= amount
        size = size.when(reached, F.lit(float(amount)))
        unit = unit.when(reached, F.lit(" " + name))
    text = F.concat(fixed2(value / size.otherwise(1.0)), unit.otherwise(""))
    return F.when(value.isNull() | F.isnan(value), F.lit(MISSING_TEXT)).otherwise(text)
