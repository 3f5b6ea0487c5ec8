"""Column expressions for cleaning: all built-in functions, no Python per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.catalog import INVESTMENT_GRADE, RATING_DOMAIN, RATING_ORDER, UNRATED

_EDGE_SPACE = r"(?U)^\s+|\s+$"
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def col(name: str) -> Column:
    """Column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_double() -> Column:
    return F.lit(None).cast("double")


def strip(x: Column) -> Column:
    """Remove all white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(x, _EDGE_SPACE, "")


def parse_number(x: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    text = strip(x)
    number = F.when(text.rlike(_NUMBER), text).try_cast("double")
    return F.nanvl(number, null_double())


def numeric(df: DataFrame, name: str) -> Column:
    """``name`` as double with NULL (never NaN) for missing, by its type in ``df``."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return parse_number(col(name))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(col(name).cast("double"), null_double())
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return col(name).cast("double")
    return null_double()


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({name: numeric(df, name) for name in cols})


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def normalize_year(x: Column) -> Column:
    """Year to int: ``2010``, ``'2010'`` and ``'2010.0'`` are 2010, other text is NULL
    (``'2010d'`` too, which a plain cast would take for a number)."""
    return parse_number(x.cast("string")).try_cast("int")


def normalize_rating(x: Column) -> Column:
    """Rating of the scale in upper case, ``NAN`` for NULL or anything else."""
    clean = F.upper(strip(x))
    return F.when(clean.isin(RATING_ORDER), clean).otherwise(F.lit(UNRATED))


def rating_ordinal(x: Column) -> Column:
    """1 for the best rating to 11 for ``NAN``; sorts a normalised rating."""
    return F.array_position(F.array(*map(F.lit, RATING_DOMAIN)), x).cast("int")


def ig_label(x: Column) -> Column:
    """1 for investment grade, 0 for every other text and for NULL."""
    return F.when(F.upper(strip(x)).isin(INVESTMENT_GRADE), 1).otherwise(0)


def rescale_score(x: Column) -> Column:
    """Score on a 0-100 scale when it is held as a fraction."""
    return F.when(x.between(0, 1), x * 100).otherwise(x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def key_hash(*parts: Column) -> Column:
    """Stable 32-bit hash of the key as bigint, the same in any SQL engine with md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def key_hash52(*parts: Column) -> Column:
    """As ``key_hash`` with 52 bits (exact as a double), for orders with hardly a tie."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
