"""Averages, ratios and percentages that do not depend on summation order."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_integer(df: DataFrame, column: str) -> Column:
    """Cast to int, rounding fractions: halves to even for floats, away from zero for decimals."""
    dtype, value = df.schema[column].dataType, F.col(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = F.rint(value)
    elif isinstance(dtype, T.DecimalType):
        value = F.round(value, 0)
    return value.cast("int")


def average(column, decimals: int = 2) -> Column:
    """Mean over an exact decimal sum: the same for every partitioning of the input."""
    c = F.col(column) if isinstance(column, str) else column
    total = F.sum(c.cast(f"decimal(18,{decimals})"))
    return total.cast("double") / F.count(c)


def rounded_average(column, digits: int = 2, decimals: int = 2) -> Column:
    """Mean rounded half up on the exact decimal quotient, so ties never hang on binary digits."""
    c = F.col(column) if isinstance(column, str) else column
    total = F.sum(c.cast(f"decimal(18,{decimals})"))
    return F.round(total / F.nullif(F.count(c), F.lit(0)).cast("decimal(20,0)"), digits).cast("double")


def ratio(part, whole) -> Column:
    """part / whole as double; null where whole is zero."""
    return F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))


def percent(part, whole, digits: int | None = 2, empty=None) -> Column:
    """100 * part / whole, rounded; ``empty`` stands in where whole is zero."""
    value = F.try_divide(
        F.lit(100.0) * part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0))
    )
    if digits is not None:
        value = F.round(value, digits)
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))
