"""Timestamp conversion and differences."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: text of this form is read as epoch seconds.
EPOCH_TEXT = r"^\s*\d+\.?\d*\s*$"


def convert_timestamp(df: DataFrame, column: str) -> Column:
    """Turn epoch numbers, epoch text, ISO text or timestamps into timestamp_ntz.

    The branch on the column's type is taken while the plan is built, so each row only
    pays for the text test when the column really is text.
    """
    dtype = df.schema[column].dataType
    value = F.col(column)
    if isinstance(dtype, T.NumericType):
        return _from_epoch(value.cast("double"))
    if isinstance(dtype, T.StringType):
        return F.when(value.rlike(EPOCH_TEXT), _from_epoch(F.trim(value).try_cast("double"))).otherwise(
            value.try_cast("timestamp").cast("timestamp_ntz")
        )
    return value.cast("timestamp_ntz")


def _from_epoch(seconds: Column) -> Column:
    micros = F.round(seconds * F.lit(1e6)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


def seconds_between(later, earlier) -> Column:
    """Whole and fractional seconds as double, exact to the microsecond."""
    micros = F.timestamp_diff("MICROSECOND", _ts(earlier), _ts(later))
    return micros.cast("double") / F.lit(1e6)


def hours_between(later, earlier, digits: int | None = 2) -> Column:
    hours = F.timestamp_diff("MICROSECOND", _ts(earlier), _ts(later)).cast("double") / F.lit(3.6e9)
    return hours if digits is None else F.round(hours, digits)


def _ts(value) -> Column:
    if isinstance(value, str):
        value = F.col(value)
    return value.cast("timestamp_ntz")
