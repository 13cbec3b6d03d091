"""Masking of personal columns by tag."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_column(column: str, tag: str) -> Column:
    """``direct`` identifiers keep their shape only, ``indirect`` ones become a stable hash."""
    value = F.col(column).cast("string")
    if tag == "direct":
        return F.regexp_replace(F.regexp_replace(value, "[A-Za-z]", "x"), "[0-9]", "n")
    if tag == "indirect":
        return F.sha2(value, 256)
    return F.col(column)
