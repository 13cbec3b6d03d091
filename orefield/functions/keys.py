"""Hash keys and order-free dataset fingerprints."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKEN = "_null_"


def _joined(columns, null_token):
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(null_token)) for c in columns]
    return F.concat_ws("|", *parts)


def surrogate_key(*columns: str) -> Column:
    """md5 over the columns as text, so the same business key always hashes the same."""
    return F.md5(_joined(columns, NULL_TOKEN))


def row_digest(*columns: str) -> Column:
    """First 32 bits of the row's md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(_joined(columns, NULL_TOKEN)), 1, 8), 16, 10).cast("bigint")


def dataset_fingerprint(*columns: str) -> Column:
    """Sum of row digests: independent of row order, file layout and partitioning.

    decimal(38,0) keeps the sum exact past 2**31 rows, where a bigint of 32-bit terms overflows.
    """
    return F.sum(row_digest(*columns).cast("decimal(20,0)")).cast("decimal(38,0)")
