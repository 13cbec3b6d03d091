"""Exact distinct counts that can be merged: bitmaps over whole numbers, in buckets of 32,768.

A set is rows (bucket, bits) with 4 kB of bits each, so ids should be dense: customers and products
numbered by a key table, not hashes. Nulls are in no set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(value: Column) -> Column:
    return F.bitmap_bucket_number(value.cast("bigint"))


def constructed(value: Column) -> Column:
    """Aggregate: the bits of the values of one bucket."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(value.cast("bigint")))


def merged(bits: Column) -> Column:
    """Aggregate: the union of bits of one bucket."""
    return F.bitmap_or_agg(bits)


def count(bits: Column) -> Column:
    return F.bitmap_count(bits)
