"""Joins on keys of which a few are very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch may name as heavy; what is collected is never more.
MOST_HEAVY = 100


def heavy_keys(rows: DataFrame, key: str, share: float, most: int = MOST_HEAVY) -> list:
    """Keys that hold more than ``share`` of the rows, by a mergeable sketch of bounded size in one pass.

    The sketch may name a key too many; it names every key above the share as long as 1 / share keys fit
    into it. Nulls, which join nothing, are not named.
    """
    found = rows.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {100 * most})").alias("top")).first()
    return [x["item"] for x in found["top"] or () if x["count"] > share * found["n"]]


def salt_of(heavy: list, key: str, salts: int, spread: list[str]) -> Column:
    """0 for usual keys; rows of heavy ones are dealt by a hash of ``spread``, the same when a task runs again."""
    own = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    return F.when(F.col(key).isin(heavy), own).otherwise(F.lit(0)) if heavy else F.lit(0)


def heavy_join(
    large: DataFrame, small: DataFrame, key: str, how: str = "inner", parts: int | None = None, share: float | None = None, spread: list[str] | None = None
) -> DataFrame:
    """``large`` joined with ``small`` on ``key``, where a few keys may hold most rows of ``large``.

    Keys that would fill more than a quarter of a partition by themselves are salted: their rows of
    ``large`` are dealt over all partitions and their rows of ``small`` are sent to each. All others
    are joined as usual. ``how`` is inner, left, left_semi or left_anti; rows are neither lost nor doubled.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of the small side meet several copies of a salt in a join of kind {how}")
    parts = parts or int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(large, key, share or 0.25 / parts)
    salted = large.withColumn("_salt", salt_of(heavy, key, parts, spread or large.columns))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    copies = F.when(F.col(key).isin(heavy), every).otherwise(F.array(F.lit(0))) if heavy else F.array(F.lit(0))
    return salted.join(small.withColumn("_salt", F.explode(copies)), [key, "_salt"], how).drop("_salt")
