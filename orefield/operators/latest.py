"""First / latest row per key and upserts over append-only tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key.

    Catalyst turns the rank filter into a WindowGroupLimit on both sides of the shuffle, so a
    task sends on at most ``n`` rows of a key however many it holds: a hot key does not pile up.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Latest row per key over both inputs; on equal versions the change wins.

    A change overwrites the row as INSERT .. ON CONFLICT DO UPDATE would, with nothing updated in
    place: applying the same changes twice gives the same table.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    order = [F.desc(c) for c in version] + [F.desc("_new")]
    return first_per_key(both, keys, order).drop("_new")


def insert_absent(current: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key the table does not hold yet (one row per key)."""
    fresh = candidates.dropDuplicates(keys)
    return fresh.join(current.select(*keys).distinct(), keys, "left_anti")


def latest_per_source(df: DataFrame, keys: list[str], at: str, tiebreak: list[str]) -> DataFrame:
    return first_per_key(df, keys, [F.desc(at)] + [F.desc(c) for c in tiebreak])
