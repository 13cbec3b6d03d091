"""Slowly-changing history (type 2) of a source's rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slowly_changing(
    versions: DataFrame, keys: list[str], tracked: list[str], day: str, tiebreak: list[str]
) -> DataFrame:
    """Validity ranges of the tracked columns, from one snapshot per key and day.

    The last version of each day is found by a grouped aggregate, which combines before the
    shuffle; the windows then see at most one row per key and calendar day, however many versions
    a busy key has.
    """
    last = F.max_by(F.struct(*tracked), F.struct(*tiebreak))
    daily = versions.groupBy(*keys, day).agg(last.alias("state"))
    history = Window.partitionBy(*keys).orderBy(day)
    changed = daily.withColumn("before", F.lag("state").over(history)).where(
        ~F.col("state").eqNullSafe(F.col("before"))
    )
    until = F.lead(day).over(history)
    return (
        changed.withColumn("valid_to", until)
        .select(
            *keys,
            "state.*",
            F.col(day).alias("valid_from"),
            "valid_to",
            F.col("valid_to").isNull().alias("is_current"),
        )
    )


def apply_snapshot(
    current: DataFrame, new: DataFrame, keys: list[str], tracked: list[str], day: str
) -> DataFrame:
    """Fold one new snapshot into an existing history (valid_from, valid_to, is_current).

    Closed ranges pass through; a current range whose tracked values differ is closed at ``day``
    and a new one opened; unseen keys open a range; keys missing from the snapshot stay as they are.
    """
    at = F.lit(day).cast("date")
    closed = current.where(~F.col("is_current"))
    open_rows = current.where("is_current").select(
        *keys, F.struct(*tracked).alias("old"), F.col("valid_from").alias("old_from")
    )
    incoming = new.select(*keys, F.struct(*tracked).alias("new"))
    both = open_rows.join(incoming, keys, "full_outer")
    moved = F.col("new").isNotNull() & F.col("old").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))
    nothing = F.lit(None).cast("date")

    def version(state, since, until, now):
        return F.struct(
            F.col(state).alias("state"), since.alias("valid_from"), until.alias("valid_to"),
            F.lit(now).alias("is_current"),
        )

    kept = version("old", F.col("old_from"), nothing, True)
    ended = version("old", F.col("old_from"), at, False)
    opened = version("new", at, nothing, True)
    rows = (
        F.when(moved, F.array(ended, opened))
        .when(F.col("old").isNull(), F.array(opened))
        .otherwise(F.array(kept))
    )
    fresh = both.select(*keys, F.explode(rows).alias("v")).select(
        *keys, "v.state.*", "v.valid_from", "v.valid_to", "v.is_current"
    )
    return closed.select(*fresh.columns).unionByName(fresh)
