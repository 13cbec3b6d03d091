"""Bronze -> silver -> gold for user records, and score grading."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions import average, band, rounded_average
from orefield.operators.latest import first_per_key

# Fixed values
GRADES = [(90, "A"), (80, "B")]
LOWEST_GRADE = "C"


def clean_to_silver(raw: DataFrame, order_by: list[str]) -> DataFrame:
    """Drop rows without email, keep the first row per id in ``order_by`` order."""
    known = raw.where(F.col("email").isNotNull())
    return first_per_key(known, ["id"], [F.asc(c) for c in order_by]).withColumns(
        {"id": F.col("id").cast("bigint"), "amount": F.col("amount").cast("double")}
    )


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Rows before and after the cleaning, without building the cleaned rows."""
    kept = F.count_distinct(F.when(F.col("email").isNotNull(), F.col("id")))
    return raw.agg(F.count("*").alias("rows_before"), kept.alias("rows_after")).withColumn(
        "rows_removed", F.col("rows_before") - F.col("rows_after")
    )


def user_summary(silver: DataFrame) -> DataFrame:
    total = F.sum(F.col("amount").cast("decimal(18,2)"))
    return silver.groupBy(F.to_date("created_at").cast("string").alias("created_date")).agg(
        F.count("id").alias("user_count"),
        total.cast("double").alias("total_amount"),
        rounded_average("amount").alias("avg_amount"),
    )


def grade_scores(scores: DataFrame) -> DataFrame:
    """Each row against the overall mean; the mean is a scalar subquery, not a window."""
    overall = scores.agg(
        F.struct(F.count("*").alias("n"), average("score").alias("mean")).alias("s")
    )
    return scores.withColumn("stats", overall.scalar()).select(
        "id",
        "name",
        "score",
        (F.col("score") > F.col("stats.mean")).alias("above_average"),
        band(F.col("score"), GRADES, LOWEST_GRADE).alias("grade"),
        F.col("stats.n").alias("score_count"),
        F.col("stats.mean").alias("avg_score"),
    )
