"""Types of JSON columns over many files: one pass, merged per file and over all files at once.

Each record is parsed as a VARIANT and cut into its top-level columns; Spark merges their types, nested
ones too, in the partial aggregation of each task, so the shuffle holds a row per task, file and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.session import new_workspace
from orefield.sources.files import text_lines

#: How a type as Spark prints it begins, and its portable name. A VARIANT stands for types
#: with nothing in common but text.
PORTABLE = {
    "VOID": "null", "BOOLEAN": "boolean", "BIGINT": "integer", "DECIMAL": "float", "DOUBLE": "float",
    "STRING": "string", "VARIANT": "string", "OBJECT": "object", "ARRAY": "array",
}


def portable_of(printed: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PORTABLE.items() for x in pair])
    return names[F.regexp_extract(printed, "^[A-Z]+", 0)]


def _without_sizes(printed: Column) -> Column:
    """Numbers with a fraction are one type, whatever their digits."""
    return F.regexp_replace(printed, r"(?<=^|<|: )(?:DECIMAL\(\d+,\d+\)|DOUBLE)(?=$|,|>)", "FLOAT")


def type_counts(records: DataFrame) -> DataFrame:
    """(file, merged, column_name, variant_type, present, records, bad_rows) of (file, value) JSON records.

    A row for each column of each file, and with ``merged`` one for each column over all files (file
    null). The rows without column_name count the records and the bad ones: text that is no JSON object,
    has a key twice, or is null. ``present`` counts values other than null. The result is stored, so
    the records are read once.
    """
    columns = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")
    record = "array(named_struct('key', cast(null as string), 'value', cast(null as variant)))"
    cut = records.select("file", columns.alias("m")).select(
        "file", F.col("m").isNull().alias("bad"), F.explode(F.expr(f"concat({record}, coalesce(map_entries(m), array()))")).alias("e")
    )
    cut = cut.select("file", "bad", F.col("e.key").alias("column_name"), F.col("e.value").alias("value"))
    filled = F.col("value").isNotNull() & ~F.coalesce(F.is_variant_null("value"), F.lit(True))
    counts = cut.groupingSets([["column_name", "file"], ["column_name"]], "column_name", "file").agg(
        (F.grouping("file") == 1).alias("merged"), F.schema_of_variant_agg("value").alias("variant_type"),
        F.count_if(filled).alias("present"), F.count("*").alias("records"), F.count_if("bad").alias("bad_rows"),
    )
    path = new_workspace(records.sparkSession, "json-types")
    counts.write.parquet(path)
    return records.sparkSession.read.schema(counts.schema).parquet(path)


def file_types(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """``type_counts`` of the NDJSON files below ``path``; blank lines are no records."""
    return type_counts(text_lines(spark, path, pattern).where(F.trim("value") != "").select("file", "value"))


def merged_types(counts: DataFrame) -> DataFrame:
    """(column_name, variant_type, portable_type, present, nullable): the columns over all files.

    ``nullable`` where some record that is not bad lacks the column or has null there.
    """
    whole = counts.where("merged")
    good = whole.where("column_name IS NULL").agg(F.max(F.col("records") - F.col("bad_rows"))).scalar()
    return whole.where("column_name IS NOT NULL").select(
        "column_name", "variant_type", portable_of(F.col("variant_type")).alias("portable_type"), "present",
        (F.col("present") < good).alias("nullable"),
    )


def drift_by_file(counts: DataFrame) -> DataFrame:
    """(file, records, bad_rows, columns, missing, widened, drifted): each file against all files.

    ``missing`` columns are in other files only. ``widened`` columns have a narrower type here than
    over all files, inside objects and arrays too; one that is always null here fits any type.
    """
    kind = _without_sizes(F.col("variant_type"))
    named = counts.where("column_name IS NOT NULL")
    every = named.where("merged")
    wide = every.select("column_name", kind.alias("wide"))
    own = named.where("NOT merged").select("file", "column_name", kind.alias("kind")).join(wide, "column_name")
    own = own.groupBy("file").agg(
        F.count("*").alias("columns"), F.count_if((F.col("kind") != F.col("wide")) & (F.col("kind") != "VOID")).alias("widened")
    )
    total = every.agg(F.count("*")).scalar()
    files = counts.where("column_name IS NULL AND NOT merged").select("file", "records", "bad_rows").join(own, "file", "left")
    zero = F.lit(0).cast("bigint")
    files = files.withColumns({c: F.coalesce(c, zero) for c in ("columns", "widened")}).withColumn("missing", total - F.col("columns"))
    return files.select(
        "file", "records", "bad_rows", "columns", "missing", "widened", ((F.col("missing") > 0) | (F.col("widened") > 0)).alias("drifted")
    )
