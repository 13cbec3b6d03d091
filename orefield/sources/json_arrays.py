"""Records of JSON arrays, cut by many tasks.

A JSON string holds no line break, so at the begin of a line no string is open and all that matters of the
lines before is how deep their brackets nest. That depth is a sum: blocks of a file are summed by themselves,
a prefix sum over the few blocks of each file gives the depth at their begin, and one more within each
block the depth of every line. Records begin where the depth is that of the array; their lines, also
across the end of a block, are put together and parsed. An array whose brackets do not match is one bad record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orefield.session import new_workspace

UNBALANCED = "brackets of the file do not match"


def bare(text: Column) -> Column:
    """The text without its strings: what is left of brackets counts."""
    return F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")


def nesting(text: Column) -> Column:
    """Opening less closing brackets of a line."""
    plain = bare(text)
    return F.char_length(F.translate(plain, "}]", "")) - F.char_length(F.translate(plain, "{[", ""))


def _held(df: DataFrame, label: str) -> DataFrame:
    path = new_workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_records(lines: DataFrame) -> DataFrame:
    """(file, record, bad): the text of each record, from ``lines`` (file, block, nth, value).

    ``block`` is where a split begins in its file, ``nth`` the order within it.
    """
    lines = lines.where(F.trim("value") != "").withColumn("delta", nesting(F.col("value")))
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("delta").alias("sum"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    run = Window.partitionBy("file", "block").orderBy("nth")
    deep = lines.join(blocks, ["file", "block"]).withColumn("after", F.col("offset") + F.sum("delta").over(run))
    deep = deep.withColumn("before", F.col("after") - F.col("delta"))
    starts = F.when(F.col("before") <= 1, 1).otherwise(0)
    placed = _held(deep.withColumn("own", F.sum(starts).over(run)).select("file", "block", "nth", "value", "before", "after", "own"), "array-lines")
    # A block's first lines may go on with the last record of a block before.
    held = placed.groupBy("file", "block").agg(F.max("own").alias("n"), F.min("after").alias("least"), F.max_by("after", "nth").alias("end"))
    held = held.withColumn("last", F.last(F.when(F.col("n") > 0, F.struct("block", "n")), ignorenulls=True).over(before))
    sound = held.groupBy("file").agg(F.min("least").alias("least"), F.max_by("end", "block").alias("end"))
    bad = sound.where((F.col("least") < 0) | (F.col("end") != 0)).select("file")
    carried = held.select("file", "block", "last").join(bad, "file", "left_anti")
    record = F.when(F.col("own") > 0, F.struct(F.col("block").alias("block"), F.col("own").alias("n"))).otherwise(F.col("last"))
    whole = placed.join(carried, ["file", "block"]).groupBy("file", record.alias("record")).agg(
        F.array_sort(F.collect_list(F.struct("block", "nth", "value", "before", "after"))).alias("lines")
    )
    text = F.trim(F.array_join(F.transform("lines", lambda x: x["value"]), "\n"))
    text = F.when(F.col("lines")[0]["before"] == 0, F.regexp_replace(text, r"^\s*\[", "")).otherwise(text)
    text = F.when(F.element_at("lines", -1)["after"] == 0, F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    found = whole.select("file", F.regexp_replace(text, r"^[\s,]+|[\s,]+$", "").alias("record"), F.lit(False).alias("bad")).where("record <> ''")
    return found.unionByName(bad.select("file", F.lit(UNBALANCED).alias("record"), F.lit(True).alias("bad")))


def parsed_records(records: DataFrame, schema: StructType, corrupt: str) -> DataFrame:
    """The columns of ``schema`` and ``file``; records that do not fit have only their text in ``corrupt``, if that is a column."""
    # Several records that share a line are parted by the parser itself.
    several = bare(F.col("record")).rlike(r"\}\s*,\s*\{")
    parts = F.when(several, F.from_json(F.concat(F.lit("["), "record", F.lit("]")), "array<string>"))
    one = records.select("file", F.explode(F.coalesce(parts, F.array("record"))).alias("record"))
    row = F.from_json("record", schema, {"columnNameOfCorruptRecord": corrupt})
    one = one.withColumn("row", row)
    columns = [
        F.when(F.col("row").isNull(), F.col("record")).otherwise(F.col(f"row.`{n}`")).alias(n) if n == corrupt else F.col(f"row.`{n}`") for n in schema.names
    ]
    return one.select(*columns, "file")
