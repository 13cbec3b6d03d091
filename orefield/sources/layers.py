"""Layer paths, listing, promotion and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Layer name to folder.
LAYER_FOLDERS = {"bronze": "raw", "silver": "staging", "gold": "curated"}
FILE_DATE = r"(.*)_(\d{4})(\d{2})(\d{2})\.parquet"


class LayerError(Exception):
    """A layer is unknown, missing or empty."""


def layer_path(root: str, layer: str, key: str = "") -> str:
    try:
        folder = LAYER_FOLDERS[layer.lower()]
    except KeyError:
        raise LayerError(f"unknown layer: {layer}") from None
    return "/".join(part for part in (root.rstrip("/"), folder, key.lstrip("/")) if part)


def parquet_key(key: str) -> str:
    """The object key with its extension replaced by .parquet."""
    stem, dot, _ = key.rpartition(".")
    return f"{stem if dot else key}.parquet"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files below a path, from the file system's own summary."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(jvm_path).getLength()


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """One row per file below ``root``; the content column is never selected, so no file is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )
    # Paths come back with their scheme in front; the key is what follows the root.
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    key = F.element_at(F.split("path", rf"\Q{base}\E", 2), -1)
    keyed = files.select(
        key.alias("object_key"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )
    return keyed.where(F.col("object_key").startswith(prefix)) if prefix else keyed


def list_layer(spark: SparkSession, root: str, layer: str, prefix: str = "") -> DataFrame:
    return list_objects(spark, layer_path(root, layer), prefix)


def layer_of_key(key: Column) -> Column:
    folder = F.split(key, "/")[0]
    expr = F.when(F.lit(False), "")
    for layer, name in LAYER_FOLDERS.items():
        expr = expr.when(folder == name, layer)
    return expr.otherwise(folder)


def layer_sizes(objects: DataFrame) -> DataFrame:
    return objects.groupBy(layer_of_key(F.col("object_key")).alias("layer")).agg(
        F.count("*").alias("object_count"), F.sum("size_bytes").alias("total_bytes")
    )


def layer_prefixes(objects: DataFrame) -> DataFrame:
    parts = F.split("object_key", "/")
    return objects.groupBy(
        layer_of_key(F.col("object_key")).alias("layer"),
        F.when(F.size(parts) > 2, parts[1]).otherwise("").alias("prefix"),
    ).agg(F.count("*").alias("object_count"))


def promote(
    spark: SparkSession,
    root: str,
    key: str,
    source: str,
    target: str,
    target_key: str | None = None,
) -> str:
    """Copy a dataset from one layer to another; returns the new path."""
    destination = layer_path(root, target, target_key or key)
    spark.read.parquet(layer_path(root, source, key)).write.mode("overwrite").parquet(destination)
    return destination


def verify_layers(spark: SparkSession, root: str, keys: dict[str, str]) -> DataFrame:
    """File count per layer; a layer with none raises."""
    counts = None
    for layer, prefix in keys.items():
        if not path_exists(spark, layer_path(root, layer, prefix)):
            raise LayerError(f"no objects in {layer} under {prefix!r}")
        one = (
            list_objects(spark, layer_path(root, layer, prefix))
            .where(F.col("object_key").endswith(".parquet"))
            .agg(F.count("*").alias("object_count"))
            .select(F.lit(layer).alias("layer"), "object_count")
        )
        counts = one if counts is None else counts.unionByName(one)
    empty = [r["layer"] for r in counts.where("object_count = 0").collect()]
    if empty:
        raise LayerError(f"no objects in {', '.join(empty)}")
    return counts


def table_ready(df: DataFrame, min_rows: int = 1) -> bool:
    """Whether the table holds at least ``min_rows``; stops reading once it does."""
    return df.limit(min_rows).count() >= min_rows


def path_ready(spark: SparkSession, path: str, min_rows: int = 1) -> bool:
    return path_exists(spark, path) and table_ready(spark.read.parquet(path), min_rows)


def file_date_partition() -> tuple[Column, Column]:
    """Dataset name and date taken from a file name such as sales_20240131.parquet."""
    name = F.col("_metadata.file_name")
    digits = F.concat_ws("-", *[F.regexp_extract(name, FILE_DATE, i) for i in (2, 3, 4)])
    return F.regexp_extract(name, FILE_DATE, 1), digits.try_cast("date")
