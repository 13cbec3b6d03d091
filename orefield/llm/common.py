"""What the operators share: null-safe input columns, stored steps, batch sizes and components."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.session import new_workspace

#: Rows of one Arrow batch, unless the session sets its own: bounds what a Python worker holds of long texts.
BATCH_ROWS = "512"
#: Where this package lies: workers on this path need no shipped copy.
HOME = str(Path(__file__).resolve().parents[2])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, a null text as the empty one; other columns cannot clash."""
    prepare(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and workers that find this package where it was not installed or shipped."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (*paths, HOME) if x)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_ROWS)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: later steps do not compute them again."""
    path = new_workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Partitions for a step that computes much on few bytes, where sizes would say one partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def sampled(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """One row for each of the ``n`` keys with the least hash, of those that are not null.

    Only hashes are compared: about twice as many as wanted leave the tasks, however many rows there
    are, and the chosen ones, a bounded list, find their rows by a broadcast.
    """
    spark = rows.sparkSession
    h = F.xxhash64(key)
    keyed = rows.where(key.isNotNull())
    total = keyed.count()
    most = -(1 << 63) + int(min(1.0, 2 * n / max(1, total)) * ((1 << 64) - 1))
    least = keyed.select(h.alias("h")).where(F.col("h") <= F.lit(min(most, (1 << 63) - 1))).distinct().orderBy("h").limit(n)
    chosen = spark.createDataFrame([(r["h"],) for r in least.collect()], "h long")
    found = keyed.select(F.struct(*rows.columns).alias("r"), h.alias("h")).join(F.broadcast(chosen), "h")
    return found.dropDuplicates(["h"]).select("r.*")


def by_bytes(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices of about ``most`` bytes each; one larger item is a slice of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Rounds of large-star and small-star: every node hands the smallest neighbour it knows to its
    larger, then to its smaller neighbours, until all edges point at a root. Each half round is one
    pre-aggregated minimum and one inner join, which may be split on a busy node, and is stored.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or found[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", F.col("v").alias("root"))
            ).distinct()
        state = found
        both = now.union(now.select("v", "u"))
        # Minima are stored, so that the joins meet two plain shuffles and may split a busy node.
        least = stored(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), label)
        least = least.withColumn("m", F.least("k", "m"))
        large = stored(
            both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct(),
            label,
        )
        least = stored(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), label)
        now = stored(
            large.join(least, F.col("u") == F.col("k"))
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct(),
            label,
        )
