from pyspark.sql import functions as F

from orefield.llm.common import by_bytes, sampled


def test_slices_by_bytes():
    sizes = [5, 5, 1, 30, 2, 2, 0]
    found = [sizes[s] for s in by_bytes(sizes, 10)]
    assert found == [[5, 5], [1], [30], [2, 2, 0]] and [*by_bytes([], 10)] == []


def test_a_sample_has_one_row_for_each_of_the_least_hashes(spark):
    rows = spark.range(5000).withColumns({"k": F.col("id") % 1000, "h": F.lit("x")})
    got = sampled(rows, F.col("k"), 50)
    want = {r["k"] for r in rows.select("k").distinct().orderBy(F.xxhash64("k")).limit(50).collect()}
    keys = [r["k"] for r in got.collect()]
    assert got.columns == ["id", "k", "h"] and len(keys) == len(set(keys)) and set(keys) <= want and len(keys) >= 15
    few = sampled(rows.where("id < 7"), F.col("id"), 50)
    assert few.count() == 7 and sampled(rows.limit(0), F.col("k"), 5).count() == 0
    assert sampled(rows.withColumn("k", F.lit(None).cast("long")), F.col("k"), 5).count() == 0
