import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from rows import rows_of

from orefield.session import new_workspace
from orefield.sources import json_types


@pytest.fixture
def written(spark):
    """Files of JSON lines in a fresh folder."""

    def make(**files):
        root = Path(new_workspace(spark, "types").removeprefix("file:"))
        root.mkdir(parents=True, exist_ok=True)
        for name, lines in files.items():
            (root / f"{name}.json").write_text("".join(f"{x if isinstance(x, str) else json.dumps(x)}\n" for x in lines))
        return str(root)

    return make


def by_name(df):
    return df.withColumn("file", F.regexp_extract("file", r"(\w+)\.json$", 1))


def test_types_of_twenty_files_merge(spark, written):
    kinds = [lambda i: i, lambda i: i + 0.5, lambda i: f"t{i}", lambda i: {"p": i}]
    path = written(**{f"f{k:02d}": [{"id": i, "v": kinds[k % 4](i), "w": [i, i + (0.25 if k == 7 else 1)]} for i in range(5)] for k in range(20)})
    counts = json_types.file_types(spark, path)
    got = rows_of(json_types.merged_types(counts), "column_name", "portable_type", "present", "nullable")
    assert got == [("id", "integer", 100, False), ("v", "string", 100, False), ("w", "array", 100, False)]
    drift = {r.file: r for r in by_name(json_types.drift_by_file(counts)).collect()}
    assert len(drift) == 20 and all(r.records == 5 and r.columns == 3 and r.missing == 0 for r in drift.values())
    # Column v differs everywhere, the arrays of all but one file are narrower than all together.
    assert {k: r.widened for k, r in drift.items()} == {f"f{k:02d}": 1 if k == 7 else 2 for k in range(20)}


def test_numbers_widen_and_digits_do_not_count(spark, written):
    path = written(a=[{"v": 1.5}], b=[{"v": 22.125}], c=[{"v": 1e300}], d=[{"v": 7}])
    counts = json_types.file_types(spark, path)
    assert rows_of(json_types.merged_types(counts), "portable_type") == [("float",)]
    drift = rows_of(by_name(json_types.drift_by_file(counts)), "file", "widened")
    assert drift == [("a", 0), ("b", 0), ("c", 0), ("d", 1)]


def test_nested_types_merge(spark, written):
    path = written(a=[{"o": {"x": 1}}, {"o": {"y": "s"}}], b=[{"o": {"x": 1, "y": "t"}}], c=[{"o": {"x": "u"}}])
    counts = json_types.file_types(spark, path)
    own = {r.file: r.variant_type for r in by_name(counts.where("column_name = 'o' AND NOT merged")).collect()}
    assert own == {"a": "OBJECT<x: BIGINT, y: STRING>", "b": "OBJECT<x: BIGINT, y: STRING>", "c": "OBJECT<x: STRING>"}
    assert json_types.merged_types(counts).first()["variant_type"] == "OBJECT<x: VARIANT, y: STRING>"


def test_bad_records_nulls_and_missing_columns(spark, written):
    path = written(a=['{"x": 1, "y": null}', "{broken", "7", "[1]", '{"x": 1, "x": 2}', "", "  "], b=['{"x": 2}', "{}"], c=["nothing"])
    counts = json_types.file_types(spark, path)
    drift = rows_of(by_name(json_types.drift_by_file(counts)), "file", "records", "bad_rows", "columns", "missing", "widened", "drifted")
    assert drift == [("a", 5, 4, 2, 0, 0, False), ("b", 2, 0, 1, 1, 0, True), ("c", 1, 1, 0, 2, 0, True)]
    merged = rows_of(json_types.merged_types(counts), "column_name", "portable_type", "present", "nullable")
    assert merged == [("x", "integer", 2, True), ("y", "null", 0, True)]


def test_null_records_and_empty_input(spark):
    none = json_types.type_counts(spark.createDataFrame([], "file string, value string"))
    assert json_types.merged_types(none).count() == json_types.drift_by_file(none).count() == 0
    nulls = json_types.type_counts(spark.createDataFrame([("a", None), ("a", '{"x": true}')], "file string, value string"))
    assert rows_of(json_types.drift_by_file(nulls), "records", "bad_rows", "columns") == [(2, 1, 1)]
    assert rows_of(json_types.merged_types(nulls), "column_name", "portable_type", "nullable") == [("x", "boolean", False)]


def test_records_are_combined_before_the_shuffle(spark, written):
    path = written(a=[{"x": i} for i in range(50)])
    lines = spark.read.text(path).select(F.lit("a").alias("file"), "value")
    stored = json_types.type_counts(lines)
    assert rows_of(stored.where("NOT merged"), "column_name", "present", "records") == [("x", 50, 50), (None, 0, 50)]
