import hashlib
import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from rows import rows_of
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orefield.operators import ledger, watermarks
from orefield.sources import files, json_arrays, layers, schemas, tables

ITEM = StructType().add("id", "long").add("amount", "double").add("note", "string")


@pytest.fixture
def local(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return str(path)

    return write


def test_csv_lands_as_parquet_with_its_schema(spark, local, folder):
    path = local("people.csv", "id,name,score\n1,Ann,2.5\n2,Bob,\n")
    done = files.ingest_file(spark, path, folder, "people/people.csv")
    assert done.uri == f"{folder}/raw/people/people.parquet" and done.row_count == 2
    assert done.file_size_bytes > 0
    again = files.ingest_file(spark, path, folder, "people/again.csv")
    assert again.checksum == done.checksum != "0"
    assert [(c["name"], c["type"]) for c in done.schema] == [
        ("id", "integer"), ("name", "string"), ("score", "float"),
    ]
    assert rows_of(spark.read.parquet(done.uri)) == [(1, "Ann", 2.5), (2, "Bob", None)]


@pytest.mark.parametrize(
    "text",
    [
        '[{"id": 1, "amount": 2.0}, {"id": 2, "amount": 3.5}]',
        '[\n  {"id": 1,\n "amount": 2.0},\n  {"id": 2, "amount": 3.5}\n]',
        '\n{"id": 1, "amount": 2.0}\n{"id": 2, "amount": 3.5}\n',
    ],
)
def test_json_array_and_lines(spark, local, folder, text):
    done = files.ingest_file(spark, local("x.json", text), folder, "x.json")
    assert rows_of(spark.read.parquet(done.uri), "id", "amount") == [(1, 2.0), (2, 3.5)]


def test_json_single_object(spark, local, folder):
    path = local("one.json", '{\n "id": 1,\n "amount": 2.0\n}')
    assert files.ingest_file(spark, path, folder, "one.json").row_count == 1


def test_empty_json_and_unknown_type_fail(spark, local, folder):
    with pytest.raises(files.IngestionError):
        files.ingest_file(spark, local("e.json", "\n"), folder, "e.json")
    with pytest.raises(files.IngestionError):
        files.ingest_file(spark, local("e.xml", "<a/>"), folder, "e.xml")
    with pytest.raises(files.IngestionError):
        files.ingest_file(spark, "/nowhere/a.csv", folder, "a.csv")


def test_batch_goes_on_past_a_bad_file(spark, local, folder, tmp_path):
    local("in/a.csv", "id,amount,note\n1,2.0,x\n2,3.0,y\n")
    local("in/b.json", '{"id": 3, "amount": 1.0, "note": "z"}\n')
    local("in/c.json", '{"id": 4, "amount": \n')
    local("in/d.txt", "skip me")
    local("in/e.csv", "note,id,amount\n")
    local("in/f.json", "")
    local("in/sub/g.json", '[\n{"id": 7,\n "amount": 7.0}, {"id": 8, "amount": 8.0}]')
    local("in/sub/h.csv", 'amount,note,id\n9.5,"a ""b"",\n c",9\n')
    options = {"multiLine": True, "escape": '"'}
    got = files.ingest_batch(spark, str(tmp_path / "in"), folder, "batch/items", ITEM, **options)
    assert rows_of(got, "file", "row_count", "bad_rows", "status") == [
        ("a.csv", 2, 0, "success"), ("b.json", 1, 0, "success"), ("c.json", 0, 1, "failed"), ("e.csv", 0, 0, "success"),
        ("f.json", 0, 0, "failed"), ("g.json", 2, 0, "success"), ("h.csv", 1, 0, "success"),
    ]
    held = spark.read.parquet(f"{folder}/raw/batch/items")
    assert rows_of(held, "id", "amount", "note") == [
        (1, 2.0, "x"), (2, 3.0, "y"), (3, 1.0, "z"), (7, 7.0, None), (8, 8.0, None), (9, 9.5, 'a "b",\n c'),
    ]


def test_each_json_file_has_its_own_form(spark, local, folder, tmp_path):
    local("mix/a.json", '{"id": 1, "amount": 1.0}\n{"id": 2, "amount": 2.0}\n')
    local("mix/b.json", '[{"id": 3, "amount": 3.0},\n {"id": 4, "amount": 4.0}]')
    local("mix/c.json", '{\n"id": 5,\n"amount": 5.0}')
    done = files.ingest_file(spark, str(tmp_path / "mix"), folder, "mix.json", "json", ITEM)
    assert done.row_count == 5
    assert rows_of(spark.read.parquet(done.uri), "id", "amount") == [(i, float(i)) for i in range(1, 6)]


def test_a_broken_first_record_leaves_a_file_ndjson(spark, local, folder):
    path = local("first.json", '[{"id": 1, "amount"\n' + "".join(f'{{"id": {i}, "amount": 1.5}}\n' for i in range(2, 30)))
    done = files.ingest_file(spark, path, folder, "first.json", "json", ITEM, on_bad="quarantine")
    assert (done.row_count, done.bad_rows) == (28, 1)


ARRAYS = {
    "pretty": '[\n  {\n    "id": 1,\n    "note": "a } ] [ { \\" , {"\n  },\n  {"id": 2, "note": "b\\\\"}\n  ,\n  {\n "id": 3 }, {"id": 4,\n"note": "x"}\n]\n',
    "lines": '[{"id": 1, "note": "a } ] [ { \\" , {"},\n{"id": 2, "note": "b\\\\"},\n{"id": 3},{"id": 4, "note": "x"}]',
    "one": '[{"id": 1, "note": "a } ] [ { \\" , {"}, {"id": 2, "note": "b\\\\"}, {"id": 3}, {"id": 4, "note": "x"}]',
}


@pytest.mark.parametrize("form", sorted(ARRAYS))
def test_arrays_are_cut_into_records(spark, local, form):
    """Brackets and escaped quotes in strings, records over lines, two on one line."""
    lines = files.text_lines(spark, local(f"{form}.json", ARRAYS[form]))
    rows = json_arrays.parsed_records(json_arrays.cut_records(lines), ITEM, "_corrupt_record")
    assert rows_of(rows, "id", "note") == [(1, 'a } ] [ { " , {'), (2, "b\\"), (3, None), (4, "x")]


def test_one_large_array_is_read_by_many_tasks(spark, local, folder):
    """Splits of 2 kB: records cross their ends; a bad record is counted and its neighbours stay."""
    body = ",\n".join(f'  {{\n    "id": {i},\n    "amount": {i}.5,\n    "note": "{"n" * (i % 90)} ]}}"\n  }}' for i in range(500))
    path = local("large.json", "[\n" + body.replace('"id": 77,', '"id": "seventy",') + "\n]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert files.text_lines(spark, path).rdd.getNumPartitions() > 10
        done = files.ingest_file(spark, path, folder, "large.json", "json", ITEM, on_bad="quarantine")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (done.row_count, done.bad_rows) == (499, 1)
    want = sorted((i, i + 0.5, "n" * (i % 90) + " ]}") for i in range(500) if i != 77)
    assert sorted(tuple(r) for r in spark.read.parquet(done.uri).select("id", "amount", "note").collect()) == want


def test_an_array_cut_short_is_one_bad_record(spark, local, folder):
    path = local("short.json", '[\n{"id": 1,\n"amount": 2.0},\n{"id": 2,\n')
    done = files.ingest_file(spark, path, folder, "short.json", "json", ITEM, on_bad="quarantine")
    assert (done.row_count, done.bad_rows) == (0, 1)


def test_csv_columns_go_by_name(spark, local, folder, tmp_path):
    local("turned/a.csv", "note,amount,id\nx,1.5,1\n")
    local("turned/b.csv", "id,extra,note\n2,zzz,y\n")
    done = files.ingest_file(spark, str(tmp_path / "turned"), folder, "turned.csv", "csv", ITEM)
    assert rows_of(spark.read.parquet(done.uri)) == [(1, 1.5, "x"), (2, None, "y")]


@pytest.mark.parametrize("kind,text", [("csv", "id,amount,note\n1,2.0,x\nz,4,y\n5,6.0,7,8\n"), ("json", '{"id": 1}\n{"id": \n{"id": "q"}\n')])
def test_bad_records_fail_or_are_set_aside(spark, local, folder, kind, text):
    path = local(f"bad.{kind}", text)
    files.ingest_file(spark, local(f"good.{kind}", "id,amount,note\n8,1.0,k\n" if kind == "csv" else '{"id": 8}'), folder, f"t.{kind}", schema=ITEM)
    with pytest.raises(files.IngestionError, match="2 malformed"):
        files.ingest_file(spark, path, folder, f"t.{kind}", schema=ITEM)
    assert rows_of(spark.read.parquet(f"{folder}/raw/t.parquet"), "id") == [(8,)]  # as it was
    done = files.ingest_file(spark, path, folder, f"t.{kind}", schema=ITEM, on_bad="quarantine")
    assert (done.row_count, done.bad_rows) == (1, 2)
    assert rows_of(spark.read.parquet(done.uri), "id") == [(1,)]
    assert spark.read.parquet(f"{done.uri}.rejected").count() == 2


def test_ingest_writes_its_ledger_and_schema(spark, local, folder):
    log, history = f"{folder}/ledger", f"{folder}/schemas"
    files.ingest_logged(spark, local("p.csv", "id,name\n1,a\n"), folder, "p.csv", log, history, 1, "p", "2024-01-01")
    with pytest.raises(files.IngestionError):
        files.ingest_logged(spark, local("q.json", "\n"), folder, "q.json", log, history, 2, "q", "2024-01-01")
    assert rows_of(ledger.current_runs(spark.read.parquet(log)), "source_name", "status", "row_count") == [("p", "success", 1), ("q", "failed", None)]
    assert rows_of(ledger.column_counts(spark.read.parquet(history)), "source_name", "column_count") == [("p", 2)]


def test_checksums(spark, local, tmp_path):
    path = local("sum/a.bin", "hello")
    row = files.file_checksums(spark, str(Path(path).parent)).first()
    assert row["md5"] == hashlib.md5(b"hello").hexdigest()
    assert row["sha256"] == hashlib.sha256(b"hello").hexdigest() and row["size_bytes"] == 5


def test_detected_schema_sees_nulls_and_sample(spark, local):
    path = local("n.csv", "a,b,t\n1,x,2024-01-01 00:00:00\n2,,2024-01-02 00:00:00\n")
    got = schemas.detect_schema(files.read_csv(spark, path), 1)
    assert rows_of(got, "column_name", "portable_type", "nullable", "sample_rows", "row_count") == [
        ("a", "integer", False, 1, 2), ("b", "string", False, 1, 2), ("t", "timestamp", False, 1, 2),
    ]
    whole = schemas.detect_schema(files.read_csv(spark, path))
    assert dict((r["column_name"], r["nullable"]) for r in whole.collect())["b"] is True
    with pytest.raises(LookupError):
        schemas.table_schema(spark, "no_such_table")


def test_schema_history_counts_columns(spark):
    row = schemas.schema_change_row(spark, "s", schemas.describe_schema(ITEM), "2024-01-01", None)
    assert ledger.column_counts(row).first()["column_count"] == 3
    assert json.loads(row.first()["schema_metadata"])["columns"][0]["type"] == "integer"


def test_load_modes(spark, folder):
    a, b = spark.range(3), spark.range(10, 12)
    a.write.parquet(f"{folder}/src")
    target = f"{folder}/t"
    assert tables.load_parquet(spark, f"{folder}/src", target, "replace") == 3
    assert tables.bulk_insert(b, target, "append") == 2
    assert spark.read.parquet(target).count() == 5
    assert tables.load_parquet(spark, f"{folder}/src", target, "replace") == 3
    assert spark.read.parquet(target).count() == 3
    with pytest.raises(Exception, match="exist"):
        tables.bulk_insert(b, target, "fail")
    with pytest.raises(tables.ExtractError):
        tables.bulk_insert(b, target, "upsert")
    spark.range(0).write.parquet(f"{folder}/empty")
    assert tables.load_parquet(spark, f"{folder}/empty", target, "replace") == 0
    assert spark.read.parquet(target).count() == 3


def test_incremental_extract_moves_the_mark_only_for_new_rows(spark, folder):
    df = spark.range(20).withColumn("v", F.col("id"))
    first = tables.extract_incremental(df.where("id < 10"), folder, "run1", "id", None)
    assert (first["row_count"], first["watermark"]) == (10, "9")
    second = tables.extract_incremental(df, folder, "run2", "id", first["watermark"])
    assert (second["row_count"], second["watermark"]) == (10, "19")
    third = tables.extract_incremental(df, folder, "run3", "id", second["watermark"])
    assert third == {"uri": None, "row_count": 0, "watermark": "19"}
    again = tables.extract_incremental(df.where("id < 10"), folder, "run1", "id", "9")
    assert again["uri"] is None and spark.read.parquet(first["uri"]).count() == 10
    # 9 < 10 as numbers though not as text
    assert tables.incremental_rows(df, "id", "9").count() == 10


def test_custom_query_name_is_cut(spark, folder):
    query = "SELECT id, " + ", ".join(f"id AS c{i}" for i in range(30)) + " FROM range(3)"
    done = tables.extract_query(spark, query, folder, "q")
    assert done["source_name"].startswith("custom_query:" + query[:80] + "#") and done["row_count"] == 3
    assert tables.query_name(query) != tables.query_name(query + " WHERE id > 1")
    named = tables.extract_query(spark, "SELECT id FROM range(9) WHERE id > :n", folder, "p", {"n": 4}, "mine")
    assert (named["source_name"], named["row_count"]) == ("mine", 4)


def test_loaded_objects_are_skipped(spark, folder):
    df = spark.range(30).withColumn("object_key", F.concat(F.lit("o"), F.col("id") % 3))
    load = lambda rows: tables.load_new_objects(spark, rows, f"{folder}/ledger", f"{folder}/t")
    load(df.where("object_key = 'o1'"))
    load(df)
    load(df)
    assert spark.read.parquet(f"{folder}/t").count() == 30
    assert rows_of(spark.read.parquet(f"{folder}/ledger"), "object_key", "row_count") == [
        ("o0", 10), ("o1", 10), ("o2", 10),
    ]


def test_layers(spark, folder):
    assert layers.layer_path("/x/", "silver", "/a/b") == "/x/staging/a/b"
    assert layers.parquet_key("d/a.csv") == "d/a.parquet" and layers.parquet_key("d") == "d.parquet"
    with pytest.raises(layers.LayerError):
        layers.layer_path("/x", "platinum")
    tables.extract_full(spark.range(5), folder, "p/data")
    path = layers.promote(spark, folder, "p/data", "bronze", "gold", "q/data")
    assert spark.read.parquet(path).count() == 5
    keys = {"bronze": "p/data", "gold": "q/data"}
    assert layers.verify_layers(spark, folder, keys).count() == 2
    with pytest.raises(layers.LayerError):
        layers.verify_layers(spark, folder, {**keys, "silver": "p/data"})
    listed = layers.list_objects(spark, folder)
    assert {r["layer"] for r in layers.layer_sizes(listed).collect()} == {"bronze", "gold"}
    assert {tuple(r)[:2] for r in layers.layer_prefixes(listed).collect()} == {("bronze", "p"), ("gold", "q")}
    assert layers.list_layer(spark, folder, "bronze", "nothing").count() == 0


def test_table_ready(spark):
    assert layers.table_ready(spark.range(5), 5) and not layers.table_ready(spark.range(4), 5)


def test_path_ready(spark, folder):
    assert not layers.path_ready(spark, f"{folder}/none")
    spark.range(3).write.parquet(f"{folder}/t")
    assert layers.path_ready(spark, f"{folder}/t", 3) and not layers.path_ready(spark, f"{folder}/t", 4)


def test_file_name_dates(spark, tmp_path):
    for name in ("sales_20240131", "sales_20240230", "other"):
        pq.write_table(pa.table({"v": [1]}), tmp_path / f"{name}.parquet")
    name, day = layers.file_date_partition()
    rows = spark.read.parquet(str(tmp_path)).select(name.alias("n"), day.cast("string").alias("d"))
    assert rows_of(rows) == [("", None), ("sales", "2024-01-31"), ("sales", None)]


def test_jdbc_read_needs_bounds(spark):
    with pytest.raises(tables.ExtractError):
        tables.jdbc_table(spark, "jdbc:x", "t", partition_column="id")


def test_run_life_cycle(spark, ts):
    runs = ts(
        [(1, "a", "2024-01-01 00:00:00", "2024-01-01 01:00:00", True),
         (2, "a", "2024-01-01 02:00:00", "2024-01-01 02:00:00", False),
         (3, "b", "2024-01-01 03:00:00", None, True)],
        "run_id int, source_name string, started_at string, ended_at string, ok boolean",
        "started_at", "ended_at",
    )
    done = runs.where("ended_at IS NOT NULL")
    finished = ledger.run_finished(done, F.col("ok"), F.lit(7), F.lit("x" * 900), F.col("ended_at"))
    got = ledger.current_runs(ledger.run_started(runs).unionByName(finished))
    assert rows_of(got, "run_id", "status", "row_count", F.length("error_message")) == [
        (1, "success", 7, None), (2, "failed", None, 900), (3, "running", None, None),
    ]


def test_logged_runs(spark, folder):
    path = f"{folder}/ledger"

    def fails():
        raise files.IngestionError("y" * 900)

    ledger.logged(spark, path, 1, "a", lambda: {"row_count": 4})
    with pytest.raises(files.IngestionError):
        ledger.logged(spark, path, 2, "a", fails)
    got = ledger.current_runs(spark.read.parquet(path))
    assert rows_of(got, "run_id", "status", "row_count", F.length("error_message")) == [
        ("1", "success", 4, None), ("2", "failed", None, 900),
    ]


def test_marks_follow_the_extracts(spark, folder):
    df = spark.range(20).withColumn("v", F.col("id"))
    run = lambda rows, key: tables.incremental_run(rows, folder, key, "t", "id", f"{folder}/marks")
    assert run(df.where("id < 10"), "a")["row_count"] == 10
    assert run(df, "b")["row_count"] == 10
    assert run(df, "c") == {"uri": None, "row_count": 0, "watermark": "19"}
    assert spark.read.parquet(f"{folder}/marks").count() == 2


def test_watermarks(spark):
    at = lambda d: f"2024-01-0{d} 00:00:00"

    def mark(source, value, day):
        return watermarks.watermark_row(spark, source, "ts", value, "timestamp", None).withColumn(
            "updated_at", F.lit(at(day)).cast("timestamp_ntz")
        )

    log = mark("a", "1", 1).unionByName(mark("a", "5", 2)).unionByName(mark("b", "3", 1))
    assert watermarks.lookup(log, "a", "ts") == "5" and watermarks.lookup(log, "zz", "ts") is None
    once = watermarks.upsert_watermarks(watermarks.current_watermarks(log), mark("b", "9", 3))
    again = watermarks.upsert_watermarks(once, mark("b", "9", 3))
    assert rows_of(once) == rows_of(again)
    assert rows_of(once, "source_name", "watermark_value") == [("a", "5"), ("b", "9")]
    gone = log.unionByName(
        watermarks.reset_row(spark, "a", "ts", None).withColumn(
            "updated_at", F.lit(at(9)).cast("timestamp_ntz")
        )
    )
    assert watermarks.lookup(gone, "a", "ts") is None
