"""CSV / JSON files to bronze Parquet."""

from __future__ import annotations

import csv
import fnmatch
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orefield.operators import ledger
from orefield.session import new_workspace
from orefield.sources import json_arrays
from orefield.sources.layers import layer_path, list_objects, parquet_key, stored_bytes
from orefield.sources.schemas import describe_schema, schema_change_row

CORRUPT = "_corrupt_record"
READERS = {"csv", "json"}


class IngestionError(Exception):
    """A file could not be ingested."""


@dataclass
class Ingested:
    """What one load produced."""

    uri: str
    row_count: int
    file_size_bytes: int
    checksum: str
    schema: list[dict] = field(default_factory=list)
    bad_rows: int = 0


def text_lines(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """(file, block, nth, value): every line of the files below ``path``, ordered by block and nth in its file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), "value",
    )


def file_heads(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """(file, head): the first line with text of each file below ``path``; files without any are left out."""
    lines = text_lines(spark, path, pattern).where(F.trim("value") != "")
    return lines.groupBy("file").agg(F.min_by("value", F.struct("block", "nth")).alias("head"))


def json_forms(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """(file, form): ``lines``, ``array`` or ``object`` (one document over lines), told from all lines of a file.

    NDJSON is where most lines look like whole objects, so a broken record, the first one too, does not
    make a file a document; else the first character decides.
    """
    line = F.trim("value")
    whole = line.startswith("{") & line.endswith("}")
    lines = text_lines(spark, path, pattern).where(line != "")
    found = lines.groupBy("file").agg(F.count("*").alias("n"), F.count_if(whole).alias("whole"), F.min_by(F.substring(line, 1, 1), F.struct("block", "nth")).alias("first"))
    form = F.when(F.col("whole") * 2 >= F.col("n"), "lines").when(F.col("first") == "[", "array").when(F.col("n") == 1, "lines").otherwise("object")
    return found.select("file", form.alias("form"))


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = new_workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _groups(found: DataFrame, by: str) -> list:
    """The forms or headers there are: as many as there are kinds of files, not files."""
    return sorted(r[by] for r in found.select(by).distinct().collect())


def _of_files(rows: DataFrame, found: DataFrame, condition: Column, single: bool, extra) -> DataFrame:
    """The rows of the files that ``found`` has under the condition; all of them, if there is one kind only."""
    if single:
        return rows.select("*", *extra)
    own = rows.select("*", F.col("_metadata.file_path").alias("_file"), *extra)
    return own.join(found.where(condition).select(F.col("file").alias("_file")), "_file", "left_semi").drop("_file")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_json(
    spark: SparkSession, path, schema: StructType | None = None, lines: bool | None = None, pattern: str | None = None, extra=()
) -> DataFrame:
    """NDJSON, JSON arrays or single objects, also side by side in one folder.

    Without ``lines`` the form of each file is told from the file, in one pass over the text. NDJSON is read by
    splits; with a schema so are arrays over lines (see ``json_arrays``). A single object is one file per task.
    """
    reader = spark.read.option("columnNameOfCorruptRecord", CORRUPT)
    reader = reader.schema(schema) if schema is not None else reader
    if lines is not None:
        return reader.option("multiLine", not lines).json(path).select("*", *extra)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    found = _kept(json_forms(spark, path, pattern), "forms")
    forms = _groups(found, "form")
    if not forms:
        raise IngestionError(f"empty JSON input: {path}")
    parts = []
    for form in forms:
        own, single = F.col("form") == form, len(forms) == 1
        if form == "array" and schema is not None:
            held = text_lines(spark, path, pattern)
            held = held if single else held.join(found.where(own).select("file"), "file", "left_semi")
            rows = json_arrays.parsed_records(json_arrays.cut_records(held), schema, CORRUPT)
            parts.append(rows.withColumn("_metadata", F.struct(F.col("file").alias("file_path"))).select(*schema.names, *extra))
        else:
            parts.append(_of_files(reader.option("multiLine", form != "lines").json(path), found, own, single, extra))
    return _union(parts)


def read_csv(
    spark: SparkSession, path, schema: StructType | None = None, pattern: str | None = None, extra=(), in_order: bool = False, **options
) -> DataFrame:
    """CSV with a header. Without a schema a first pass over all rows infers the types.

    A schema's columns are found by the names in each file's own header, in any order; a column the
    header lacks is null, one the schema lacks is left out. That takes a pass for the headers; ``in_order``
    reads at once, and fails where a header does not name the schema's columns in their order.
    """
    reader = spark.read.option("header", True).option("columnNameOfCorruptRecord", CORRUPT).options(**options)
    if schema is None:
        return reader.option("inferSchema", True).csv(path).select("*", *extra)
    if in_order:
        return reader.option("enforceSchema", False).schema(schema).csv(path).select("*", *extra)
    found = _kept(file_heads(spark, path, pattern), "headers")
    headers = _groups(found, "head")
    delimiter = options.get("sep", options.get("delimiter", ","))
    wanted = {f.name: f for f in schema.fields}
    parts = []
    for header in headers:
        names = [n.strip().lstrip("\ufeff") for n in next(csv.reader([header], delimiter=delimiter))]
        own = StructType([wanted.get(n, StructField(n, StringType())) for n in names])
        own = own.add(wanted[CORRUPT]) if CORRUPT in wanted else own
        columns = [F.col(f"`{n}`") if n in own.names else F.lit(None).cast(f.dataType).alias(n) for n, f in wanted.items()]
        rows = _of_files(reader.schema(own).csv(path), found, F.col("head") == header, len(headers) == 1, extra)
        parts.append(rows.select(*columns, *rows.columns[len(own) :]))
    return _union(parts) if parts else reader.schema(schema).csv(path).select("*", *extra)


def read_files(spark, path, kind, schema=None, lines=None, **options) -> DataFrame:
    if kind == "csv":
        return read_csv(spark, path, schema, **options)
    if kind == "json":
        return read_json(spark, path, schema, lines)
    raise IngestionError(f"unsupported file type: {kind}")


def write_counted(df: DataFrame, target: str, **metrics) -> dict:
    """Write Parquet and observe the row count, and any further metrics, in the same pass."""
    seen = Observation()
    named = [F.count(F.lit(1)).alias("row_count")] + [v.alias(k) for k, v in metrics.items()]
    df.observe(seen, *named).write.mode("overwrite").parquet(target)
    return seen.get


def content_hash(columns: list[str], where: Column | None = None) -> Column:
    """Order-free checksum of all rows, cheap enough to be taken while they are written."""
    own = F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(20,0)")
    return F.sum(own if where is None else F.when(where, own))


def _landed(spark: SparkSession, path: str, root: str, kind: str, schema: StructType, lines: bool | None, options: dict):
    """All records of ``path`` stored with their corrupt text: the counts, the place, the rows.

    The usual forms are tried first, since they need no pass over the text beforehand: CSV whose headers
    name the schema's columns in order, and NDJSON, which stands if no record is bad.
    """
    full, good = StructType(list(schema.fields)).add(CORRUPT, "string"), F.col(CORRUPT).isNull()

    def write(rows: DataFrame):
        held = f"{root.rstrip('/')}/_incoming/{uuid.uuid4().hex}"
        return write_counted(rows, held, checksum=content_hash(schema.names, good), good=F.count_if(good), bad=F.count_if(~good)), held, rows

    if kind == "csv":
        try:
            return write(read_csv(spark, path, full, in_order=True, **options))
        except (PySparkException, Py4JJavaError) as e:  # a task's own error comes as it is
            if "CSV header" not in str(e):
                raise
    if kind == "json" and lines is None:
        done = write(read_json(spark, path, full, True))
        if done[0]["good"] and not done[0]["bad"]:
            return done
    return write(read_files(spark, path, kind, full, lines, **options))


def ingest_file(
    spark: SparkSession,
    path: str,
    root: str,
    key: str,
    kind: str | None = None,
    schema: StructType | None = None,
    lines: bool | None = None,
    on_bad: str = "fail",
    **options,
) -> Ingested:
    """Load one CSV or JSON dataset (a file or a folder of part files) into bronze.

    Records that do not fit the schema make the load fail, with the target as it was before, or go to
    a quarantine folder beside it with ``on_bad="quarantine"``; either way they are counted.
    """
    kind = (kind or path.rsplit(".", 1)[-1]).lower()
    target = layer_path(root, "bronze", parquet_key(key))
    try:
        if schema is None:
            found = read_files(spark, path, kind, None, lines, **options).schema
            schema = StructType([f for f in found.fields if f.name != CORRUPT])
        counted, held, rows = _landed(spark, path, root, kind, schema, lines, options)
        good = F.col(CORRUPT).isNull()
        if counted["bad"] and on_bad == "fail":
            raise IngestionError(f"{path}: {counted['bad']} malformed records")
        landed = spark.read.schema(rows.schema).parquet(held)
        landed.where(good).drop(CORRUPT).write.mode("overwrite").parquet(target)
        if counted["bad"]:
            landed.where(~good).select(CORRUPT).write.mode("overwrite").parquet(f"{target}.rejected")
    except PySparkException as e:
        raise IngestionError(f"{path}: {e}") from e
    return Ingested(
        target, counted["good"], stored_bytes(spark, target), str(counted["checksum"] or 0), describe_schema(schema), counted["bad"]
    )


def ingest_logged(
    spark: SparkSession, path: str, root: str, key: str, ledger_path: str, history_path: str, run_id, source: str, execution_date: str, **how
) -> Ingested:
    """``ingest_file`` between its ledger events; the schema of a good run goes into the history."""
    done = ledger.logged(spark, ledger_path, run_id, source, lambda: ingest_file(spark, path, root, key, **how))
    row = schema_change_row(spark, source, done.schema, execution_date, None)
    row.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")).write.mode("append").parquet(history_path)
    return done


def _without_bytes(spark: SparkSession, folder: str, kind: str, pattern: str) -> list[tuple[str, str]]:
    """(path, file type) of files of length 0, which Spark's readers skip; from the driver's listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0 and fnmatch.fnmatch(status.getPath().getName(), f"{pattern}.{kind}"):
            out.append((re.sub("^[a-z0-9]+:/*", "/", status.getPath().toString()), kind))
    return out


def ingest_batch(
    spark: SparkSession, folder: str, root: str, key: str, schema: StructType, pattern: str = "*", **options
) -> DataFrame:
    """Load a batch of CSV and JSON files into bronze; returns the outcome of each file.

    (file, file_type, row_count, bad_rows, content_hash, status, error): a file with records that do
    not fit, or without any content, fails and the batch goes on; a header without rows is a success.
    The rows of good files are written below ``key``, one partition for each file. Other types are skipped.
    """
    with_corrupt = StructType(list(schema.fields)).add(CORRUPT, "string")
    name = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:/*", "/")
    listed, parts = [], []
    for kind in sorted(READERS):
        some = f"{pattern}.{kind}"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", some).load(folder)
        files = files.select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("path"), F.lit(kind).alias("file_type"))
        heads = file_heads(spark, folder, some).select(F.regexp_replace("file", "^[a-z0-9]+:/*", "/").alias("path"), F.lit(True).alias("content"))
        empty = spark.createDataFrame(_without_bytes(spark, folder, kind, pattern), "path string, file_type string")
        listed.append(files.unionByName(empty).distinct().join(heads, "path", "left"))
        extra = [name.alias("path")]
        try:
            if kind == "csv":
                parts.append(read_csv(spark, folder, with_corrupt, some, extra, recursiveFileLookup="true", pathGlobFilter=some, **options))
            else:
                parts.append(read_json(spark, folder, with_corrupt, None, some, extra))
        except IngestionError:
            continue  # no JSON file with content
    held = f"{root.rstrip('/')}/_incoming/{uuid.uuid4().hex}"
    rows = _union(parts).withColumn(CORRUPT, F.col(CORRUPT))
    rows.write.parquet(held)
    rows = spark.read.schema(rows.schema).parquet(held)
    good = F.col(CORRUPT).isNull()
    counts = rows.groupBy("path").agg(
        F.count_if(good).alias("row_count"), F.count_if(~good).alias("bad_rows"),
        F.bit_xor(F.when(good, F.xxhash64(*[F.col(f"`{c}`") for c in schema.names]))).alias("content_hash"),
    )
    found = _union(listed).join(counts, "path", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("row_count", "bad_rows")})
    error = F.when(F.col("content").isNull(), "empty file").when(F.col("bad_rows") > 0, F.format_string("%d malformed records", "bad_rows"))
    manifest = found.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file"), "file_type", "row_count", "bad_rows", "content_hash",
        F.when(error.isNull(), "success").otherwise("failed").alias("status"), error.alias("error"),
    )
    kept = f"{root.rstrip('/')}/_manifests/{uuid.uuid4().hex}"
    manifest.write.parquet(kept)
    manifest = spark.read.schema(manifest.schema).parquet(kept)
    sound = manifest.where("status = 'success' AND row_count > 0").select("path", F.col("file").alias("source_file"))
    (
        rows.where(good).join(sound, "path").drop("path", CORRUPT).hint("rebalance", "source_file")
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("source_file")
        .parquet(layer_path(root, "bronze", key))
    )
    return manifest.drop("path").orderBy("file")


def landed_json_pages(spark: SparkSession, path: str, items: str, schema: StructType) -> DataFrame:
    """Rows of API responses that already landed as JSON pages, one response per line."""
    pages = spark.read.schema(schema).json(path)
    return pages.select(F.explode(items).alias("item")).select("item.*")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """md5 and sha256 per part file. Each file is one row; split writes keep them small."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith("_")).select(
        name.alias("file"),
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.col("length").alias("size_bytes"),
        F.md5("content").alias("md5"),
        F.sha2("content", 256).alias("sha256"),
    )


def dataset_size(spark: SparkSession, path: str) -> DataFrame:
    data = list_objects(spark, path).where(F.col("object_key").endswith(".parquet"))
    return data.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))
