"""Partial results of a stream as runs: bounded work for each batch, however many came before.

Every batch adds one run of partial rows. Runs are merged in levels: ``fan`` runs of a level become one
run of the next, so a read meets at most ``fan`` runs of each of logarithmically many levels. With a
``Closing`` the store keeps the event-time watermark of the stream: rows that no timely row can change
any more move from the open to the closed runs, so that what batches touch stays as large as what is
open. Late rows go straight to the closed runs and correct them when they are read.

A manifest for each batch names its runs. It appears by one rename, after all its data; a batch that is
delivered again finds its manifest and changes nothing, one that failed half way starts from the
manifest before it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orefield.sources.layers import path_exists

FAN = 4


@dataclass(frozen=True)
class Closing:
    """When partial rows are final.

    ``event`` is the time of a row's latest event, ``delay`` how far behind the latest event so far the
    watermark stays; ``late`` and ``closed`` take the watermark (timestamp without zone) and tell which new
    rows come too late for the open runs and which open rows are final.
    """

    event: Column
    delay: timedelta
    late: Callable[[Column], Column]
    closed: Callable[[Column], Column]


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[str]:
    if not path_exists(spark, folder):
        return []
    fs, place = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(place))


class RunStore:
    """``merge`` puts partial rows of the same keys together; it may be applied in any order and again."""

    def __init__(self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame], fan: int = FAN, closing: Closing | None = None):
        self.spark, self.root, self.merge, self.fan, self.closing = spark, root.rstrip("/"), merge, fan, closing

    # -- manifests

    def _batches(self) -> list[int]:
        found = (re.fullmatch(r"(\d+)\.json", x) for x in _names(self.spark, f"{self.root}/manifests"))
        return sorted(int(m[1]) for m in found if m)

    def manifest(self, batch_id: int | None = None) -> dict:
        """The manifest of a batch, or of the last one; an empty one where there is none."""
        batches = self._batches()
        batch_id = (batches[-1] if batches else None) if batch_id is None else batch_id
        if batch_id not in batches:
            return {"batch": None, "schema": None, "watermark": None, "late_rows": 0, "runs": [], "own": []}
        fs, place = _fs(self.spark, f"{self.root}/manifests/{batch_id:012d}.json")
        stream = fs.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs, target = _fs(self.spark, f"{self.root}/manifests/{manifest['batch']:012d}.json")
        _, made = _fs(self.spark, f"{self.root}/manifests/_{uuid.uuid4().hex}")
        stream = fs.create(made, True)
        stream.write(bytearray(json.dumps(manifest), "utf-8"))
        stream.close()
        if not fs.rename(made, target) and not fs.exists(target):
            raise OSError(f"no manifest could be put at {target}")

    # -- runs

    def _place(self, batch_id: int) -> str:
        return f"{self.root}/runs/{batch_id:012d}-{uuid.uuid4().hex}"

    def _rows(self, runs: list[dict], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(r["path"] for r in runs))

    def read(self, which: str | None = None, manifest: dict | None = None) -> DataFrame | None:
        """All rows, merged; or those of the ``open`` or ``closed`` runs. None before the first batch."""
        found = manifest or self.manifest()
        if found["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(found["schema"]))
        runs = [r for r in found["runs"] if which in (None, r["kind"])]
        return self.merge(self._rows(runs, schema)) if runs else self.spark.createDataFrame([], schema)

    def add(self, batch_id: int, parts: DataFrame) -> dict:
        """Keep a batch's partial rows; the manifest that is in force now.

        Batches are numbered in order: a number up to the last one kept is a batch delivered again.
        """
        last = self.manifest()
        if last["batch"] is not None and batch_id <= last["batch"]:
            return last
        schema, runs, place, seen = parts.schema, list(last["runs"]), self._place(batch_id), Observation()
        mark = F.lit(last["watermark"]).cast("timestamp_ntz")
        late = F.lit(False) if self.closing is None else F.coalesce(self.closing.late(mark), F.lit(False))
        event = F.lit(None).cast("timestamp_ntz") if self.closing is None else self.closing.event.cast("timestamp_ntz")
        marked = parts.withColumn("_closed", late)
        marked = marked.observe(seen, F.count("*").alias("rows"), F.count_if("_closed").alias("late"), F.max(event).alias("event"))
        marked.write.partitionBy("_closed").parquet(place)
        found = seen.get
        runs += [{"kind": k, "level": 0, "path": f"{place}/_closed={v}"} for k, v, n in (
            ("open", "false", found["rows"] - found["late"]), ("closed", "true", found["late"])) if n]
        watermark = last["watermark"]
        if found["event"] is not None:
            watermark = max(filter(None, [watermark, str(found["event"] - self.closing.delay)]), key=datetime.fromisoformat)
        manifest = {
            "batch": batch_id, "schema": schema.json(), "watermark": watermark, "late_rows": last["late_rows"] + found["late"], "runs": runs,
            "own": [place],
        }
        if self.closing is not None:
            manifest["runs"] = self._close(batch_id, runs, schema, watermark)
        manifest["runs"] = self._levelled(batch_id, manifest["runs"], schema)
        self._publish(manifest)
        return manifest

    def own(self, batch_id: int) -> DataFrame | None:
        """The partial rows that the batch itself brought, as long as its manifest is kept."""
        manifest = self.manifest(batch_id)
        if manifest["schema"] is None:
            return None
        return self._rows([{"path": x} for x in manifest["own"]], StructType.fromJson(json.loads(manifest["schema"])))

    def _close(self, batch_id: int, runs: list[dict], schema: StructType, watermark: str | None) -> list[dict]:
        """Once ``fan`` open runs have come together, the open rows as one run and the final ones as another."""
        mine = [r for r in runs if r["kind"] == "open"]
        if len(mine) < self.fan or watermark is None:
            return runs
        place, seen = self._place(batch_id), Observation()
        done = F.coalesce(self.closing.closed(F.lit(watermark).cast("timestamp_ntz")), F.lit(False))
        rows = self.merge(self._rows(mine, schema)).select(*schema.names).withColumn("_closed", done)
        rows.observe(seen, F.count("*").alias("rows"), F.count_if("_closed").alias("closed")).write.partitionBy("_closed").parquet(place)
        n = seen.get
        new = [("open", "false", n["rows"] - n["closed"]), ("closed", "true", n["closed"])]
        return [r for r in runs if r["kind"] != "open"] + [{"kind": k, "level": 0, "path": f"{place}/_closed={v}"} for k, v, m in new if m]

    def _levelled(self, batch_id: int, runs: list[dict], schema: StructType) -> list[dict]:
        kinds = ["closed"] if self.closing is not None else ["open"]
        for kind in kinds:
            level = 0
            while any(r["kind"] == kind and r["level"] >= level for r in runs):
                full = [r for r in runs if r["kind"] == kind and r["level"] == level]
                if len(full) >= self.fan:
                    place = self._place(batch_id)
                    self.merge(self._rows(full, schema)).select(*schema.names).write.parquet(place)
                    runs = [r for r in runs if r not in full] + [{"kind": kind, "level": level + 1, "path": place}]
                level += 1
        return runs

    def expire(self, keep: int = 2) -> int:
        """Remove manifests before the last ``keep`` and the runs that none of these names; how many runs went.

        Streams deliver at most their last batch again, so two manifests are enough to start from.
        """
        batches = self._batches()
        kept = [self.manifest(x) for x in batches[-keep:]]
        if not kept:
            return 0
        # Both a run's folder and, of a run in two parts, the folder above it.
        paths = [p for m in kept for p in (*m["own"], *(r["path"] for r in m["runs"]))]
        used = {x.removeprefix(f"{self.root}/runs/").split("/")[0] for x in paths}
        gone = [x for x in _names(self.spark, f"{self.root}/runs") if x not in used and int(x.split("-")[0]) <= kept[-1]["batch"]]
        for path in [f"{self.root}/manifests/{x:012d}.json" for x in batches[:-keep]] + [f"{self.root}/runs/{x}" for x in gone]:
            fs, place = _fs(self.spark, path)
            fs.delete(place, True)
        return len(gone)
