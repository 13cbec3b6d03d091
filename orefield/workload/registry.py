"""Registration of queries with their oracle SQL."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from orefield.workload.oracle_tables import CTES
from orefield.workload.tables import Lake

MODULES = ["models", "ingest", "quality", "monitor", "alerts", "governance", "dashboards", "streams"]


@dataclass(frozen=True)
class Entry:
    key: str
    build: Callable[[Lake], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # Dates and hours are taken in UTC whatever the machine's zone.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # Opened anew each time: files that came since the last call are seen.
        return self.build(Lake(spark, sf_dir))


ENTRIES: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(lake) -> DataFrame`` under ``key``; ``sql`` may use the names in CTES."""

    def register(fn):
        if key in ENTRIES:
            raise ValueError(f"{key} registered twice")
        ENTRIES[key] = Entry(key, fn, with_tables(sql) if sql else None)
        return fn

    return register


def with_tables(sql: str) -> str:
    """Put the definitions the statement needs in front of it, in order."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in CTES.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                todo.append(body)
    if not wanted:
        return sql.strip()
    parts = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in CTES if name in wanted)
    recursive = "RECURSIVE " if re.match(r"\s*WITH RECURSIVE\b", sql) else ""
    sql = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", sql) if re.match(r"\s*WITH\b", sql) else sql
    return f"WITH {recursive}{parts}\n{sql.strip()}"


def all_entries() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"orefield.workload.{module}")
    return dict(ENTRIES)
