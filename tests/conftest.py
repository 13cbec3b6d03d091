import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))
sys.path.insert(0, str(ROOT / "tests"))

from orefield.session import build_session, new_workspace  # noqa: E402
from orefield.workload.tables import Lake  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    shared = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="orefield-tests-")}
    session = build_session("tests", master="local[4]", shuffle_partitions=4, **shared)
    session.sparkContext.setLogLevel("OFF")
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return session


@pytest.fixture(scope="session")
def lake(spark):
    return Lake(spark, SMALL)


@pytest.fixture
def folder(spark):
    return new_workspace(spark, "test")


@pytest.fixture
def ts(spark):
    """Rows with text timestamps -> DataFrame with timestamp_ntz columns."""

    def make(rows, schema, *columns):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})

    return make
