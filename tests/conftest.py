import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").appName("tests").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    return str(DATA / "sf0.001")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_small):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return con


def rows_of(frame):
    """A pandas frame as sorted tuples, columns by name, numbers alike whatever their type."""
    import numpy as np
    import pandas as pd

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        return repr(float(v) + 0.0) if isinstance(v, (int, float, np.number, np.bool_)) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=str)
