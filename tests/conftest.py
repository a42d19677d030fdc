"""One session for all tests, and a DuckDB connection over the smallest tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.fixture
def same_rows():
    """Assert that two pandas frames hold the same rows in any order, doubles to nine digits."""

    def plain(x):
        if x is None or x != x:
            return "~"
        if isinstance(x, float):
            return f"{x:.9g}"
        text = str(x)
        return text.removesuffix(" 00:00:00")

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        columns = sorted(a.columns)
        rows = [sorted(tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)) for df in (a, b)]
        assert [tuple(x.replace(".0", "") for x in r) for r in rows[0]] == [tuple(x.replace(".0", "") for x in r) for r in rows[1]]

    return check
