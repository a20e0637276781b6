from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def table(found) -> list[tuple]:
    """Rows of a DataFrame or of a DuckDB relation as sorted tuples by column name, numbers to six digits."""
    rows, names = (found.collect(), found.columns) if hasattr(found, "collect") else (found.fetchall(), found.columns)
    columns = sorted(names)
    at = [list(names).index(c) for c in columns]

    def plain(v):
        if v is None or isinstance(v, (bool, str, int)):
            return v
        v = float(v)
        return None if v != v else float(f"{v:.6g}")

    order = lambda row: ["" if v is None else v if isinstance(v, str) else f"{float(v):.17g}" for v in row]
    return [tuple(columns), *sorted((tuple(plain(row[k]) for k in at) for row in rows), key=order)]
