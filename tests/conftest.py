import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tidemark.config import SPARK_CONF

    conf = {**SPARK_CONF, "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"}
    s = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(a, b, ordered: bool = False) -> None:
    """Both pandas frames hold the same rows, in the same order if asked for."""
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    x, y = ([tuple(map(_plain, r)) for r in f[columns].itertuples(index=False)] for f in (a, b))
    assert x == y if ordered else sorted(x) == sorted(y)


def _plain(v) -> str:
    """Frames show integers beside nulls as floats."""
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
