import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


def same_rows(df, sql: str, folder: str) -> None:
    """Compares a DataFrame with what DuckDB gives for the SQL over the folder's tables, in any order."""
    from collections import Counter

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    con.execute(sql)
    names = [d[0] for d in con.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)

    def norm(v):
        return round(v, 6) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v

    mine = Counter(repr([norm(r[c]) for c in cols]) for r in df.select(*cols).collect())
    theirs = Counter(repr([norm(dict(zip(names, r))[c]) for c in cols]) for r in con.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
