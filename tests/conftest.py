import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", folder).config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    """A value that Spark and DuckDB have alike."""
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5)
    return v.item() if hasattr(v, "item") else v


def same_rows(spark_df, duck_rows, duck_names):
    names = sorted(spark_df.columns)
    assert names == sorted(duck_names)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in spark_df.collect()), key=repr)
    at = [duck_names.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in duck_rows), key=repr)
    assert mine == theirs
