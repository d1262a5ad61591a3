import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def compare_with_duckdb(spark, name, sf="sf0.001"):
    """Rows of a registered query and of its SQL on the same tables, as sorted lists of strings."""
    import duckdb
    import pandas

    import __spark_entry__ as e

    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")

    def plain(v):
        if v is None or v is pandas.NA:
            return "nan"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.9g}"
        return str(v)

    def rows(frame):
        return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))

    got, want = e.queries()[name](spark, folder).toPandas(), con.execute(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got.where(got.notna(), None)), rows(want.where(want.notna(), None))
