import os

import pytest
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over one of the driver's folders; both must agree."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from '{path}'")

    def rows(found, columns):
        at = [columns.index(c) for c in sorted(columns)]
        return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else repr(r[i]) for i in at) for r in found)

    def run(query, sql):
        df = query(spark, SF_DIR)
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)

    return run
