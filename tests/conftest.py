import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from linderos.session import local_session

    folder = str(tmp_path_factory.mktemp("checkpoint"))
    session = local_session("8", **{"spark.checkpoint.dir": folder})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    import __spark_entry__ as driver

    return driver.tables(spark, SMALL)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from linderos.sources.sample import SAMPLE_INPUTS

    con = duckdb.connect()
    for name in SAMPLE_INPUTS:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def bag(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
