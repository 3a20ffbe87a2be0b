import os
import tempfile

import pytest

from ledgerlake.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, 4, app="llm-tests", driver_memory="4g", extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="llm-test-", dir="/tmp")})
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF if os.path.isdir(SF) else pytest.skip("no test tables")


def docs_frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()
