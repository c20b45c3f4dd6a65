import os

import pytest

from rowloom.session import build_session

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": str(shared), "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


def rows(df):
    return sorted(tuple(r) for r in df.collect())
