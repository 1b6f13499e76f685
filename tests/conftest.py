import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpuslens.session import build_session

    session = build_session("tests", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    from corpuslens.schemas import FILES

    def make(*rows):
        """rows of (repo, path, content)"""
        full = [(r, p, len(c.encode()), False, c, True) for r, p, c in rows]
        return spark.createDataFrame(full, FILES).repartition(4, "path")

    return make
