import sys
import tempfile
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from fleetlark.session import local_session  # noqa: E402
from fleetlark.sources import tables  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "fleetlark-tests")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def fences(spark):
    return tables.site_fences(spark).cache()


@pytest.fixture(scope="session")
def readings(spark):
    return tables.readings(spark, SF).cache()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
