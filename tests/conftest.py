import pytest

from assayer.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
