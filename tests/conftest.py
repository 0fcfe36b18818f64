import pytest

from factloom.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session
