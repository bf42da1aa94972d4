import pytest

from docloom.session import build_session, ship


@pytest.fixture(scope="session")
def spark():
    session = build_session("docloom-tests", cores=4, **{"spark.sql.shuffle.partitions": "4"})
    return ship(session)
