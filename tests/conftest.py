import pytest

from kelpwright.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4, **{"spark.sql.autoBroadcastJoinThreshold": "256k"})
