import pytest

from pokerlake.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("shared")
    session = local_session(8, partitions=4, app="tests", settings={"spark.checkpoint.dir": str(home)})
    yield session
    session.stop()
