import pytest

from lattica.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("checkpoint"))})
    yield session
    session.stop()
