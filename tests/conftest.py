import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docloom.session import build_session, drop_work  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", cpus=4, driver_memory="4g", **{"spark.checkpoint.dir": shared})
    yield session
    drop_work(session)
    session.stop()
