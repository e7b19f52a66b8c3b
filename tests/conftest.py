import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from curvelab.session import build  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build(app="curvelab-tests", partitions=4, shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
