from __future__ import annotations

import os

import pytest

from plumbline.runtime import local_session

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
