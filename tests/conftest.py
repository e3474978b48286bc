import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ticketloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    return local_session("8", shuffle_partitions=4, app="tests",
                         **{"spark.checkpoint.dir": shared})


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"
