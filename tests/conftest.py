import sys
import uuid
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT.parent))
sys.path.insert(0, str(ROOT))

from tallymill.session import build_session  # noqa: E402
from tallymill.sources.scratch import release  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", shuffle_partitions=8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def free_scratch(spark):
    yield
    release(spark)


@pytest.fixture
def path(tmp_path):
    """A new path below the test's temporary folder, on each call."""
    return lambda name="out": f"{tmp_path}/{name}-{uuid.uuid4().hex}"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return f"{DATA}/sf0.01"
